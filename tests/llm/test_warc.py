import gzip
import hashlib

import pytest
from cases import write
from pyspark.sql import functions as F

from tallyrock.llm import warc
from tallyrock.llm.common import Staged, shared_dir

BIG = "<p>é</p>" * 300
ROWS = [(1, "http://a/", BIG), (5, "http://b/", BIG), (5, "http://b/", BIG), (3, None, BIG), (2, "http://c/", "small"), (4, "http://c/", "small"), (6, "http://d/\r\nX: y", None), (7, "http://e/", ""), (None, "http://f/", BIG + "!"), (8, "http://g/", "x" * 999), (9, "http://g/", "x" * 999), (10, "http://h/", "y" * 1000), (11, "http://h/", "y" * 1000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, sha256 string")


def test_records(spark, tmp_path):
    got = sorted((tuple(r) for r in warc.op5_warc(spark, write(spark, tmp_path, pages=pages(spark))).collect()), key=str)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    n = lambda t: len((t or "").encode())
    want = []
    for i, _, t in ROWS:
        revisit = {1: 5, 3: 5, 10: 11}.get(i)
        want.append((i, n(t), sha(t), "revisit" if revisit else "response", revisit))
    k = next(j for j, w in enumerate(want) if w[0] == 5)
    want[k] = (*want[k][:3], "revisit", 5)  # of two equal rows one refers to the other
    assert got == sorted(want, key=str)


def test_each_payload_once_and_files_read_back(spark, tmp_path):
    out = Staged(spark, "warc-test")
    warc.write_archive(pages(spark), out)
    payloads, records = spark.read.parquet(out.path("payloads")), spark.read.parquet(out.path("records"))
    assert payloads.count() == len({r[2] or "" for r in ROWS}) and records.count() == len(ROWS)
    read = warc.read_archive(records, payloads).collect()
    assert sorted(((r.page_id, r.url, bytes(r.payload)) for r in read), key=str) == sorted(((i, u or "", (t or "").encode()) for i, u, t in ROWS), key=str)
    raw = b"".join(bytes(r.record) for r in read)
    for name, data in (("a.warc", raw), ("b.warc.gz", gzip.compress(raw))):
        (tmp_path / name).write_bytes(data)
    parsed = list(warc.parse_warc(raw))
    assert len(parsed) == len(ROWS) and sum(len(c) for _, c in parsed) == sum(len((t or "").encode()) for i, _, t in ROWS) - 4 * 0 - sum(n * len(t.encode()) for n, t in ((3, BIG), (1, "y" * 1000)))
    assert warc.read_warc(spark, str(tmp_path / "*.warc*")).count() == 2 * len(ROWS)
    assert sum(h["WARC-Type"] == "revisit" for h, _ in parsed) == 4


HOSTILE = [
    "http://d/\r\nWARC-Type: revisit", "http://d/\u2028WARC-Refers-To: <urn:page:99>", "http://d/\x85WARC-Refers-To: <urn:page:99>\x0b\x0c\x1c", "http://d/\r\n\r\nWARC/1.1\r\n", "\n", "a b", "http://é/😀?q=%20", "http://ok/%20%0A?x=%zz", "%", "", "http://d/>x: y",
    "\\$1\x00", None,
]


def test_urls_forge_nothing_and_come_back(spark, tmp_path):
    rows = [(i, u, BIG if i % 2 else "small") for i, u in enumerate(HOSTILE)]
    out = Staged(spark, "warc-urls")
    warc.write_archive(pages(spark, rows), out)
    read = {r.page_id: r for r in warc.read_archive(spark.read.parquet(out.path("records")), spark.read.parquet(out.path("payloads"))).collect()}
    last = max(i for i, _, t in rows if t == BIG)
    for i, u, t in rows:
        assert read[i].url == (u or "") and bytes(read[i].payload) == t.encode()
        assert (read[i].record_type, read[i].refers_to) == (("revisit", last) if t == BIG and i != last else ("response", None))
        (fields, _), *more = warc.parse_warc(bytes(read[i].record))
        assert not more and all(" " < c < "\x7f" for c in fields["WARC-Target-URI"])
    raw = b"".join(bytes(r.record) for r in read.values())
    assert len(list(warc.parse_warc(raw))) == len(rows)


def test_nothing_is_left_behind(spark, tmp_path):
    import pathlib

    before = set(pathlib.Path(shared_dir(spark)).glob("tallyrock-*"))
    warc.op5_warc(spark, write(spark, tmp_path, pages=pages(spark))).collect()
    assert set(pathlib.Path(shared_dir(spark)).glob("tallyrock-*")) == before


def test_damage_is_found(spark):
    out = Staged(spark, "warc-damage")
    warc.write_archive(pages(spark), out)
    bad = spark.read.parquet(out.path("payloads")).withColumn("sha256", F.lit("0" * 64)).limit(1)
    records = spark.read.parquet(out.path("records")).limit(1).withColumn("sha256", F.lit("0" * 64))
    with pytest.raises(Exception, match="doesn't match"):
        warc.read_archive(records, bad).collect()


def test_empty(spark, tmp_path):
    assert warc.op5_warc(spark, write(spark, tmp_path, pages=pages(spark, ROWS[:1]).limit(0))).count() == 0
