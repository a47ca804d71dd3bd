"""Content-addressed WARC archive.

Each page becomes a WARC record. The archive is two tables: ``payloads`` holds each different payload once, compressed, under its SHA-256,
``records`` holds the exact header bytes of each record with the digest of its payload. Reading joins them, checks the stored
bytes against their address, puts the bytes of each record together (header, content and the closing line ends) and parses
them as a WARC file is parsed. Of records with equal payloads of at least ``REVISIT_FROM`` bytes, that with the largest id is
the response; the others are revisits, without content, that refer to it. Small payloads are always responses.

A url of printable ASCII characters stands in its header as it is. In any other, the characters that aren't and ``%`` are
percent-encoded as UTF-8 and a header field says so, so that no url can end its line and every one is read back exactly.

Null payloads are empty; a null url is an empty target; equal rows each get a record, of which the first is the response;
a null page_id sorts below all others; an empty table gives an empty archive; other columns are ignored.

A payload that a third of the pages share is stored by one of them: the winners come from a small aggregate by digest, so
payload bytes are never gathered by key, and the joins on reading are ones that Spark splits where a digest is frequent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Staged, checkpoint, free_shuffles, table

REVISIT_FROM = 1000
EXPANDED_BYTES = 4 << 20
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
#: What a url must not have to stand in a header as it is, and the field of those that have it.
UNSAFE, ESCAPED = r"[^\x21-\x7E]", "X-Target-URI-Escaped"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long"


def record_uri(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def safe_uri(url: Column) -> Column:
    """A url without characters that could end a line or a field; those that need it are escaped as a whole."""
    code = lambda c: F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")
    escaped = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"^[\x21-\x24\x26-\x7E]?\z"), c).otherwise(code(c))), "")
    return F.when(url.rlike(UNSAFE), escaped).otherwise(url)


def header(kind: Column, refers_to: Column) -> Column:
    """A record's exact header bytes, WARC and HTTP blocks, from page_id, url, sha1 and bytes."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_uri(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), safe_uri(F.coalesce("url", F.lit("")))), F.when(F.col("url").rlike(UNSAFE), f"{ESCAPED}: percent"), F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_uri(refers_to), F.lit(f"{CRLF}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: text/html"), F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(F.col("bytes").cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)), "UTF-8")


def compressed(df: DataFrame) -> DataFrame:
    """The last column, a payload, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([squeeze(x.as_py()) for x in batch.columns[-1]], pa.binary())], names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def write_archive(pages: DataFrame, out: Staged) -> None:
    """Stores pages (page_id, url, html) as the tables payloads and records."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select("page_id", "url", payload.alias("payload"))
    keyed = p.withColumn("sha256", F.sha2("payload", 256)).withColumn("sha1", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    rows = keyed.groupBy("page_id", "url", "sha256", "sha1", "bytes").agg(F.count(F.lit(1)).alias("copies"))
    # url only breaks ties between equal ids
    place = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    best = rows.groupBy("sha256").agg(F.max(place).alias("best"), F.max("page_id").alias("best_id")).withColumnRenamed("sha256", "_sha")
    rows = rows.join(best, F.col("sha256") == F.col("_sha")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    first = (place == F.col("best")) & (F.col("copy") == 1)
    kind = F.when((F.col("bytes") < REVISIT_FROM) | first, "response").otherwise("revisit")
    out.put(rows.select("sha256", header(kind, F.col("best_id")).alias("header")), "records")
    free_shuffles(pages.sparkSession)
    # dealt by digest and id, which the join and the removal of equal rows share: payloads move once
    owned = compressed(keyed.select("sha256", F.coalesce("page_id", F.lit(-(1 << 63))).alias("_id"), "payload"))
    held = owned.join(best.select(F.col("_sha").alias("sha256"), F.col("best.id").alias("_id")), ["sha256", "_id"], "left_semi")
    out.put(held.dropDuplicates(["sha256", "_id"]).select("sha256", "payload"), "payloads")
    free_shuffles(pages.sparkSession)


def parsed_page(value: str | None) -> int | None:
    """The id in a record's URI."""
    inside = value.removeprefix("<urn:page:").removesuffix(">") if value else ""
    return int(inside) if inside else None


def read_archive(records: DataFrame, payloads: DataFrame, contents: bool = True) -> DataFrame:
    """RECORD_SCHEMA, and with contents record and payload, of each record of an archive: the bytes of the original record, and its
    payload in full also for revisits. Fails on bytes that don't match their address or their record's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            for k, (address, head, stored) in enumerate(zip(*batch.columns, strict=True), 1):
                payload, head = expand(stored.as_py()), head.as_py()
                if hashlib.sha256(payload).hexdigest() != address.as_py():
                    raise ValueError("stored payload doesn't match its digest")
                revisit = head.startswith(b"WARC/1.1\r\nWARC-Type: revisit\r\n")
                record = b"".join((head, b"" if revisit else payload, b"\r\n\r\n"))
                (fields, content), *more = parse_warc(record)
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if more or content != (b"" if revisit else payload) or hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError("a record doesn't match its payload")
                uri = fields["WARC-Target-URI"]
                found = (parsed_page(fields["WARC-Record-ID"]), unquote(uri) if ESCAPED in fields else uri, fields["WARC-Type"], parsed_page(fields.get("WARC-Refers-To")), digest, len(payload))
                rows.append((*found, record, payload) if contents else found)
                size += len(payload)
                if size >= EXPANDED_BYTES or k == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, size = [], 0

    schema = RECORD_SCHEMA + (", record binary, payload binary" if contents else "")
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*((n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))), strict=True)
    return records.join(payloads, "sha256").select("sha256", "header", "payload").mapInArrow(run, schema)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content of the records in the bytes of a WARC file, which may be gzipped."""
    import gzip

    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split(CRLF)[1:])  # only a CRLF ends a line
        size = int(head["Content-Length"])
        yield head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, type, uri, payload) of the records in WARC files; a file is read whole by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list(parse_warc(content))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([h.get("WARC-Type") for h, _ in found], pa.string()), pa.array([h.get("WARC-Target-URI") for h, _ in found], pa.string()), pa.array([c for _, c in found], pa.binary())], names=["path", "type", "uri", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, type string, uri string, payload binary")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive goes when what was read back from it is written."""
    out = Staged(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), out)
    read = read_archive(spark.read.parquet(out.path("records")), spark.read.parquet(out.path("payloads")), contents=False)
    found = checkpoint(read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    out.drop()
    return found


ORACLE = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id DESC NULLS LAST, url DESC) AS nth, max(page_id) OVER (PARTITION BY html) AS best FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN n < 1000 OR nth = 1 THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN n >= 1000 AND nth > 1 THEN best END AS refers_to FROM r
"""
