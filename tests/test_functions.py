import pytest
from pyspark.sql import functions as F

from tallyrock.functions import keys as K
from tallyrock.functions import text as X


def values(spark, rows, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def fnv(text):
    h = 2166136261
    raw = text.encode("utf-16-be", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ (raw[i] << 8 | raw[i + 1])) * 16777619) & 0xFFFFFFFF
    return h


def test_fnv(spark):
    rows = ["", "a", "https://example.ro/job/1", "șî𝐎x"]
    assert values(spark, rows, K.fnv1a) == [fnv(t) for t in rows]
    assert fnv("https://example.ro/job/1") == 2320302225


def test_fiscal(spark):
    rows = ["24973770", "RO24973770", "24973771", "abc", "RO 08119423", "1", ""]
    assert values(spark, rows, K.fiscal_key) == ["24973770", "24973770", "24973771", "", "8119423", "1", ""]
    assert [bool(v) for v in values(spark, rows, K.fiscal_checksum_ok)][:4] == [True, True, False, False]
    assert values(spark, ["24973770", "24973770\n", "1234567"], K.fiscal_shape_ok) == [True, False, False]
    assert values(spark, [" ro1", "1ro"], K.fiscal_has_prefix) == [True, False]


def test_host(spark):
    rows = ["https://www.Example.RO/a?b", "http://a:b@x.ro:80/", "ftp://x", "", "nope", "HTTPS://WWW.WWW.X.ro", "https://ex ample.ro", "https://jösb.ro/1"]
    assert values(spark, rows, K.host_of) == ["example.ro", "x.ro", K.INVALID_HOST, K.INVALID_HOST, K.INVALID_HOST, "www.x.ro", K.INVALID_HOST, "jösb.ro"]


def test_age(spark):
    rows = ["2026-09-01T08:00:00Z", "2026-09-05T12:00:00Z", "2026-09-06T12:00:01Z", "", "ieri", "2026-09-04"]
    assert values(spark, rows, lambda c: K.age_days(c, "2026-09-05T12:00:00Z")) == [4, 0, -2, None, None, 1]


def test_freshness(spark):
    df = spark.createDataFrame([(a,) for a in (None, -3, 7, 8, 30, 31, 90, 91)], "age int")
    assert [r[0] for r in df.select(K.freshness("age")).collect()] == ["no date", "≤7", "≤7", "≤30", "≤30", "≤90", "≤90", ">90"]


def test_classes(spark):
    df = spark.createDataFrame([(n,) for n in (1, 2, 10, 11, 100, 101, 1000, 1001)], "n int")
    assert [r[0] for r in df.select(K.size_class("n")).collect()] == ["1", "2-10", "2-10", "11-100", "11-100", "101-1000", "101-1000", ">1000"]
    codes = spark.createDataFrame([(c,) for c in (None, 200, 301, 404, 410, 403, 500)], "c int")
    assert [r[0] for r in codes.select(K.link_state("c")).collect()] == ["unreachable", "ok", "ok", "dead", "dead", "error", "error"]


def test_titles(spark):
    rows = [" A&amp;B  Inginer ", "X&AMP;y", "", "Șofer\t B"]
    assert values(spark, rows, X.normal_title) == ["a&b inginer", "x&y", "", "șofer b"]
    assert values(spark, ["𝐎𝐩", "ab"], X.utf16_length) == [4, 2]
    assert values(spark, ["a" * 130, "𝐎" * 70, "șț"], lambda c: X.utf16_left(c, 120)) == ["a" * 120, "𝐎" * 60, "șț"]
    assert values(spark, [" x ", "﻿ y"], X.trimmed) == ["x", "y"]
    assert values(spark, ["Târgu-Mureș 2", "Ţara Şi"], X.fold_key) == ["targumures2", "tarasi"]


def test_alphabets(spark):
    rows = ["abc", "абв", "ab", "Rаdiologie", "𝐎𝐩𝐞𝐫"]
    share = values(spark, rows, lambda c: X.latin_share(X.nfkc(c)))
    assert share == [1.0, 0.0, 1.0, pytest.approx(0.9), 1.0]
    assert values(spark, ["a1 b", "𝐎2"], lambda c: X.letters_only(X.nfkc(c))) == ["ab", "O"]
