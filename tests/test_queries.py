"""Queries against their SQL in DuckDB, on a few rows of our own in the shape of the general tables."""

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyrock import oracles, queries, samples
from tallyrock.operators import checks


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    at = tmp_path_factory.mktemp("tables")
    t0 = datetime.datetime(2024, 1, 1)
    words = lambda n: " ".join(rng.choice(["Ana", "are", "mere", "și", "pere", "coapte.", "ROU", "ză"]) for _ in range(n))
    tables = {
        "documents": ([(i, words(rng.randint(1, 60)) + f" {i % 90}", rng.choice(["en", "de"]), f"src{rng.randrange(5)}", 1) for i in range(400)], "doc_id long, text string, lang string, source string, n_chars long"),
        "supplier": ([(i, f"Supplier#{i:09d}", 1, 1.0) for i in range(110)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "pages": ([(i, f"http{'s' * (i % 2)}://www.h{i % 4}.ro/{i}" if i % 9 else "broken", f"<title> Pagina  {i % 7} &amp; Co</title>") for i in range(60)], "page_id long, url string, html string"),
        "conversations": ([(i, 0, rng.choice(["user", "assistant"]), rng.choice(["0722 123 456", "a@b.ro", "1900101123456", "nimic"])) for i in range(60)], "conv_id long, turn long, role string, text string"),
        "customer": ([(i, f"C{i}", 1, 1.0, rng.choice(["BUILDING", "OTHER"])) for i in range(80)], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "orders": ([(i, rng.randrange(80), rng.choice("FOP"), 3000.0 * i, datetime.datetime(2001, 5, 1) + datetime.timedelta(days=i), "x") for i in range(100)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": ([(i % 100, rng.choice("ANR"), i % 4, datetime.datetime(2001, 5, 1) + datetime.timedelta(days=rng.randrange(160))) for i in range(300)], "l_orderkey long, l_returnflag string, l_linenumber int, l_shipdate timestamp"),
        "part": ([(i, f"green part {i % 5}", f"LARGE BOX {i % 3}") for i in range(40)], "p_partkey long, p_name string, p_type string"),
        "events": ([(i, t0 + datetime.timedelta(hours=i * 2), rng.randrange(40), rng.choice(["click", "view", "error"]), 1.0, f'{{"k": {i % 11}}}') for i in range(360)], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}.parquet")
    return str(at), list(tables)


def values(rows, names):
    def one(v):
        if v is None:
            return ""
        if isinstance(v, float):
            return f"{v:.6g}"
        return v.isoformat()[:19].replace("T00:00:00", "") if hasattr(v, "isoformat") else str(v)

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, folder, name):
    at, tables = folder
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, at)
    assert sorted(got.columns) == sorted(names)
    found, wanted = values(map(tuple, got.collect()), got.columns), values(want.fetchall(), names)
    assert found == wanted
    assert wanted


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_words_in_sql(spark):
    """Each branch of the rules with words, both ways, in Spark and in SQL."""
    more = ("Dansatoare si ANIMATOARE", "non adult industry", "xxx", "NON\u00a0ADULT xxx", "strip\u00a0club", "escortă", "hostess mascota masaj", "dansatoare Passion Club", "conținut pentru adulţi", "")
    titles = [(t,) for t in (*samples.ADULT_TITLES, *samples.MOJIBAKE_TITLES, *more)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (title VARCHAR, company VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, '')", titles)
    wanted = con.execute(f"SELECT title, {oracles.RULES['title_adult']}, {oracles.RULES['text_mojibake']} FROM t").fetchall()
    found = spark.createDataFrame(titles, "title string").select("title", checks.looks_adult(F.col("title")), F.col("title").rlike(checks.MOJIBAKE)).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert {a for _, a, _ in wanted} == {m for _, _, m in wanted} == {True, False}
