"""Listings, companies, state and link responses derived from general tables, in SQL that Spark and other engines share.

Listings are made of documents by arithmetic on their ids, so that every rule has rows that break it; companies of suppliers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import enrich, places, probe
from .operators import state as marks
from .plans import analysis
from .sources import store

NOW, TODAY = "2024-02-01T00:00:00Z", "2024-02-01"


def fiscal_id(k: str) -> str:
    """SQL for an eight-digit fiscal id with a right checksum, different for each value of k."""
    body = f"CAST(1000000 + ({k}) * 37 AS STRING)"
    total = " + ".join(f"{w} * CAST(substr({body}, {i}, 1) AS INT)" for i, w in enumerate((3, 2, 1, 7, 5, 3, 2), 1))
    return f"{body} || CAST((({total}) * 10) % 11 % 10 AS STRING)"


COMPANY = "doc_id % 97"
#: Places as listings write them, of every kind that resolution tells apart.
RAW_PLACES = (
    "Valdoria", "VALDORIA, Romania", "Str. Lunga nr. 4, Monteluna", "comuna Pietralunga", "undeva langa Monteluna in sat", "Lunca", "Lunca, Brezan", "Sector 3, București", "Bukarest", "407123", "407124", "Pietralungacentru", "Monteluma",
    "Valdxxia", "maresta", "Bologna", "kenya", "remote", "Romania, all", "", "AB-1234-XY", "Fagetel, Dorna", "Fagetol, Dorna", "Sf. Andrei", "Arbor", "Valdoria", "Monteluna",
)
#: An invented gazetteer: a name in two counties, a postal code of two places, two names that differ in one letter, and a county that only localities name.
INDEX = (
    ("valdoria", "Valdoria", "Arbor", "seat"), ("monteluna", "Monteluna", "Brezan", "seat"), ("pietralunga", "Pietralunga", "Brezan", "town"), ("sfantuandrei", "Sfântu Andrei", "Cornet", "town"), ("lunca", "Lunca", None, "village"),
    ("bucuresti", "București", "București", "seat"), ("marenta", "Marenta", "Arbor", "village"), ("marelta", "Marelta", "Brezan", "village"),
)
LOCALITIES = (
    ("Valdoria", "Arbor", 1, "seat", None, None), ("Pietralunga", "Brezan", 4, "town", None, None), ("Lunca", "Arbor", 22, "village", None, None), ("Lunca", "Brezan", 22, "village", None, None), ("Poiana Alba", "Cornet", 22, "village", "407123", ("Comuna Alba", 5)),
    ("Fagetel", "Dorna", 22, "village", "407124", None), ("Stejaris", "Dorna", 22, "village", "407124", None),
)
COUNTIES = ("Arbor", "Brezan", "Cornet")
PLACE = "CASE doc_id % 27 " + " ".join(f"WHEN {k} THEN '{raw}'" for k, raw in enumerate(RAW_PLACES)) + " END"
#: Titles on both sides of each branch of two rules: strong, weak, general, negated, club and children's words; wrongly decoded letters, and right ones.
ADULT_TITLES = ("hostess masaj ", "model Video  Chat ", "masaj erotic ", "editor filme pentru adulți ", "non-adult content ", "hostess night club ", "hostess receptie ", "hostess masaj copii ", "videochatul ", "masaj de relaxare ")
MOJIBAKE_TITLES = ("Junior â€“ ", "CafenÃ© bucÄƒtar ", "È™ofer ", "secÅ£ie ", "Â«montaj ", "Ãrea Åsa Âme ")
ADULT = f"CASE doc_id % {len(ADULT_TITLES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(ADULT_TITLES)) + " END"
MOJIBAKE = f"CASE doc_id % {len(MOJIBAKE_TITLES)} " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(MOJIBAKE_TITLES)) + " END"
LISTINGS = f"""
SELECT doc_id,
  CASE WHEN doc_id % 53 = 0 THEN 'ftp://' || source || '.example.ro/' || CAST(doc_id AS STRING) WHEN doc_id % 47 = 0 THEN '/job/' || CAST(doc_id AS STRING)
    ELSE 'https://www.' || source || '.example.ro/job/' || CAST(doc_id AS STRING) END AS url,
  CASE WHEN doc_id % 61 = 0 THEN '' WHEN doc_id % 59 = 0 THEN '12 x' WHEN doc_id % 71 = 0 THEN 'call 0722 123 ' || CAST(100 + doc_id % 900 AS STRING) WHEN doc_id % 73 = 0 THEN {ADULT} || CAST(doc_id AS STRING)
    WHEN doc_id % 79 = 0 THEN {MOJIBAKE} || CAST(doc_id AS STRING) WHEN doc_id % 83 = 0 THEN '① job nou ' || CAST(doc_id AS STRING) WHEN doc_id % 89 = 0 THEN 'Водитель ' || CAST(doc_id AS STRING)
    WHEN doc_id % 97 = 0 THEN 'Asistent Rаdiologie si imagistica' WHEN doc_id % 23 = 0 THEN ' ' || substr(text, 1, 30) WHEN doc_id % 19 = 0 THEN substr(text, 1, 20) || ' &amp; co'
    WHEN doc_id % 13 = 0 AND lang = 'en' THEN upper(substr(text, 1, 24)) WHEN doc_id % 11 = 0 THEN substr(text, 1, 260) ELSE substr(split_part(text, '.', 1), 1, 12) END AS title,
  CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 5 = 0 THEN 'Supplier#' || lpad(CAST({COMPANY} AS STRING), 9, '0') WHEN doc_id % 103 = 0 THEN 'A&quot;B SRL' ELSE 'SUPPLIER#' || lpad(CAST({COMPANY} AS STRING), 9, '0') END AS company,
  CASE WHEN doc_id % 37 = 0 THEN '' WHEN doc_id % 41 = 0 THEN 'RO' || {fiscal_id(COMPANY)} WHEN doc_id % 43 = 0 THEN '12345' WHEN doc_id % 51 = 0 THEN CAST(10000001 + doc_id AS STRING) ELSE {fiscal_id(COMPANY)} END AS cif,
  {PLACE} AS place,
  CASE WHEN doc_id % 9 = 0 THEN '' WHEN doc_id % 7 = 0 THEN 'Sofer,transport' WHEN doc_id % 6 = 0 THEN 'șofer' WHEN doc_id % 101 = 0 THEN repeat('t,', 20) || 't' ELSE lang || ',' || source || ',' || lang END AS tag_list,
  CASE WHEN doc_id % 8 = 0 THEN '' WHEN doc_id % 8 = 1 THEN 'office' WHEN doc_id % 8 = 2 THEN 'remote' WHEN doc_id % 8 = 3 THEN 'hybrid' ELSE 'on-site' END AS workmode,
  CASE WHEN doc_id % 33 = 0 THEN '' WHEN doc_id % 34 = 0 THEN 'soon' WHEN doc_id % 35 = 0 THEN '2025-01-01T00:00:00Z'
    WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T08:00:00Z' ELSE '2023-' || lpad(CAST(9 + doc_id % 4 AS STRING), 2, '0') || '-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || 'T08:00:00Z' END AS date,
  CASE WHEN doc_id % 12 = 0 THEN '' WHEN doc_id % 12 = 1 THEN 'activ' WHEN doc_id % 12 < 5 THEN 'scraped' WHEN doc_id % 12 < 8 THEN 'tested' WHEN doc_id % 12 < 10 THEN 'verified' ELSE 'published' END AS status,
  CASE WHEN doc_id % 10 = 0 THEN '2023-12-01T00:00:00Z' ELSE '' END AS vdate,
  CASE WHEN doc_id % 20 = 0 THEN '2024-01-15T00:00:00Z' WHEN doc_id % 30 = 0 THEN '2023-12-20T00:00:00Z' ELSE '' END AS expirationdate,
  CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 3 = 0 THEN '3000 lei' ELSE '3000-4500 RON' END AS pay,
  CASE WHEN doc_id % 39 = 0 THEN 404 WHEN doc_id % 36 = 0 THEN 503 WHEN doc_id % 15 = 0 THEN 403 WHEN doc_id % 6 = 0 THEN 200 END AS link_code
FROM documents
"""
COMPANIES = f"""
SELECT {fiscal_id("s_suppkey")} AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'OTHER NAME' ELSE upper(s_name) END AS company,
  CASE WHEN s_suppkey % 10 = 0 THEN 'radiat' WHEN s_suppkey % 10 = 1 THEN 'unknown' WHEN s_suppkey % 10 = 2 THEN '' ELSE 'activ' END AS status, 'x.py' AS "scraperFile", '2024-01-31' AS "lastScraped"
FROM supplier
"""
#: Rows known from earlier runs were first seen on a day of January.
STATE_DAYS = 30


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The rows of a query over tables of a folder, without leaving views behind."""
    return spark.sql(_placed(sql, tables), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})


def _placed(sql: str, tables: tuple[str, ...]) -> str:
    """SQL with Spark's quotes, and tables as parameters."""
    sql = sql.replace('"', "`")
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return sql


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, LISTINGS, "documents")
    none = F.array().cast("array<string>")
    listed = lambda c, of: F.when(F.col(c) == "", none).otherwise(of)
    return rows.withColumns({
        "location": listed("place", F.array("place")), "tags": listed("tag_list", F.split("tag_list", ",")), "salary": listed("pay", F.array("pay")), "salary_is_array": F.lit(False),
    }).drop("place", "tag_list", "pay")


def state(rows: DataFrame) -> DataFrame:
    known = rows.filter("doc_id % 31 <> 0").select("url", F.expr(f"date_add(date'2024-01-02', cast(doc_id % {STATE_DAYS} as int))").alias("first_seen"), F.lit(None).cast("date").alias("missing_since"))
    left = rows.filter("doc_id % 50 = 7").select(F.concat(F.lit("https://gone.example.ro/"), F.col("doc_id").cast("string")).alias("url"), F.expr("date'2024-01-10'").alias("first_seen"), F.expr("if(doc_id % 100 = 7, date'2023-11-01', null)").alias("missing_since"))
    return known.unionByName(left)


def gazetteer(spark: SparkSession) -> places.Gazetteer:
    index = spark.createDataFrame(list(INDEX), "key string, name string, county string, type string")
    localities = spark.createDataFrame(list(LOCALITIES), "name string, county string, type int, type_label string, postal_code string, parent struct<name:string,type:int>")
    return places.build(index, localities, spark.createDataFrame([(c,) for c in COUNTIES], "name string"))


#: Where the rows of a session's analyses are stored, by application and folder of tables.
_STORED: dict[tuple[str, str], str] = {}


def analysed(spark: SparkSession, sf_dir: str) -> analysis.Result:
    """The analysis of the listings. As in a run, rows are stored once, and all that is counted reads them; Spark's own files go with the folder."""
    raw = listings(spark, sf_dir)
    before, companies = state(raw), view(spark, sf_dir, COMPANIES, "supplier")
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED or not store.exists(spark, _STORED[key]):
        responses = raw.filter("doc_id % 3 = 0").select("url", "link_code", F.lit("").alias("link_reason"))
        result = analysis.analyse(raw.drop("link_code"), companies, gazetteer(spark), before, NOW, responses=responses, persist=False)
        path = store.new_folder(spark, "analysed")
        result.rows.write.parquet(path)
        result.close()
        _STORED[key] = path
    rows = spark.read.parquet(_STORED[key])
    marked = marks.Marked(rows, before, spark.createDataFrame([], "fresh long"), marks.baseline_day(before))
    return analysis.Result(rows, enrich.companies(companies), marked, probe.per_host(rows), NOW, TODAY, [])
