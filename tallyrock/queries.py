"""Every operator as a query over the general tables, and its SQL for an independent engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles as O
from . import samples as D
from .functions import keys as K
from .functions import text as X
from .operators import checks as C
from .operators import dedupe, filters, places, probe, stats
from .operators import state as S
from .plans import trend
from .sources import readers, store

_DAY = "2024-01-15"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.analysed(spark, sf_dir).rows


# --- rules ----------------------------------------------------------------------------------------------------------------


@query(O.WITH + "SELECT url, host, cif_key, age, ntitle, dup_index, found AS in_catalog FROM l")
def enriched(spark, sf_dir):
    return rows_of(spark, sf_dir).select("url", "host", "cif_key", "age", "ntitle", "dup_index", F.col("co").isNotNull().alias("in_catalog"))


@query(O.WITH + "SELECT l.url, coalesce(string_agg(i.check_id, ',' ORDER BY m.ordinal), '') AS issues FROM l LEFT JOIN issues i USING (doc_id) LEFT JOIN meta m ON m.check_id = i.check_id GROUP BY l.url")
def issues_per_row(spark, sf_dir):
    return rows_of(spark, sf_dir).select("url", F.array_join("issues", ",").alias("issues"))


@query(O.WITH + "SELECT m.check_id, m.severity, m.question, count(i.doc_id) AS count FROM meta m LEFT JOIN issues i USING (check_id) GROUP BY ALL")
def check_counts(spark, sf_dir):
    return stats.check_counts(rows_of(spark, sf_dir)).select("check_id", "severity", "question", "count")


@query(O.WITH + "SELECT count(*) AS jobs, count(*) FILTER (NOT affected) AS trusted, count(*) FILTER (affected) AS affected, (SELECT count(DISTINCT doc_id) FROM issues JOIN meta USING (check_id) WHERE question = 'format') AS format, (SELECT count(*) FROM catalog) AS companies FROM r")
def totals(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.totals(r.rows, r.catalog)


@query(O.WITH + "SELECT question, count(DISTINCT doc_id) AS affected FROM meta LEFT JOIN issues USING (check_id) WHERE question IS NOT NULL GROUP BY 1")
def question_counts(spark, sf_dir):
    return stats.question_counts(rows_of(spark, sf_dir)).select("question", "affected")


@query(O.WITH + "SELECT * FROM (SELECT check_id, host, count(*) AS jobs, row_number() OVER (PARTITION BY check_id ORDER BY count(*) DESC, host) AS rank FROM issues GROUP BY 1, 2) WHERE rank <= 3")
def check_top_hosts(spark, sf_dir):
    return stats.top_hosts_per_check(rows_of(spark, sf_dir))


_SHOWN = "CASE check_id " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in O.EVIDENCE.items()) + " ELSE title END"


@query(O.WITH + f", shown AS (SELECT check_id, left({_SHOWN}, 120) AS evidence, i.url, i.host FROM issues i JOIN l USING (doc_id)), firsts AS (SELECT check_id, evidence, min(url) AS url, arg_min(host, url) AS host FROM shown WHERE evidence <> '' GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY url, evidence) AS rank FROM firsts) WHERE rank <= 3")
def check_samples(spark, sf_dir):
    return stats.samples(rows_of(spark, sf_dir))


# --- map ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {O.CASES} SELECT raw, loc_kind AS kind, loc_value AS value, loc_how AS how, loc_county AS county FROM places")
def place_cases(spark, sf_dir):
    raws = spark.createDataFrame([(r,) for r in D.RAW_PLACES], "raw string")
    return places.resolve(raws, D.gazetteer(spark)).select("raw", "kind", "value", "how", "county")


@query(O.WITH + "SELECT loc_county AS county, count(*) AS jobs FROM r WHERE NOT affected AND loc_kind = 'fixed' AND loc_county <> '' GROUP BY 1")
def map_counties(spark, sf_dir):
    return stats.counties(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT loc_value AS locality, count(*) AS jobs FROM r WHERE NOT affected AND loc_kind = 'fixed' GROUP BY 1 ORDER BY jobs DESC, locality LIMIT 30")
def map_localities(spark, sf_dir):
    return stats.localities(rows_of(spark, sf_dir))


@query(O.WITH + f", c AS (SELECT affected, {O.PLACE_CLASS} AS class FROM r) SELECT count(*) FILTER (NOT affected AND class = 'placed') AS placed, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in ("foreign", "placeholder", "gibberish", "empty", "ambiguous")) + ", count(*) FILTER (NOT affected AND class = 'ambiguous') AS ambiguous_trusted FROM c")
def map_unplaced(spark, sf_dir):
    return stats.unplaced(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT loc_value AS place, count(*) AS jobs FROM r WHERE loc_kind = 'international' GROUP BY 1 ORDER BY jobs DESC, place LIMIT 20")
def map_foreign(spark, sf_dir):
    return stats.foreign_places(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT CASE WHEN place = '' THEN '(gol)' ELSE place END AS raw, count(*) AS jobs FROM r WHERE loc_kind = 'junk' GROUP BY 1 ORDER BY jobs DESC, raw LIMIT 30")
def map_raw_unplaced(spark, sf_dir):
    return stats.raw_unplaced(rows_of(spark, sf_dir))


@query(O.WITH + ", c AS (SELECT loc_county AS county, count(*) AS jobs FROM r WHERE NOT affected AND loc_kind = 'fixed' AND loc_county <> '' GROUP BY 1), a AS (SELECT unnest(['ARBOR', 'Brezan', 'Nowhere']) AS name) SELECT name, coalesce(jobs, 0) AS jobs, round(log10(coalesce(jobs, 0) + 1), 9) AS scale FROM a LEFT JOIN c ON lower(county) = lower(name)")
def map_scale(spark, sf_dir):
    areas = spark.createDataFrame([("ARBOR",), ("Brezan",), ("Nowhere",)], "name string")
    return stats.county_scale(areas, stats.counties(rows_of(spark, sf_dir))).select("name", "jobs", F.round("scale", 9).alias("scale"))


# --- what the screens derive --------------------------------------------------------------------------------------------


@query(O.WITH + "SELECT host, count(*) AS jobs FROM r GROUP BY 1 HAVING count(*) >= 20")
def large_sources(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.large_sources(stats.source_counts(r.rows, r.today, r.since)).select("host", "jobs")


@query(O.WITH + "SELECT m.check_id, count(*) AS count FROM meta m JOIN issues i USING (check_id) GROUP BY m.check_id, m.severity ORDER BY CASE m.severity WHEN 'grav' THEN 0 WHEN 'minor' THEN 1 ELSE 2 END, count DESC, check_id LIMIT 12")
def worst_checks(spark, sf_dir):
    return stats.worst_checks(stats.check_counts(rows_of(spark, sf_dir))).select("check_id", "count")


@query(O.WITH + "SELECT m.check_id, m.severity, count(*) AS count FROM meta m JOIN issues i USING (check_id) WHERE i.host = 'src3.example.ro' GROUP BY 1, 2")
def source_sheet(spark, sf_dir):
    return stats.source_sheet(rows_of(spark, sf_dir), "src3.example.ro").select("check_id", "severity", "count")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n - lag(n) OVER (ORDER BY day) AS delta, CASE WHEN lag(n) OVER (ORDER BY day) IS NULL THEN 'first' WHEN n > lag(n) OVER (ORDER BY day) THEN 'up' WHEN n < lag(n) OVER (ORDER BY day) THEN 'down' ELSE 'same' END AS direction FROM d")
def daily_change(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    before = days.select(F.date_add("day", 1).alias("day"), F.col("n").alias("before"))
    return days.join(before, "day", "left").select("day", stats.change(F.col("n"), F.col("before")).alias("c")).select("day", "c.*")


@query(O.WITH + "SELECT l.url, CASE WHEN doc_id % 2 = 0 THEN link ELSE '' END AS link, CASE WHEN doc_id % 2 = 0 AND link <> '' THEN link_code END AS link_code FROM l")
def links_carried_over(spark, sf_dir):
    rows = rows_of(spark, sf_dir)
    return probe.carried_over(rows, rows.filter("doc_id % 2 = 0")).select("url", "link", "link_code")


# --- what runs keep -----------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT CAST(user_id AS VARCHAR) AS url, DATE '2024-01-15' AS first_seen FROM events")
def state_roundtrip(spark, sf_dir):
    root = store.new_folder(spark, "state")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url")).distinct()
    store.save_state(rows.select("url", F.lit(_DAY).cast("date").alias("first_seen"), F.lit(None).cast("date").alias("missing_since")), root)
    return store.load_state(spark, root).select("url", "first_seen")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS jobs FROM events GROUP BY 1")
def history_upserts(spark, sf_dir):
    """Days written one half before the other, one of them twice: the last of a day stays."""
    path = store.new_folder(spark, "history")
    totals_ = F.struct(F.count(F.lit(1)).alias("jobs"), *(F.lit(0).cast("bigint").alias(c) for c in ("companies", "trusted", "affected", "format")))
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(totals_.alias("totals"))
    none = {c: F.lit(None).cast(t) for c, t in (("incoming", "struct<jobs:bigint,affected:bigint,gone:bigint>"), ("questions", "array<struct<id:string,affected:bigint>>"), ("sources", "array<struct<host:string,jobs:bigint,affected:bigint>>"))}
    rows = days.withColumn("run_at", F.lit("x")).withColumns(none).select("run_at", "totals", "incoming", "questions", "sources", "day")
    wrong = rows.withColumn("totals", F.col("totals").withField("jobs", F.lit(-1).cast("bigint")))
    store.upsert_history(wrong.filter("day(day) <= 10"), path)
    store.upsert_history(rows.filter("day(day) <= 20"), path)
    store.upsert_history(rows.filter("day(day) > 20"), path)
    return store.load_history(spark, path).select("day", F.col("totals.jobs").alias("jobs"))


@query("SELECT 'run' AS source, count(*) AS jobs FROM documents")
def summary_roundtrip(spark, sf_dir):
    root = store.new_folder(spark, "summary")
    store.write_summary(spark, {"jobs": read(spark, sf_dir, "documents").count()}, root)
    found, source = store.load_summary(spark, root)
    return spark.createDataFrame([(source, found["jobs"])], "source string, jobs long")


# --- overview, companies, occupations -----------------------------------------------------------------------------------


@query(O.WITH + "SELECT CASE WHEN workmode = '' THEN '(gol)' ELSE workmode END AS value, count(*) AS jobs FROM l GROUP BY 1 ORDER BY jobs DESC, value LIMIT 10")
def work_modes(spark, sf_dir):
    return stats.work_modes(rows_of(spark, sf_dir))


@query(O.WITH + O.zero_filled(K.FRESHNESS, f"SELECT {O.freshness('age')} AS value, count(*) AS n FROM l GROUP BY 1", "jobs"))
def freshness(spark, sf_dir):
    return stats.freshness(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT count(*) FILTER (tag_list <> '') AS with_tags, count(*) FILTER (pay <> '') AS with_salary FROM l")
def extras(spark, sf_dir):
    return stats.extras(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT cif_key, coalesce(any_value(co_name), '(not in catalog)') AS name, coalesce(any_value(co_status), '') AS status, count(*) AS jobs FROM r WHERE NOT affected AND cif_key <> '' GROUP BY 1 ORDER BY jobs DESC, cif_key LIMIT 40")
def top_companies(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.top_companies(r.rows, r.catalog)


@query(O.WITH + O.zero_filled(K.SIZES, f"SELECT {O.size_class('jobs')} AS value, count(*) AS n FROM (SELECT cif_key, count(*) AS jobs FROM r WHERE NOT affected AND cif_key <> '' GROUP BY 1) GROUP BY 1", "companies"))
def company_sizes(spark, sf_dir):
    return stats.size_classes(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT CASE WHEN status = '' THEN '(gol)' ELSE status END AS value, count(*) AS companies FROM catalog GROUP BY 1 ORDER BY companies DESC, value LIMIT 10")
def company_statuses(spark, sf_dir):
    return stats.company_statuses(D.analysed(spark, sf_dir).catalog)


@query(O.WITH + "SELECT count(DISTINCT CASE WHEN NOT affected THEN nullif(cif_key, '') END) AS distinct_in_trusted, count(DISTINCT nullif(cif_key, '')) AS distinct_in_jobs, count(*) FILTER (cif <> '' AND NOT found) AS orphan_jobs, count(*) FILTER (found AND co_status IN ('suspendat', 'inactiv', 'radiat')) AS not_active_jobs, (SELECT count(*) FROM catalog WHERE key NOT IN (SELECT cif_key FROM l)) AS catalog_without_jobs FROM r")
def company_totals(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.company_totals(r.rows, r.catalog)


@query(O.WITH + "SELECT key, name, status FROM catalog WHERE key NOT IN (SELECT cif_key FROM l)")
def companies_without_jobs(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.without_jobs(r.rows, r.catalog).select("key", "name", "status")


@query(O.WITH + "SELECT c.key, count(l.url) AS jobs FROM catalog c LEFT JOIN l ON l.cif_key = c.key GROUP BY 1")
def companies_with_jobs(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.with_jobs(r.rows, r.catalog).select("key", "jobs")


@query(O.WITH + "SELECT ntitle AS title, count(*) AS jobs FROM r WHERE NOT affected AND ntitle <> '' GROUP BY 1 ORDER BY jobs DESC, title LIMIT 40")
def top_titles(spark, sf_dir):
    return stats.top_titles(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT count(DISTINCT ntitle) AS distinct_titles FROM r WHERE NOT affected AND ntitle <> ''")
def distinct_titles(spark, sf_dir):
    return stats.distinct_titles(rows_of(spark, sf_dir))


@query(O.WITH + "SELECT tag, count(*) AS jobs FROM (SELECT unnest(string_split(tag_list, ',')) AS tag FROM r WHERE NOT affected AND tag_list <> '') GROUP BY 1 ORDER BY jobs DESC, tag LIMIT 40")
def top_tags(spark, sf_dir):
    return stats.top_tags(rows_of(spark, sf_dir))


# --- sources and arrivals -----------------------------------------------------------------------------------------------

_SINCE = "DATE '2024-01-02'"
_FROM = f"greatest(DATE '2024-02-01' - 9, {_SINCE} + 1)"
_FAILS = ", ".join(f"count(*) FILTER (doc_id IN (SELECT doc_id FROM issues JOIN meta USING (check_id) WHERE question = '{q.id}')) AS q_{q.id}" for q in C.QUESTIONS)


@query(O.WITH + f"SELECT host, count(*) AS jobs, count(*) FILTER (NOT affected) AS trusted, count(*) FILTER (affected) AS affected, count(*) FILTER (is_new) AS fresh, count(*) FILTER (is_new AND affected) AS fresh_affected, count(*) FILTER (first_seen >= {_FROM}) AS window, count(*) FILTER (first_seen >= {_FROM} AND affected) AS window_affected, {_FAILS}, round(100.0 * count(*) FILTER (affected) / count(*), 0) AS pct, round(100.0 * count(*) / (SELECT count(*) FROM l), 1) AS share FROM r GROUP BY 1".replace(" AS window,", ' AS "window",'))
def source_scorecard(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.source_counts(r.rows, r.today, r.since)


@query(O.WITH + "SELECT host, string_agg(check_id || '=' || n, ',' ORDER BY check_id) AS by_check FROM (SELECT host, check_id, count(*) AS n FROM issues GROUP BY 1, 2) GROUP BY 1")
def source_check_map(spark, sf_dir):
    maps = stats.check_maps(stats.checks_by_host(rows_of(spark, sf_dir)))
    return maps.select("host", F.array_join(F.transform(F.array_sort(F.map_entries("by_check")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("by_check"))


@query(O.WITH + "SELECT * FROM (SELECT host, check_id, count(*) AS count, row_number() OVER (PARTITION BY host ORDER BY count(*) DESC, check_id) AS rank FROM issues JOIN meta USING (check_id) WHERE severity = 'grav' GROUP BY 1, 2) WHERE rank <= 3")
def source_top_checks(spark, sf_dir):
    return stats.top_checks_by_host(stats.checks_by_host(rows_of(spark, sf_dir)))


@query(O.WITH + f"SELECT first_seen AS day, count(*) AS jobs, count(*) FILTER (affected) AS affected FROM r WHERE first_seen >= {_FROM} GROUP BY 1")
def incoming_by_day(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.by_day(stats.arrivals(r.rows, r.today, r.since))


@query(O.WITH + f"SELECT host, count(*) AS jobs, count(*) FILTER (affected) AS affected, round(100.0 * count(*) FILTER (affected) / count(*), 0) AS pct FROM r WHERE first_seen >= {_FROM} GROUP BY 1")
def incoming_by_host(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return stats.by_host(stats.arrivals(r.rows, r.today, r.since))


@query(O.WITH + "SELECT check_id, count(*) AS count FROM issues JOIN meta USING (check_id) WHERE severity = 'grav' AND doc_id IN (SELECT doc_id FROM l WHERE is_new) GROUP BY 1")
def incoming_new_checks(spark, sf_dir):
    return stats.grave_counts(rows_of(spark, sf_dir).filter("is_new"))


@query(O.WITH + "SELECT url, first_seen, is_new, greatest(0, DATE '2024-02-01' - first_seen) AS days_here FROM l")
def first_seen(spark, sf_dir):
    return rows_of(spark, sf_dir).select("url", "first_seen", "is_new", F.col("days_here").cast("long").alias("days_here"))


@query("WITH g AS (SELECT doc_id FROM documents WHERE doc_id % 50 = 7) SELECT false AS baseline, DATE '2024-01-02' AS since, DATE '2024-02-01' AS today, (SELECT count(*) FROM documents WHERE doc_id % 31 = 0) AS fresh, count(*) AS gone, (SELECT count(*) FROM documents) + count(*) FILTER (doc_id % 100 <> 7) AS tracked FROM g")
def flow(spark, sf_dir):
    rows = D.listings(spark, sf_dir)
    return S.mark(rows, D.state(rows), D.TODAY).flow


@query("SELECT 'https://gone.example.ro/' || doc_id AS url, DATE '2024-01-10' AS first_seen FROM documents WHERE doc_id % 50 = 7")
def gone(spark, sf_dir):
    rows = D.listings(spark, sf_dir)
    return S.gone(D.state(rows), rows).select("url", "first_seen")


# --- links --------------------------------------------------------------------------------------------------------------


@query(O.WITH + "SELECT host, count(*) AS sampled, count(*) FILTER (link = 'dead') AS dead, count(*) FILTER (link = 'error') AS error, count(*) FILTER (link = 'unreachable') AS unreachable, round((count(*) FILTER (link IN ('dead', 'error'))) / count(*), 4) AS share FROM l WHERE link <> '' GROUP BY 1")
def link_summary(spark, sf_dir):
    return probe.problem_share(D.analysed(spark, sf_dir).links).drop("codes")


@query(O.WITH + "SELECT CAST(link_code AS VARCHAR) AS code, count(*) AS n FROM l WHERE link <> '' AND link_code IS NOT NULL GROUP BY 1")
def link_codes_merged(spark, sf_dir):
    return probe.merged_codes(D.analysed(spark, sf_dir).links)


_FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(url, '')]), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"
_PAGE_HOST = r"CASE WHEN regexp_matches(lower(url), '^https?://[^/?#\s@:]') THEN regexp_extract(lower(url), '^https?://(?:www\.)?([^/:?#]+)', 1) ELSE '(url invalid)' END"


@query(f"SELECT page_id, host FROM (SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY fnv, url) AS nth FROM (SELECT page_id, url, {_PAGE_HOST} AS host, {_FNV} AS fnv FROM pages) WHERE host <> '(url invalid)') WHERE nth <= 3")
def fnv_sample_per_host(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select("page_id", "url").withColumn("host", K.host_of("url"))
    return probe.sample_per_host(rows, 3).select("page_id", "host")


@query("SELECT CASE WHEN l_returnflag = 'A' THEN 'dead' WHEN l_returnflag = 'R' THEN 'error' WHEN l_linenumber = 1 THEN 'unreachable' ELSE 'ok' END AS link, count(*) AS n FROM lineitem GROUP BY 1")
def link_states(spark, sf_dir):
    code = F.when(F.col("l_returnflag") == "A", 404).when(F.col("l_returnflag") == "R", 500).when(F.col("l_linenumber") != 1, 200)
    return read(spark, sf_dir, "lineitem").groupBy(K.link_state(code).alias("link")).agg(F.count(F.lit(1)).alias("n"))


# --- repeats ------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) - 1 AS dup_index FROM documents")
def dup_index(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("digest"), F.length("text").alias("size"))
    return dedupe.dup_index(rows, ["digest", "size", "lang"], ["doc_id"]).select("doc_id", "dup_index")


@query("SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM documents GROUP BY text, lang) GROUP BY 1")
def dup_group_sizes(spark, sf_dir):
    return dedupe.group_sizes(read(spark, sf_dir, "documents").select("lang", F.sha2("text", 256).alias("digest")), ["digest", "lang"])


# --- drill-down ---------------------------------------------------------------------------------------------------------

_FILTERS = {
    "check": ("title_html", "doc_id IN (SELECT doc_id FROM issues WHERE check_id = 'title_html')"), "question": ("exista", "doc_id IN (SELECT doc_id FROM issues JOIN meta USING (check_id) WHERE question = 'exista')"),
    "trusted": (True, "NOT affected"), "affected": (True, "affected"), "new": (True, "is_new"), "days": (5, "first_seen >= DATE '2024-01-28'"), "first_day": ("2024-01-20", "first_seen = DATE '2024-01-20'"), "host": ("src3.example.ro", "host = 'src3.example.ro'"),
    "rawloc": ("Lunca, Brezan", "place = 'Lunca, Brezan'"), "county": ("arbor", "loc_county = 'Arbor'"), "locality": ("Monteluna", "loc_value = 'Monteluna'"), "place": ("Bologna", "loc_value = 'Bologna'"), "loc": ("ambiguous", f"{O.PLACE_CLASS} = 'ambiguous'"), "workmode": ("(gol)", "workmode = ''"), "status": ("scraped", "status = 'scraped'"), "title": ("12 x", "ntitle = '12 x'"), "tag": ("en", "list_contains(string_split(tag_list, ','), 'en')"),
    "fresh": ("≤30", "age <= 30 AND age > 7"), "link": ("dead", "link = 'dead'"), "linkbad": (True, "link IN ('dead', 'error')"), "q": ("SUPPLIER#00000001", "contains(lower(company), 'supplier#00000001') OR contains(ntitle, 'supplier#00000001')"), "company": ("10000009", "cif_key = '10000009'"),
}


@query(O.WITH + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS n FROM r WHERE {sql}" for k, (_, sql) in _FILTERS.items()))
def drilldown_filters(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(k).alias("name"), F.count_if(F.coalesce(filters.where({k: v}, r.context()), F.lit(False))).alias("n")) for k, (v, _) in _FILTERS.items()))
    return r.rows.agg(each.alias("e")).select(F.explode("e").alias("x")).select("x.*")


@query(O.WITH + "SELECT url, date, status FROM r WHERE NOT affected ORDER BY date DESC, url LIMIT 25 OFFSET 25")
def drilldown_page(spark, sf_dir):
    r = D.analysed(spark, sf_dir)
    return filters.page_of(r.rows.filter(filters.where({"trusted": True}, r.context())), 2, 25).select("url", "date", "status")


@query("SELECT source AS value, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def facet(spark, sf_dir):
    return readers.facet(read(spark, sf_dir, "documents"), "source", "lang = 'en'")


@query("SELECT o_orderstatus AS value, count(*) AS n FROM orders WHERE o_totalprice > 200000 GROUP BY 1 ORDER BY n DESC, value LIMIT 20")
def facet_orders(spark, sf_dir):
    return readers.facet(read(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice > 200000")


# --- the same operators on other tables ---------------------------------------------------------------------------------


@query(f"SELECT {_PAGE_HOST} AS host, count(*) AS jobs FROM pages GROUP BY 1")
def host_histogram(spark, sf_dir):
    return stats.top(read(spark, sf_dir, "pages"), K.host_of("url"), None, "host")


_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query(rf"SELECT title, jobs FROM (SELECT {O.trim(rf"regexp_replace(lower(replace({_TITLE}, '&amp;', '&')), '{O.SPACES}+', ' ', 'g')")} AS title, count(*) AS jobs FROM pages GROUP BY 1) WHERE title <> '' ORDER BY jobs DESC, title LIMIT 40")
def page_titles(spark, sf_dir):
    title = X.normal_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1))
    return stats.top(read(spark, sf_dir, "pages").select(title.alias("t")).filter("t <> ''"), "t", 40, "title")


@query(rf"SELECT lang, count(*) AS n, count(*) FILTER (share < 1) AS mixed, count(*) FILTER (caps) AS capitals FROM (SELECT lang, {O.latin('text')} AS share, length({O.letters('text')}) >= 6 AND regexp_matches(text, '[A-Z]') AND NOT regexp_matches(text, '[\p{{Ll}}]') AS caps FROM documents) GROUP BY 1")
def script_shares(spark, sf_dir):
    caps = (F.length(X.letters_only("text")) >= 6) & F.col("text").rlike("[A-Z]") & ~F.col("text").rlike(r"\p{Ll}")
    return read(spark, sf_dir, "documents").select("lang", X.latin_share("text").alias("share"), caps.alias("caps")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("share") < 1).alias("mixed"), F.count_if("caps").alias("capitals"))


#: Conversations have no such contacts, so some are written into them: right ones, and near misses.
_CONTACTS = "text || CASE conv_id % 7 WHEN 0 THEN ' 0722 123 456' WHEN 1 THEN ' ana@firma.ro' WHEN 2 THEN ' 1900101123456 ' WHEN 3 THEN ' 0622 123 456' WHEN 4 THEN ' ana@firma' WHEN 5 THEN ' 9900101123456' ELSE '' END"


@query(rf"SELECT role, conv_id % 7 AS kind, count(*) AS n FROM (SELECT conv_id, role, {_CONTACTS} AS text FROM conversations) WHERE regexp_matches(text, '{O.PHONE}') OR regexp_matches(text, '(?:^|[^A-Za-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+\.[a-z]{{2,}}') OR regexp_matches(text, '(?:^|[^A-Za-z0-9_])[1-8][0-9]{{12}}(?:[^A-Za-z0-9_]|$)') GROUP BY 1, 2")
def contacts_in_turns(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("text", F.expr(_CONTACTS))
    return rows.filter(C.has_contact(F.col("text"))).groupBy("role", (F.col("conv_id") % 7).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


_CIF = "lpad(CAST(c_custkey * 7919 % 100000000 AS VARCHAR), 8, '0')"


@query(f"WITH k AS (SELECT c_custkey, regexp_replace({_CIF}, '^0+', '') AS key FROM customer) SELECT c_custkey, key, coalesce({O.fiscal_ok('key')}, false) AS ok FROM k WHERE key <> ''")
def fiscal_checksums(spark, sf_dir):
    cif = F.lpad((F.col("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0")
    rows = read(spark, sf_dir, "customer").select("c_custkey", K.fiscal_key(cif).alias("key"), F.coalesce(K.fiscal_checksum_ok(cif), F.lit(False)).alias("ok"))
    return rows.filter("key <> ''")


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1")
def orders_without_customer(spark, sf_dir):
    known = read(spark, sf_dir, "customer").filter("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, sf_dir, "orders").join(known, "o_custkey", "left_anti").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') GROUP BY 1")
def customers_without_orders(spark, sf_dir):
    some = read(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").join(some, "c_custkey", "left_anti").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


_ORDER_NOW = "2001-08-10T12:00:00Z"


@query(O.zero_filled(K.FRESHNESS, f"SELECT {O.freshness('age')} AS value, count(*) AS n FROM (SELECT CAST(floor((epoch(TIMESTAMP '2001-08-10 12:00:00') - epoch(o_orderdate)) / 86400) AS INT) AS age FROM orders) GROUP BY 1", "jobs").replace(", labels", "WITH labels", 1))
def order_freshness(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(K.age_between(F.col("o_orderdate").cast("timestamp"), _ORDER_NOW).alias("age"))
    return stats.freshness(rows)


@query(O.zero_filled(K.SIZES, f"SELECT {O.size_class('n')} AS value, count(*) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1", "companies").replace(", labels", "WITH labels", 1))
def customer_sizes(spark, sf_dir):
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("jobs"))
    return stats.zero_filled(counts.groupBy(K.size_class("jobs").alias("value")).agg(F.count(F.lit(1)).alias("companies")), list(K.SIZES), "value", "companies")


@query("SELECT l_returnflag AS flag, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate + INTERVAL 30 DAY GROUP BY 1")
def shipped_late(spark, sf_dir):
    days = F.unix_micros(F.col("l_shipdate").cast("timestamp")) > F.unix_micros(F.col("o_orderdate").cast("timestamp")) + 30 * K.DAY_US
    pairs = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.filter(days).groupBy(F.col("l_returnflag").alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT tag, count(*) AS jobs FROM (SELECT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS tag FROM part) GROUP BY 1 ORDER BY jobs DESC, tag LIMIT 40")
def part_tags(spark, sf_dir):
    words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    return stats.top(read(spark, sf_dir, "part").select(F.explode(words).alias("tag")), "tag", 40, "tag")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (event_type NOT IN ('click', 'view')) AS invalid, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY 1")
def event_types(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("event_type").isin("click", "view")).alias("invalid"), F.sum(k).alias("k"))


@query("SELECT event_type AS code, count(*) AS n FROM events GROUP BY 1")
def event_codes_merged(spark, sf_dir):
    counts = read(spark, sf_dir, "events").groupBy(F.pmod("user_id", F.lit(16)).alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("bucket").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("codes"))
    return probe.merged_codes(maps)


# --- state and history on events ----------------------------------------------------------------------------------------


@query(f"WITH before AS (SELECT user_id, min(CAST(ts AS DATE)) AS first FROM events WHERE CAST(ts AS DATE) < DATE '{_DAY}' AND user_id % 5 <> 0 GROUP BY 1), now AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '{_DAY}') SELECT CAST(user_id AS VARCHAR) AS url, coalesce(first, DATE '{_DAY}') AS first_seen, first IS NULL AS is_new, greatest(0, DATE '{_DAY}' - coalesce(first, DATE '{_DAY}')) AS days_here FROM now LEFT JOIN before USING (user_id)")
def first_seen_users(spark, sf_dir):
    return _users_marked(spark, sf_dir).jobs.select("url", "first_seen", "is_new", F.col("days_here").cast("long").alias("days_here"))


@query(f"WITH before AS (SELECT user_id, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events WHERE CAST(ts AS DATE) < DATE '{_DAY}' AND user_id % 5 <> 0 GROUP BY 1), now AS (SELECT DISTINCT user_id FROM events WHERE CAST(ts AS DATE) = DATE '{_DAY}') SELECT CAST(coalesce(b.user_id, n.user_id) AS VARCHAR) AS url, coalesce(first, DATE '{_DAY}') AS first_seen, CASE WHEN n.user_id IS NULL THEN CASE WHEN last < DATE '2024-01-14' THEN last + 1 ELSE DATE '{_DAY}' END END AS missing_since FROM before b FULL JOIN now n ON b.user_id = n.user_id")
def state_after_users(spark, sf_dir):
    return _users_marked(spark, sf_dir).state


def _users_marked(spark, sf_dir) -> S.Marked:
    events = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), F.to_date("ts").alias("day"), "user_id")
    seen = events.filter((F.col("day") < F.lit(_DAY).cast("date")) & (F.col("user_id") % 5 != 0)).groupBy("url").agg(F.min("day").alias("first_seen"), F.max("day").alias("_last"))
    missing = F.when(F.col("_last") < F.date_sub(F.lit(_DAY).cast("date"), 1), F.date_add("_last", 1))
    before = seen.select("url", "first_seen", missing.alias("missing_since"))
    return S.mark(events.filter(F.col("day") == F.lit(_DAY).cast("date")).select("url").distinct(), before, _DAY, baseline=False)


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), t AS (SELECT unnest([DATE '2024-01-03', DATE '2024-01-08', DATE '2024-01-30']) AS today) SELECT today, day AS since, today - day AS days, n FROM t JOIN d ON d.day = (SELECT coalesce(max(day) FILTER (day <= today - 7), min(day)) FROM d WHERE day < today)")
def trend_as_of(spark, sf_dir):
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    out = None
    for today in ("2024-01-03", "2024-01-08", "2024-01-30"):
        one = trend.as_of(days, today).select(F.lit(today).cast("date").alias("today"), F.col("day").alias("since"), F.datediff(F.lit(today).cast("date"), "day").cast("long").alias("days"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT CAST(ts AS DATE) AS day, CAST(CAST(ts AS DATE) AS VARCHAR) AS run_at, count(*) AS jobs, count(*) FILTER (event_type <> 'error') AS trusted, count(*) FILTER (event_type = 'error') AS affected FROM events GROUP BY 1, 2 ORDER BY day DESC LIMIT 10")
def recent_runs(spark, sf_dir):
    bad = F.col("event_type") == "error"
    totals_ = F.struct(F.count(F.lit(1)).alias("jobs"), F.count_if(~bad).alias("trusted"), F.count_if(bad).alias("affected"))
    days = read(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(totals_.alias("totals"))
    return trend.recent_runs(days.select("day", F.col("day").cast("string").alias("run_at"), "totals", F.lit(None).alias("incoming"))).drop("incoming")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def rows_roundtrip(spark, sf_dir):
    """Rows written as sorted JSON lines and read again, counted by day."""
    root = store.new_folder(spark, "rows")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("url"), F.to_date("ts").cast("string").alias("date"))
    store.write_rows(rows, root)
    return store.scan_rows(spark, root, "url string, date string").groupBy(F.col("date").cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


# --- places -------------------------------------------------------------------------------------------------------------

_NAMES = "SELECT s_suppkey AS k, 'place' || translate(CAST(s_suppkey * 7 + 1000 AS VARCHAR), '0123456789', 'abcdefghik') AS name FROM supplier"


def _places(spark, sf_dir) -> tuple[DataFrame, places.Gazetteer]:
    """Invented places of suppliers, in a county each for every ten."""
    key = F.col("s_suppkey")
    name = F.concat(F.lit("Place"), F.translate((key * 7 + 1000).cast("string"), "0123456789", "abcdefghik"))
    rows = read(spark, sf_dir, "supplier").select(key.alias("k"), name.alias("name"), F.concat(F.lit("County "), F.translate(F.floor(key / 10).cast("string"), "0123456789", "abcdefghik")).alias("county"))
    counties = rows.select(F.col("county").alias("name")).distinct()
    return rows, places.build(rows.select(F.col("name").alias("key"), "name", "county", F.lit("town").alias("type")), None, counties)


@query(f"WITH n AS ({_NAMES}), t AS (SELECT unnest([k]) AS k, unnest([upper(name) || ', Romania']) AS raw, 'exact' AS how, name FROM n UNION ALL SELECT k, 'Str. Lunga nr. 4, ' || name, 'exact', name FROM n UNION ALL SELECT k, 'comuna ' || name, 'alias', name FROM n UNION ALL SELECT k, 'undeva langa ' || name || ' in sat', 'substring', name FROM n) SELECT raw, 'fixed' AS kind, upper(left(name, 1)) || substr(name, 2) AS value, how FROM t")
def gazetteer_names(spark, sf_dir):
    rows, g = _places(spark, sf_dir)
    texts = F.array(F.concat(F.upper("name"), F.lit(", Romania")), F.concat(F.lit("Str. Lunga nr. 4, "), F.lower("name")), F.concat(F.lit("comuna "), F.lower("name")), F.concat(F.lit("undeva langa "), F.lower("name"), F.lit(" in sat")))
    return places.resolve(rows.select(F.explode(texts).alias("raw")), g).select("raw", "kind", "value", "how")


# a last letter is lost: of two names that differ in it alone, neither is nearest
_LONG = "SELECT s_suppkey AS k, 'localitatea' || translate(CAST(s_suppkey * 79193 + 1000003 AS VARCHAR), '0123456789', 'abcdefghik') AS name FROM supplier"


@query(f"WITH n AS ({_LONG}), every AS (SELECT name FROM n UNION SELECT left(name, length(name) - 1) || 'x' FROM n WHERE k % 3 = 0), t AS (SELECT DISTINCT left(name, length(name) - 1) AS raw FROM n), c AS (SELECT raw, name, levenshtein(raw, name) AS d FROM t JOIN every ON abs(length(raw) - length(name)) <= 2 WHERE raw NOT IN (SELECT name FROM every)), b AS (SELECT raw, min(d) AS d FROM c GROUP BY 1), u AS (SELECT raw, d, count(DISTINCT name) AS names, min(name) AS name, max(length(name)) AS longest FROM c JOIN b USING (raw, d) GROUP BY 1, 2) SELECT raw, upper(left(name, 1)) || substr(name, 2) AS value, 'typo-fixed (distance ' || d || ')' AS how FROM u WHERE names = 1 AND d BETWEEN 1 AND 2 AND d / greatest(length(raw), longest) <= 0.15")
def gazetteer_fuzzy(spark, sf_dir):
    key = F.col("s_suppkey")
    name = F.concat(F.lit("Localitatea"), F.translate((key * 79193 + 1000003).cast("string"), "0123456789", "abcdefghik"))
    rows = read(spark, sf_dir, "supplier").select(key.alias("k"), name.alias("name"))
    near = rows.filter("k % 3 = 0").select(F.concat(F.expr("left(name, length(name) - 1)"), F.lit("x")).alias("name"))
    index = rows.select("name").unionByName(near).distinct().select(F.col("name").alias("key"), "name", F.lit("Sat").alias("county"), F.lit("town").alias("type"))
    g = places.build(index, None, spark.createDataFrame([("Judet",)], "name string"))
    found = places.resolve(rows.select(F.lower(F.expr("left(name, length(name) - 1)")).alias("raw")), g)
    return found.filter("kind = 'fixed'").select("raw", "value", "how")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scorecard of sources."""
    return source_scorecard(spark, sf_dir)
