"""Aggregates of a run. Each is one function from rows to a small table; every bucket is also a filter of the drill-down.

``rows`` are enriched rows with issues. Aggregates over trusted rows take them from ``trusted``. Ties are broken by label.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K
from ..functions import text as X
from . import checks as C

WINDOW_DAYS = 10


def n() -> Column:
    return F.count(F.lit(1))


def top(rows: DataFrame, label: str | Column, limit: int | None, name: str, by: str = "jobs") -> DataFrame:
    """(name, jobs): the most frequent labels, all if limit is None."""
    label = F.col(label) if isinstance(label, str) else label
    counts = rows.groupBy(label.alias(name)).agg(n().alias(by)).orderBy(F.desc(by), name)
    return counts if limit is None else counts.limit(limit)


def zero_filled(counts: DataFrame, labels: list[str], name: str, by: str = "jobs") -> DataFrame:
    """Counts of all labels in their order, 0 where there are none."""
    order = counts.sparkSession.createDataFrame(list(enumerate(labels)), f"ordinal int, {name} string")
    return order.join(counts, name, "left").select("ordinal", name, F.coalesce(by, F.lit(0)).alias(by)).orderBy("ordinal")


def trusted(rows: DataFrame) -> DataFrame:
    return rows.filter(~C.is_affected())


# --- totals, rules, questions -------------------------------------------------------------------------------------------


def totals(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: jobs, companies, trusted, affected, format."""
    bad = C.is_affected()
    own = rows.agg(n().alias("jobs"), F.count_if(~bad).alias("trusted"), F.count_if(bad).alias("affected"), F.count_if(C.fails_any(C.of_question(C.FORMAT))).alias("format"))
    return own.join(catalog.agg(n().alias("companies")))


def check_counts(rows: DataFrame) -> DataFrame:
    """The catalog with the count of each rule, 0 included."""
    counts = C.exploded(rows.select("issues")).groupBy("check_id").agg(n().alias("count"))
    return C.catalog_frame(rows.sparkSession).join(counts, "check_id", "left").withColumn("count", F.coalesce("count", F.lit(0))).orderBy("ordinal")


def top_hosts_per_check(rows: DataFrame, limit: int = 3) -> DataFrame:
    counts = C.exploded(rows.select("host", "issues")).groupBy("check_id", "host").agg(n().alias("jobs"))
    return ranked(counts, ["check_id"], [F.desc("jobs"), F.col("host")], limit)


def ranked(rows: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """The first rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= limit)


def samples(rows: DataFrame, limit: int = 3) -> DataFrame:
    """(check_id, evidence, url, host, rank): of each rule the first different values by url."""
    shown = C.with_evidence(C.exploded(rows)).filter("evidence <> ''")
    first = shown.groupBy("check_id", "evidence").agg(F.min(F.struct("url", "host")).alias("at")).select("check_id", "evidence", "at.url", "at.host")
    return ranked(first, ["check_id"], [F.col("url"), F.col("evidence")], limit)


def question_counts(rows: DataFrame) -> DataFrame:
    """Rows that fail each question, each counted once, 0 included."""
    counts = rows.select(F.explode(C.questions_failed()).alias("question")).groupBy("question").agg(n().alias("affected"))
    return C.question_frame(rows.sparkSession).join(counts, "question", "left").withColumn("affected", F.coalesce("affected", F.lit(0))).orderBy("ordinal")


# --- overview and map ---------------------------------------------------------------------------------------------------


def work_modes(rows: DataFrame, limit: int = 10) -> DataFrame:
    return top(rows, X.or_label("workmode"), limit, "value")


def freshness(rows: DataFrame) -> DataFrame:
    return zero_filled(rows.groupBy(K.freshness("age").alias("value")).agg(n().alias("jobs")), list(K.FRESHNESS), "value")


def extras(rows: DataFrame) -> DataFrame:
    """One row: with_tags, with_salary."""
    return rows.agg(F.count_if(F.size("tags") > 0).alias("with_tags"), F.count_if(~C.salary_is_missing()).alias("with_salary"))


def counties(rows: DataFrame) -> DataFrame:
    """Trusted rows by county, all counties."""
    return top(trusted(rows).filter("loc.kind = 'fixed' and loc.county <> ''"), K.plain_county("loc.county"), None, "county")


def localities(rows: DataFrame, limit: int = 30) -> DataFrame:
    return top(trusted(rows).filter("loc.kind = 'fixed'"), "loc.value", limit, "locality")


def place_class(loc: str = "loc") -> Column:
    """placed, ambiguous, foreign, empty, placeholder or gibberish: the filter's classes."""
    kind, how = F.col(f"{loc}.kind"), F.col(f"{loc}.how")
    fixed = F.when(F.coalesce(F.col(f"{loc}.county"), F.lit("")) != "", "placed").otherwise("ambiguous")
    return F.when(kind == "fixed", fixed).when(kind == "international", "foreign").when(how.isin("empty", "placeholder"), how).otherwise("gibberish")


def unplaced(rows: DataFrame) -> DataFrame:
    """One row: placed rows among the trusted; foreign, placeholder, gibberish and empty among all; ambiguous among all, so that it
    equals the drill-down's list, and ambiguous_trusted as the map has it."""
    good, where = ~C.is_affected(), place_class()
    named = [F.count_if(where == c).alias(c) for c in ("foreign", "placeholder", "gibberish", "empty", "ambiguous")]
    return rows.agg(F.count_if(good & (where == "placed")).alias("placed"), *named, F.count_if(good & (where == "ambiguous")).alias("ambiguous_trusted"))


def foreign_places(rows: DataFrame, limit: int = 20) -> DataFrame:
    return top(rows.filter("loc.kind = 'international'"), "loc.value", limit, "place")


def raw_unplaced(rows: DataFrame, limit: int = 30) -> DataFrame:
    return top(rows.filter("loc.kind = 'junk'"), X.or_label(F.array_join("location", ", ")), limit, "raw")


# --- companies and occupations ------------------------------------------------------------------------------------------


def jobs_per_company(rows: DataFrame) -> DataFrame:
    return trusted(rows).filter("cif_key <> ''").groupBy("cif_key").agg(n().alias("jobs"))


def top_companies(rows: DataFrame, catalog: DataFrame, limit: int = 40) -> DataFrame:
    """The companies with most trusted rows; the limit is applied before names are looked up."""
    most = jobs_per_company(rows).orderBy(F.desc("jobs"), "cif_key").limit(limit)
    named = most.join(catalog.select(F.col("key").alias("cif_key"), "name", "status"), "cif_key", "left")
    return named.select("cif_key", F.coalesce("name", F.lit("(not in catalog)")).alias("name"), F.coalesce("status", F.lit("")).alias("status"), "jobs").orderBy(F.desc("jobs"), "cif_key")


def size_classes(rows: DataFrame) -> DataFrame:
    counts = jobs_per_company(rows).groupBy(K.size_class("jobs").alias("value")).agg(n().alias("companies"))
    return zero_filled(counts, list(K.SIZES), "value", "companies")


def company_statuses(catalog: DataFrame, limit: int = 10) -> DataFrame:
    return top(catalog, X.or_label("status"), limit, "value", "companies")


def without_jobs(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """Companies of the catalog that no row names."""
    return catalog.join(rows.select(F.col("cif_key").alias("key")), "key", "left_anti")


def with_jobs(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """The catalog with the number of rows of each company."""
    counts = rows.groupBy(F.col("cif_key").alias("key")).agg(n().alias("jobs"))
    return catalog.join(counts, "key", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))


def company_totals(rows: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: distinct companies among trusted and all rows, companies without rows, rows of unknown and inactive companies."""
    good = ~C.is_affected()
    key = F.nullif("cif_key", F.lit(""))
    own = rows.agg(F.countDistinct(F.when(good, key)).alias("distinct_in_trusted"), F.countDistinct(key).alias("distinct_in_jobs"), F.count_if(F.array_contains("issues", "cif_orphan")).alias("orphan_jobs"), F.count_if(F.array_contains("issues", "company_not_active")).alias("not_active_jobs"))
    return own.join(without_jobs(rows, catalog).agg(n().alias("catalog_without_jobs")))


def top_titles(rows: DataFrame, limit: int = 40) -> DataFrame:
    return top(trusted(rows).filter("ntitle <> ''"), "ntitle", limit, "title")


def distinct_titles(rows: DataFrame) -> DataFrame:
    return trusted(rows).filter("ntitle <> ''").agg(F.countDistinct("ntitle").alias("distinct_titles"))


def top_tags(rows: DataFrame, limit: int = 40) -> DataFrame:
    """Tags of trusted rows; one that a row has twice counts twice."""
    return top(trusted(rows).select(F.explode("tags").alias("tag")), "tag", limit, "tag")


# --- sources ------------------------------------------------------------------------------------------------------------


def source_counts(rows: DataFrame, today: str, since: str | None) -> DataFrame:
    """Per host: jobs, trusted, affected, fresh, window and their affected rows, and rows that fail each question; pct and share."""
    bad = C.is_affected()
    start = K.window_start(today, F.lit(since).cast("date") if since else None, WINDOW_DAYS)
    recent = F.col("first_seen") >= start
    per_question = [F.count_if(C.fails_any(C.of_question(q.id))).alias(f"q_{q.id}") for q in C.QUESTIONS]
    per_host = rows.groupBy("host").agg(
        n().alias("jobs"), F.count_if(~bad).alias("trusted"), F.count_if(bad).alias("affected"), F.count_if("is_new").alias("fresh"), F.count_if(F.col("is_new") & bad).alias("fresh_affected"),
        F.count_if(recent).alias("window"), F.count_if(recent & bad).alias("window_affected"), *per_question,
    )
    # one row a host: the window over all of them is small, and reads the aggregate once
    per_host = per_host.withColumn("_total", F.sum("jobs").over(Window.partitionBy()))
    return per_host.withColumn("pct", K.percent(F.col("affected"), F.col("jobs"))).withColumn("share", K.percent(F.col("jobs"), F.col("_total"), 1)).drop("_total")


def checks_by_host(rows: DataFrame) -> DataFrame:
    """(host, check_id, count)."""
    return C.exploded(rows.select("host", "issues")).groupBy("host", "check_id").agg(n().alias("count"))


def check_maps(counts: DataFrame) -> DataFrame:
    """(host, by_check): counts as a map."""
    return counts.groupBy("host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("check_id", "count")))).alias("by_check"))


def top_checks_by_host(counts: DataFrame, limit: int = 3) -> DataFrame:
    """Of each host the most frequent grave rules."""
    return ranked(counts.filter(F.col("check_id").isin(C.grave_ids())), ["host"], [F.desc("count"), F.col("check_id")], limit)


def sources(rows: DataFrame, today: str, since: str | None, links: DataFrame | None = None) -> DataFrame:
    """The scorecard of hosts, those with most affected rows first."""
    counts = checks_by_host(rows)
    best = top_checks_by_host(counts).groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "check_id", "count"))), lambda s: F.struct(s["check_id"].alias("id"), s["count"].alias("count"))).alias("top_checks"))
    out = source_counts(rows, today, since).join(check_maps(counts), "host", "left").join(best, "host", "left")
    if links is not None:
        out = out.join(links.select("host", F.struct("sampled", "dead", "error", "unreachable", "codes").alias("links")), "host", "left")
    return out.orderBy(F.desc("affected"), "host")


# --- what came in -------------------------------------------------------------------------------------------------------


def arrivals(rows: DataFrame, today: str, since: str | None, days: int = WINDOW_DAYS) -> DataFrame:
    """Rows first seen in the window, never on the baseline day."""
    return rows.filter(F.col("first_seen") >= K.window_start(today, F.lit(since).cast("date") if since else None, days))


def by_day(rows: DataFrame) -> DataFrame:
    """(day, jobs, affected) of rows by the day they were first seen."""
    return rows.groupBy(F.col("first_seen").alias("day")).agg(n().alias("jobs"), F.count_if(C.is_affected()).alias("affected")).orderBy("day")


def by_host(rows: DataFrame) -> DataFrame:
    """(host, jobs, affected, pct), those with most affected rows first, then with most rows."""
    counts = rows.groupBy("host").agg(n().alias("jobs"), F.count_if(C.is_affected()).alias("affected"))
    return counts.withColumn("pct", K.percent(F.col("affected"), F.col("jobs"))).orderBy(F.desc("affected"), F.desc("jobs"), "host")


def grave_counts(rows: DataFrame) -> DataFrame:
    """(check_id, count) of grave rules."""
    counts = C.exploded(rows.select("issues")).filter(F.col("check_id").isin(C.grave_ids()))
    return counts.groupBy("check_id").agg(n().alias("count")).orderBy(F.desc("count"), "check_id")


# --- what the screens derive --------------------------------------------------------------------------------------------


def large_sources(scorecard: DataFrame, least: int = 20, all_of_them: bool = False) -> DataFrame:
    return scorecard if all_of_them else scorecard.filter(F.col("jobs") >= least)


def change(now: Column, before: Column) -> Column:
    """A struct: the difference to the run before and its direction."""
    d = now - before
    return F.struct(d.alias("delta"), F.when(before.isNull(), "first").when(d > 0, "up").when(d < 0, "down").otherwise("same").alias("direction"))


def worst_checks(counts: DataFrame, limit: int = 12) -> DataFrame:
    """Rules that fired, grave ones first, then by count."""
    order = F.when(F.col("severity") == C.GRAVE, 0).when(F.col("severity") == C.MINOR, 1).otherwise(2)
    return counts.filter("count > 0").orderBy(order, F.desc("count"), "check_id").limit(limit)


def source_sheet(rows: DataFrame, host: str) -> DataFrame:
    """One host's rules that fired, with severity, grave ones first."""
    counts = checks_by_host(rows.filter(F.col("host") == host))
    return worst_checks(C.catalog_frame(rows.sparkSession).join(counts.drop("host"), "check_id"), len(C.CATALOG))


def county_scale(areas: DataFrame, counts: DataFrame) -> DataFrame:
    """Areas (name) with their counts, 0 included, and the logarithmic scale of a map; names meet without accents."""
    folded = counts.select(X.accent_free("county").alias("_key"), "jobs")
    out = areas.join(folded, X.accent_free("name") == F.col("_key"), "left").drop("_key").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    return out.withColumn("scale", K.log_scale("jobs"))
