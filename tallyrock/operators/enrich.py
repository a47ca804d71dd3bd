"""Enrichment: the derived columns that rules and aggregates share, each computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as X
from . import places
from .vocabulary import Vocabulary

SERVED = ("url", "title", "company", "cif", "location", "date", "status", "workmode", "host", "issues", "loc", "link", "co_status", "co_checked", "is_new", "first_seen", "days_here", "link_code", "link_reason")


def companies(raw: DataFrame) -> DataFrame:
    """(key, id, name, status, last_scraped, scraper_file), one row per key: of several the last by id. Empty keys go."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in raw.columns else F.lit("")
    rows = raw.select(K.fiscal_key(text("id")).alias("key"), text("id").alias("id"), text("company").alias("name"), text("status").alias("status"), text("lastScraped").alias("last_scraped"), text("scraperFile").alias("scraper_file"))
    last = rows.filter("key <> ''").groupBy("key").agg(F.max(F.struct("id", "name", "status", "last_scraped", "scraper_file")).alias("last"))
    return last.select("key", "last.*")


def jobs(listings: DataFrame, catalog: DataFrame, gazetteer: places.Gazetteer | None, now: str, vocabulary: Vocabulary | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """Listings with host, cif_key, co (the catalog's company or null), loc, age and normalised title.

    Both joins are on keys; Spark sends the smaller side to all tasks where it is small, and shuffles otherwise.
    """
    raw_place = F.array_join(F.transform("location", lambda x: F.coalesce(x, F.lit(""))), ", ")
    rows = listings.withColumns({"host": K.host_of("url"), "cif_key": K.fiscal_key("cif"), "age": K.age_days("date", now), "ntitle": X.normal_title("title"), "raw_place": raw_place})
    co = catalog.select(F.col("key").alias("_key"), F.struct("id", "key", "name", "status", "last_scraped", "scraper_file").alias("co"))
    rows = rows.join(co, F.nullif("cif_key", F.lit("")) == F.col("_key"), "left").drop("_key")
    if gazetteer is None:
        return rows.withColumn("loc", F.lit(None).cast("struct<kind:string,value:string,how:string,county:string>"))
    found = places.resolve(rows.select(F.col("raw_place").alias("raw")), gazetteer, vocabulary, held)
    loc = found.select(F.col("raw").alias("_raw"), F.struct("kind", "value", "how", "county").alias("loc"))
    return rows.join(loc, F.col("raw_place") == F.col("_raw"), "left").drop("_raw")


def compact(rows: DataFrame) -> DataFrame:
    """What is stored of a row: the company's status and date of check in place of the company, without what only rules need."""
    out = rows.withColumn("co_status", F.coalesce("co.status", F.lit(""))).withColumn("co_checked", F.coalesce("co.last_scraped", F.lit("")))
    return out.drop("co", "vdate", "expirationdate", "salary", "salary_is_array", "raw_place")


def served(rows: DataFrame) -> DataFrame:
    """The fields of a drill-down row."""
    return rows.select(*SERVED)
