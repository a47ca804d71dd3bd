"""Sources: coercion of loosely typed documents, scans with the fields the engine needs, counts and facets.

Sources are read-only: there is no function that writes to one.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields that a listing and a company have.
JOB_FIELDS = ("url", "title", "company", "cif", "location", "tags", "workmode", "date", "status", "vdate", "expirationdate", "salary")
COMPANY_FIELDS = ("id", "company", "status", "scraperFile", "lastScraped")
LISTS = ("location", "tags")
#: Characters of a source's own message that an error repeats.
LONGEST_MESSAGE = 300


class SourceError(Exception):
    """A source can't be read: which one, the kind of error, and the beginning of its message."""

    def __init__(self, path: str, error: Exception):
        self.path, self.kind = path, type(error).__name__
        super().__init__(f"{path} can't be read ({self.kind}): {str(error)[:LONGEST_MESSAGE]}")


def loaded(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A source as a table. Credentials are the file system's or catalog's, in the session's settings; what it answers instead of
    rows becomes a SourceError."""
    try:
        return spark.read.format(format).load(path)
    except (PySparkException, Py4JJavaError) as e:
        raise SourceError(path, e) from e


def _kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("VOID"))


def as_array(v: Column) -> Column:
    """A variant as an array of texts: a scalar alone, null as none."""
    kind = _kind(v)
    return F.when(kind.startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>"))).when(kind == "VOID", F.array().cast("array<string>")).otherwise(F.array(F.try_variant_get(v, "$", "string")))


def as_text(v: Column) -> Column:
    """A variant as a text: of an array the first element, null as ""."""
    return F.when(_kind(v).startswith("ARRAY"), F.coalesce(F.try_variant_get(v, "$[0]", "string"), F.lit(""))).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.lit("")))


def from_variant(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Listings of documents held as variants, whose fields may be scalars, arrays or null."""
    field = lambda name: F.try_variant_get(F.col(column), f"$.{name}", "variant")
    texts = [as_text(field(n)).alias(n) for n in JOB_FIELDS if n not in (*LISTS, "salary")]
    lists = [as_array(field(n)).alias(n) for n in LISTS]
    return docs.select(*texts, *lists, as_array(field("salary")).alias("salary"), _kind(field("salary")).startswith("ARRAY").alias("salary_is_array"))


def typed(docs: DataFrame) -> DataFrame:
    """Listings of a typed table: missing columns and nulls become "" or empty arrays, scalar lists are wrapped."""
    types = dict(docs.dtypes)

    def one(name: str) -> Column:
        if name not in types:
            return F.lit("")
        return F.coalesce(F.try_element_at(F.col(name), F.lit(1)) if types[name].startswith("array") else F.col(name).cast("string"), F.lit(""))

    def many(name: str) -> Column:
        none = F.array().cast("array<string>")
        if name not in types:
            return none
        return F.coalesce(F.col(name).cast("array<string>"), none) if types[name].startswith("array") else F.when(F.col(name).isNull(), none).otherwise(F.array(F.col(name).cast("string")))

    is_list = F.col("salary_is_array") if "salary_is_array" in types else F.lit(types.get("salary", "").startswith("array"))
    return docs.select(*(one(n).alias(n) for n in JOB_FIELDS if n not in (*LISTS, "salary")), *(many(n).alias(n) for n in (*LISTS, "salary")), is_list.alias("salary_is_array"))


def scan(spark: SparkSession, path: str, fields: tuple[str, ...], where: str | None = None, format: str = "parquet", sort: str | None = None) -> DataFrame:
    """The fields of a source; filters and columns reach the files. In no order unless sort is given."""
    rows = loaded(spark, path, format)
    rows = rows.filter(where) if where else rows
    rows = rows.select(*(f for f in fields if f in rows.columns))
    return rows.orderBy(sort) if sort else rows


def scan_json(spark: SparkSession, path: str) -> DataFrame:
    """Listings of a file with a JSON document on each line, gzipped or not; lines that are no JSON are skipped."""
    lines = spark.read.text(path).select(F.try_parse_json("value").alias("doc")).filter("doc is not null")
    return from_variant(lines)


def count(rows: DataFrame, where: str | Column = "true") -> int:
    return rows.filter(where).count()


def facet(rows: DataFrame, field: str, where: str | Column = "true", limit: int = 20) -> DataFrame:
    """The most frequent values of a field, ties by value."""
    return rows.filter(where).filter(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(limit)


def ping(spark: SparkSession, path: str, format: str = "parquet") -> bool:
    """Whether a source can be read."""
    try:
        spark.read.format(format).load(path).limit(0).count()
    except Exception:  # whatever stands in the way, it can't be read
        return False
    return True
