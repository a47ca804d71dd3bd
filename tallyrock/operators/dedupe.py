"""Repeated listings: the place of each row among those with one title, company and place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dup_index(rows: DataFrame, by: list[str], order: list[str], name: str = "dup_index") -> DataFrame:
    """Adds the number of rows before each in its group; 0 is the original."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return rows.withColumn(name, at.cast("int"))


def repeated(rows: DataFrame, collated: bool = False) -> DataFrame:
    """dup_index of listings: by title, fiscal key and place, in order of date and url; 0 without a title.

    Groups are split by a hash of date and url first where none repeats within them, so rows without a title, which may be
    many, don't meet in one task. collated orders by the Unicode root collation instead of bytes.
    """
    place = F.coalesce(F.nullif(F.col("loc.value"), F.lit("")), F.lower(F.array_join("location", ",")))
    order = [F.collate(c, "UNICODE") for c in ("date", "url")] if collated else ["date", "url"]
    keyed = rows.withColumn("_place", place).withColumn("_split", F.when(F.col("ntitle") == "", F.xxhash64("url")).otherwise(0))
    out = dup_index(keyed, ["ntitle", "cif_key", "_place", "_split"], order)
    return out.withColumn("dup_index", F.when(F.col("ntitle") == "", 0).otherwise(F.col("dup_index"))).drop("_place", "_split")


def group_sizes(rows: DataFrame, by: list[str]) -> DataFrame:
    """(size, groups): how many groups of each size there are."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))
