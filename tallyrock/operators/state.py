"""First-seen tracking between runs: what is new, how long it has been here, and what is gone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TTL_DAYS = 60


@dataclass(frozen=True)
class Marked:
    """jobs with first_seen, is_new and days_here; the state after the run; a row of flow counts; the day that tracking began."""

    jobs: DataFrame
    state: DataFrame
    flow: DataFrame
    since: DataFrame


def baseline_day(state: DataFrame) -> DataFrame:
    """(since): the day that tracking began, null if it hasn't."""
    return state.agg(F.min("first_seen").alias("since"))


def mark(jobs: DataFrame, state: DataFrame, today: str, baseline: bool | None = None, since: str | None = None) -> Marked:
    """Marks jobs (url, ...) against state (url, first_seen, missing_since).

    On the first run, the baseline, nothing is new. A url that comes back loses its missing mark. A url that has been missing
    since before today less TTL_DAYS is forgotten, but still counts as gone on this run. Of rows with one url only the first is new.
    """
    day = F.lit(today).cast("date")
    first_run = state.isEmpty() if baseline is None else baseline
    known = state.select("url", "first_seen").withColumnRenamed("first_seen", "_known")
    order = [F.lit(1)] if "date" not in jobs.columns else [F.col("date")]
    marked = jobs.join(known, "url", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("url").orderBy(*order)))
    marked = marked.withColumn("first_seen", F.coalesce("_known", day)).withColumn("is_new", F.lit(not first_run) & F.col("_known").isNull() & (F.col("_nth") == 1))
    marked = marked.withColumn("days_here", F.greatest(F.lit(0), F.datediff(day, F.col("first_seen")))).drop("_known", "_nth")

    present = jobs.select("url").distinct().withColumn("_here", F.lit(True))
    both = state.join(present, "url", "full_outer")
    after = both.select("url", F.coalesce("first_seen", day).alias("first_seen"), F.when(F.col("_here"), None).otherwise(F.coalesce("missing_since", day)).cast("date").alias("missing_since"))
    kept = after.filter(F.col("missing_since").isNull() | (F.col("missing_since") >= F.date_sub(day, TTL_DAYS)))
    gone = after.agg(F.count_if(F.col("missing_since").isNotNull()).alias("gone"))
    began = state.agg(F.coalesce(F.lit(since).cast("date"), F.min("first_seen"), day).alias("since"))
    tracked = kept.agg(F.count(F.lit(1)).alias("tracked"))
    fresh = marked.agg(F.count_if("is_new").alias("fresh"))
    # one row each
    flow = began.join(gone).join(tracked).join(fresh).select(F.lit(first_run).alias("baseline"), "since", day.alias("today"), "fresh", "gone", "tracked")
    return Marked(marked, kept, flow, began)


def gone(state: DataFrame, jobs: DataFrame) -> DataFrame:
    """State rows whose url isn't among the jobs."""
    return state.join(jobs.select("url"), "url", "left_anti")


def in_window(first_seen: Column | str, today: str, since: Column | None, days: int = 10) -> Column:
    from ..functions.keys import window_start

    return (F.col(first_seen) if isinstance(first_seen, str) else first_seen) >= window_start(today, since, days)
