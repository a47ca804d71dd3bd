"""History: snapshots of runs, the trend against a week before, recent runs, and when to run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Days that a trend looks back, hours after which a run is stale, minutes between retries.
LOOK_BACK, MAX_AGE_HOURS = 7, 22
RETRY_MINUTES = (10, 20, 40, 60)


def as_of(history: DataFrame, today: str, days: int = LOOK_BACK) -> DataFrame:
    """The snapshot that today is compared with: the latest of at least so many days ago, else the oldest before today."""
    day = F.lit(today).cast("date")
    earlier = history.filter(F.col("day") < day)
    pick = earlier.agg(F.coalesce(F.max(F.when(F.col("day") <= F.date_sub(day, days), F.col("day"))), F.min("day")).alias("_pick"))
    return earlier.join(pick, F.col("day") == F.col("_pick")).drop("_pick")


def trend(history: DataFrame, today: str) -> DataFrame:
    """(since, days, totals, questions) of the snapshot compared with; empty on the first day."""
    return as_of(history, today).select(F.col("day").alias("since"), F.datediff(F.lit(today).cast("date"), "day").alias("days"), "totals", "questions")


def recent_runs(history: DataFrame, limit: int = 10) -> DataFrame:
    """(run_at, jobs, trusted, affected, incoming) of the newest snapshots."""
    return history.orderBy(F.desc("day")).limit(limit).select("day", "run_at", "totals.jobs", "totals.trusted", "totals.affected", "incoming")


def is_stale(run_at_ms: float | None, now_ms: float, from_seed: bool = False, max_age_hours: float = MAX_AGE_HOURS) -> bool:
    return run_at_ms is None or from_seed or now_ms - run_at_ms > max_age_hours * 3_600_000


def retry_after_minutes(failures: int) -> int:
    """Minutes to wait after so many failures in a row."""
    return RETRY_MINUTES[min(max(failures, 1), len(RETRY_MINUTES)) - 1]


def should_run(run_at_ms: float | None, now_ms: float, running: bool, failures: int, failed_at_ms: float, from_seed: bool = False) -> bool:
    if running or not is_stale(run_at_ms, now_ms, from_seed):
        return False
    return failures == 0 or now_ms - failed_at_ms >= retry_after_minutes(failures) * 60_000
