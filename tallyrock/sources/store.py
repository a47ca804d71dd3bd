"""What runs leave behind: rows, summary, history and first-seen state, in folders that any Spark file system holds.

New versions are written beside the old and become current by the rename of a small pointer, so a reader never meets a
half-written table and a table can be replaced by what was read from it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
import warnings

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATE = "url string, first_seen date, missing_since date"
HISTORY = "run_at string, totals struct<jobs:bigint,companies:bigint,trusted:bigint,affected:bigint,format:bigint>, incoming struct<jobs:bigint,affected:bigint,gone:bigint>, questions array<struct<id:string,affected:bigint>>, sources array<struct<host:string,jobs:bigint,affected:bigint>>, day date"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return bool(fs.exists(at))


def new_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the one that driver and executors share; in a local one where that is unset, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tallyrock-")
    return f"{at.rstrip('/')}/tallyrock-{name}-{uuid.uuid4().hex}"


class Versions:
    """A table with a current version: folders named by number, the largest with a marker being current."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def numbers(self) -> list[int]:
        fs, at = _fs(self.spark, self.root)
        if not fs.exists(at):
            return []
        return sorted(int(n[1:]) for s in fs.listStatus(at) if (n := s.getPath().getName())[:1] == "v" and n[1:].isdigit())

    def path(self) -> str | None:
        found = self.numbers()
        return f"{self.root}/v{found[-1]}" if found else None

    def replace(self, write, keep: int = 1) -> str:
        """Calls write with a new folder and makes it current; older versions but keep go."""
        temporary = f"{self.root}/.new-{uuid.uuid4().hex}"
        write(temporary)
        fs, at = _fs(self.spark, self.root)
        found = self.numbers()
        final = f"{self.root}/v{(found[-1] if found else 0) + 1}"
        if not fs.rename(_fs(self.spark, temporary)[1], _fs(self.spark, final)[1]):
            raise OSError(f"{final} could not be committed")
        for old in found[: max(0, len(found) - keep)]:
            fs.delete(_fs(self.spark, f"{self.root}/v{old}")[1], True)
        return final


# --- rows ---------------------------------------------------------------------------------------------------------------


def write_rows(rows: DataFrame, root: str, format: str = "json") -> str:
    """Stores rows by date, newest first, ties by url."""
    return Versions(rows.sparkSession, root).replace(lambda at: rows.orderBy(F.desc("date"), "url").write.format(format).save(at))


def scan_rows(spark: SparkSession, root: str, schema: T.StructType | str, format: str = "json", limit: int | None = None) -> DataFrame:
    """The stored rows; blank and malformed lines are skipped."""
    path = Versions(spark, root).path()
    if path is None:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").format(format).load(path)
    return rows.limit(limit) if limit is not None else rows


def rows_exist(spark: SparkSession, root: str) -> bool:
    return Versions(spark, root).path() is not None


# --- summary ------------------------------------------------------------------------------------------------------------


def write_summary(spark: SparkSession, summary: dict, root: str) -> str:
    text = json.dumps(summary, ensure_ascii=False, default=str)
    return Versions(spark, root).replace(lambda at: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(at))


def load_summary(spark: SparkSession, root: str, seed: str | None = None) -> tuple[dict, str] | None:
    """The last summary and "run", or else the seed's and "seed"."""
    for path, source in ((Versions(spark, root).path(), "run"), (seed if seed and exists(spark, seed) else None, "seed")):
        if path:
            row = spark.read.text(path, wholetext=True).first()
            if row:
                return json.loads(row[0]), source
    return None


def copy_seed(spark: SparkSession, root: str, seed: str) -> bool:
    """Keeps the last summary as the seed of later installations."""
    found = load_summary(spark, root)
    if not found:
        return False
    text = json.dumps(found[0], ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(seed)
    return True


def sync(spark: SparkSession, remote: str, root: str, rows_root: str, schema: T.StructType | str) -> str:
    """Takes over a newer published run: a folder with summary.json and rows.json.gz. Says what it did; never raises."""
    try:
        row = spark.read.text(f"{remote}/summary.json", wholetext=True).first()
        theirs, ours = json.loads(row[0]), load_summary(spark, root)
        if ours and rows_exist(spark, rows_root) and str(theirs.get("run_at", "")) <= str(ours[0].get("run_at", "")):
            return "current"
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{remote}/rows.json.gz")
        Versions(spark, rows_root).replace(lambda at: rows.write.json(at))
        write_summary(spark, theirs, root)
    except Exception as e:  # a sync that fails leaves what there is
        return f"failed: {type(e).__name__}"
    return "updated"


# --- history and state --------------------------------------------------------------------------------------------------


def upsert_history(snapshot: DataFrame, path: str) -> None:
    """Stores a day's snapshot (HISTORY); a later run of the day replaces it, other days stay."""
    snapshot.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def load_history(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], HISTORY)
    return spark.read.schema(HISTORY).parquet(path)


def load_state(spark: SparkSession, root: str) -> DataFrame:
    """The first-seen state; none, or one that can't be read as a table, is empty.

    It is read whole once, so that what can't be read shows here and not in the run. A root that can't be reached is an error: to
    take it for an empty state would make every row new.
    """
    path = Versions(spark, root).path()
    if path is None:
        return spark.createDataFrame([], STATE)
    state = spark.read.schema(STATE).parquet(path)
    try:
        state.agg(F.count("url"), F.count("first_seen"), F.count("missing_since")).collect()
    except (PySparkException, Py4JJavaError) as e:
        if not exists(spark, path):
            raise
        warnings.warn(f"the state at {path} can't be read and counts as empty: {str(e)[:200]}", stacklevel=2)
        return spark.createDataFrame([], STATE)
    return state


def save_state(state: DataFrame, root: str) -> str:
    return Versions(state.sparkSession, root).replace(lambda at: state.write.parquet(at))
