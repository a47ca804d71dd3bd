"""What the operators share: tables, staged data, row identity and the numpy kernels over UTF-8 bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Bytes of text that a numpy kernel holds at once; only a single longer text goes beyond.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset (tests) a new local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyrock-"))
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = found.get()
    return at.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage; Spark removes the files when nothing refers to them."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Staged:
    """Parquet tables in the shared folder for one run of an operator. drop() removes those no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tallyrock-{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df and reads it again."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        delete(self.spark, self.path(name) if name else self.root)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = filesystem(spark, path)
    fs.delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files that no DataFrame refers to any more, and the driver's heap shrink to what is in use."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free_arrays() -> None:
    """Gives back to the system what numpy and Arrow keep of memory that this process no longer uses."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def with_uid(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds uid (long), different on every row and in the order of id; nulls come first.

    Ids are usually unique, which one aggregate over the ids shows; uid is then the id itself. Otherwise rows are sorted over all
    partitions and numbered by counts per partition. Equal rows are told apart by where they were read, so a third of all rows
    with one id, or equal ones, are dealt to many partitions like others.
    """
    found = df.select(id_col).agg(F.count(F.lit(1)).alias("n"), F.count(id_col).alias("present")).first()
    most = df.groupBy(id_col).count().filter("count > 1").select("count").limit(1).collect()
    if found["n"] == found["present"] and not most:
        return df.withColumn("uid", F.col(id_col).cast("long"))
    # the beginning of a text orders most of what has one id, a digest the rest
    keys = {"_uid_head": F.left(text_col, F.lit(256)), "_uid_digest": F.xxhash64(text_col), "_uid_place": F.monotonically_increasing_id()}
    order = [F.col(id_col).asc_nulls_first(), F.col("_uid_head").asc_nulls_first(), "_uid_digest", "_uid_place"]
    parts = checkpoint(
        df.withColumns(keys)
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_uid_part", F.spark_partition_id())
        .withColumn("_uid_row", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33))
    )
    sizes = sorted(parts.groupBy("_uid_part").count().collect())  # a row per partition
    starts, total = [], 0
    for part, n in sizes:
        starts.append((part, total))
        total += n
    base = F.create_map(*[F.lit(x) for pair in starts or [(0, 0)] for x in pair])
    return parts.withColumn("uid", (F.element_at(base, F.col("_uid_part")) + F.col("_uid_row")).cast("long")).drop(*keys, "_uid_part", "_uid_row")


def as_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(uid, text, _row): rows of any columns, of whatever names, with what the operators need beside them."""
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return with_uid(rows, "_id", "text").select("uid", "text", "_row")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: the optimiser would copy a column's expression into a lambda that reads it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column, block: int = 64) -> Column:
    """What lies before each element of an array of numbers: sums by blocks of a block, and of blocks of blocks."""
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    count = lambda a: F.floor((F.size(a) - 1) / block).cast("int")
    sums = lambda a: F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), count(a)), lambda b: total(F.slice(a, b * block + 1, F.lit(block))))).otherwise(F.array().cast("array<int>"))
    inside = lambda a, i: total(F.slice(a, i - i % block + 1, i % block))
    of = lambda a, i: F.floor(i / block).cast("int")
    before = lambda small, large: F.transform(small, lambda _, i: inside(small, i) + total(F.slice(large, F.lit(1), of(small, i))))
    starts = lambda small, of_blocks: F.transform(small, lambda _, i: inside(small, i) + F.element_at(of_blocks, of(small, i) + 1))
    return let(sums(lengths), lambda blocks: let(sums(blocks), lambda groups: let(before(blocks, groups), lambda at: starts(lengths, at))))


# --- numpy over UTF-8 -------------------------------------------------------------------------------------------------

#: Odd multipliers of polynomial hashes modulo 2**64 (any odd number does).
BASE = 0x9E3779B97F4A7C55
BASE2 = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]] if len(column) else data[:0], ends - ends[0] if len(column) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of at most limit bytes together, or of one text."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a line feed after each, so that no word or line crosses texts; the new offsets."""
    return np.insert(data, offsets[1:], 10), offsets + np.arange(len(offsets))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i up to n. Tables for chunks are kept, larger ones are not."""
    if base in _powers and len(_powers[base][0]) > n:
        return _powers[base]
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full((n >> 18 << 18) + (1 << 18), b, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    if n <= 2 * CHUNK_BYTES:
        _powers[base] = tuple(both)
    return tuple(both)


def sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Prefix sums of a polynomial hash; hashes() takes them."""
    out = np.zeros(len(values) + 1, np.uint64)
    up, _ = powers(len(values), base)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], dtype=np.uint64, out=out[1:])
    return out


def hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE) -> np.ndarray:
    """Hashes of the runs [start, end) of what sums() got."""
    _, down = powers(len(prefix), base)
    return mix((prefix[end] - prefix[start]) * down[start])


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 in lower case; lengths stay."""
    out = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    out[second] += np.uint8(32)
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of letters and digits, any case) of lined texts: starts, ends, hashes in lower case, text number."""
    start, end = runs(ALNUM[data])
    hashed = hashes(sums(lower(data)), start, end)
    return start, end, hashed, np.searchsorted(offsets, start, "right") - 1


def windows(values: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the runs of n values with one owner."""
    if len(values) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    return at, hashes(sums(values), at, at + n)


def by_key(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by key, and which of the ordered rows repeat the key of the row before."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[1:] = key[order[1:]] == key[order[:-1]]
    return order, again
