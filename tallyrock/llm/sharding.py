"""Size-tiered compaction of immutable shards under a versioned manifest. JVM only.

A store is a folder: ``data/<commit>/part-*`` holds shards, which are never changed, and ``manifest/v=<n>`` lists the shards
of version n: path (relative to the store), bytes, rows, tier. ``append`` writes arrivals as shards of about
``arrival_bytes``. A shard's tier follows from its size alone: 0 up to ``SMALLEST`` bytes, and one more for each factor
``fan_in``, until it has half of ``target_bytes``, which is where merging ends. ``compact`` merges the tiers that hold at
least ``fan_in`` shards into as few files of about ``target_bytes`` as hold them: the scan packs whole small files into partitions
of the target's size, which are coalesced to that number and written as one file each, so merging shuffles nothing. Two files below
half the target fit into one, so a merge always lessens the shards, and n arrivals leave at most fan_in - 1 shards of each of
the log(n) tiers.

A commit writes the new manifest beside the others and renames it into place; the rename fails if the version exists. Of two
writers one wins; the other tries again on top of it. What an append adds can always be added again; a merge only as long as
all that it read is still listed, and is given up otherwise. ``vacuum`` keeps the newest versions and pinned ones, all that they
list, and what is younger than a grace period, since its writer may be about to commit.

Rows keep all columns, nulls and repeated rows included, whatever their names; an empty table gives a version without shards
and reads back as an empty table with its schema; one very long text makes a shard larger than the target, never a cut text.
A lost executor only repeats tasks: nothing is listed before the commit. The driver knows at most ``MERGE_AT_ONCE`` paths of
shards, and the folders of commits; manifests stay tables.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, delete, filesystem, shared_dir, table

ARRIVAL_BYTES, TARGET_BYTES, FAN_IN, SMALLEST = 4 << 20, 64 << 20, 4, 4 << 10
#: Shards that one merge reads; a larger tier takes several merges. Tries of a commit. Versions, and seconds, that vacuum spares.
MERGE_AT_ONCE, TRIES, KEEP, GRACE = 10_000, 20, 10, 24 * 3600
MANIFEST = "path string, bytes long, rows long, tier int"
#: Tier of a shard that isn't merged again.
DONE = -1
#: Parts that op4's query appends the table in.
ARRIVALS = 4


class Conflict(Exception):
    """Another writer has committed the version."""


class Lost(Exception):
    """Shards to be committed are gone, or merged by another writer."""


@dataclass
class Store:
    spark: SparkSession
    root: str
    arrival_bytes: int = ARRIVAL_BYTES
    target_bytes: int = TARGET_BYTES
    fan_in: int = FAN_IN

    def tier(self, size: Column) -> Column:
        step = F.ceil(F.log(size / SMALLEST) / math.log(self.fan_in))
        return F.when(size * 2 >= self.target_bytes, DONE).otherwise(F.greatest(F.lit(0), step)).cast("int")

    # --- versions ---

    def versions(self) -> list[int]:
        fs, at = filesystem(self.spark, f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        return sorted(int(n[2:]) for s in fs.listStatus(at) if (n := s.getPath().getName()).startswith("v="))

    def manifest(self, version: int | None = None) -> DataFrame:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version}")

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes shards the version's manifest, all or nothing."""
        temporary, final = f"{self.root}/manifest/.new-{uuid.uuid4().hex}", f"{self.root}/manifest/v={version}"
        shards.coalesce(8).write.parquet(temporary)
        fs, at = filesystem(self.spark, final)
        if fs.exists(at) or not fs.rename(filesystem(self.spark, temporary)[1], at):
            delete(self.spark, temporary)
            raise Conflict(final)
        if fs.exists(filesystem(self.spark, f"{final}/{temporary.rpartition('/')[2]}")[1]):  # some stores rename into an existing folder
            delete(self.spark, f"{final}/{temporary.rpartition('/')[2]}")
            raise Conflict(final)
        return version

    def change(self, added: DataFrame, folder: str, removed: DataFrame | None = None) -> int:
        """Commits the newest version with the shards in folder added and others removed, on top of whatever others commit meanwhile."""
        fs, at = filesystem(self.spark, f"{self.root}/{folder}")
        gone = removed.select("path") if removed is not None else None
        n_gone = gone.count() if gone is not None else 0
        for _ in range(TRIES):
            version = max(self.versions(), default=0)
            now = self.manifest(version)
            if not fs.exists(at):
                raise Lost(folder)
            if gone is not None:
                if now.join(gone, "path", "left_semi").count() != n_gone:
                    raise Lost("what a merge has read")
                now = now.join(gone, "path", "left_anti")
            try:
                return self.commit(now.unionByName(added), version + 1)
            except Conflict:
                continue
        raise Conflict(f"{TRIES} times")

    def pin(self, version: int, on: bool = True) -> None:
        """A pinned version stays readable whatever vacuum removes."""
        fs, at = filesystem(self.spark, f"{self.root}/pins/{version}")
        fs.create(at, True).close() if on else fs.delete(at, False)

    def pinned(self) -> set[int]:
        fs, at = filesystem(self.spark, f"{self.root}/pins")
        return {int(s.getPath().getName()) for s in fs.listStatus(at)} if fs.exists(at) else set()

    # --- writing ---

    def write(self, rows: DataFrame) -> tuple[DataFrame, str]:
        """Writes rows as they are dealt, a shard for each task that has any; their manifest rows and folder."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        written = self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")
        found = written.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))
        return found.select(F.concat(F.lit(f"{name}/"), "file").alias("path"), "bytes", "rows", self.tier(F.col("bytes")).alias("tier")), name

    def packing_session(self, size: int) -> SparkSession:
        """A session whose scans deal files out by this size."""
        s = self.spark.newSession()
        for k, v in (("maxPartitionBytes", size), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            s.conf.set(f"spark.sql.files.{k}", str(v))
        return s

    def append(self, *paths: str, schema=None) -> int:
        """Adds the Parquet tables at paths: each scan task of about arrival_bytes becomes a shard."""
        reader = self.packing_session(self.arrival_bytes).read
        return self.change(*self.write((reader.schema(schema) if schema else reader).parquet(*paths)))

    def compact(self, schema) -> int | None:
        """Merges the fullest of the tiers with at least fan_in shards, once; None if there is none."""
        now = self.manifest()
        tiers = now.filter(F.col("tier") != DONE).groupBy("tier").count().filter(F.col("count") >= self.fan_in)
        full = tiers.orderBy(F.desc("count"), "tier").first()  # of a row per tier
        if full is None:
            return None
        merge = now.filter(F.col("tier") == full["tier"]).orderBy("path").limit(MERGE_AT_ONCE)
        shards = merge.select("path", "bytes").collect()  # at most MERGE_AT_ONCE
        rows = self.packing_session(self.target_bytes).read.schema(schema).parquet(*(f"{self.root}/{r['path']}" for r in shards))
        files = -(-sum(r["bytes"] for r in shards) // self.target_bytes)
        return self.change(*self.write(rows.coalesce(files)), merge)

    def compact_all(self, schema) -> int:
        """Merges until no tier has fan_in shards; merges that another writer forestalls are left to it."""
        try:
            while self.compact(schema) is not None:
                pass
        except Lost:
            pass
        return max(self.versions(), default=0)

    def vacuum(self, keep: int = KEEP, grace: float = GRACE) -> None:
        """Removes manifests but the last and pinned ones, and data older than the grace period that no kept manifest lists."""
        import time

        versions, pinned = self.versions(), self.pinned()
        kept = [v for v in versions if v in pinned or v in versions[-keep:]]
        listed = set()
        for v in kept:  # names of commits
            listed.update(r["d"] for r in self.manifest(v).select(F.split("path", "/")[1].alias("d")).distinct().collect())
        fs, at = filesystem(self.spark, f"{self.root}/data")
        before = (time.time() - grace) * 1000
        old = [s.getPath() for s in (fs.listStatus(at) if fs.exists(at) else []) if s.getPath().getName() not in listed and s.getModificationTime() <= before]
        for v in set(versions) - set(kept):
            delete(self.spark, f"{self.root}/manifest/v={v}")
        for path in old:
            fs.delete(path, True)

    def drop(self) -> None:
        delete(self.spark, self.root)

    # --- reading ---

    def read(self, schema, version: int | None = None) -> DataFrame:
        """The rows of a version, with their shard's path, bytes and rows as _shard, _shard_bytes and _shard_rows.

        The folders of its commits are scanned, and the manifest decides which of their shards count.
        """
        shards = self.manifest(version).select(F.col("path").alias("_shard"), F.col("bytes").alias("_shard_bytes"), F.col("rows").alias("_shard_rows"))
        folders = [r["d"] for r in shards.select(F.substring_index("_shard", "/", 2).alias("d")).distinct().collect()]  # a name per commit
        if not folders:
            rows = self.spark.createDataFrame([], schema).withColumn("_shard", F.lit(""))
        else:
            rows = self.spark.read.schema(schema).parquet(*(f"{self.root}/{d}" for d in folders))
            rows = rows.withColumn("_shard", F.regexp_extract(F.col("_metadata.file_path"), "(data/[^/]+/[^/]+)$", 1))
        return rows.join(shards, "_shard").select(*(F.col(f"`{c}`") for c in rows.columns if c != "_shard"), "_shard", "_shard_bytes", "_shard_rows")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends documents in several arrivals, compacting after each; the place of each document in the version that this ends with,
    read back from it. The store goes when the result is written."""
    documents = table(spark, sf_dir, "documents")
    schema, files = documents.schema, sorted(documents.inputFiles())  # names of the files, as a scan lists them
    store = Store(spark, f"{shared_dir(spark)}/tallyrock-store-{uuid.uuid4().hex}")
    version = 0
    for k in range(min(ARRIVALS, len(files))):
        store.append(*files[k::ARRIVALS], schema=schema)
        version = store.compact_all(schema)
        store.vacuum(keep=1, grace=0)  # there is no other writer or reader
    placed = store.read(schema, version).select("doc_id", F.col("_shard").alias("shard"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("text_bytes"), F.col("_shard_bytes").alias("shard_bytes"), F.col("_shard_rows").alias("shard_rows"), F.lit(version).alias("version"))
    placed = checkpoint(placed)
    store.drop()
    return placed
