"""Removal of repeated substrings by a sparse, distributed suffix array.

A byte is removed if it is covered by a string of ``LENGTH`` bytes that also starts earlier: in a row before, by (id, text),
or earlier in the same text. Matches are within one text each and are judged on the input.

1. Every window of ``LENGTH`` bytes has an anchor, the least of its ``GRAM``-byte grams by hash; windows in a row with one
   anchor make a segment. Equal windows have equal grams at equal places as anchors, so only segments of one anchor gram can
   share windows. The suffixes that begin at anchors are range-partitioned by their leading bytes, by splitters that Spark
   samples; each bucket is sorted by multikey quicksort, eight bytes at a time and runs of ties only, through the gram and then by
   the segment's length and hash. Of equal segments all but the first are repeats. A segment that is the only one of its gram is
   done; others, and those at a bucket's edge, are contested. This leaves the few suffixes that begin near a difference.
2. The bytes of contested segments are range-partitioned by the leading ``LEAD`` bytes of their gram; in a bucket all their suffixes
   are sorted by multikey quicksort on their ``LENGTH`` bytes, and one equal to the suffix before it, byte by byte, is a repeat. Of leads
   with more than ``FREQUENT`` contested segments the suffixes themselves are range-partitioned by their bytes, and the first of a
   bucket is compared with the last of the bucket before.
3. Repeats give intervals, which meet their texts by a join and are cut out.

So a frequent gram or suffix is spread over as many buckets as its rows need, since ties are split by place. Only in the first step
a 64-bit hash stands for bytes: those of a segment beyond its gram, which are equal in ``GRAM`` bytes and in length.

Null texts are empty; texts below ``LENGTH`` bytes lose nothing; of equal rows the later loses all of it; an empty table gives
an empty result; other columns are ignored by ``repeats`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Staged, checkpoint, chunks, free_shuffles, hashes, sums, table, utf8, with_uid

LENGTH, GRAM, LEAD = 100, 32, 16
#: Bytes of text whose sparse suffixes, and contested suffixes, a bucket should have.
TEXT_PER_BUCKET, SUFFIXES_PER_BUCKET = 24 << 20, 1 << 20
#: Contested segments of a lead that one bucket compares.
FREQUENT = 4096
LOW = np.uint64(0xFFFFFFFF)
#: Bytes that a sort takes at a time, and the columns of a gram.
WORD = 8
WORDS = [f"w{k}" for k in range(GRAM // WORD)]
LEADS = WORDS[: LEAD // WORD]


def word(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The WORD bytes at each place as a number; numbers have the order of the bytes."""
    every = np.ndarray((max(0, len(data) - WORD + 1),), ">u8", np.ascontiguousarray(data), strides=(1,))
    return (every[at].astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first and last window, content hash, and the words of the anchor gram, of each segment of texts."""
    size = np.diff(offsets)
    counts = np.maximum(size - LENGTH + 1, 0)
    total = int(counts.sum())
    if not total:
        return tuple(np.zeros(0, np.int64) for _ in range(4 + len(WORDS)))
    prefix = sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = hashes(prefix, at, at + GRAM)
    least = (gram & ~LOW) | at.astype(np.uint64)
    span, want = 1, LENGTH - GRAM + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    owner = np.repeat(np.arange(len(size)), counts)
    window = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts)
    anchor = (least[window] & LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], total) - 1
    lo, hi, text = window[first], window[last], owner[first]
    content = hashes(prefix, lo, hi + LENGTH) + (hi - lo).astype(np.uint64)
    return text, lo - offsets[text], hi - offsets[text], content.view(np.int64), *(word(data, anchor[first] + WORD * k) for k in range(len(WORDS)))


SPARSE = ", ".join(f"{c} long" for c in (*WORDS, "b", "uid", "place"))


def sparse_suffixes(docs: DataFrame) -> DataFrame:
    """SPARSE of (uid, text): the words of the anchor gram, content hash, and first << 32 | last window of each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                text, lo, hi, content, *gram = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*map(pa.array, gram), pa.array(content), pa.array(uid[i:j][text]), pa.array(lo << 32 | hi)], names=[*WORDS, "b", "uid", "place"])

    return docs.select("uid", "text").mapInArrow(run, SPARSE)


Key = Callable[[np.ndarray], np.ndarray]


def multikey_sort(n: int, keys: list[Key]) -> np.ndarray:
    """The order of n rows by several keys, functions of row numbers: by the first, then each run of equal rows by the next, until no
    run is left. A key is asked for rows of such runs only."""
    order = np.arange(n)
    tied, run = np.arange(n), np.zeros(n, np.int64)
    for key in keys:
        if len(tied) < 2:
            break
        rows = order[tied]
        values = key(rows)
        part = np.lexsort((values, run))
        order[tied], values = rows[part], values[part]
        change = np.ones(len(tied), bool)
        change[1:] = (values[1:] != values[:-1]) | (run[1:] != run[:-1])
        more = ~(change & np.append(change[1:], True))
        tied, run = tied[more], np.cumsum(change)[more]
    return order


def equal_to_previous(order: np.ndarray, keys: list[Key]) -> np.ndarray:
    """Which of the ordered rows have the keys of the row before."""
    at = np.arange(1, len(order))
    for key in keys:
        at = at[key(order[at]) == key(order[at - 1])]
    out = np.zeros(len(order), bool)
    out[at] = True
    return out


def columns(*values: np.ndarray) -> list[Key]:
    return [v.__getitem__ for v in values]


def byte_words(data: np.ndarray, at: np.ndarray) -> list[Key]:
    """The LENGTH bytes at each place, word by word; the last word ends with the last byte."""
    return [lambda rows, k=k: word(data, at[rows] + k) for k in (*range(0, LENGTH - WORD, WORD), LENGTH - WORD)]


def bucket(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    held = [b for b in batches if b.num_rows]
    return [np.concatenate([b.column(c).to_numpy() for b in held]) if held else np.zeros(0, np.int64) for c in names]


def judged_segments(sparse: DataFrame, buckets: int) -> DataFrame:
    """(w0, w1, uid, lo, hi, contested): repeated segments, and those whose windows must be compared one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *gram, b, uid, place = bucket(batches, [*WORDS, "b", "uid", "place"])
        if not len(b):
            return
        order = multikey_sort(len(b), columns(*gram, b, uid, place))
        same_gram = equal_to_previous(order, columns(*gram))
        b, uid, place = b[order], uid[order], place[order]
        repeat = same_gram & np.concatenate(([False], b[1:] == b[:-1]))
        # a gram is contested if it has different segments, or more of it may be in another bucket
        group = np.cumsum(~same_gram) - 1
        varied = np.zeros(group[-1] + 1, bool)
        varied[group[same_gram & ~repeat]] = True
        varied[[0, -1]] = True
        contested = ~repeat & varied[group]
        out = repeat | contested
        yield pa.RecordBatch.from_arrays([*(pa.array(g[order[out]]) for g in gram[: len(LEADS)]), pa.array(uid[out]), pa.array(place[out] >> 32), pa.array(place[out] & 0xFFFFFFFF), pa.array(contested[out])], names=[*LEADS, "uid", "lo", "hi", "contested"])

    schema = ", ".join(f"{c} long" for c in (*LEADS, "uid", "lo", "hi")) + ", contested boolean"
    return sparse.repartitionByRange(buckets, *WORDS, "b", "uid", "place").mapInArrow(run, schema)


def contested_bytes(docs: DataFrame, contested: DataFrame) -> DataFrame:
    """(w0, w1, frequent, uid, lo, bytes) of contested segments: all bytes of their windows."""
    listed = contested.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", *LEADS, "frequent")).alias("spans"))
    names = [*LEADS, "frequent", "uid", "lo", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0)
            spans, count = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy()
            lo, hi = spans.field(0).to_numpy(), spans.field(1).to_numpy()
            data, offsets = utf8(batch.column(2))
            row = np.repeat(np.arange(len(count)), count)
            own = [data[x : y + LENGTH].tobytes() for x, y in zip(offsets[row] + lo, offsets[row] + hi, strict=True)]
            yield pa.RecordBatch.from_arrays([*(spans.field(k) for k in range(2, 3 + len(LEADS))), uid.take(pa.array(row)), pa.array(lo), pa.array(own, pa.binary())], names=names)

    found = listed.join(docs.select("uid", "text"), "uid").select("uid", "spans", "text")
    return found.mapInArrow(run, ", ".join(f"{c} long" for c in LEADS) + ", frequent boolean, uid long, lo long, bytes binary")


def expand(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """The bytes of rows (.., uid, lo, bytes), and of each suffix of LENGTH bytes its place in them, uid and start."""
    t = pa.Table.from_batches(batches)
    uid, lo = (t.column(c).to_numpy() for c in ("uid", "lo"))
    raw = t.column("bytes").cast(pa.large_binary()).combine_chunks()
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    count = np.diff(ends) - LENGTH + 1
    row = np.repeat(np.arange(len(raw)), count)
    shift = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.frombuffer(data, np.uint8), ends[row] + shift, uid[row], lo[row] + shift


def repeated_runs(again: np.ndarray, uid: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of sorted suffixes: uid, first and last start of the runs of starts at which a suffix equals the one before it."""
    at = np.flatnonzero(again)
    at = at[np.lexsort((place[at], uid[at]))]
    begins = np.ones(len(at), bool)
    begins[1:] = (uid[at[1:]] != uid[at[:-1]]) | (place[at[1:]] != place[at[:-1]] + 1)
    ends = np.append(begins[1:], True)[: len(at)]
    return uid[at[begins]], place[at[begins]], place[at[ends]]


def judged_within(segments_: DataFrame, buckets: int) -> DataFrame:
    """(uid, lo, hi): suffixes that equal an earlier one, of leads that are whole in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            data, at, uid, place = expand(held)
            keys = byte_words(data, at)
            order = multikey_sort(len(at), [*keys, *columns(uid, place)])
            yield pa.RecordBatch.from_arrays([*map(pa.array, repeated_runs(equal_to_previous(order, keys), uid[order], place[order]))], names=["uid", "lo", "hi"])

    return segments_.repartitionByRange(buckets, *LEADS).mapInArrow(run, "uid long, lo long, hi long")


def suffixes(segments_: DataFrame) -> DataFrame:
    """(bytes, uid, place): the suffixes of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data, at, uid, place = expand([batch])
            for i in range(0, len(at), 1 << 15):
                rows = data[at[i : i + (1 << 15), None] + np.arange(LENGTH)]
                edges = pa.py_buffer((np.arange(len(rows) + 1) * LENGTH).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(rows), [None, edges, pa.py_buffer(np.ascontiguousarray(rows))]), pa.array(uid[i : i + (1 << 15)]), pa.array(place[i : i + (1 << 15)])], names=["bytes", "uid", "place"])

    return segments_.mapInArrow(run, "bytes binary, uid long, place long")


def judged_suffixes(all_suffixes: DataFrame, buckets: int) -> DataFrame:
    """(uid, lo, hi): suffixes that equal an earlier one, wherever they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        data = np.frombuffer(b"".join(v for b in held for v in b.column("bytes").to_pylist()), np.uint8)
        uid, place = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("uid", "place"))
        keys = byte_words(data, np.arange(len(uid)) * LENGTH)
        order = multikey_sort(len(uid), [*keys, *columns(uid, place)])
        owner, first, last = repeated_runs(equal_to_previous(order, keys), uid[order], place[order])
        n, edge = len(first), [data[k * LENGTH : (k + 1) * LENGTH].tobytes() for k in order[[0, -1]]]
        # the last row is the bucket's edge: its first suffix, to be judged, and its last one
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(owner, uid[order[0]])), pa.array(np.append(first, place[order[0]])), pa.array(np.append(last, place[order[0]])), pa.array([None] * n + [number], pa.int32()), pa.array([None] * n + [edge], pa.list_(pa.binary()))],
            names=["uid", "lo", "hi", "bucket", "edge"],
        )

    found = checkpoint(all_suffixes.repartitionByRange(buckets, "bytes", "uid", "place").mapInArrow(run, "uid long, lo long, hi long, bucket int, edge array<binary>"))
    edges = sorted((r["bucket"], *map(bytes, r["edge"])) for r in found.filter("bucket is not null").select("bucket", "edge").collect())  # a row per bucket
    again = [later[0] for before, later in zip(edges, edges[1:], strict=False) if before[2] == later[1]]
    return found.filter(F.col("bucket").isNull() | F.col("bucket").isin(again)).select("uid", "lo", "hi")


def repeats(docs: DataFrame) -> DataFrame:
    """(uid, spans): the repeated byte ranges (start, end) of (uid, text), which may overlap; texts without any are left out."""
    spark, out = docs.sparkSession, Staged(docs.sparkSession, "suffixes")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    judged = out.put(judged_segments(sparse_suffixes(docs), max(least, -(-size // TEXT_PER_BUCKET))), "segments")
    free_shuffles(spark)
    contested = judged.filter("contested").select(*LEADS, "uid", "lo", "hi")
    counts = contested.groupBy(*LEADS).agg((F.count(F.lit(1)) > FREQUENT).alias("frequent"))
    n = contested.agg(F.sum(F.expr("hi - lo + 1"))).first()[0] or 0
    buckets = max(least, -(-n // SUFFIXES_PER_BUCKET))
    held = out.put(contested_bytes(docs, contested.join(counts, LEADS)), "bytes")
    free_shuffles(spark)
    single = judged_within(held.filter("not frequent"), buckets).unionByName(judged_suffixes(suffixes(held.filter("frequent")), buckets))
    spans = judged.filter("not contested").select("uid", "lo", "hi").unionByName(single)
    found = checkpoint(spans.groupBy("uid").agg(F.collect_list(F.struct(F.col("lo").alias("start"), (F.col("hi") + LENGTH).alias("end"))).alias("spans")))
    out.drop()
    free_shuffles(spark)
    return found


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that ranges cover; touching ranges are one run."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    begins = np.concatenate(([True], start[1:] > reach[:-1]))
    return start[begins], reach[np.append(np.flatnonzero(begins)[1:] - 1, len(reach) - 1)]


def deduplicated(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in keep and n_bytes, n_removed, n_spans and kept (binary, what is left of text)."""
    found = docs.select("uid", *keep, "text").join(repeats(docs.select("uid", "text")), "uid", "left").select(*keep, "spans", "text")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep) + 1))
            spans = batch.column(len(keep))
            values, count = spans.flatten(), spans.value_lengths().fill_null(0).to_numpy()
            first = np.concatenate(([0], np.cumsum(count)))
            start, end = values.field(0).to_numpy(), values.field(1).to_numpy()
            removed, runs, kept = [], [], []
            for k in range(batch.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                lost = 0
                n = 0
                if count[k]:
                    a, b = merged(start[first[k] : first[k + 1]], end[first[k] : first[k + 1]])
                    inside = np.zeros(len(text) + 1, np.int64)
                    np.add.at(inside, a, 1)
                    np.add.at(inside, b, -1)
                    text, n, lost = text[np.cumsum(inside[:-1]) == 0], len(a), int((b - a).sum())
                removed.append(lost)
                runs.append(n)
                kept.append(text.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=[*keep, "n_bytes", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(run, schema)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_uid(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return deduplicated(docs, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as hexadecimal texts, ranked among equal ones; repeats that lie at most LENGTH apart make a run.
ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
lists AS (SELECT doc_id, [substr(h, 2 * i + 1, {2 * LENGTH}) FOR i IN range(greatest(n - {LENGTH - 1}, 0))] AS w FROM d),
wins AS (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) - 1 AS i FROM lists),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM wins) WHERE nth > 1),
steps AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > {LENGTH}, true) AS fresh FROM rep),
runs AS (SELECT doc_id, i, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS k, sum(b - a) AS removed, count(*) AS n_spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
