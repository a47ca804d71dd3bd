"""Near-duplicate join of texts on word shingles by a MinHash LSH forest.

1. Each text becomes the set of its shingles (five words in lower case; a shorter text is one shingle of all its words) and a
   signature of ``TREES * DEPTH`` minima. Texts with equal sets become one class with a number of copies by an aggregate, so
   groups of exact copies cost nothing further.
2. Each tree of the forest holds ``DEPTH`` minima of each class as its path. Paths are range-partitioned and sorted tree by tree,
   so that a node of the prefix trie is a run of rows, and the common prefixes with the rows before and after, also across the
   edges of partitions, are the longest that a path shares in its tree. Paths that share fewer than the floor's minima go.
3. Matched prefixes are shortened from ``DEPTH`` on, for each text by itself. At each length the texts that share a node are
   compared by sketches, two bits of each minimum, and it is counted in how many trees each likely neighbour of a text is met:
   from those met once and twice follows how many were not met (Chao's estimate). A text whose neighbours were met with a
   recall of at least ``RECALL`` keeps its length; others, and those without a neighbour, go on to a shorter one, down to the
   floor, at which a pair of the wanted similarity shares a prefix in some tree with that probability whatever the data.
4. A pair is a candidate where it shares a prefix as long as the shorter of its two lengths and its sketches reach ``SKETCH``
   (seven standard errors below the similarity wanted). It is looked at in the first tree in which that is so, and verified there
   on the whole sets: pairs of a dense node by products of incidence matrices, others by counting common elements. No pair is
   ever a row, and nothing is compared for lying in one component.

A node with more than ``BLOCK`` members is dealt out as pairs of blocks to many tasks, all of which are compared.

The result has a row for each row: class_id, the smallest uid of the component of texts linked by a similarity of at least
0.8 (uid is doc_id where that is unique), and n_links, the number of other rows whose similarity to it is at least 0.8, exact
copies included.

Null texts, and texts without any word, are linked to nothing; equal rows are copies of each other; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, BASE2, Staged, as_rows, by_key, checkpoint, chunks, free_shuffles, hashes, lined, mix, sums, table, utf8, with_uid, words
from .graph import components

SHINGLE, SIMILARITY, RECALL = 5, 0.8, 0.9998
TREES, DEPTH = 24, 7
SKETCH, LIKELY, BLOCK, SEED = 0.55, 0.72, 4096, 11
#: Elements of a matrix that a task holds at once, members of a node whose pairs are all listed, and paths that a bucket should have.
CELLS, SMALL, PATHS_PER_BUCKET = 1 << 22, 32, 1 << 20
#: Minima in the high half of a path.
HIGH = 4


def floor_for(similarity: float = SIMILARITY, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which some tree joins a pair of this similarity with this probability."""
    return next((k for k in range(depth, 1, -1) if 1 - (1 - similarity**k) ** trees >= recall), 1)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of texts and the offsets of each text's."""
    data, offsets = lined(data, offsets)
    n = len(offsets) - 1
    _, _, word, owner = words(data, offsets)
    count = np.bincount(owner, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))
    prefix = sums(word)
    size = np.minimum(SHINGLE, count[owner])
    at = np.flatnonzero(np.arange(len(word)) + size <= first[owner + 1])
    hashed = mix(hashes(prefix, at, at + size[at]) + size[at].astype(np.uint64))
    own = owner[at]
    order, again = by_key(hashed ^ mix(own.astype(np.uint64) + np.uint64(1)))
    keep = np.sort(order[~again])
    hashed, own = hashed[keep], own[keep]
    order = np.lexsort((hashed, own))
    return hashed[order], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n))))


def signatures(hashed: np.ndarray, first: np.ndarray) -> np.ndarray:
    """TREES * DEPTH minima (uint32) of each set; sets must not be empty."""
    seeds = np.random.default_rng(SEED).integers(1, 1 << 63, (TREES * DEPTH, 2), np.uint64) | np.uint64(1)
    out = np.zeros((len(first) - 1, len(seeds)), np.uint32)
    for k, (a, b) in enumerate(seeds):
        out[:, k] = np.minimum.reduceat(((hashed ^ b) * a) >> np.uint64(32), first[:-1])
    return out


def sketches(sign: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, packed."""
    spread = sign * np.uint32(0x9E3779B1)
    return np.packbits(np.stack([spread >> np.uint32(31), (spread >> np.uint32(30)) & np.uint32(1)], 2).reshape(len(sign), -1).astype(np.uint8), axis=1)


def binary(rows: np.ndarray) -> pa.Array:
    """A binary array of the rows of a matrix of bytes."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def profiles(docs: DataFrame) -> DataFrame:
    """(uid, digest_a, digest_b, n_shingles, paths, sketch) of (uid, text): the digest of the set, the paths in all trees, and the
    sketch; paths and sketch are null for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                hashed, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                digest = [hashes(sums(hashed, base), first[:-1], first[1:], base).view(np.int64) for base in (BASE, BASE2)]
                size = np.diff(first)
                some = size > 0
                sign = signatures(hashed, np.concatenate((first[:-1][some], first[-1:]))) if some.any() else np.zeros((0, TREES * DEPTH), np.uint32)
                place = pa.array(np.where(some, np.cumsum(some) - 1, 0), pa.int64(), mask=~some)
                paths = binary(sign.astype("<u2").view(np.uint8).reshape(len(sign), -1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, digest), pa.array(size), paths.take(place), binary(sketches(sign)).take(place)], names=["uid", "digest_a", "digest_b", "n_shingles", "paths", "sketch"])

    return docs.select("uid", "text").mapInArrow(run, "uid long, digest_a long, digest_b long, n_shingles long, paths binary, sketch binary")


# --- the forest ---------------------------------------------------------------------------------------------------------


def matrix(column: pa.ChunkedArray | pa.Array, dtype: str) -> np.ndarray:
    """The values of a binary column of one width as rows."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), dtype).reshape(len(values), -1)


def opened_paths(rows: DataFrame) -> DataFrame:
    """(tree, hi, lo, uid): the paths of (uid, paths), the first HIGH minima and the others each as a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = matrix(batch.column(1), "<u2").reshape(-1, TREES, DEPTH).astype(np.uint64)
            packed = lambda part: np.bitwise_or.reduce(part << (np.uint64(16) * np.arange(part.shape[2], dtype=np.uint64)[::-1]), axis=2).view(np.int64)
            hi, lo = packed(path[:, :, :HIGH]), packed(path[:, :, HIGH:])
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(path), t, np.int32)), pa.array(hi[:, t]), pa.array(lo[:, t]), batch.column(0)], names=["tree", "hi", "lo", "uid"])

    return rows.select("uid", "paths").mapInArrow(run, "tree int, hi long, lo long, uid long")


def common_prefix(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many minima paths (tree, hi, lo) share, from the first on."""
    length, same = np.zeros(len(a[0]), np.int32), a[0] == b[0]
    for k in range(DEPTH):
        half, left = (1, HIGH - 1 - k) if k < HIGH else (2, DEPTH - 1 - k)
        same = same & ((a[half] ^ b[half]) >> (16 * left) & 0xFFFF == 0)
        length += same
    return length


def matched_paths(paths: DataFrame, floor: int, buckets: int) -> DataFrame:
    """(tree, hi, lo, uid, longest): the paths that share at least floor minima with a neighbour in their tree's order."""
    schema = "tree int, hi long, lo long, uid long, longest int, bucket int, edge int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        tree, hi, lo, uid = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("tree", "hi", "lo", "uid"))
        order = np.lexsort((uid, lo, hi, tree))
        path, uid = tuple(x[order] for x in (tree, hi, lo)), uid[order]
        shared = common_prefix(tuple(x[1:] for x in path), tuple(x[:-1] for x in path))
        longest = np.maximum(np.append(0, shared), np.append(shared, 0)).astype(np.int32)
        edge = np.zeros(len(uid), np.int32)
        edge[0] |= 1
        edge[-1] |= 2
        out = np.flatnonzero((longest >= floor) | (edge > 0))
        yield pa.RecordBatch.from_arrays([*(pa.array(x[out]) for x in (*path, uid, longest)), pa.array(np.full(len(out), number, np.int32)), pa.array(edge[out])], names=[c.split()[0] for c in schema.split(", ")])

    found = checkpoint(paths.repartitionByRange(buckets, "tree", "hi", "lo", "uid").mapInArrow(run, schema))
    edges = [list(r) for r in found.filter("edge > 0").orderBy("bucket", "edge").collect()]  # at most two rows for each bucket
    for before, after in zip(edges, edges[1:], strict=False):
        if before[5] != after[5]:
            shared = int(common_prefix(*(tuple(np.array([v]) for v in e[:3]) for e in (before, after)))[0])
            before[4], after[4] = max(before[4], shared), max(after[4], shared)
    names = ["tree", "hi", "lo", "uid", "longest"]
    at_edges = found.sparkSession.createDataFrame([e[:5] for e in edges if e[4] >= floor], "tree int, hi long, lo long, uid long, longest int")
    return found.filter("edge = 0").select(*names).unionByName(at_edges)


def node(depth: int) -> Column:
    """The key of a path's node at a depth."""
    hi, lo = F.col("hi"), F.col("lo")
    cut = lambda c, drop: F.shiftright(c, 16 * drop) if drop else c
    return F.xxhash64(F.lit(depth), "tree", *((cut(hi, HIGH - depth),) if depth <= HIGH else (hi, cut(lo, DEPTH - depth))))


def marks(rows: DataFrame, depths: list[int]) -> DataFrame:
    """(uid, sketch, keys): keys maps each depth to 32-bit hashes of the text's prefixes of this length in all trees, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = matrix(batch.column(1), "<u2").reshape(-1, TREES, DEPTH).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), path.shape[:2])
            found = {}
            for k in range(DEPTH):
                key = mix(key ^ mix(path[:, :, k] + np.uint64(k + 1 << 32)))
                found[k + 1] = binary(np.ascontiguousarray((key >> np.uint64(32)).astype("<u4")).view(np.uint8).reshape(len(path), -1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(found[d] for d in depths)], names=["uid", "sketch", *(f"keys_{d}" for d in depths)])

    return rows.select("uid", "paths", "sketch").mapInArrow(run, "uid long, sketch binary, " + ", ".join(f"keys_{d} binary" for d in depths))


def with_sets(rows: DataFrame) -> DataFrame:
    """Puts the packed 64-bit hashes of a text's shingles, as set, in the place of the last column, text."""
    names = [*rows.columns[:-1], "set"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(names) - 1))
            for i, j in chunks(offsets):
                hashed, first = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                raw = hashed.tobytes()
                sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(first, first[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), sets], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("set", T.BinaryType())]))


def dealt(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Adds _i, _j and _block to rows: the pairs of blocks of its key that a row takes part in, and its own block.

    Keys with one row go. A key of up to block rows is one pair of equal blocks. Of a larger key, rows are split into blocks by a
    hash and each goes to all pairs that its block is in.
    """
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").withColumnRenamed(key, "_key")
    found = rows.join(sizes, F.col(key) == F.col("_key")).drop("_key")
    blocks = F.ceil(F.col("_n") / F.lit(block)).cast("int")
    found = found.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("uid"), blocks.cast("long")).cast("int"))
    found = found.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return found.withColumn("_i", F.least("_block", "_other")).withColumn("_j", F.greatest("_block", "_other")).drop("_other", "_blocks", "_n")


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, pa.Table]]:
    """The runs of rows of a sorted partition that share their first columns, each as a table, and whole lists of small runs.

    Yields (bounds, table): several runs at once, run k being rows bounds[k] to bounds[k + 1].
    """
    held: list[pa.RecordBatch] = []

    def bounds_of(t: pa.Table) -> np.ndarray:
        change = np.zeros(t.num_rows, bool)
        change[0] = True
        for k in range(keys):
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        return np.append(np.flatnonzero(change), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        t = pa.Table.from_batches(held)
        bounds = bounds_of(t)
        if len(bounds) > 2:
            yield bounds[:-1].tolist(), t.slice(0, bounds[-2])
            held = t.slice(bounds[-2]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield bounds_of(t).tolist(), t


def roots_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of the component of each of n nodes under the pairs (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


BITS = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


class Members:
    """The members of nodes in a sorted partition, and their candidate pairs."""

    def __init__(self, bounds: list[int], t: pa.Table):
        self.bounds, self.tree = np.asarray(bounds), t.column("tree").to_numpy()
        self.block, self.at_i, self.at_j = (t.column(c).to_numpy() for c in ("_block", "_i", "_j"))
        self.keys, self.sketch = matrix(t.column("keys"), "<u4"), matrix(t.column("sketch"), np.uint8)
        self.sketch = np.pad(self.sketch, ((0, 0), (0, self.sketch.shape[1] % 2))).view(np.uint16)
        self.length, self.depth = (t.column(c).to_numpy() if c in t.column_names else None for c in ("length", "depth"))

    def pairs(self, least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(x, y, trees): pairs of rows that meet first in their node's tree and whose sketches reach least, and in how many trees they
        meet. With lengths only pairs of which the shorter length is the node's depth."""
        sizes, starts = np.diff(self.bounds), self.bounds[:-1]
        small = (sizes <= SMALL) & (self.at_i[starts] == self.at_j[starts])
        for size in np.unique(sizes[small]):
            if size < 2:
                continue
            one, two = np.triu_indices(size, 1)
            at = starts[small & (sizes == size)]
            step = max(1, CELLS // 64 // len(one))
            for s in range(0, len(at), step):
                x, y = ((at[s : s + step, None] + k).ravel() for k in (one, two))
                met = self.keys[x] == self.keys[y]
                fresh = ~(met & (np.arange(TREES) < self.tree[x][:, None])).any(1)
                yield self.near(x[fresh], y[fresh], least)
        for lo, hi in zip(starts[~small], self.bounds[1:][~small], strict=True):
            left = np.flatnonzero(self.block[lo:hi] == self.at_i[lo]) + lo
            right = np.flatnonzero(self.block[lo:hi] != self.at_i[lo]) + lo
            same = self.at_i[lo] == self.at_j[lo]
            right = left if same else right
            step = max(1, CELLS // 4 // max(1, len(right)))
            for s in range(0, len(left), step):
                some = left[s : s + step]
                earlier = np.zeros((len(some), len(right)), bool)
                for u in range(self.tree[lo]):
                    earlier |= self.keys[some, u][:, None] == self.keys[right, u][None, :]
                x, y = np.nonzero(~earlier)
                x, y = some[x], right[y]
                if same:
                    x, y = x[x < y], y[x < y]
                for k in range(0, len(x), CELLS // 64):
                    yield self.near(x[k : k + CELLS // 64], y[k : k + CELLS // 64], least)

    def near(self, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.length is not None:
            own = np.minimum(self.length[x], self.length[y]) == self.depth[x]
            x, y = x[own], y[own]
        w = self.sketch[x] ^ self.sketch[y]
        w = (w | (w >> 1)) & np.uint16(0x5555)  # a minimum's two bits differ
        likely = 1 - BITS[w].sum(1, dtype=np.int64) / (TREES * DEPTH) * (4 / 3) >= least
        x, y = x[likely], y[likely]
        return x, y, (self.keys[x] == self.keys[y]).sum(1)


NODE = ["key", "_i", "_j"]


def counted(members: DataFrame) -> DataFrame:
    """(uid, met, once, twice): of each member of nodes, how many likely neighbours it meets first there, and how many of them in one and two trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in grouped(batches, len(NODE)):
            out = np.zeros((3, t.num_rows), np.int64)
            for x, y, trees in Members(bounds, t).pairs(LIKELY):
                for k, which in enumerate((trees > 0, trees == 1, trees == 2)):
                    out[k] += np.bincount(x[which], minlength=t.num_rows) + np.bincount(y[which], minlength=t.num_rows)
            some = np.flatnonzero(out[0])
            yield pa.RecordBatch.from_arrays([pa.array(t.column("uid").to_numpy()[some]), *(pa.array(c[some]) for c in out)], names=["uid", "met", "once", "twice"])

    return members.mapInArrow(run, "uid long, met long, once long, twice long")


def flagged(members: DataFrame) -> DataFrame:
    """The members of nodes that have a candidate pair there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in grouped(batches, len(NODE)):
            has = np.zeros(t.num_rows, bool)
            for x, y, _ in Members(bounds, t).pairs(SKETCH):
                has[x] = has[y] = True
            yield from t.filter(pa.array(has)).combine_chunks().to_batches()

    return members.mapInArrow(run, members.schema)


def verify(members: DataFrame) -> DataFrame:
    """(uid, links, low): of each member of nodes, how many rows it is linked to exactly there, and its component's smallest uid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bounds, t in grouped(batches, len(NODE)):
            uid, copies = t.column("uid").to_numpy(), t.column("copies").to_numpy()
            sets = [np.frombuffer(x.as_py(), np.uint64) for c in t.column("set").chunks for x in c]
            links, ties = np.zeros(len(uid), np.int64), []
            for x, y, _ in Members(bounds, t).pairs(SKETCH):
                for a, b in linked(sets, x, y, np.asarray(bounds)):
                    np.add.at(links, a, copies[b])
                    np.add.at(links, b, copies[a])
                    ties.append((a, b))
            order = np.argsort(uid, kind="stable")
            place = np.argsort(order)
            a, b = (np.concatenate([p[k] for p in ties]) if ties else np.zeros(0, np.int64) for k in (0, 1))
            low = uid[order][roots_of(len(uid), place[a], place[b])][place]
            yield pa.RecordBatch.from_arrays([pa.array(uid), pa.array(links), pa.array(low)], names=["uid", "links", "low"])

    return members.mapInArrow(run, "uid long, links long, low long")


def linked(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs (x, y) of sets whose similarity is at least SIMILARITY. Pairs of one node come one after the other; those of
    a dense node are taken from products of matrices."""
    of = np.searchsorted(bounds, x, "right")
    edges = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1, [len(x)])) if len(x) else np.zeros(1, np.int64)
    sparse = np.ones(len(x), bool)
    for lo, hi in zip(edges, edges[1:], strict=False):
        if hi - lo <= SMALL * SMALL:
            continue
        left, right = np.unique(x[lo:hi]), np.unique(y[lo:hi])
        if 16 * (hi - lo) < len(left) * len(right):
            continue
        sparse[lo:hi] = False
        wanted = np.sort(x[lo:hi] * len(sets) + y[lo:hi])
        both = np.unique(np.concatenate((left, right)))
        a, b = dense_links([sets[k] for k in both], np.searchsorted(both, left), np.searchsorted(both, right))
        a, b = both[a], both[b]
        code = a * len(sets) + b
        own = wanted[np.minimum(np.searchsorted(wanted, code), len(wanted) - 1)] == code
        yield a[own], b[own]
    x, y = x[sparse], y[sparse]
    size = np.array([len(s) for s in sets])
    total = np.concatenate(([0], np.cumsum(size[x] + size[y])))
    for i, j in chunks(total, CELLS // 4):
        p, q = x[i:j], y[i:j]
        pair = np.repeat(np.arange(j - i), size[p] + size[q])
        elements = np.concatenate([sets[k] for both in zip(p, q, strict=True) for k in both])
        order, again = by_key(elements ^ mix(pair.astype(np.uint64) + np.uint64(1)))
        common = np.bincount(pair[order[again]], minlength=j - i)
        sure = reaches(common, size[p] + size[q])
        yield p[sure], q[sure]


def reaches(common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with so many common elements, and sizes of this sum, are similar enough, in whole numbers."""
    part, whole = SIMILARITY.as_integer_ratio() if SIMILARITY != 0.8 else (4, 5)
    return whole * common >= part * (sizes - common)


def dense_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (one of left, one of right) of sets with a similarity of at least SIMILARITY, by exact counts of common elements."""
    size = np.array([len(s) for s in sets])
    elements = np.concatenate(sets)
    values, column, count = np.unique(elements, return_inverse=True, return_counts=True)
    shared = count > 1  # an element of one set is common to no pair
    number = np.cumsum(shared) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    keep = shared[column]
    owner, column, wide = owner[keep], number[column[keep]], int(shared.sum())
    first = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(sets)))))
    out_a, out_b = [], []
    tall = max(1, min(1024, CELLS // max(1, len(right))))
    for s in range(0, len(left), tall):
        some = left[s : s + tall]
        common = np.zeros((len(some), len(right)), np.float32)
        step = max(1, CELLS // max(1, len(some) + len(right)))
        for c in range(0, max(wide, 1), step):
            common += incidence(some, first, column, c, step) @ incidence(right, first, column, c, step).T
        # float32 holds counts up to 2**24 exactly
        x, y = np.nonzero(reaches(common.astype(np.int64), size[some][:, None] + size[right][None, :]))
        out_a.append(some[x])
        out_b.append(right[y])
    return np.concatenate(out_a), np.concatenate(out_b)


def incidence(rows: np.ndarray, first: np.ndarray, column: np.ndarray, start: int, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float32)
    counts = first[rows + 1] - first[rows]
    which = np.repeat(np.arange(len(rows)), counts)
    at = column[np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first[rows], counts)] - start
    inside = (at >= 0) & (at < width)
    out[which[inside], at[inside]] = 1
    return out


def lengths_of(matched: DataFrame, marked: DataFrame, floor: int, block: int) -> DataFrame | None:
    """(uid, length): the length at which a text's matched prefixes reached the target recall; texts that go down to the floor are left out."""
    settled = None
    for depth in range(DEPTH, floor, -1):
        rows = matched.filter(F.col("longest") >= depth).select(node(depth).alias("key"), "tree", "uid")
        if settled is not None:  # only nodes with a text that is still open
            rows = rows.join(rows.join(settled, "uid", "left_anti").select("key").distinct(), "key", "left_semi")
        met = counted(in_nodes(dealt(rows, "key", block), marked.select("uid", "sketch", F.col(f"keys_{depth}").alias("keys")), ["uid"]))
        met = met.groupBy("uid").agg(*(F.sum(c).alias(c) for c in ("met", "once", "twice")))
        missed = F.col("once") * F.col("once") / (2 * F.greatest("twice", F.lit(1)))
        done = met.filter(F.col("met") >= RECALL * (F.col("met") + missed)).select("uid", F.lit(depth).alias("length"))
        settled = checkpoint(done if settled is None else settled.unionByName(done.join(settled, "uid", "left_anti")))
        free_shuffles(matched.sparkSession)
    return settled


def in_nodes(rows: DataFrame, more: DataFrame, on: list[str]) -> DataFrame:
    """Members of nodes, NODE first, with what is known of their texts; the members of a node together."""
    found = rows.join(more, on)
    return found.select(*NODE, *(c for c in found.columns if c not in NODE)).repartition(*NODE).sortWithinPartitions(*NODE)


def near_classes(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(uid, class_id, n_links) for each row of (uid, text)."""
    spark = docs.sparkSession
    out, floor = Staged(spark, "near"), floor_for()
    depths = list(range(DEPTH, floor - 1, -1))
    all_rows = out.put(profiles(docs), "profiles")
    digest = ["digest_a", "digest_b", "n_shingles"]
    classes = checkpoint(all_rows.filter("n_shingles > 0").groupBy(*digest).agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("copies")))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-TREES * classes.count() // PATHS_PER_BUCKET))
    forest = all_rows.select("uid", "paths").join(classes.select("uid"), "uid", "left_semi")
    matched = out.put(matched_paths(opened_paths(forest), floor, buckets), "matched")
    free_shuffles(spark)
    marked = out.put(marks(all_rows.select("uid", "paths", "sketch").join(matched.select("uid").distinct(), "uid", "left_semi"), depths), "marks")
    lengths = lengths_of(matched, marked, floor, block)
    known = matched if lengths is None else matched.join(lengths, "uid", "left")
    known = known.withColumn("length", F.lit(floor) if lengths is None else F.coalesce("length", F.lit(floor)))
    each = F.array(*(F.when((F.col("longest") >= d) & (F.col("length") >= d), F.struct(F.lit(d).alias("depth"), node(d).alias("key"))) for d in depths))
    members = known.select("tree", "uid", "length", F.explode(F.array_compact(each)).alias("n")).select("n.key", "n.depth", "tree", "uid", "length")
    # of a node that no text's length is the depth of, all pairs are looked at elsewhere
    members = members.join(members.filter("length = depth").select("key").distinct(), "key", "left_semi")
    keys = F.coalesce(*(F.when(F.col("depth") == d, F.col(f"keys_{d}")) for d in depths))
    members = in_nodes(dealt(members, "key", block), marked, ["uid"]).withColumn("keys", keys).drop(*(f"keys_{d}" for d in depths))
    candidates = out.put(flagged(members), "candidates")
    free_shuffles(spark)
    wanted = candidates.select("uid").distinct().join(classes.select("uid", "copies"), "uid").join(docs.select("uid", "text"), "uid").select("uid", "copies", "text")
    seen = checkpoint(verify(in_nodes(candidates, with_sets(wanted), ["uid"])))
    free_shuffles(spark)
    found = components(seen.select(F.col("uid").alias("a"), F.col("low").alias("b")))
    links = seen.groupBy("uid").agg(F.sum("links").alias("links"))
    named = classes.join(links, "uid", "left").join(found.withColumnRenamed("node", "uid"), "uid", "left")
    named = named.select(*digest, F.coalesce("component", "uid").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    rows = all_rows.select("uid", *digest).join(named, digest, "left")
    rows = checkpoint(rows.select("uid", F.coalesce("class_id", "uid").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    out.drop()
    return rows


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs of which one of each class stays, the first by (id, text)."""
    rows = as_rows(docs, id_col, text_col)
    first = near_classes(rows.select("uid", "text")).filter("uid = class_id").select("uid")
    return rows.select("uid", "_row").join(first, "uid", "left_semi").select("_row.*")


def op10_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_uid(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return docs.select("uid", "doc_id").join(near_classes(docs.select("uid", "text")), "uid").select("doc_id", "class_id", "n_links")


#: All pairs by common shingles, and components by reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{80}-\x{10FFFF}]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 5 * c >= 4 * (a.n + b.n - c)),
r(node, class) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.class FROM r JOIN e ON r.node = e.x),
links AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT doc_id, class_id, coalesce(links.n, 0) AS n_links FROM (SELECT node AS doc_id, min(class) AS class_id FROM r GROUP BY 1) LEFT JOIN links ON x = doc_id
"""
