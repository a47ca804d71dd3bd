"""Benchmark decontamination by canonical templates.

A text is contaminated in one of two ways.

``verbatim``: it has ``RUN`` words in a row of an item, or all words of a shorter one, down to one word; capitals and what
stands between words don't matter.

``reparameterised``: numbers, units after numbers, and names (words inside a sentence of which the first letter alone is a
capital) become typed placeholders, runs of one type one placeholder; what stood there are the slots. The text has ``RUN``
template words in a row of an item, or all of a shorter one of at least ``SHORTEST``. In the longest such run the slots must
be consistent: each value of the item's stands for one value in the text and the other way round. Somewhere in the run, half of
``WINDOW`` template words in a row (or of a shorter item) must be literal ones. Every text has a second template, in which names
are ordinary words in lower case, so that a copy with other capitals is found as well.

Windows of ``RUN`` words, or a whole shorter item, are hashed; windows of texts that a bitmap of the benchmark's lets through
and that lie in a row make a stretch, with its slots numbered by first occurrence. Stretches with equal hashes and numbers are one
class, and so are items: a class of stretches meets a class of items by a join on the hash of a window, slots are compared once
for each pair of classes, and texts take the verdict of their class. So texts and items of one template, however many, never meet
each by each. A window that a third of the texts hold makes a frequent key on one side of each join only, which Spark splits.

The result has one row for each contaminated text: the kind, verbatim before reparameterised; item_id, of the items that share the
window that fewest items have, the smallest (of a reparameterised text, the smallest of the class with the longest run); n_items,
how many share it; n_matched, the windows matched. Null or empty texts and items match nothing, nor do items with a null id; equal rows are judged alike, each by
itself; empty tables give an empty result; other columns are ignored or passed on. The bitmap has at most 2**BITS bits, however
large the benchmark is; the join decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ALNUM, as_rows, checkpoint, chunks, free_shuffles, hashes, lined, lower, mix, runs, sums, table, utf8, windows, with_uid

RUN, WINDOW, SHORTEST, BITS = 13, 8, 4, 27
#: Windows of a stretch; a longer one, which only a text that repeats itself has, is judged in parts.
LONGEST = 1 << 14
UNITS = (
    "mm cm m km in inch inches ft foot feet yard yards mile miles g kg mg lb lbs oz pound pounds ounce ounces ton tons l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degrees celsius fahrenheit "
    "kmh mph hz khz mhz ghz kb mb gb tb w kw mw v volt volts amp amps j kj cal kcal k people items apples pieces times"
).split()
NUMBER, UNIT, NAME = 1, 2, 3
#: The forms of a text: names as placeholders, names as words, all as words.
NAMES, PLAIN, EXACT = 0, 1, 2
STOPS = np.zeros(256, bool)
STOPS[[ord(c) for c in ".!?:\n"]] = True
SCHEMA = "uid long, form int, size int, key binary, windows array<struct<hash:long,strong:boolean,slots:array<int>>>"
WINDOWS = pa.list_(pa.struct([("hash", pa.int64()), ("strong", pa.bool_()), ("slots", pa.list_(pa.int32()))]))


def unit_hashes() -> np.ndarray:
    raw, offsets = lined(*utf8(pa.array([" ".join(UNITS)])))
    start, end = runs(ALNUM[raw])
    return np.sort(hashes(sums(raw), start, end))


def words_and_kinds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, hash, kind (0: literal), start and end of the words of lined texts."""
    start, end = runs(ALNUM[data])
    owner = np.searchsorted(offsets, start, "right") - 1
    small = lower(data)
    hashed = hashes(sums(small), start, end)
    kind = np.zeros(len(start), np.int8)
    if not len(start):
        return owner, hashed, kind, start, end
    head = data[start]
    capitals = np.concatenate(([0], np.cumsum(small != data)))
    second = np.minimum(start + 1, len(data) - 1)
    capital = (small[start] != head) | ((head == 0xC3) & (small[second] != data[second]))
    stops = np.concatenate(([0], np.cumsum(STOPS[data])))
    opens = np.ones(len(start), bool)
    opens[1:] = (stops[start[1:]] > stops[end[:-1]]) | (owner[1:] != owner[:-1])
    kind[capital & ~opens & (capitals[end] - capitals[start] == 1)] = NAME
    kind[(head >= 48) & (head <= 57)] = NUMBER
    known = unit_hashes()
    is_unit = known[np.minimum(np.searchsorted(known, hashed), len(known) - 1)] == hashed
    kind[1:][is_unit[1:] & (kind[:-1] == NUMBER) & (owner[1:] == owner[:-1])] = UNIT
    return owner, hashed, kind, start, end


def template(owner: np.ndarray, hashed: np.ndarray, kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same of template words: placeholders in place of words that aren't literal, a run of one kind being one."""
    more = np.zeros(len(start), bool)  # goes on with the placeholder before
    more[1:] = (kind[1:] > 0) & (kind[1:] == kind[:-1]) & (owner[1:] == owner[:-1])
    first = np.flatnonzero(~more)
    ends = end[np.append(first[1:], len(start)) - 1]
    hashed = np.where(kind > 0, mix(kind.astype(np.uint64) + np.uint64(77)), hashed)[first]
    return owner[first], hashed, kind[first], start[first], ends


def strong_windows(literal: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Whether the windows at these words have WINDOW words in a row, or all of theirs, of which half are literal."""
    part = min(size, WINDOW)
    out = np.zeros(len(at), bool)
    for shift in range(size - part + 1):
        out |= 2 * (literal[at + shift + part] - literal[at + shift]) >= part
    return out


def passes(bits: tuple[int, bytes], value: np.ndarray) -> np.ndarray:
    """Whether a bitmap has both bits of these hashes."""
    bitmap, out = np.frombuffer(bits[1], np.uint8), np.ones(len(value), bool)
    for v in (value, value << np.uint64(32) | value >> np.uint64(32)):
        bit = v >> np.uint64(64 - bits[0])
        out &= (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def numbered(kind: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Numbers of slots: the type, and how many different values were met before the first one like this."""
    _, first, which = np.unique(value, return_index=True, return_inverse=True)
    return (kind.astype(np.int32) << 24) + np.argsort(np.argsort(first))[which].astype(np.int32)


def stretches(texts: DataFrame, sizes: dict[int, list[int]] | None = None, bits: tuple[int, bytes] | None = None) -> DataFrame:
    """SCHEMA: stretches of windows of (uid, text), and their class. With sizes by form and bits: of windows of these sizes that a
    bitmap lets through; without: of all windows of RUN words, or of the whole text if it is shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid = batch.column(0).to_numpy()
            data, offsets = utf8(batch.column(1))
            for i, j in chunks(offsets):
                part, off = lined(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                found = words_and_kinds(part, off)
                if not len(found[0]):
                    continue
                letters = None
                plain = np.where(found[2] == NAME, 0, found[2]).astype(np.int8)
                for form, kinds in enumerate((found[2], plain, np.zeros_like(plain))):
                    if sizes is not None and form not in sizes:
                        continue
                    owner, hashed, kind, start, end = template(*found[:2], kinds, *found[3:])
                    count = np.bincount(owner, minlength=j - i)
                    literal = np.concatenate(([0], np.cumsum(kind == 0)))
                    for size in sizes[form] if sizes is not None else range(1 if form == EXACT else SHORTEST, RUN + 1):
                        at, value = windows(hashed, owner, size)
                        value = mix(value + np.uint64(4 * size + form))
                        use = passes(bits, value) if bits else (size == RUN) | (count[owner[at]] == size)
                        at, value = at[use], value[use]
                        if not len(at):
                            continue
                        strong = strong_windows(literal, at, size)
                        # only windows of RUN words can lie in a row in an item
                        begins = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(owner[at]) > 0) | (size < RUN)))
                        nth = np.arange(len(at))
                        begins = np.flatnonzero((nth - np.maximum.accumulate(np.where(begins, nth, 0))) % LONGEST == 0)
                        ends = np.append(begins[1:], len(at))
                        if form != EXACT:
                            some = np.add.reduceat(strong.astype(np.int64), begins) > 0
                            begins, ends = begins[some], ends[some]
                        if letters is None and form != EXACT and len(begins):
                            letters = sums(lower(part))
                        rows: list[list] = [[], [], []]
                        for a, b in zip(begins, ends, strict=True):
                            first, last = at[a], at[b - 1] + size
                            slot = np.flatnonzero(kind[first:last]) + first
                            ids = numbered(kind[slot], hashes(letters, start[slot], end[slot])) if len(slot) else np.zeros(0, np.int32)
                            edge = np.searchsorted(slot, np.stack([at[a:b], at[a:b] + size]))
                            rows[0].append(owner[first])
                            rows[1].append(hashlib.blake2b(value[a:b].tobytes() + (slot - first).tobytes() + ids.tobytes(), digest_size=16, salt=bytes([form, size])).digest())
                            rows[2].append([{"hash": h, "strong": s, "slots": ids[x:y].tolist()} for h, s, x, y in zip(value[a:b].view(np.int64).tolist(), strong[a:b].tolist(), *edge.tolist(), strict=True)])
                        n = len(rows[0])
                        if n:
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(uid[i:j][rows[0]]), pa.array(np.full(n, form, np.int32)), pa.array(np.full(n, size, np.int32)), pa.array(rows[1], pa.binary()), pa.array(rows[2], WINDOWS)],
                                names=["uid", "form", "size", "key", "windows"],
                            )

    return texts.select("uid", "text").mapInArrow(run, SCHEMA)


def bitmap_of(hashed: DataFrame, n: int) -> tuple[int, bytes]:
    """A bitmap with 64 bits for each of n windows, within bounds; two bits are set by the leading bits of the hash's halves."""
    bits = int(np.clip(np.ceil(np.log2(max(1, n) * 64)), 16, BITS))
    turned = F.expr("shiftleft(hash, 32) | shiftrightunsigned(hash, 32)")
    both = hashed.select(F.explode(F.array("hash", turned)).alias("hash"))
    bit = F.shiftrightunsigned("hash", 64 - bits)
    words = both.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 31 as int))")).alias("on"))
    found = words.toArrow()  # at most 2**BITS / 32 rows
    out = np.zeros(1 << (bits - 5), "<u4")
    out[found["word"].to_numpy()] = found["on"].to_numpy().astype(np.uint32)
    return bits, out.tobytes()


def consistent(stretch_classes: DataFrame, item_classes: DataFrame) -> DataFrame:
    """(key, item_id, n_items, n_matched): the classes of stretches that have a consistent run of an item, and the longest such run's."""
    opened = lambda df, names: df.select(*names, "form", F.posexplode("windows").alias("pos", "w"))
    of_item = opened(item_classes, ["key", "item_id", "n_items"]).select("form", F.col("key").alias("item"), "item_id", "n_items", F.col("pos").alias("_pos"), F.col("w.hash").alias("hash"), F.col("w.slots").alias("_slots"))
    joined = opened(stretch_classes, ["key"]).select("key", "form", "pos", "w.hash", "w.strong", "w.slots").join(of_item, ["form", "hash"]).filter(F.size("slots") == F.size("_slots"))
    occurrence = ["key", "item", F.col("pos") - F.col("_pos")]
    in_row = F.col("pos") - F.row_number().over(Window.partitionBy(*occurrence).orderBy("pos"))
    runs_ = joined.withColumn("_run", in_row).withColumn("_shift", occurrence[2])
    pairs = F.arrays_zip(F.col("_slots").alias("a"), F.col("slots").alias("b"))
    judged = runs_.groupBy("key", "item", "_shift", "_run").agg(
        F.max("strong").alias("strong"), F.count(F.lit(1)).alias("n_matched"), F.first("item_id").alias("item_id"), F.first("n_items").alias("n_items"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs")
    )
    one_to_one = (F.size(F.array_distinct("pairs.a")) == F.size("pairs")) & (F.size(F.array_distinct("pairs.b")) == F.size("pairs"))
    longest = judged.filter(F.col("strong") & one_to_one).groupBy("key").agg(F.min(F.struct((-F.col("n_matched")).alias("less"), "item_id", "n_items")).alias("best"))
    return longest.select("key", "best.item_id", "best.n_items", (-F.col("best.less")).alias("n_matched"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(uid, item_id, kind, n_matched, n_items) of the contaminated among (uid, text)."""
    items = checkpoint(stretches(benchmark.filter("item_id is not null").select(F.col("item_id").cast("long").alias("uid"), "text")))
    # an item has one stretch for each form, which is its class
    classes = items.groupBy("form", "key").agg(F.min("uid").alias("item_id"), F.count_distinct("uid").alias("n_items"), F.first("windows").alias("windows"))
    hashed = items.select("uid", "form", F.explode("windows").alias("w")).select("uid", "form", "w.hash")
    exact_items = hashed.filter(F.col("form") == EXACT).groupBy("hash").agg(F.min("uid").alias("item_id"), F.count_distinct("uid").alias("n_items"))
    sizes = {}
    for form, size in sorted(items.select("form", "size").distinct().collect()):  # at most RUN for each form
        sizes.setdefault(form, []).append(size)
    every = hashed.select("hash").distinct()
    found = checkpoint(stretches(docs, sizes, bitmap_of(every, every.count())))
    free_shuffles(docs.sparkSession)
    verbatim = found.filter(F.col("form") == EXACT).select("uid", F.explode("windows.hash").alias("hash")).join(exact_items, "hash")
    verbatim = checkpoint(verbatim.groupBy("uid").agg(F.min(F.struct("n_items", "item_id")).alias("best"), F.count(F.lit(1)).alias("n_matched")).select("uid", "best.item_id", F.lit("verbatim").alias("kind"), "n_matched", "best.n_items"))
    other = found.filter(F.col("form") != EXACT).join(verbatim.select("uid"), "uid", "left_anti")
    verdicts = consistent(other.groupBy("form", "key").agg(F.first("windows").alias("windows")), classes.filter(F.col("form") != EXACT))
    changed = other.select("uid", "key").join(verdicts, "key").groupBy("uid").agg(F.min(F.struct((-F.col("n_matched")).alias("less"), "item_id", "n_items")).alias("best"))
    return verbatim.unionByName(changed.select("uid", "best.item_id", F.lit("reparameterised").alias("kind"), (-F.col("best.less")).alias("n_matched"), "best.n_items"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item."""
    rows = as_rows(docs, id_col, text_col)
    hit = matches(rows.select("uid", "text"), benchmark).select("uid").distinct()
    return rows.select("uid", "_row").join(hit, "uid", "left_anti").select("_row.*")


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_uid(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    found = matches(docs.select("uid", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("uid", "doc_id").join(found, "uid").drop("uid")
