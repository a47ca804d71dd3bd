"""Best-fit packing by a histogram of lengths.

Texts become token ids with an end token; what is longer than a sequence is cut into whole sequences and a rest. Only the
number of pieces of each length (at most ``size`` numbers) goes to the driver, where best fit runs over counts: lengths
descend, and equally filled sequences are one group with a count. The plan says, for each length, which run of ranks goes to
which run of sequences at which offset; its size depends on ``size``, not on the corpus. Pieces are then ranked within their
length and take their slots by joining the plan on length and rank.

Ranks come from counts by (length, salt), a salt for each equal share of the pieces, so a length that a third of all pieces have is
numbered by many tasks.

Null or empty texts are one piece, the end token; equal rows are packed one by one; rows with a null or repeated doc_id
are packed like others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, free_shuffles, table

SIZE, END_TOKEN, TOKENIZER = 1024, 2, "byte_bpe_50k.json"
#: Characters that are tokenized at once, white space in a row that is tokenized by itself, and pieces that a salt of a length has at most.
CHARS_AT_ONCE, LONG_RUN, PIECES_PER_SALT = 1 << 20, 1 << 16, 200_000
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
# What the vocabulary's pattern takes for white space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Tokens:
    """Ids of texts as the tokenizers library gives them for TOKENIZER, without special tokens added.

    The same vocabulary as ranks gives the same ids several times faster. It doesn't know special tokens, whose strings are cut
    out first, and its pattern steps back over white space in a row, on a stack that a very long run exceeds; all of such a run
    but the character before a word is one token of the pattern, so it is encoded by itself. Long texts are cut where a word
    ends, which is where a token of the pattern ends as well.
    """

    def __init__(self, directory: str | None = None):
        import base64
        import json
        import re

        import tiktoken

        path = lambda name: f"{directory}/{name}" if directory else public_tokenizers.path(name)
        self.path = path(TOKENIZER)
        with open(self.path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"special tokens of {TOKENIZER} take their surroundings with them")
        self.special = {t["content"]: t["id"] for t in added}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.long_run, self.word_end = re.compile(f"(?<![{SPACE}])[{SPACE}]{{{LONG_RUN},}}+"), re.compile(f"[^{SPACE}](?=[{SPACE}])")
        with open(path(TOKENIZER.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = tiktoken.Encoding("byte_bpe_run", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= LONG_RUN and not any(s in text for s in self.special):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        parts = self.cut_special.split(text) if self.special else [text]
        found = [np.array(p, "<u4") for k, part in enumerate(parts) for p in ([[self.special[part]]] if k % 2 else self.by_runs(part))]
        return np.concatenate(found)

    def by_runs(self, text: str) -> Iterator[list[int]]:
        at = 0
        for run in self.long_run.finditer(text):
            yield from self.by_words(text, at, run.start())
            at = run.end() - (run.end() < len(text))
            yield self.whole.encode_ordinary(text[run.start() : at])
        yield from self.by_words(text, at, len(text))

    def by_words(self, text: str, at: int, end: int) -> Iterator[list[int]]:
        while end - at > CHARS_AT_ONCE and (word := self.word_end.search(text, at + CHARS_AT_ONCE, end)):
            yield self.fast.encode_ordinary(text[at : word.end()])
            at = word.end()
        yield self.fast.encode_ordinary(text[at:end])


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: a rest first, then whole sequences."""
    rest = n % size
    edges = [0, *([rest] if rest else []), *range(rest + size, n + 1, size)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, size: int = SIZE, directory: str | None = None) -> DataFrame:
    """PIECE_SCHEMA: the pieces of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(directory)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(tokens.ids(text.as_py() or ""), np.array([END_TOKEN], "<u4"))
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    for column, value in zip(rows, (doc, k, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE_SCHEMA)


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: (length, first rank, end rank, first sequence, pieces per sequence, offset).

    Of a run's pieces, the one with the rank r goes to the sequence first + (r - first rank) // pieces per sequence, and lies
    there at offset + length * ((r - first rank) % pieces per sequence).
    """
    free: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first sequence, count)
    out, used = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        rooms = sorted(r for r in free if r >= length)
        while left:
            if rooms:
                room = rooms[0]
                first, n = free[room].pop()
            else:
                room, per = size, size // length
                first, n = used, -(-left // per)
                used += n
            per = room // length
            full = min(n, left // per)
            if full:
                out.append((length, rank, rank + full * per, first, per, size - room))
                free.setdefault(room - per * length, []).append((first, full))
                rank, left = rank + full * per, left - full * per
            if left and full < n:  # the last sequence takes what is left
                out.append((length, rank, rank + left, first + full, per, size - room))
                free.setdefault(room - left * length, []).append((first + full, 1))
                full, left = full + 1, 0
            if full < n:
                free.setdefault(room, []).append((first + full, n - full))
            while rooms and not free.get(rooms[0]):
                rooms.pop(0)
        free = {r: x for r, x in free.items() if r and x}
    return out


def pack(cut_pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to pieces."""
    spark, names = cut_pieces.sparkSession, cut_pieces.columns
    cut_pieces = checkpoint(cut_pieces.withColumn("_at_row", F.monotonically_increasing_id()))
    free_shuffles(spark)
    histogram = {r["length"]: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # at most size rows
    # a length that many pieces have is numbered by as many tasks as an equal share of all pieces needs
    share = -(-sum(histogram.values()) // int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = min(PIECES_PER_SALT, max(1, share))
    salts = spark.createDataFrame([(length, -(-n // share)) for length, n in histogram.items()], "_of long, _salts long")  # at most size rows
    salted = cut_pieces.join(F.broadcast(salts), F.col("length") == F.col("_of")).withColumn("_salt", F.pmod(F.xxhash64("_at_row"), F.col("_salts"))).drop("_of", "_salts")
    # a row for each length and salt
    sizes = salted.groupBy("length", "_salt").count()
    base = sizes.withColumn("_base", F.sum("count").over(Window.partitionBy("length").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = salted.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(base.withColumnsRenamed({"length": "_l", "_salt": "_s"}), (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_base") + F.col("_nth"))
    # bounded by the number of lengths: each length ends at most one run of sequences and adds at most two
    slots = spark.createDataFrame(plan(histogram, size), "_length long, _from long, _to long, _first long, _per long, _at long")
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    placed = ranked.join(F.broadcast(slots), on).withColumn("_i", F.col("_rank") - F.col("_from"))
    return placed.select(*names, (F.col("_first") + F.floor(F.col("_i") / F.col("_per"))).cast("long").alias("sequence_id"), (F.col("_at") + F.col("length") * (F.col("_i") % F.col("_per"))).cast("long").alias("offset"))


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents").select("doc_id", "text")))
