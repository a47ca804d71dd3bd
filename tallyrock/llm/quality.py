"""Quality rules by repetition coverage.

Words, lines and n-grams of several lengths are hashed by rolling 64-bit polynomials in numpy over the UTF-8 bytes of many
texts at once; an n-gram or line that repeats an earlier one of its text covers its characters, and a text is rejected
where the covered share is over the length's limit.

Null or empty texts have no words and fail the base rule; texts of any length are taken whole; equal rows get equal
verdicts; an empty table gives an empty result; other columns are passed on untouched and may have any name but those of
``MEASURES``, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import WHITE, by_key, chunks, hashes, lined, mix, runs, sums, table, utf8, windows

#: Largest share of a text's word characters inside n-grams that repeat an earlier n-gram of the text.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines that equal an earlier line, and of word characters on them.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20
BASE_WINDOW, BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 8, 20, 30
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and coverage of the texts in data; a row for each."""
    data, offsets = lined(data, offsets)
    n, begin = len(offsets) - 1, offsets[:-1]
    prefix, inside = sums(data), ~WHITE[data]
    char = inside & ((data & 0xC0) != 0x80)  # a code point of a word starts here
    chars = np.concatenate(([0], np.cumsum(char)))
    total = lambda mask: np.add.reduceat(mask.astype(np.int64), begin) if n else np.zeros(0, np.int64)
    start, end = runs(inside)
    owner = np.searchsorted(offsets, start, "right") - 1
    n_words = np.bincount(owner, minlength=n)
    word = hashes(prefix, start, end) + (end - start).astype(np.uint64)
    length = chars[end] - chars[start]
    out = {"n_words": n_words, "word_chars": total(char), "n_symbols": total(SYMBOLS[data])}

    line_end = np.flatnonzero(data == 10)
    line_start = np.concatenate(([0], line_end[:-1] + 1)) if len(line_end) else line_end
    used = chars[line_end] > chars[line_start]
    line_start, line_end = line_start[used], line_end[used]
    line_owner = np.searchsorted(offsets, line_start, "right") - 1
    order, again = by_key(mix(hashes(prefix, line_start, line_end) + (line_end - line_start).astype(np.uint64)) ^ mix(line_owner.astype(np.uint64) + np.uint64(1)))
    again = order[again]
    out["n_lines"] = np.bincount(line_owner, minlength=n)
    out["n_dup_lines"] = np.bincount(line_owner[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_owner[again], weights=(chars[line_end] - chars[line_start])[again], minlength=n)

    salt = mix(owner.astype(np.uint64) + np.uint64(1))
    for size in sorted({BASE_WINDOW, *NGRAM_LIMITS}):
        at, hashed = windows(word, owner, size)
        order, again = by_key(mix(hashed) ^ salt[at])
        if size == BASE_WINDOW:
            twice = again.copy()
            twice[:-1] |= again[1:]
            out["n_repeat_words"] = np.bincount(owner[covered(at[order[twice]], size, len(word))], minlength=n)
        if size in NGRAM_LIMITS:
            inside = covered(at[order[again]], size, len(word))
            out[f"dup_chars_{size}"] = np.bincount(owner[inside], weights=length[inside], minlength=n)
    return out


def covered(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in windows of a size that start at the given words."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size, -1)
    return np.cumsum(step[:-1]) > 0


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether the base rule fails, and whether the text is kept."""
    failed = (m["n_words"] < BASE_LEAST_WORDS) | (100 * m["n_repeat_words"] > BASE_REPEAT_PERCENT * m["n_words"])
    kept = ~failed & (m["n_dup_lines"] <= LINE_LIMIT * m["n_lines"]) & (m["dup_line_chars"] <= LINE_CHAR_LIMIT * m["word_chars"])
    for size, limit in NGRAM_LIMITS.items():
        kept &= m[f"dup_chars_{size}"] <= limit * m["word_chars"]
    return failed, kept


def repetition(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds MEASURES, base_failed and kept to the columns in keep (all if None). No shuffle."""
    new = [*MEASURES, "base_failed", "kept"]
    keep = [c for c in (df.columns if keep is None else keep) if c not in new]
    text_at = "_text_measured"
    given = df.select(*keep, df[text_col].alias(text_at))
    schema = T.StructType([*given.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in MEASURES), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(len(keep)))
            for i, j in chunks(offsets):
                m = measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                failed, kept = verdict(m)
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[:-1]), *(pa.array(m[c].astype(np.int64)) for c in MEASURES), pa.array(failed), pa.array(kept)], names=[*keep, *new])

    return given.mapInArrow(run, schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def _oracle() -> str:
    """SQL for another engine: words with their places and lengths, then repeats of windows and lines by place."""
    grams = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS size, pos, list_aggregate(list(word) OVER w, 'string_agg', ' ') AS gram, count(*) OVER w AS n FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING)" for n in sorted({BASE_WINDOW, *NGRAM_LIMITS})
    )
    limits = ", ".join(f"({n}, {limit})" for n, limit in NGRAM_LIMITS.items())
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM split),
lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY nth) > 1 AS again, length(regexp_replace(line, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
by_line AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (again) AS n_dup_lines, coalesce(sum(chars) FILTER (again), 0) AS dup_chars FROM lines GROUP BY 1),
grams AS (SELECT doc_id, size, pos, row_number() OVER (PARTITION BY doc_id, size, gram ORDER BY pos) > 1 AS again, count(*) OVER (PARTITION BY doc_id, size, gram) > 1 AS twice FROM ({grams}) WHERE n = size),
covered AS (SELECT DISTINCT doc_id, size, twice_only, pos + i AS pos FROM (
  SELECT doc_id, size, pos, true AS twice_only, unnest(range(size)) AS i FROM grams WHERE twice AND size = {BASE_WINDOW} UNION ALL SELECT doc_id, size, pos, false, unnest(range(size)) FROM grams WHERE again)),
inside AS (SELECT doc_id, size, twice_only, count(*) AS n, sum(length(word)) AS chars FROM covered JOIN words USING (doc_id, pos) GROUP BY ALL),
m AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum([length(x) FOR x IN w]), 0) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce((SELECT n FROM inside i WHERE i.doc_id = split.doc_id AND twice_only), 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, coalesce(dup_chars, 0) AS dup_chars FROM split LEFT JOIN by_line USING (doc_id)),
too_many AS (SELECT DISTINCT i.doc_id FROM inside i JOIN (VALUES {limits}) AS l(size, share) USING (size) JOIN m ON m.doc_id = i.doc_id WHERE NOT twice_only AND i.chars > share * word_chars),
v AS (SELECT *, n_words < {BASE_LEAST_WORDS} OR 100 * n_repeat_words > {BASE_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_dup_lines <= {LINE_LIMIT} * n_lines AND dup_chars <= {LINE_CHAR_LIMIT} * word_chars AND doc_id NOT IN (SELECT doc_id FROM too_many) AS kept FROM v
"""


ORACLE = _oracle()
