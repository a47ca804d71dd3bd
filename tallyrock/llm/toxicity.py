"""Toxicity by a convolutional text classifier in numpy.

Words and their beginnings are hashed into ``BUCKETS`` embeddings, a word's own being the sum, so that inflected forms
share what is learned; filters of several widths run over the whole text, their largest response is
kept, and a linear layer makes a score of it. The language is guessed from frequent function words of the text itself, and
for each guess a threshold is fitted on rows kept out of training, at which the score is 0.5.

The classifier is fitted in the driver on at most ``TRAIN_ROWS`` labelled rows with at most ``TRAIN_BYTES`` of text, taken by the
hash of doc_id; a text that the rest of these bytes doesn't hold is passed over.
Rows whose crc32(doc_id as text) modulo 5 is 0 are never learned from. Scoring is one pass without a shuffle.

Null or empty texts score like a text without any known word; texts of any length are taken whole; equal texts get equal
scores; without labels of both classes every score is the share of label 1 (0 if there is none); rows with null labels are
not learned from; an empty table gives an empty result; other columns are passed on, score and predicted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_arrays, free_shuffles, hashes, lined, lower, mix, sums, table, utf8, words

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 8, (1, 2, 3), 12
#: Bytes of a word's beginnings that have embeddings too.
BEGINNINGS = (4, 5)
TRAIN_BYTES = 48 << 20
TRAIN_ROWS, EPOCHS, BATCH, RATE, SEED = 6000, 4, 64, 0.02, 7
#: Share of the training rows that only calibrate, and words of a text that the kernel holds at once.
CALIBRATE, WORDS_AT_ONCE = 5, 1 << 16
#: Frequent function words of the languages that thresholds are fitted for; other texts share one threshold.
FUNCTION_WORDS = {
    "en": "the of and to in is that was for with as on by are this it from at be",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine",
    "fr": "de la le et les des en un du une que est pour qui dans par au sur il",
    "es": "de la que el en y a los del se las por un para con no una su es",
}
LANGUAGES = len(FUNCTION_WORDS) + 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings, a row for each kind, and the text of each word."""
    data, offsets = lined(data, offsets)
    start, end, hashed, owner = words(data, offsets)
    prefix = sums(lower(data))
    return np.stack([hashed, *(mix(hashes(prefix, start, np.minimum(start + n, end)) + np.uint64(n)) for n in BEGINNINGS)]), owner


def hashed_words(texts: list[str] | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """features() of texts by chunks: first text, end, hashes, and the text of each word within the chunk."""
    data, offsets = utf8(pa.array(texts, pa.string()) if isinstance(texts, list) else texts)
    for i, j in chunks(offsets):
        yield i, j, *features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def language_table() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, sorted, and the languages that each speaks for."""
    _, _, (hashed, *_), owner = next(hashed_words(list(FUNCTION_WORDS.values())))
    keys = np.unique(hashed)
    votes = np.zeros((len(keys), LANGUAGES), np.float32)
    votes[np.searchsorted(keys, hashed), owner] = 1
    return keys, votes / votes.sum(1, keepdims=True)


def guess_language(hashed: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The language whose function words a text has most; the last number if it has none."""
    keys, votes = language_table()
    at = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
    found = keys[at] == hashed
    count = np.stack([np.bincount(owner[found], weights=votes[at[found], k], minlength=n) for k in range(LANGUAGES)], 1).astype(float)
    count[:, -1] = 0.5
    return count.argmax(1)


def padded(hashed: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word, with bucket 0 as padding after each text so that every filter fits; starts of the texts."""
    pad = max(WIDTHS)
    counts = np.bincount(owner, minlength=n)
    starts = np.concatenate(([0], np.cumsum(counts + pad)))
    ids = np.zeros((len(hashed), starts[-1]), np.uint16)
    ids[:, np.arange(len(owner)) + owner * pad] = 1 + (hashed >> np.uint64(20)) % np.uint64(BUCKETS - 1)
    return ids, starts


class Classifier:
    def __init__(self, prior: float = 0.0):
        rng = np.random.default_rng(SEED)
        self.prior, self.fitted = prior, False
        self.words = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
        self.words[0] = 0
        self.filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.out = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.threshold, self.scale = np.zeros(LANGUAGES), 1.0

    def pooled(self, ids: np.ndarray, starts: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Largest response of each filter in each text, and the first place that has it."""
        high, places = [], []
        embedded = self.words[ids].sum(0)
        for w, filt in self.filters.items():
            score = embedded @ filt[0]
            for j in range(1, w):
                score[:-j] += embedded[j:] @ filt[j]
            last = np.minimum(starts[1:, None] - 1 - np.arange(w - 1), starts[-1] - 1)  # windows that would leave the text
            score[last.ravel()] = -np.inf
            high.append(np.maximum.reduceat(score, starts[:-1]))
            if where:
                owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                rows = np.where(score == high[-1][owner], np.arange(len(score))[:, None], len(score))
                places.append(np.minimum.reduceat(rows, starts[:-1]))
        return np.concatenate(high, 1), np.concatenate(places, 1) if where else None

    def logits(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts) - 1)
        for i, j in chunks(starts, WORDS_AT_ONCE):
            high, _ = self.pooled(ids[:, starts[i] : starts[j]], starts[i : j + 1] - starts[i])
            out[i:j] = np.tanh(high) @ self.out + self.bias[0]
        return out

    def fit(self, texts: list[str] | pa.Array, labels: np.ndarray) -> None:
        self.prior = float(labels.mean()) if len(labels) else 0.0
        if len(set(labels.tolist())) < 2 or len(labels) < 2 * CALIBRATE:
            return
        rng = np.random.default_rng(SEED)
        parts = [(*padded(hashed, owner, j - i), guess_language(hashed[0], owner, j - i)) for i, j, hashed, owner in hashed_words(texts)]
        ids, guess = np.concatenate([p[0] for p in parts], 1), np.concatenate([p[2] for p in parts])
        starts = np.concatenate(([0], np.cumsum(np.concatenate([np.diff(p[1]) for p in parts]))))
        del parts, texts
        kept = np.arange(len(labels)) % CALIBRATE != 0
        if len(set(labels[kept].tolist())) < 2 or len(set(labels[~kept].tolist())) < 2:
            kept[:] = True
        learn = np.flatnonzero(kept)
        self.start_words(ids, starts, labels, learn)
        ones, zeros = learn[labels[learn] == 1], learn[labels[learn] == 0]
        params = {"words": self.words, "out": self.out, "bias": self.bias, **{f"f{w}": f for w, f in self.filters.items()}}
        mean = {k: np.zeros_like(v) for k, v in params.items()}
        square = {k: np.zeros_like(v) for k, v in params.items()}
        for step in range(1, max(40, EPOCHS * len(learn) // BATCH) + 1):
            docs = np.concatenate([rng.choice(ones, BATCH // 2), rng.choice(zeros, BATCH // 2)])
            own = np.concatenate([ids[:, starts[d] : starts[d + 1]] for d in docs], 1)
            begin = np.concatenate(([0], np.cumsum(starts[docs + 1] - starts[docs])))
            for k, g in self.gradients(own, begin, labels[docs].astype(np.float32)).items():
                if k == "words":  # only the buckets that a batch met
                    rows, g = g
                    square[k][rows] += g * g
                    params[k][rows] -= RATE * 2 * g / (np.sqrt(square[k][rows]) + 1e-4)
                    continue
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                params[k] -= RATE * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
        self.fitted = True
        rows = np.flatnonzero(~kept) if (~kept).any() else learn
        self.calibrate(self.logits(ids, starts)[rows], labels[rows], guess[rows])

    def start_words(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray, learn: np.ndarray) -> None:
        """The first dimension starts as the log odds of label 1 among the training texts that have a word of the bucket."""
        seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
        for d in learn:
            seen[int(labels[d])][np.unique(ids[:, starts[d] : starts[d + 1]])] += 1
        n = [max(1, int((labels[learn] == k).sum())) for k in (0, 1)]
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        self.words[:, 0] = np.where(seen[0] + seen[1] >= 3, np.clip(odds, -3, 3), 0) / 3
        self.words[0] = 0
        for filt in self.filters.values():
            filt[:, 0, : FILTERS // 2] = np.abs(filt[:, 0, : FILTERS // 2]) + 0.5

    def gradients(self, ids: np.ndarray, starts: np.ndarray, labels: np.ndarray) -> dict:
        high, places = self.pooled(ids, starts, where=True)
        act = np.tanh(high)
        p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.bias[0], -30, 30)))
        d = ((p - labels) / len(labels)).astype(np.float32)
        grads = {"out": act.T @ d + 1e-4 * self.out, "bias": np.array([d.sum()], np.float32)}
        back = d[:, None] * self.out * (1 - act * act)
        rows, values = [], []
        for k, (w, filt) in enumerate(self.filters.items()):
            at, g = places[:, k * FILTERS : (k + 1) * FILTERS], back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[f"f{w}"] = np.stack([np.einsum("nfd,nf->df", self.words[ids[:, at + j]].sum(0), g) for j in range(w)])
            for j in range(w):
                rows.append(ids[:, at + j].ravel())
                values.append(np.tile((g[:, :, None] * filt[j].T[None]).reshape(-1, DIM), (len(ids), 1)))
        rows, values = np.concatenate(rows), np.concatenate(values)
        found, at = np.unique(rows, return_inverse=True)
        total = np.zeros((len(found), DIM), np.float32)
        np.add.at(total, at, values)
        total[found == 0] = 0
        grads["words"] = (found, total)
        return grads

    def calibrate(self, z: np.ndarray, y: np.ndarray, guess: np.ndarray) -> None:
        """For each guessed language the threshold with the fewest errors, drawn to that of all rows where rows are few."""
        whole = best_threshold(z, y)
        self.scale = max(0.25, float(np.std(z)) / 2)
        for k in range(LANGUAGES):
            own = guess == k
            some = min(int(y[own].sum()), int((y[own] == 0).sum()))
            share = some / (some + 10)
            self.threshold[k] = share * best_threshold(z[own], y[own]) + (1 - share) * whole if some else whole

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if not self.fitted:
            return np.full(n, self.prior)
        hashed, owner = features(data, offsets)
        z = self.logits(*padded(hashed, owner, n)) - self.threshold[guess_language(hashed[0], owner, n)]
        return 1 / (1 + np.exp(-np.clip(z / self.scale, -30, 30)))


def best_threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap in z at which cutting makes the fewest errors."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    errors = np.concatenate(([0], np.cumsum(y == 1))) + np.concatenate((np.cumsum((y == 0)[::-1])[::-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate(([z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]))
    return float(edges[best].mean())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> Classifier:
    """Fits on at most so many labelled rows and bytes; texts meet labels by a join with this bounded sample."""
    learned = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    some = labels.filter(learned & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # numbers only: the rows and bytes of each id, of which as many are taken as the bounds allow
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).join(F.broadcast(some), "doc_id")
    sizes = sizes.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).orderBy(F.xxhash64("doc_id"), "doc_id")
    taken = []
    for r in sizes.collect():  # at most a row for each of the sample's ids
        if r["n"] <= rows and r["size"] <= size:
            rows, size = rows - r["n"], size - r["size"]
            taken.append((r["doc_id"], r["toxic"]))
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, toxic int")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    model = Classifier()
    texts, toxic = found["text"].combine_chunks(), found["toxic"].to_numpy().astype(np.int64)
    del found
    model.fit(texts, toxic)
    del texts
    free_arrays()  # what training took is not needed by what follows in the driver
    free_shuffles(docs.sparkSession)
    return model


def scored(df: DataFrame, model: Classifier, text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds score and predicted, under the given names, to the columns in keep (all if None)."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in names]
    given = df.select(*keep, F.col(text_col).alias("_text_scored")) if text_col not in keep else df.select(*keep)
    at = keep.index(text_col) if text_col in keep else len(keep)
    schema = T.StructType([*given.schema.fields[: len(keep)], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(at))
            for i, j in chunks(offsets):
                score = model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[: len(keep)]), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, *names])

    return given.mapInArrow(run, schema)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted to be toxic."""
    names = ("_toxic_score", "_toxic")
    return scored(docs, train(docs, labels), names=names).filter(F.col(names[1]) == 0).drop(*names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return scored(docs, model, keep=["doc_id"]).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
