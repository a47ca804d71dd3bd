"""Awkward rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

import random

LONG = " ".join(random.Random(3).choice(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]) + str(i % 977) for i in range(30_000))
NEAR = "the quick brown fox jumps over the lazy dog near a river bank where seven old boats lie in the sun and nobody ever comes to paint them again before winter sets in for good"
DOCS = [
    (1, None), (2, ""), (3, " \n "), (4, "ß"), (5, NEAR), (6, NEAR), (6, NEAR), (7, NEAR + " indeed"), (None, "a row without an id"), (None, None), (8, LONG), (9, LONG), (10, "\n".join(["one line that comes again"] * 30)), (10, "another text of the same id"),
    (11, "Ünïcödé 😀 wörds — «quoted» テスト 文字"), (12, "x" * 5000), (-13, "negative ids are ids too"),
]
#: Names that operators use within, and that a table may have as well.
CLASHES = ("uid", "score", "predicted", "pii_spans", "_row", "_id", "length", "piece", "count", "key", "group", "kept", "spans", "copies", "component")
SCHEMA = "doc_id long, text string"


def docs(spark, rows=None, clashes=False):
    rows = DOCS if rows is None else rows
    if not clashes:
        return spark.createDataFrame(rows, SCHEMA)
    return spark.createDataFrame([(*r, "en", "src", len(r[1] or ""), *("own",) * len(CLASHES)) for r in rows], f"{SCHEMA}, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def write(spark, folder, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
