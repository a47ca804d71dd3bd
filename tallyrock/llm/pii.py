"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score. JVM only.

Base kinds (email, ip, card, phone) count whenever their validator holds. Scored kinds (iban, id_number, local_phone) start
from a prior, gain from a checksum and from a context word shortly before them, lose by a word there that speaks against personal
data, and count from ``THRESHOLD`` on: a valid iban needs no context but for such a word, the others need one and no such word.

A span's place follows from the lengths of the pieces between matches, summed by blocks of ``BLOCK`` matches, so that a text
with many matches costs little more than its length. Patterns take a run of characters possessively and begin at the
run's start or where the match before ended, which finds the same leftmost matches in one pass over any text.

Null or empty texts have no spans; texts are taken whole; equal rows get equal spans; an empty table gives an empty result;
other columns are passed on, of whatever name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, table

#: Kind, pattern, and what a text must contain for the pattern to be tried.
PATTERNS = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@[A-Za-z0-9-]"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][\x20-]?[0-9]"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"),
    "id_number": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "local_phone": (r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[\x20.-][0-9]{4}"),
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: Prior score of a scored kind, and what a valid checksum and a context word add.
SCORES = {"iban": (0.1, 0.6, 0.2), "id_number": (0.3, 0.0, 0.5), "local_phone": (0.2, 0.0, 0.5)}
CONTEXT = {
    "iban": r"(?i)(iban|account|konto|compte|cuenta)",
    "id_number": r"(?i)(ssn|social security|security number)",
    "local_phone": r"(?i)(phone|call|tel|mobile|fax)",
}
#: Words that speak against personal data, and what a span loses by one.
AGAINST, LOSS = r"(?i)(serial|model|version|order no|part no|sku|isbn|checksum)", 0.2
CONTEXT_CHARS, THRESHOLD, BLOCK = 40, 0.7, 64


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def characters(m: Column) -> Column:
    return F.filter(F.split(m, ""), lambda c: c != "")


def luhn_ok(number: Column) -> Column:
    """Whether the digits of a string pass Luhn's checksum."""
    figures = F.reverse(characters(number))
    doubled = lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(F.transform(figures, lambda c, i: doubled(c.cast("int"), i)), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97_ok(iban: Column) -> Column:
    """Whether the letters and digits of a string, its first four moved to the end, leave 1 modulo 97."""
    plain = F.regexp_replace(iban, " ", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, v: F.when(v > 9, (a * 100 + v) % 97).otherwise((a * 10 + v) % 97)
    return F.aggregate(F.transform(characters(moved), value), F.lit(0), step) == 1


def valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.when(F.length(p) <= 3, F.concat(F.lit("0"), p).cast("int") <= 255).otherwise(False)
        return F.forall(F.split(m, r"\."), lambda p: small(F.regexp_replace(p, "^0+", "")))
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & luhn_ok(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    if kind == "iban":
        return F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97_ok(m)
    return F.lit(True)


def placed(text: Column, kind: str) -> Column:
    """An array of structs (start, end, ok, score) of the kind's matches in the text that hold."""
    pattern, hint = PATTERNS[kind]
    empty = F.array().cast("array<struct<start:int,end:int,ok:boolean,score:double>>")
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["gap"] + x["own"])

    def spans(found: Column, gaps: Column) -> Column:
        # the length of the piece before each match, and of the match
        pairs = F.transform(found, lambda m, i: F.struct(F.length(F.element_at(gaps, i + 1)).alias("gap"), F.length(m).alias("own")))
        return let(pairs, lambda lengths: let(block_sums(lengths), lambda sums: let(starts(sums), lambda before: confirmed(found, gaps, lengths, before))))

    def block_sums(lengths: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK))))

    def starts(sums: Column) -> Column:
        """What lies before each block, itself summed by blocks of blocks."""
        inside = lambda b: F.aggregate(F.slice(sums, b - b % BLOCK + 1, b % BLOCK), F.lit(0), lambda a, x: a + x)
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(sums) - 1) / BLOCK).cast("int")), lambda g: F.aggregate(F.slice(sums, g * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x))
        earlier = lambda totals, g: F.aggregate(F.slice(totals, F.lit(1), g), F.lit(0), lambda a, x: a + x)
        return let(groups, lambda totals: F.transform(sums, lambda _, b: inside(b) + earlier(totals, F.floor(b / BLOCK).cast("int"))))

    def confirmed(found: Column, gaps: Column, lengths: Column, before: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            inside = (i % BLOCK).cast("int")
            at = F.element_at(before, (F.floor(i / BLOCK) + 1).cast("int")) + total(F.slice(lengths, (i - inside + 1).cast("int"), inside)) + F.element_at(lengths, i + 1)["gap"]
            ok = valid(kind, m)
            if kind in SCORES:
                prior, checksum, context = SCORES[kind]
                near = F.right(F.element_at(gaps, i + 1), F.lit(CONTEXT_CHARS))
                score = F.lit(prior) + F.when(ok, checksum).otherwise(0.0) + F.when(near.rlike(CONTEXT[kind]), context).otherwise(0.0) - F.when(near.rlike(AGAINST), LOSS).otherwise(0.0)
                score = F.round(score, 6)
            else:
                score = F.when(ok, 1.0).otherwise(0.0)
            return let(at, lambda start: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), ok.alias("ok"), score.cast("double").alias("score")))

        return F.filter(F.transform(found, span), lambda s: s["ok"] & (s["score"] >= THRESHOLD))

    matched = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, let(F.split(text, pattern, -1), lambda gaps: spans(found, gaps))).otherwise(empty))
    return F.when(text.rlike(hint), matched).otherwise(empty)


def find_spans(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Adds spans_col: array<struct<kind, start, end, score>> by kind as listed, then start; code points, end exclusive."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = lambda k: F.transform(placed(text, k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    return df.withColumn(spans_col, F.concat(*map(named, KINDS)))


def redact(df: DataFrame, text_col: str = "text", spans_col: str = "pii_spans") -> DataFrame:
    """Replaces each span of the text by its kind in brackets; of overlapping spans the earliest names the run."""
    ordered = F.array_sort(F.transform(spans_col, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    piece = lambda a, s: F.substring(F.col(text_col), a["at"] + 1, s["start"] - a["at"])

    def step(a: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(a["out"], piece(a, s), F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out"))
        joined = F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))
        return F.when(s["start"] >= a["at"], fresh).otherwise(joined)

    done = F.aggregate("_pii_ordered", first, step, lambda a: F.concat(a["out"], F.substring(F.col(text_col), a["at"] + 1, F.length(text_col))))
    return df.withColumn("_pii_ordered", ordered).withColumn(text_col, F.when(F.size("_pii_ordered") > 0, done).otherwise(F.col(text_col))).drop("_pii_ordered")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the personal data of text replaced, and n_chars, where there is one, counted again."""
    out = redact(find_spans(docs, spans_col="_pii_spans"), spans_col="_pii_spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_pii_spans") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii_spans")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    return df.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))
