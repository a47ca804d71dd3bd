import collections
import re

from cases import DOCS, docs, write

from tallyrock.llm import quality

#: Short words, and one long line without spaces that stands twice.
LONG_LINE = (24, " ".join(f"w{i}" for i in range(25)) + "\n" + "\n".join(["é" * 400, "between", "é" * 400, "last"]))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    seen, lines, dup_lines, dup_line_chars = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            if line in seen:
                dup_lines, dup_line_chars = dup_lines + 1, dup_line_chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    chars = sum(map(len, w))

    def cover(n, first):
        grams = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        met, inside = set(), set()
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if grams[g] > 1 and (first or g in met):
                inside.update(range(i, i + n))
            met.add(g)
        return inside

    repeat = len(cover(8, True))
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    kept = not failed and dup_lines <= 0.30 * lines and dup_line_chars <= 0.20 * chars and all(sum(len(w[i]) for i in cover(n, False)) <= limit * chars for n, limit in quality.NGRAM_LIMITS.items())
    return len(w), chars, len(re.findall(r"[#*$%&|<>]", text)), dup_lines, repeat, failed, kept


def test_against_brute_force(spark):
    more = [(20, " ".join(f"w{i % 37}" for i in range(200))), (21, "a b c d e f g h " * 3 + " ".join(f"u{i}" for i in range(60))), (22, "# * $ % & | < > ##\n\na\na\n\x0b\x0c\x1c a"), (23, " ".join(f"v{i}" for i in range(25))), LONG_LINE]
    rows = [r for r in DOCS if r[0] not in (8, 9)] + more
    got = sorted(map(tuple, quality.repetition(docs(spark, rows).coalesce(1), keep=["doc_id", "text"]).collect()), key=str)
    assert got == sorted(((i, t, *brute(t)) for i, t in rows), key=str)
    assert {r[-1] for r in got} == {True, False}
    assert [r[-1] for r in got if r[0] == LONG_LINE[0]] == [False]


def test_names_and_empty(spark):
    out = quality.repetition(docs(spark, clashes=True))
    assert out.count() == len(DOCS) and "uid" in out.columns and out.columns.count("kept") == 1
    assert quality.repetition(docs(spark, [])).count() == 0


def test_query(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark, clashes=True))
    assert quality.op6_quality(spark, d).count() == len(DOCS)
