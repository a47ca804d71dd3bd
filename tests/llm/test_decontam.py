import random
import re

import pytest
from cases import DOCS, docs, write

from tallyrock.llm import decontam
from tallyrock.llm.common import with_uid

TRAIN = "A train travels 120 miles in 3 hours from the old station where Alice waits. How far does the train of Alice travel in 5 hours at the same speed?"
ADD = "Ann has 3 apples and gives Ben 4 apples so now Ann has 7 apples while Ben has 9 apples in all"
FOX = "the quick brown fox jumps over a lazy dog near the river bank today again"
ITEMS = [(1, TRAIN), (2, "capital city of this country"), (3, None), (None, "x y z w"), (4, "capital city of this country"), (5, FOX), (6, ""), (7, "a b"), (8, ADD), (1, TRAIN)]


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame([(*i, "own") for i in items], "item_id long, text string, hash string")


def judged(spark, texts, items=ITEMS):
    """text -> (item, kind, n_matched, n_items)"""
    d = with_uid(docs(spark, list(enumerate(texts))), "doc_id", "text")
    rows = decontam.matches(d.select("uid", "text"), benchmark(spark, items)).collect()
    assert len({r.uid for r in rows}) == len(rows)
    return {r.uid: (r.item_id, r["kind"], r.n_matched, r.n_items) for r in rows}


def found(spark, texts, items=ITEMS):
    return {(uid, item): kind for uid, (item, kind, *_) in judged(spark, texts, items).items()}


@pytest.fixture(scope="module")
def cases(spark):
    texts = [
        "So. " + TRAIN + " End.", TRAIN.replace("120 miles", "90 km").replace("3 hours", "7 hours").replace("Alice", "Bob"), TRAIN.replace("Alice waits", "Bob waits").replace("Alice travel", "Carol travel"),
        "we ask for the capital city of this country now", FOX.replace("dog", "cat"), "x " * 50 + FOX.upper() + " y" * 50, "", None, "nothing of the kind is in this text, which is long enough to have windows",
        "the quick brown fox jumps over a", FOX.replace("again", "") + "and so on",
        ADD.replace("Ann", "Eve").replace("Ben", "Tom").replace("9", "1"), "Ann has 3 apples and gives Ben 4 apples so now Eve has 8 apples while Tom has 9 apples in all",
    ]
    return found(spark, texts)


@pytest.mark.parametrize("n, item, kind", [(0, 1, "verbatim"), (1, 1, "reparameterised"), (2, 1, "verbatim"), (3, 2, "verbatim"), (4, 5, None), (5, 5, "verbatim"), (9, 5, None), (10, 5, "verbatim"), (11, 8, "reparameterised"), (12, 8, None)])
def test_case(cases, n, item, kind):
    assert cases.get((n, item)) == kind


def test_nothing_else(cases):
    assert {u for u, _ in cases} == {0, 1, 2, 3, 5, 10, 11} and 4 not in {i for _, i in cases}


def test_rows_that_stay(spark):
    rows = [*DOCS, (70, "a " + FOX), (None, FOX), (71, TRAIN)]
    out = decontam.clean(docs(spark, rows, clashes=True), benchmark(spark))
    assert out.columns == docs(spark, clashes=True).columns and out.count() == len(DOCS)
    assert decontam.clean(docs(spark, [], clashes=True), benchmark(spark)).count() == 0
    assert decontam.clean(docs(spark, rows, clashes=True), benchmark(spark).limit(0)).count() == len(rows)


def test_query(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark, [*DOCS, (70, "a " + FOX), (70, "b " + FOX)], clashes=True), benchmark=benchmark(spark))
    assert [(r.doc_id, r.item_id) for r in decontam.op2_decontam(spark, d).collect()] == [(70, 5), (70, 5)]


def test_items_of_one_template_are_judged_each_by_its_own_slots(spark):
    other = ADD.replace("gives Ben 4", "gives Ben 3")  # 3 stands for two values in ADD then
    got = judged(spark, ["So. " + ADD, "So. " + other, TRAIN.replace("120", "90"), ADD.replace("4", "14").replace("7", "17")], [(3, other), (7, ADD), (8, ADD), (9, TRAIN), (9, TRAIN.replace("120", "90"))])
    assert {k: v[:2] for k, v in got.items()} == {0: (7, "verbatim"), 1: (3, "verbatim"), 2: (9, "verbatim"), 3: (7, "reparameterised")}
    assert got[0][3] == 2 and got[3][3] == 2  # items 7 and 8 are one


def test_slots_are_consistent_both_ways(spark):
    one, two = ADD.replace("Ann", "Eve").replace("Ben", "Tom"), ADD.replace("Ann", "Eve").replace("Ben", "Eve")
    same = "In all Ben has 5 apples and so Eva has 5 apples as well"
    assert found(spark, [one.replace("3", "33"), two.replace("3", "33")], [(1, ADD)]) == {(0, 1): "reparameterised"}
    assert found(spark, [same.replace("5", "6"), same.replace("5", "6", 1), same.replace("Eva", "Ben").replace("5", "7")], [(1, same)]) == {(0, 1): "reparameterised"}


def test_scattered_windows_are_no_run(spark):
    start, end = "the quick brown fox jumps over a lazy", "near the river bank today again and again"
    part = FOX.split()
    texts = [" clean words between ".join([start] * 6), " and ".join([" ".join(part[:8]), " ".join(part[6:])]), "nine words make this one item of the test x " * 1, "nine words make this one item of the so nine words make this one item of the", f"{start} {end} " * 6]
    assert judged(spark, texts, [(5, FOX), (6, "nine words make this one item of the test")]) == {2: (6, "verbatim", 1, 1)}


def test_texts_and_items_of_one_template_do_not_meet_each_by_each(spark, monkeypatch):
    """300 of each: the join of classes has few rows, and the result one for each text."""
    sale = "On market day a shop in the old town sells {0} pounds of fine flour for {1} dollars each so how much do {0} pounds cost in all"
    items, texts = [(k, sale.format(k + 2, 1000 + k)) for k in range(300)], [sale.format(5000 + k, 9000 + k) for k in range(300)]
    sizes, real = [], decontam.consistent
    monkeypatch.setattr(decontam, "consistent", lambda s, i: (sizes.append((s.count(), i.count())), real(s, i))[1])
    got = judged(spark, texts, items)
    assert sizes[0][0] <= 4 and sizes[0][1] <= 4
    assert len(got) == 300 and {(v[0], v[1], v[3]) for v in got.values()} == {(0, "reparameterised", 300)}
    short = "What do {0} pounds of flour cost at {1} dollars"
    got = judged(spark, [short.format(5000 + k, 9000 + k) for k in range(300)], [(k, short.format(k + 2, 1000 + k)) for k in range(300)])
    assert len(got) == 300 and {(v[0], v[1], v[3]) for v in got.values()} == {(0, "reparameterised", 300)}
    assert all(n <= 4 for pair in sizes for n in pair)


CONVERT = "Convert 3 hours 20 minutes 15 seconds to seconds and 2 days 4 hours to minutes"
TABLE = "3 kg 5 lb 7 kg 9 lb 11 kg 13 lb 15 kg 17 lb"


def test_items_with_many_placeholders(spark):
    items = [(1, CONVERT), (2, "What is 17 times 23?"), (3, "What is 12 + 7?"), (4, TABLE), (6, "zyzzyva")]
    texts = [
        f"So. {CONVERT} now", "So. " + CONVERT.replace("20", "50").replace("15", "45").replace("2 days", "6 days"), "and what is 17 times 23? asks one", "what is 17 times 24?", "what is 12 + 7, then", "what is 12 + 8, then",
        f"we have {TABLE} here", TABLE.replace("9", "8"), "a zyzzyva", "convert hours to seconds and days to minutes",
    ]
    got = found(spark, texts, items)
    assert got == {(0, 1): "verbatim", (1, 1): "reparameterised", (2, 2): "verbatim", (4, 3): "verbatim", (6, 4): "verbatim", (8, 6): "verbatim"}


# --- brute force over all windows ---


def tokens(text):
    """(word, kind) by reading from left to right."""
    out, last = [], None
    for m in re.finditer(r"[0-9A-Za-z]+", text or ""):
        word, between = m.group(), (text[last : m.start()] if last is not None else None)
        kind = "w"
        if word[0].isdigit():
            kind = "number"
        elif word.lower() in decontam.UNITS and out and out[-1][1] == "number":
            kind = "unit"
        elif between is not None and not re.search(r"[.!?:\n]", between) and word[0].isupper() and sum(c.isupper() for c in word) == 1:
            kind = "name"
        out.append((word.lower(), kind, m.start(), m.end()))
        last = m.end()
    return out


def templated(text, names):
    """(template word, literal, slot) with runs of one kind as one."""
    out = []
    for word, kind, a, b in tokens(text):
        if kind == "w" or (kind == "name" and not names):
            out.append([word, True, None, None])
        elif out and out[-1][0] == "<" + kind and not out[-1][1]:
            out[-1][3] = b
        else:
            out.append(["<" + kind, False, a, b])
    return [(w, lit, None if lit else (w, text[a:b].lower())) for w, lit, a, b in out]


def brute(text, items):
    words = [w for w, *_ in tokens(text)]
    for _, item in items:
        of = [w for w, *_ in tokens(item)]
        n = min(len(of), decontam.RUN)
        grams = {tuple(of[i : i + n]) for i in range(len(of) - n + 1)} if n else set()
        if any(tuple(words[i : i + n]) in grams for i in range(len(words) - n + 1)):
            return "verbatim"
    for names in (True, False):
        t = templated(text, names)
        for _, item in items:
            of = templated(item, names)
            n = min(len(of), decontam.RUN)
            if n < decontam.SHORTEST:
                continue
            match = {(i, j) for i in range(len(t) - n + 1) for j in range(len(of) - n + 1) if all(t[i + k][0] == of[j + k][0] for k in range(n))}
            for i, j in match:
                if (i - 1, j - 1) in match:
                    continue
                m = 1
                while (i + m, j + m) in match:
                    m += 1
                span = n + m - 1
                part = min(n, decontam.WINDOW)
                strong = any(2 * sum(lit for _, lit, _ in of[j + k : j + k + part]) >= part for k in range(span - part + 1))
                slots = {(of[j + k][2], t[i + k][2]) for k in range(span) if of[j + k][2]}
                if strong and len({a for a, _ in slots}) == len(slots) == len({b for _, b in slots}):
                    return "reparameterised"
    return None


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def sentence(n):
        return " ".join(rng.choice(["Ann", "Ben", "Eve", "has", "gives", "so", "now", "and", f"{rng.randint(1, 4)} apples", f"{rng.randint(1, 4)}", "km", "the", "a"]) + rng.choice(["", "", "", ".", ","]) for _ in range(n))

    items = [(k, sentence(rng.choice([2, 5, 9, 13, 16, 24]))) for k in range(12)]
    texts = []
    for _ in range(60):
        item = rng.choice(items)[1]
        changed = item
        for name in rng.sample(["Ann", "Ben", "Eve", "1", "2", "3", "4"], rng.randint(0, 3)):
            changed = changed.replace(name, rng.choice(["Tom", "Eve", "7", "2"]) if not name.isdigit() else rng.choice(["5", "8", "2"]))
        part = changed.split(" ")
        cut = rng.randint(0, 3)
        texts.append(f"{sentence(4)} {' '.join(part[cut:])} {sentence(rng.randint(0, 5))}")
    got = judged(spark, texts, items)
    want = {k: brute(t, items) for k, t in enumerate(texts)}
    assert {k: v[1] for k, v in got.items()} == {k: v for k, v in want.items() if v}
    assert set(want.values()) == {"verbatim", "reparameterised", None}
