import collections
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from cases import DOCS, LONG, NEAR, docs, write

from tallyrock.llm import near
from tallyrock.llm.common import with_uid
from tallyrock.llm.graph import components

WORD = re.compile(r"[A-Za-z0-9\u0080-\U0010ffff]+")


def shingles(text):
    text = "".join(c.lower() if c < "\u0080" or "À" <= c <= "Þ" else c for c in text or "")
    w = WORD.findall(text)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """class and links of each (uid, text)."""
    sets = {u: shingles(t) for u, t in rows}
    root, links = {u: u for u in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {u: (find(u), links[u]) for u in sets}


def edited(rng, words, share):
    return [rng.choice("pqrstuv") + str(rng.randrange(99)) if rng.random() < share else w for w in words]


def corpus(seed=5):
    rng, rows = random.Random(seed), []
    for g in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 150))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.03, 0.06]))))
    rows += [" ".join(f"common{i}" for i in range(30)) + " " + " ".join(f"own{k}x{i}" for i in range(30)) for k in range(20)]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [near.BLOCK, 4])
def test_against_brute_force(spark, block):
    rows = corpus() + [(1000 + k, t) for k, (_, t) in enumerate(DOCS)]
    got = {r.uid: (r.class_id, r.n_links) for r in near.near_classes(spark.createDataFrame(rows, "uid long, text string"), block).collect()}
    assert got == brute(rows)


def test_large_group_without_pairs(spark):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, base, 0.008))) for i in range(400)]
    got = {r.uid: (r.class_id, r.n_links) for r in near.near_classes(spark.createDataFrame(rows, "uid long, text string"), 64).collect()}
    assert got == brute(rows)


def test_floor():
    k = near.floor_for()
    assert 1 - (1 - 0.8**k) ** near.TREES >= near.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** near.TREES


def signed(rows):
    """Paths of (uid, text) as tuples by tree."""
    out = {}
    for uid, text in rows:
        hashed, first = near.shingles(*near.utf8(pa.array([text])))
        if len(hashed):
            sign = near.signatures(hashed, first)[0].astype("<u2").reshape(near.TREES, near.DEPTH)
            out[uid] = [tuple(p) for p in sign.tolist()]
    return out


def shared(a, b):
    return next((k for k in range(near.DEPTH) if a[k] != b[k]), near.DEPTH)


@pytest.mark.parametrize("buckets", [1, 7])
def test_longest_prefixes_in_sorted_tries(spark, buckets):
    """Against all pairs of paths; with many buckets also across their edges."""
    rows = corpus()
    paths = signed(rows)
    frame = near.profiles(spark.createDataFrame(rows, "uid long, text string")).filter("paths is not null")
    got = {(r.tree, r.uid): r.longest for r in near.matched_paths(near.opened_paths(frame), 4, buckets).collect()}
    want = {}
    for t in range(near.TREES):
        for a, b in itertools.combinations(paths, 2):
            n = shared(paths[a][t], paths[b][t])
            if n >= 4:
                want[t, a], want[t, b] = max(n, want.get((t, a), 0)), max(n, want.get((t, b), 0))
    assert got == want


def test_prefixes_are_shortened_for_each_text(spark, monkeypatch):
    """Texts whose neighbours are all met in many trees keep the whole length; those with a neighbour met in few, or none, go on."""
    rng, base = random.Random(8), [f"w{i}" for i in range(400)]
    close = [" ".join([*base[: 30 * k], f"own{k}", *base[30 * k + 1 :]]) for k in range(12)]
    other = [f"v{i}" for i in range(300)]
    far = [" ".join(edited(rng, other, 0.02)) for _ in range(12)]
    rows = list(enumerate(close + far + ["all alone in this small corpus of texts"]))
    seen, real = [], near.lengths_of
    monkeypatch.setattr(near, "lengths_of", lambda *a: (seen.append(real(*a)), seen[0])[1])
    got = {r.uid: (r.class_id, r.n_links) for r in near.near_classes(spark.createDataFrame(rows, "uid long, text string")).collect()}
    assert got == brute(rows)
    lengths = {r.uid: r.length for r in seen[0].collect()}
    assert {u for u in range(12) if lengths.get(u) == near.DEPTH} == set(range(12)) and 24 not in lengths
    assert any(u not in lengths or lengths[u] < near.DEPTH for u in range(12, 24))


def test_recall_at_the_limit(spark):
    """Every text has neighbours just at the similarity wanted; queries are the ids divisible by 20, against all rows."""
    rng, rows = random.Random(9), []
    for g in range(150):
        base = [f"g{g}w{i}" for i in range(94)]  # 90 shingles; ten lost and ten gained leave 80 of 100
        for _ in range(4):
            cut = list(base)
            for at in rng.sample(range(5, 89), 1):
                cut[at] = f"n{rng.randrange(10**6)}"
            rows.append(" ".join(cut))
    rows = list(enumerate(rows))
    want = brute(rows)
    got = {r.uid: r.n_links for r in near.near_classes(spark.createDataFrame(rows, "uid long, text string")).collect()}
    asked = [u for u in want if u % 20 == 0]
    assert sum(want[u][1] for u in asked) > 10
    assert sum(got[u] for u in asked) >= 0.99 * sum(want[u][1] for u in asked)
    assert sum(got.values()) >= 0.999 * sum(n for _, n in want.values())


def test_chains_cost_their_links_only(spark, monkeypatch):
    """A corpus that is one chain: each text is alike to the next few. What is verified grows with the links, not with the square."""
    words = [f"w{i}" for i in range(1600)]
    rows = [(k, " ".join(words[8 * k : 8 * k + 200])) for k in range(175)]
    listed, real = [], near.verify
    monkeypatch.setattr(near, "verify", lambda m: (listed.append(m.select("key", "uid").distinct().groupBy("key").count().selectExpr("sum(count * (count - 1) / 2)").first()[0]), real(m))[1])
    got = {r.uid: (r.class_id, r.n_links) for r in near.near_classes(spark.createDataFrame(rows, "uid long, text string")).collect()}
    want = brute(rows)
    assert got == want and {c for c, _ in got.values()} == {0}
    assert listed[0] < 40 * len(rows) < len(rows) ** 2 / 2 * 0.5


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, np.uint64)
    b = np.concatenate((a[:800], rng.integers(0, 1 << 63, 200, np.uint64)))
    sign = near.signatures(np.concatenate((a, b)), np.array([0, 1000, 2000]))
    one, two = np.unpackbits(near.sketches(sign), axis=1)[:, : 2 * near.TREES * near.DEPTH].reshape(2, -1, 2)
    assert abs(1 - 4 / 3 * (one != two).any(1).mean() - 800 / 1200) < 0.15


def test_representatives(spark):
    rows = [*DOCS, (90, LONG + " a few more words"), (91, NEAR + " x")]
    out = near.representatives(docs(spark, rows, clashes=True))
    assert out.columns == docs(spark, clashes=True).columns
    kept = sorted((str(r.doc_id), (r.text or "")[:20]) for r in out.collect())
    assert [k for k in kept if k[1].startswith("the quick")] == [("5", NEAR[:20])] and [k for k in kept if k[1] == LONG[:20]] == [("8", LONG[:20])]
    assert out.count() == len(rows) - 6 and near.representatives(docs(spark, [], clashes=True)).count() == 0


def test_query(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark, clashes=True))
    assert near.op10_near(spark, d).count() == len(DOCS)


def test_uids(spark):
    unique = with_uid(docs(spark, [(3, "a"), (1, "b")]), "doc_id", "text")
    assert {r.uid for r in unique.collect()} == {1, 3}
    got = [(r.uid, r.doc_id, r.text) for r in with_uid(docs(spark), "doc_id", "text").orderBy("uid").collect()]
    assert [u for u, *_ in got] == list(range(len(DOCS)))
    assert [(i, t) for _, i, t in got] == sorted(DOCS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 900), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(400):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in root.items() if x != 900 or r != 900}
