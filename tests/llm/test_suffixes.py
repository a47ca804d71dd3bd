import hashlib
import random

import numpy as np
import pytest
from cases import DOCS, docs, write

from tallyrock.llm import suffixes
from tallyrock.llm.common import with_uid


def brute(rows):
    """Of rows in order: bytes, removed, spans, digest."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        lost = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                lost[p : p + 100] = True
            seen.add(s)
        kept = bytes(c for c, x in zip(b, lost, strict=False) if not x)
        out.append((len(b), int(lost.sum()), int((np.diff(np.concatenate(([0], lost.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdé fgh") for _ in range(n))
    shared, line = text(300), text(80)
    rows = [text(rng.randint(0, 700)) for _ in range(40)]
    rows += [text(50) + shared[rng.randint(0, 150) : rng.randint(160, 300)] + text(60) for _ in range(30)]
    rows += [text(30) + line + text(30) for _ in range(30)] + [shared] * 3 + ["z" * 450, "zy" * 200, text(99), text(100) * 3]
    for t in rows[:12]:
        k = rng.randint(0, len(t))
        rows.append(t[:k] + "#" + t[k + 1 :])
    rng.shuffle(rows)
    return list(enumerate(rows))


def check(spark, rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got = suffixes.deduplicated(with_uid(docs(spark, rows), "doc_id", "text"), ["doc_id", "uid"]).collect()
    found = {r.uid: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in got}
    assert [found[u] for u in sorted(found)] == brute([t for _, t in ordered])


def test_against_brute_force(spark):
    check(spark, corpus())


@pytest.mark.parametrize("frequent, per_bucket", [(1, 500), (3, 2000)])
def test_frequent_grams_over_buckets(spark, monkeypatch, frequent, per_bucket):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    monkeypatch.setattr(suffixes, "SUFFIXES_PER_BUCKET", per_bucket)
    monkeypatch.setattr(suffixes, "TEXT_PER_BUCKET", 3000)
    check(spark, corpus())


def test_awkward_rows(spark):
    check(spark, [r for r in DOCS if r[0] not in (8, 9)] + [(8, "q" * 20000), (9, "q" * 20000), (9, "q" * 150 + "\x00" * 300)])


def test_multikey_sort():
    rng = np.random.default_rng(3)
    keys = [rng.integers(0, 4, 500) for _ in range(4)]
    order, want = suffixes.multikey_sort(500, suffixes.columns(*keys)), np.lexsort(keys[::-1])
    assert all((k[order] == k[want]).all() for k in keys)
    again = suffixes.equal_to_previous(order, suffixes.columns(*keys))
    assert again.tolist() == [False] + [all(k[want[i]] == k[want[i - 1]] for k in keys) for i in range(1, 500)]
    assert suffixes.multikey_sort(3, suffixes.columns(np.array([3, 1, 2]))).tolist() == [1, 2, 0] and len(suffixes.multikey_sort(0, suffixes.columns(np.zeros(0)))) == 0


def test_suffixes_are_sorted_by_their_bytes():
    rng = random.Random(5)
    raw = bytes(rng.choice([0, 1, 127, 128, 255]) for _ in range(700)) + b"same" * 100
    data, at = np.frombuffer(raw, np.uint8), np.arange(len(raw) - suffixes.LENGTH + 1)
    keys = suffixes.byte_words(data, at)
    order = suffixes.multikey_sort(len(at), keys)
    strings = [raw[k : k + suffixes.LENGTH] for k in at[order]]
    assert strings == sorted(strings)
    assert suffixes.equal_to_previous(order, keys).tolist() == [k > 0 and strings[k] == strings[k - 1] for k in range(len(strings))]


def test_merged():
    a, b = suffixes.merged(np.array([5, 0, 200, 50, 100]), np.array([105, 100, 300, 60, 120]))
    assert a.tolist() == [0, 200] and b.tolist() == [120, 300]


def test_query(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark, clashes=True))
    assert suffixes.op7_suffixes(spark, d).count() == len(DOCS)
    assert suffixes.op7_suffixes(spark, write(spark, tmp_path / "e", documents=docs(spark, []))).count() == 0
