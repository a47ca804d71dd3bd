import random
import zlib

import numpy as np
from cases import DOCS, docs, labels, write

from tallyrock.llm import common, toxicity

CALM = "the of river stone cloud meadow paper window garden table quiet morning letter number simple".split()
RUDE = "idiots idiocy moron scumbag".split()


def corpus(n, seed=1):
    rng, out = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(CALM) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 80))]
        bad = rng.random() < 0.3
        for _ in range(2 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE) + rng.choice(["", "ly", "ness"]))
        out.append((i, " ".join(words), int(bad)))
    return out


def test_held_out_accuracy(spark, tmp_path):
    rows = corpus(1500)
    d = write(spark, tmp_path, documents=docs(spark, [r[:2] for r in rows] + DOCS, clashes=True), labels=labels(spark, [(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (2, None, None)]))
    got = {r.doc_id: r for r in toxicity.op9_toxicity(spark, d).filter("doc_id >= 20").collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 20 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert toxicity.op9_toxicity(spark, d).count() == len(rows) + len(DOCS)


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = corpus(400)
    fit = lambda turned: toxicity.train(docs(spark, [r[:2] for r in rows]), labels(spark, [(i, 1, 1 - y if turned and zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]))
    a, b = fit(False), fit(True)
    assert np.array_equal(a.words, b.words) and np.array_equal(a.threshold, b.threshold)


def test_training_is_bounded(spark, monkeypatch):
    """Rows and bytes beyond the bounds, among them one huge text and an id that many rows have, don't reach the driver."""
    rows = corpus(300)
    seen = []
    monkeypatch.setattr(toxicity.Classifier, "fit", lambda self, texts, y: seen.append((len(texts), sum(len(t) for t in texts.to_pylist()), len(y))))
    frame = docs(spark, [*(r[:2] for r in rows), (1000, "x" * 200_000), *((1001, "many rows") for _ in range(120))])
    all_labels = labels(spark, [(i, 1, y) for i, _, y in rows] + [(1000, 1, 1), (1001, 1, 1)])
    toxicity.train(frame, all_labels, rows=100, size=20_000)
    n, size, m = seen[0]
    assert n == m and 20 < n <= 100 and size <= 20_000


def test_one_class_and_empty(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark), labels=labels(spark, [(5, 1, 0), (7, 1, 0)]))
    assert {r.score for r in toxicity.op9_toxicity(spark, d).collect()} == {0.0}
    e = write(spark, tmp_path / "e", documents=docs(spark, []), labels=labels(spark, []))
    assert toxicity.op9_toxicity(spark, e).count() == 0


def test_chunks_score_alike():
    rows = corpus(300)
    model = toxicity.Classifier()
    model.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]))
    data, offsets = toxicity.utf8(toxicity.pa.array([t for _, t, _ in rows] + ["", None]))
    whole = model.score(data, offsets)
    single = [float(model.score(*toxicity.utf8(toxicity.pa.array([t])))[0]) for t in [r[1] for r in rows[:40]]]
    assert np.allclose(whole[:40], single) and whole[-1] == whole[-2]


def test_language_guess():
    texts = ["the house of the king and that was for him", "der Hund und die Katze sind nicht mit dem Mann auf", "le chat et les chiens dans une maison pour qui", "el perro y los gatos del vecino con las casas", "zzz qqq", ""]
    found = [toxicity.guess_language(h[0], o, j - i) for i, j, h, o in toxicity.hashed_words(texts)]
    assert np.concatenate(found).tolist() == [0, 1, 2, 3, 4, 4]


def test_training_leaves_nothing_in_the_driver(spark):
    rows = corpus(200, seed=9)
    model = toxicity.train(docs(spark, [r[:2] for r in rows]), labels(spark, [(i, 1, y) for i, _, y in rows]))
    assert model.fitted
    assert not common._powers  # tables that the kernels keep otherwise
