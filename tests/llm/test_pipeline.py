import corpus_pipeline
import pytest
from cases import DOCS, NEAR, docs, labels, write
from test_toxicity import corpus

from tallyrock.llm import packing

FOX = "seven grey geese flew over a frozen lake toward some distant hills before dark"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(1000 + i, t, y) for i, t, y in corpus(700)]
    extra = [(5000, NEAR + " mail me at a@b.com"), (5001, "so " + FOX + " it was"), (5002, "call me at +49 30 1234567 or x@y.org please, any day of this long week will do for me")]
    d = tmp_path_factory.mktemp("pipeline")
    return write(spark, d, documents=docs(spark, [r[:2] for r in rows] + DOCS + extra, clashes=True), labels=labels(spark, [(i, 1, y) for i, _, y in rows]), benchmark=spark.createDataFrame([(1, FOX)], "item_id long, text string")), {i: y for i, _, y in rows}


def test_stages(spark, folder, tmp_path):
    d, toxic = folder
    given = spark.read.parquet(f"{d}/documents.parquet")
    rows = given
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, rows, d).write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
        after[name] = rows
        if name != "packing":
            assert rows.columns == given.columns
    ids = lambda name: {r.doc_id for r in after[name].collect()}
    kept = ids("toxicity")
    assert sum(i in kept for i, y in toxic.items() if y) <= 0.05 * len(toxic) and sum(i not in kept for i, y in toxic.items() if not y) <= 0.05 * len(toxic)
    texts = [r.text for r in after["near_duplicates"].collect()]
    assert sum((t or "").startswith("the quick brown fox") for t in texts) == 1
    assert 5001 in ids("near_duplicates") and 5001 not in ids("decontamination")
    assert ids("near_duplicates") - ids("decontamination") == {5001}
    clean = {r.doc_id: (r.text, r.n_chars) for r in after["personal_data"].collect()}
    assert clean[5002][0].startswith("call me at [PHONE] or [EMAIL] please") and clean[5002][1] == len(clean[5002][0])
    assert clean[1] == (None, 0)
    tokens = packing.Tokens()
    assert after["packing"].groupBy().sum("length").first()[0] == sum(len(tokens.ids(r.text or "")) + 1 for r in after["personal_data"].collect())


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder[0])
    assert out.count() > 0 and "sequence_id" in out.columns
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_empty_tables(spark, tmp_path):
    d = write(spark, tmp_path, documents=docs(spark, [], clashes=True), labels=labels(spark, []), benchmark=spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0
