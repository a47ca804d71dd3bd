import datetime

import pytest

from tallyrock.operators import state as S
from tallyrock.sources import store

D = [datetime.date(2024, 1, 1) + datetime.timedelta(days=i) for i in range(70)]


def urls(spark, *names):
    return spark.createDataFrame([(n, "2024") for n in names], "url string, date string")


def replay(spark, days):
    """Flow and new urls of runs on days (number, urls)."""
    state, out = spark.createDataFrame([], store.STATE), []
    for day, names in days:
        m = S.mark(urls(spark, *names), state, str(D[day]))
        state = spark.createDataFrame(m.state.collect(), store.STATE)
        flow = m.flow.first()
        rows = m.jobs.collect()
        out.append(((flow.baseline, flow.fresh, flow.gone, flow.tracked, str(flow.since)), {r.url for r in rows if r.is_new}, {r.url: (r.first_seen, r.days_here) for r in rows}))
    return out


def test_replay(spark):
    runs = replay(spark, [(0, "ab"), (1, "ac"), (2, "abc"), (3, "ac"), (63, "ac"), (64, "ac"), (65, "abc")])
    day0 = str(D[0])
    assert [r[0] for r in runs] == [(True, 0, 0, 2, day0), (False, 1, 1, 3, day0), (False, 0, 0, 3, day0), (False, 0, 1, 3, day0), (False, 0, 1, 3, day0), (False, 0, 1, 2, day0), (False, 1, 0, 3, day0)]
    assert [r[1] for r in runs] == [set(), {"c"}, set(), set(), set(), set(), {"b"}]
    assert runs[2][2]["b"] == (D[0], 2) and runs[3][2]["a"] == (D[0], 3) and runs[6][2]["b"] == (D[65], 0)


def test_same_day_again_and_repeated_urls(spark):
    runs = replay(spark, [(0, "a"), (1, "abb"), (1, "ab")])
    assert runs[1][0][1] == 1 and runs[1][1] == {"b"}
    assert runs[2][0][1] == 0


def test_state_is_kept_between_runs(spark, tmp_path):
    root = str(tmp_path / "state")
    assert store.load_state(spark, root).count() == 0
    for day, names in ((0, "ab"), (1, "b")):
        m = S.mark(urls(spark, *names), store.load_state(spark, root), str(D[day]))
        store.save_state(m.state, root)
    assert {r.url: r.missing_since for r in store.load_state(spark, root).collect()} == {"a": D[1], "b": None}
    assert S.gone(store.load_state(spark, root), urls(spark, "b")).count() == 1


def test_unreadable_state_is_empty(spark, tmp_path):
    from tallyrock.sources import store

    root = str(tmp_path / "state")
    assert store.load_state(spark, root).count() == 0
    store.save_state(spark.createDataFrame([("u", None, None)], store.STATE), root)
    assert store.load_state(spark, root).count() == 1
    for name, content in (("v2", b"garbage, not a table"), ("v3", b"")):
        (tmp_path / "state" / name).mkdir()
        (tmp_path / "state" / name / "part-0.parquet").write_bytes(content)
        if content:
            with pytest.warns(UserWarning, match="counts as empty"):
                assert store.load_state(spark, root).count() == 0


def test_source_errors(spark, tmp_path):
    from tallyrock.sources import readers

    with pytest.raises(readers.SourceError, match="can't be read") as e:
        readers.scan(spark, str(tmp_path / "nowhere"), ("url",))
    assert e.value.path.endswith("nowhere") and len(str(e.value)) < 600
