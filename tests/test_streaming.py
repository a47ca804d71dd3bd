import datetime

from pyspark.sql import functions as F

from tallyrock.sources import store
from tallyrock.streaming import first_seen


def source(spark, tmp_path, rows):
    path = str(tmp_path / "in")
    spark.createDataFrame(rows, "url string, ts timestamp, date string").coalesce(1).write.parquet(path)
    return spark.readStream.schema("url string, ts timestamp, date string").parquet(path)


T = [datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=20 * i) for i in range(6)]


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_first_sightings(spark, tmp_path):
    s = source(spark, tmp_path, [("a", T[0], "x"), ("a", T[0], "x"), ("b", T[1], "x")])
    assert sorted(r.url for r in run(first_seen.first_sightings(s, "url", "ts"), "first")) == ["a", "b"]


def test_daily_counts(spark, tmp_path):
    s = source(spark, tmp_path, [("a", t, "x") for t in T])
    got = {str(r.day): r.n for r in run(first_seen.daily_counts(s, "ts", "1 hour"), "daily")}
    assert got["2024-01-01"] == 2


def test_tracked(spark, tmp_path):
    s = source(spark, tmp_path, [("a", T[1], "x"), ("a", T[0], "x"), ("b", T[2], "x")])
    assert {(r.key, r.first_seen) for r in run(first_seen.tracked(s, "url", "ts", None), "tracked")} == {("a", T[0]), ("b", T[2])}


def test_run_daily(spark, tmp_path):
    s = source(spark, tmp_path, [("a", T[0], "x"), ("b", T[1], "x")])
    flows, root = [], str(tmp_path / "state")
    first_seen.run_daily(s.select("url", "date"), root, str(tmp_path / "cp"), lambda: "2024-01-01", flows.append).awaitTermination(120)
    assert store.load_state(spark, root).count() == 2 and flows[0]["baseline"]


def test_settings(spark):
    from tallyrock.session import SETTINGS, configure

    s = configure(spark)
    assert all(s.conf.get(k) == v for k, v in SETTINGS.items())
    assert s.range(1).select(F.lit(1)).count() == 1
