"""Whole runs: counts equal lists, sums add up, and what is kept can be read again."""

import json

import pytest
from fixtures import NOW, companies, gazetteer, listings
from pyspark.sql import functions as F

from tallyrock.operators import checks as C
from tallyrock.operators import filters, outlines, probe, stats
from tallyrock.plans import analysis, api, trend
from tallyrock.sources import readers, settings, store


@pytest.fixture(scope="module")
def rows(spark):
    some = [{"url": f"https://www.s{i % 3}.ro/{i}", "title": t, "location": [l], "cif": c, "date": d, "workmode": w} for i, (t, l, c, d, w) in enumerate([
        ("Inginer", "Sibiu", "24973770", "2026-09-01T08:00:00Z", "remote"), ("Inginer", "Sibiu", "24973770", "2026-09-02T08:00:00Z", ""), ("INGINER SEF", "Romania", "12345678", "2026-08-01", "hybrid"),
        ("Model videochat", "Paris", "31468843", "", "acasa"), ("Șofer", "Sânmartin", "24973770", "2026-01-01", "on-site"), ("", "", "", "2026-09-04", ""), ("Cofetar", "Cluj-Napoca", "RO24973770", "2026-09-03", "on-site"), ("Cofetar", "Cluj-Napoca", "24973770", "2026-09-03", "on-site")])]
    return listings(spark, *some)


@pytest.fixture(scope="module")
def result(spark, rows):
    before = spark.createDataFrame([("https://www.s0.ro/0", "2026-09-01"), ("https://gone.ro/1", "2026-08-20")], "url string, day string").select("url", F.to_date("day").alias("first_seen"), F.lit(None).cast("date").alias("missing_since"))
    answers = spark.createDataFrame([("https://www.s0.ro/0", 404, "x"), ("https://www.s1.ro/1", 500, ""), ("https://www.s2.ro/2", 200, ""), ("https://www.s0.ro/3", None, "timeout")], "url string, link_code int, link_reason string")
    return analysis.analyse(rows, companies(spark), gazetteer(spark), before, NOW, responses=answers)


def test_counts_equal_lists(result):
    for r in stats.check_counts(result.rows).collect():
        assert result.rows.filter(F.array_contains("issues", r.check_id)).count() == r["count"], r.check_id
    for q in stats.question_counts(result.rows).collect():
        assert result.jobs(question=q.question)["total"] == q.affected


def test_totals_add_up(result):
    t = stats.totals(result.rows, result.catalog).first()
    assert t.trusted + t.affected == t.jobs == 8
    assert t.trusted == result.jobs(trusted=True)["total"] and t.affected == result.jobs(affected=True)["total"]
    assert sum(r.jobs for r in stats.freshness(result.rows).collect()) == 8
    assert sum(r.jobs for r in stats.source_counts(result.rows, result.today, result.since).collect()) == 8
    u = stats.unplaced(result.rows).first()
    assert u.ambiguous == result.jobs(loc="ambiguous")["total"] and u.foreign == result.jobs(loc="foreign")["total"]


def test_buckets_are_filters(result):
    for r in stats.freshness(result.rows).collect():
        assert result.jobs(fresh=r.value)["total"] == r.jobs
    for r in stats.work_modes(result.rows).collect():
        assert result.jobs(workmode=r.value)["total"] == r.jobs
    for r in stats.source_counts(result.rows, result.today, result.since).collect():
        assert result.jobs(host=r.host)["total"] == r.jobs
    for r in stats.counties(result.rows).collect():
        assert result.jobs(county=r.county.upper(), trusted=True)["total"] == r.jobs


def test_repeats_links_and_arrivals(result):
    by = {r.url: r for r in result.rows.collect()}
    assert [by[f"https://www.s{i % 3}.ro/{i}"].dup_index for i in (0, 1, 6, 7)] == [0, 1, 0, 1]
    assert [by[f"https://www.s{i % 3}.ro/{i}"].link for i in (0, 1, 2, 3, 4)] == ["dead", "error", "ok", "unreachable", ""]
    assert result.flow["gone"] == 1 and result.flow["fresh"] == 7 == result.jobs(new=True)["total"]
    assert result.jobs(linkbad=True)["total"] == 2 and result.jobs(link="dead")["total"] == 1
    total = probe.totals(result.links).first()
    assert (total.sampled, total.ok, total.dead, total.error, total.unreachable, total.codes) == (4, 1, 1, 1, 1, {"200": 1, "404": 1, "500": 1})
    assert result.jobs(days=10)["total"] == 8 and result.jobs(days="x")["total"] == 0 and result.jobs(first_day="2026-09-05")["total"] == 7


def test_other_filters(result):
    assert result.jobs(q="INGINER")["total"] == 3 and result.jobs(title="cofetar")["total"] == 2 and result.jobs(tag="sofer")["total"] == 8
    assert result.jobs(company="24973770")["total"] == 5 and result.jobs(rawloc="Paris")["total"] == 1 and result.jobs(locality="Sibiu")["total"] == 2 == result.jobs(place="Sibiu")["total"]
    assert result.jobs(question="nothing")["total"] == 0 and result.jobs(check="title_allcaps")["total"] == 1 and result.jobs(q="")["total"] == 8
    with pytest.raises(ValueError):
        result.jobs(wrong="x")


def test_paging(result):
    out = result.jobs(page=2, size=3)
    assert (out["total"], out["pages"], out["items"].count()) == (8, 3, 3)
    dates = [r.date for p in (1, 2, 3) for r in result.jobs(page=p, size=3)["items"].collect()]
    assert dates == sorted(dates, reverse=True)
    assert [filters.paging(*p) for p in ((None, None), (0, 0), ("x", "y"), (-2, 500), ("2", "10"))] == [(1, 50), (1, 50), (1, 50), (1, 200), (2, 10)]


def test_summary(result):
    s = analysis.summary(result)
    json.dumps(s, default=str)
    assert len(s["checks"]) == 47 and len(s["questions"]) == 3 and s["incoming"]["window"]["jobs"] == 8
    assert "jobs are trusted" in analysis.report(s)
    adult = next(c for c in s["checks"] if c["check_id"] == "title_adult")
    assert adult["count"] == 1 and adult["samples"][0]["value"] == "Model videochat" and adult["top_hosts"] == [{"host": "s0.ro", "jobs": 1}]
    assert s["companies"]["catalog_without_jobs"] == 1 and [b["value"] for b in s["companies"]["size_buckets"]] == list(stats.K.SIZES)


def test_runs_and_service(spark, rows, tmp_path):
    root = str(tmp_path / "runs")
    service = api.Api(spark, root)
    assert service.jobs()[0] == 503 and service.get("POST", "/api/run", {})[0] == 405 and service.get("GET", "/x", {})[0] == 404
    for now in ("2026-08-28T12:00:00Z", "2026-09-05T18:00:00Z"):
        found = analysis.run(spark, root, rows, companies(spark), gazetteer(spark), now)
    assert found["trend"]["days"] == 8 and len(found["recent_runs"]) == 2
    status, body = service.get("GET", "/api/jobs", {"size": "2", "host": "s0.ro"})
    assert status == 200 and body["total"] == 3 and len(body["items"]) == 2 and body["items"][0]["loc"]["kind"]
    assert service.get("GET", "/api/run", {})[1]["source"] == "run" and service.get("GET", "/api/jobs", {"bad": "1"})[0] == 400
    store.copy_seed(spark, f"{root}/summary", str(tmp_path / "seed"))
    assert store.load_summary(spark, str(tmp_path / "none"), str(tmp_path / "seed"))[1] == "seed"


def test_rows_store_skips_bad_lines(spark, tmp_path):
    root = str(tmp_path / "rows")
    df = spark.createDataFrame([("b", "2024-01-01"), ("a", "2024-01-02"), ("c", "2024-01-02")], "url string, date string")
    path = store.write_rows(df, root)
    (tmp_path / "rows" / path.rpartition("/")[2] / "part-x.json").write_text('{"url": "d", "date": "2023"}\n\nnot json\n')
    assert {r.url for r in store.scan_rows(spark, root, df.schema).collect()} == {"a", "b", "c", "d"}
    assert store.scan_rows(spark, root, df.schema, limit=2).count() == 2


def test_history_by_day(spark, tmp_path):
    path = str(tmp_path / "history")
    assert store.load_history(spark, path).count() == 0
    for run_at, day in (("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-02")):
        one = spark.createDataFrame([(run_at, (1, 1, 1, 0, 0), None, [], [], None)], store.HISTORY).withColumn("day", F.to_date(F.lit(day)))
        store.upsert_history(one, path)
    assert sorted(r.run_at for r in store.load_history(spark, path).collect()) == ["a", "c"]


def test_trend(spark):
    days = spark.createDataFrame([(d, (i, 1, 1, 1, 1), [], []) for i, d in enumerate(["2024-01-01", "2024-01-04", "2024-01-08", "2024-01-09"])], "d string, totals struct<jobs:bigint,companies:bigint,trusted:bigint,affected:bigint,format:bigint>, questions array<struct<id:string,affected:bigint>>, sources array<int>").withColumn("day", F.to_date("d"))
    at = lambda today: [(str(r.since), r.days) for r in trend.trend(days, today).collect()]
    assert at("2024-01-10") == [("2024-01-01", 9)] and at("2024-01-12") == [("2024-01-04", 8)] and at("2024-01-05") == [("2024-01-01", 4)] and at("2024-01-01") == []
    assert trend.retry_after_minutes(1) == 10 and trend.retry_after_minutes(9) == 60
    hour = 3_600_000
    assert trend.is_stale(None, 0) and not trend.is_stale(0, 21 * hour) and trend.is_stale(0, 23 * hour)
    assert trend.should_run(None, 0, False, 0, 0) and not trend.should_run(None, 5 * 60_000, False, 1, 0)


def test_loose_documents(spark, tmp_path):
    (tmp_path / "d.json").write_text('{"url": ["u1", "u2"], "title": null, "location": "Sibiu", "salary": "1-2 RON", "tags": ["a", "b"]}\nbad\n{"url": "u3", "salary": [], "location": null}\n')
    got = {r.url: r for r in readers.scan_json(spark, str(tmp_path / "d.json")).collect()}
    assert (got["u1"].title, got["u1"].location, got["u1"].tags, got["u1"].salary, got["u1"].salary_is_array) == ("", ["Sibiu"], ["a", "b"], ["1-2 RON"], False)
    assert (got["u3"].location, got["u3"].salary, got["u3"].salary_is_array) == ([], [], True)


def test_facets(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "f string, n int")
    assert [tuple(r) for r in readers.facet(df, "f").collect()] == [("a", 2), ("b", 1)]
    assert readers.count(df, "n > 1") == 3
    df.write.parquet(str(tmp_path / "p"))
    assert readers.ping(spark, str(tmp_path / "p")) and not readers.ping(spark, str(tmp_path / "q"))
    assert readers.scan(spark, str(tmp_path / "p"), ("n", "x"), "f = 'a'", sort="n").columns == ["n"]


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# c\nA=1\nB='two'\nC\nD=\"x=y\"\nE = 5\n")
    env = {"E": "kept"}
    assert settings.load(tmp_path / "env", env) == {"A": "1", "B": "two", "D": "x=y"} and env["E"] == "kept"


def test_sampling_is_stable(spark):
    df = spark.range(200).select(F.concat(F.lit("https://h"), (F.col("id") % 3).cast("string"), F.lit(".ro/"), F.col("id").cast("string")).alias("url"))
    df = df.withColumn("host", probe.K.host_of("url"))
    first = {r.url for r in probe.sample_per_host(df, 5).collect()}
    assert first == {r.url for r in probe.sample_per_host(df.repartition(7), 5).collect()} and len(first) == 15
    got = probe.fetched(probe.sample_per_host(df, 2), lambda u: (404, "gone") if u.endswith("0") else (None, "timeout")).collect()
    assert {r.link for r in got} <= {"dead", "unreachable"} and len(got) == 6


def test_outlines(spark):
    line = [[0.0, 0.0], [1.0, 0.01], [2.0, 0.0], [2.0, 2.0]]
    assert outlines.simplified(outlines.np.array(line), 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]
    assert outlines.simplify_arcs(spark.createDataFrame([(7, line)], "arc long, points array<array<double>>"), 0.1).first().points == [[0, 0], [2, 0], [2, 2]]
    topology = {"arcs": [line, [[2.0, 2.0], [0.0, 0.0]]], "objects": {"o": {"geometries": [{"type": "Polygon", "arcs": [[0, 1]], "properties": {"name": "x"}}]}}}
    assert outlines.geojson(topology, "o", 0.1)["features"][0]["geometry"]["coordinates"] == [[[0, 0], [2, 0], [2, 2], [0, 0]]]
    packed = {"transform": {"scale": [0.5, 0.5], "translate": [10, 20]}, "arcs": [[[0, 0], [2, 0], [0, 2], [-2, -2]]], "objects": {"o": {"geometries": [{"type": "Polygon", "arcs": [[0]]}]}}}
    assert outlines.geojson(packed, "o", 0.01)["features"][0]["geometry"]["coordinates"][0][1] == [11.0, 20.0]


def test_derived(result):
    sheet = stats.source_sheet(result.rows, "s0.ro").collect()
    assert [r.severity for r in sheet] == sorted((r.severity for r in sheet), key=["grav", "minor", "info"].index)
    assert all(r["count"] > 0 for r in stats.worst_checks(stats.check_counts(result.rows)).collect())
    areas = result.rows.sparkSession.createDataFrame([("SIBIU",), ("Cluj",), ("Alba",)], "name string")
    got = {r.name: r.jobs for r in stats.county_scale(areas, stats.counties(result.rows)).collect()}
    assert got["Alba"] == 0 and sum(got.values()) == sum(r.jobs for r in stats.counties(result.rows).collect())
    assert result.rows.select(stats.change(F.lit(3), F.lit(5)).alias("c")).first().c.direction == "down"
    assert stats.large_sources(stats.source_counts(result.rows, result.today, result.since), 3).count() == 2
    assert result.links.select(probe.codes_text().alias("t")).filter("t <> ''").count() == 3


def test_question_of_info_rules():
    assert next(c for c in C.CATALOG if c.id == "missing_salary").counts_for is None
