"""One run: enrich, mark, probe, rank repeats, apply the rules, aggregate, and keep what the next run needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks, dedupe, enrich, filters, probe, state, stats
from ..operators.places import Gazetteer
from ..operators.vocabulary import Vocabulary
from ..sources import store
from . import trend as T


@dataclass
class Result:
    rows: DataFrame
    catalog: DataFrame
    marked: state.Marked
    links: DataFrame
    now: str
    today: str
    held: list[DataFrame]

    def context(self) -> filters.Context:
        return filters.Context(self.today, self.since)

    @cached_property
    def flow(self) -> dict:
        return self.marked.flow.first().asDict()

    @cached_property
    def since(self) -> str | None:
        found = self.marked.since.first()[0]
        return str(found) if found else None

    def close(self) -> None:
        """Gives back what is held in memory."""
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def jobs(self, page=None, size=None, **by) -> dict:
        """The drill-down."""
        return filters.query(self.rows, self.context(), page, size, **by)


def analyse(
    listings: DataFrame, companies: DataFrame, gazetteer: Gazetteer | None, before: DataFrame, now: str, responses: DataFrame | None = None, previous: DataFrame | None = None, vocabulary: Vocabulary | None = None,
    fetch: Callable | None = None, log: Callable[[str, dict], None] = lambda step, info: None, persist: bool = True,
) -> Result:
    """Rows with issues and what they are counted with. Links come from responses (url, link_code, link_reason), from a fetch of a
    sample, or from the previous rows. The rows are persisted, since every aggregate reads them, unless told otherwise; close() the result when done."""
    today = now[:10]
    catalog = enrich.companies(companies)
    held: list[DataFrame] = []
    rows = enrich.jobs(listings, catalog, gazetteer, now, vocabulary, held)
    log("enriched", {})
    marked = state.mark(rows, before, today)
    rows = marked.jobs
    if responses is not None:
        rows = probe.with_links(rows, probe.classified(responses))
    elif fetch is not None:
        rows = probe.with_links(rows, probe.fetched(probe.sample_per_host(rows), fetch))
    elif previous is not None:
        rows = probe.carried_over(rows, previous)
    else:
        rows = rows.withColumn("link", F.lit("")).withColumn("link_code", F.lit(None).cast("int")).withColumn("link_reason", F.lit(""))
    rows = checks.with_issues(dedupe.repeated(rows), now)
    if persist:
        held.append(rows := rows.persist())
    log("checked", {})
    return Result(rows, catalog, marked, probe.per_host(rows), now, today, held)


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def summary(r: Result) -> dict:
    """The whole summary document; its tables are bounded by the catalog, by limits, and by the number of hosts."""
    start = stats.arrivals(r.rows, r.today, r.since)
    fresh = r.rows.filter("is_new")
    one = lambda df: df.first().asDict(recursive=True)
    hosts = stats.top_hosts_per_check(r.rows)
    shown = stats.samples(r.rows)
    tops, values = {}, {}
    for row in _rows(hosts.orderBy("check_id", "rank")):
        tops.setdefault(row["check_id"], []).append({"host": row["host"], "jobs": row["jobs"]})
    for row in _rows(shown.orderBy("check_id", "rank")):
        values.setdefault(row["check_id"], []).append({"value": row["evidence"], "url": row["url"], "host": row["host"]})
    arrived = lambda rows: {"jobs": rows.count(), "affected": rows.filter(checks.is_affected()).count(), "hosts": _rows(stats.by_host(rows)), "checks": _rows(stats.grave_counts(rows))}
    from_day = start.sparkSession.range(1).select(stats.K.window_start(r.today, F.lit(r.since).cast("date") if r.since else None).alias("d")).first()["d"]
    return {
        "run_at": r.now,
        "totals": one(stats.totals(r.rows, r.catalog)),
        "questions": _rows(stats.question_counts(r.rows)),
        "checks": [{**c, "samples": values.get(c["check_id"], []), "top_hosts": tops.get(c["check_id"], [])} for c in _rows(stats.check_counts(r.rows))],
        "overview": {"workmode": _rows(stats.work_modes(r.rows)), "freshness": _rows(stats.freshness(r.rows)), **one(stats.extras(r.rows))},
        "map": {**one(stats.unplaced(r.rows)), "counties": _rows(stats.counties(r.rows)), "top_localities": _rows(stats.localities(r.rows)), "top_foreign": _rows(stats.foreign_places(r.rows)), "top_unplaced": _rows(stats.raw_unplaced(r.rows))},
        "companies": {"top": _rows(stats.top_companies(r.rows, r.catalog)), "size_buckets": _rows(stats.size_classes(r.rows)), "status": _rows(stats.company_statuses(r.catalog)), **one(stats.company_totals(r.rows, r.catalog))},
        "occupations": {"top_titles": _rows(stats.top_titles(r.rows)), "top_tags": _rows(stats.top_tags(r.rows)), **one(stats.distinct_titles(r.rows))},
        "sources": _rows(stats.sources(r.rows, r.today, r.since, r.links)),
        "incoming": {"window": {"days": stats.WINDOW_DAYS, "from": str(from_day), "partial": False, **arrived(start), "by_day": _rows(stats.by_day(start))}, **r.flow, **arrived(fresh)},
        "links": one(probe.totals(r.links)),
    }


def snapshot(r: Result, found: dict) -> DataFrame:
    """A day's row of history."""
    questions = [(q["question"], q["affected"]) for q in found["questions"]]
    hosts = [(s["host"], s["jobs"], s["affected"]) for s in found["sources"]]
    t, i = found["totals"], found["incoming"]
    row = (r.now, tuple(t[k] for k in ("jobs", "companies", "trusted", "affected", "format")), (i["jobs"], i["affected"], i["gone"]), questions, hosts, r.rows.sparkSession.sql(f"SELECT date'{r.today}'").first()[0])
    return r.rows.sparkSession.createDataFrame([row], store.HISTORY)


def run(spark: SparkSession, root: str, listings: DataFrame, companies: DataFrame, gazetteer: Gazetteer | None, now: str, **how) -> dict:
    """A run over the folder root, which keeps state, rows, history and summary; returns the summary."""
    result = analyse(listings, companies, gazetteer, store.load_state(spark, f"{root}/state"), now, **how)
    found = summary(result)
    store.upsert_history(snapshot(result, found), f"{root}/history")
    history = store.load_history(spark, f"{root}/history")
    found["trend"] = next(iter(_rows(T.trend(history, result.today))), None)
    found["recent_runs"] = _rows(T.recent_runs(history))
    store.write_rows(enrich.compact(result.rows), f"{root}/rows", "parquet")
    store.save_state(result.marked.state, f"{root}/state")
    store.write_summary(spark, found, f"{root}/summary")
    result.close()
    return found


def report(found: dict, limit: int = 12) -> str:
    """A run as text: trusted rows, questions, and the rules that fired most."""
    t = found["totals"]
    lines = [f"{t['trusted']} of {t['jobs']} jobs are trusted"]
    lines += [f"  {q['label']:<28} {q['affected']}" for q in found["questions"]]
    fired = sorted((c for c in found["checks"] if c["count"]), key=lambda c: (-c["count"], c["check_id"]))
    return "\n".join(lines + [f"  {c['count']:>8}  {c['check_id']}" for c in fired[:limit]])
