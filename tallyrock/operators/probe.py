"""Link probes: a deterministic sample of each host, the state of its links, and their summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keys as K

PER_HOST = 15


def sample_per_host(rows: DataFrame, per_host: int = PER_HOST) -> DataFrame:
    """Of each valid host the rows with the smallest hash of their url; the same rows in every run."""
    order = Window.partitionBy("host").orderBy("_hash", "url")
    ranked = rows.filter(F.col("host") != K.INVALID_HOST).withColumn("_hash", K.fnv1a("url")).withColumn("_nth", F.row_number().over(order))
    return ranked.filter(F.col("_nth") <= per_host).drop("_hash", "_nth")


def fetched(sample: DataFrame, fetch: Callable[[str], tuple[int | None, str]]) -> DataFrame:
    """(url, link, link_code, link_reason) by an injected fetch: url to status, null if there was no answer, and reason.

    fetch follows redirects and gives up after its own time limit; partitions bound how many run at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [fetch(u) for u in f["url"]]
            yield pd.DataFrame({"url": f["url"], "link_code": pd.array([c for c, _ in found], dtype="Int32"), "link_reason": [r for _, r in found]})

    got = sample.select("url").mapInPandas(run, "url string, link_code int, link_reason string")
    return classified(got)


def classified(responses: DataFrame) -> DataFrame:
    """Adds link to (url, link_code, link_reason)."""
    return responses.select("url", K.link_state("link_code").alias("link"), "link_code", F.coalesce("link_reason", F.lit("")).alias("link_reason"))


def with_links(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with link, link_code and link_reason; link is "" where a row wasn't sampled."""
    kept = rows.drop("link", "link_code", "link_reason").join(links.select("url", "link", "link_code", "link_reason").dropDuplicates(["url"]), "url", "left")
    return kept.withColumn("link", F.coalesce("link", F.lit(""))).withColumn("link_reason", F.coalesce("link_reason", F.lit("")))


def carried_over(rows: DataFrame, previous: DataFrame) -> DataFrame:
    """rows with the verdicts of the run before, for runs without probes."""
    return with_links(rows, previous.filter("link <> ''"))


def per_host(rows: DataFrame) -> DataFrame:
    """(host, sampled, dead, error, unreachable, codes) of the sampled rows; codes maps each HTTP status to its count."""
    sampled = rows.filter("link <> ''")
    states = sampled.groupBy("host").agg(F.count(F.lit(1)).alias("sampled"), *(F.count_if(F.col("link") == s).alias(s) for s in ("dead", "error", "unreachable")))
    return states.join(code_maps(sampled, "host"), "host", "left").withColumn("codes", F.coalesce("codes", F.create_map().cast("map<string,bigint>")))


def code_maps(rows: DataFrame, by: str) -> DataFrame:
    """(by, codes): counts of the HTTP statuses as a map."""
    counts = rows.filter("link_code is not null").groupBy(by, F.col("link_code").cast("string").alias("code")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))


def merged_codes(maps: DataFrame, codes: str = "codes") -> DataFrame:
    """(code, n): the sum of maps of counts."""
    return maps.select(F.explode(codes).alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n"))


def totals(hosts: DataFrame) -> DataFrame:
    """One row: sampled, ok, dead, error, unreachable, and the merged codes."""
    counts = hosts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("sampled", "dead", "error", "unreachable")))
    codes = merged_codes(hosts).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("code", "n")))).alias("codes"))
    return counts.join(codes).withColumn("ok", F.expr("sampled - dead - error - unreachable"))


def problem_share(hosts: DataFrame) -> DataFrame:
    """Adds share: dead and failing links among the sampled."""
    return hosts.withColumn("share", F.round((F.col("dead") + F.col("error")) / F.col("sampled"), 4))


def codes_text(codes: str = "codes", least: int = 0):
    """Statuses and counts as one text, in order of status; those from least on."""
    entries = F.filter(F.array_sort(F.map_entries(codes)), lambda x: x["key"].cast("int") >= least)
    return F.array_join(F.transform(entries, lambda x: F.concat(x["key"], F.lit(" × "), x["value"].cast("string"))), ", ")
