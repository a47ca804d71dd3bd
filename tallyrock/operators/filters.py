"""The drill-down: filters that are all ANDed, and pages of what they leave.

Every filter is a Column, so Spark pushes what it can to the files. Unknown names are errors; None and "" mean no filter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as X
from . import checks as C
from .stats import place_class

DEFAULT_SIZE, LARGEST_SIZE = 50, 200


@dataclass(frozen=True)
class Context:
    """What the filters on days refer to: the run's day, and the day that tracking began."""

    today: str
    since: str | None = None


def _days(value, ctx: Context) -> Column:
    try:
        days = int(value)
    except (TypeError, ValueError):
        return F.lit(False)
    if days < 1:
        return F.lit(False)
    return F.coalesce(F.col("first_seen") >= K.window_start(ctx.today, F.lit(ctx.since).cast("date") if ctx.since else None, days), F.lit(False))


def _first_day(value: str, ctx: Context) -> Column:
    if ctx.since and value <= ctx.since:
        return F.lit(False)
    return F.col("first_seen") == F.lit(value).try_cast("date")


def _text(value: str) -> Column:
    needle = F.lower(F.lit(value))
    return F.contains("ntitle", needle) | F.contains(F.lower("company"), needle)


FILTERS = {
    "check": lambda v, c: F.array_contains("issues", v),
    "question": lambda v, c: C.fails_any(C.of_question(v)),
    "trusted": lambda v, c: ~C.is_affected(),
    "affected": lambda v, c: C.is_affected(),
    "new": lambda v, c: F.col("is_new"),
    "days": _days,
    "first_day": _first_day,
    "host": lambda v, c: F.col("host") == v,
    "county": lambda v, c: X.accent_free(K.plain_county("loc.county")) == X.accent_free(F.lit(v)),
    "locality": lambda v, c: F.col("loc.value") == v,
    "loc": lambda v, c: place_class() == v,
    "rawloc": lambda v, c: F.array_join("location", ", ") == v,
    "place": lambda v, c: F.col("loc.value") == v,
    "company": lambda v, c: F.col("cif_key") == v,
    "workmode": lambda v, c: X.or_label("workmode") == v,
    "status": lambda v, c: X.or_label("status") == v,
    "title": lambda v, c: F.col("ntitle") == v,
    "tag": lambda v, c: F.array_contains("tags", v),
    "fresh": lambda v, c: K.freshness("age") == v,
    "link": lambda v, c: F.col("link") == v,
    "linkbad": lambda v, c: F.col("link").isin("dead", "error"),
    "q": lambda v, c: _text(v),
}


def where(filters: dict, ctx: Context) -> Column:
    """All filters as one condition. Flags (trusted, affected, new, linkbad) are on if true."""
    out = F.lit(True)
    for name, value in filters.items():
        if name not in FILTERS:
            raise ValueError(f"there is no filter named {name}")
        if value is None or value == "" or value is False:
            continue
        out = out & FILTERS[name](value, ctx)
    return out


def paging(page=None, size=None) -> tuple[int, int]:
    """Page from 1, and size from 1 to LARGEST_SIZE; defaults for what is no number or 0."""

    def number(v, default):
        try:
            return int(float(v)) or default
        except (TypeError, ValueError, OverflowError):
            return default

    return max(1, number(page, 1)), min(LARGEST_SIZE, max(1, number(size, DEFAULT_SIZE)))


def page_of(rows: DataFrame, page=None, size=None) -> DataFrame:
    """One page by date, newest first, ties by url."""
    page, size = paging(page, size)
    return rows.orderBy(F.desc("date"), "url").offset((page - 1) * size).limit(size)


def query(rows: DataFrame, ctx: Context, page=None, size=None, **filters) -> dict:
    """total, page, size, pages, and items as a DataFrame."""
    found = rows.filter(where(filters, ctx))
    total = found.count()
    page, size = paging(page, size)
    return {"total": total, "page": page, "size": size, "pages": math.ceil(total / size), "items": page_of(found, page, size)}
