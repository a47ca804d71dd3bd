"""Identifiers, hashes, hosts, ages and the classes that rows are counted by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, col, trimmed

DAY_US = 86_400_000_000
INVALID_HOST = "(url invalid)"
# Weights of the fiscal checksum, parameters of the 32-bit hash, class labels in display order.
FISCAL_WEIGHTS = "753217532"
FNV_SEED, FNV_PRIME = 2166136261, 16777619
FRESHNESS = ("≤7", "≤30", "≤90", ">90", "no date")
SIZES = ("1", "2-10", "11-100", "101-1000", ">1000")
LINK_STATES = ("ok", "dead", "error", "unreachable")


def fiscal_key(c: Column | str) -> Column:
    """Digits of a fiscal id, without its RO prefix and leading zeros."""
    digits = F.regexp_replace(F.regexp_replace(col(c), rf"(?i)^{SPACE}*ro", ""), "[^0-9]", "")
    return F.regexp_replace(digits, "^0+", "")


def fiscal_checksum_ok(c: Column | str) -> Column:
    key = fiscal_key(c)
    body = F.lpad(F.substring(key, F.lit(1), F.length(key) - 1), 9, "0")
    total = sum((F.coalesce(F.substring(body, i + 1, 1).try_cast("int"), F.lit(0)) * int(w) for i, w in enumerate(FISCAL_WEIGHTS)), F.lit(0))
    rest = (total * 10) % 11
    return F.length(key).between(2, 10) & (F.when(rest == 10, 0).otherwise(rest) == F.substring(key, -1, 1).try_cast("int"))


def fiscal_shape_ok(c: Column | str) -> Column:
    return col(c).rlike(r"^[0-9]{8}\z")


def fiscal_has_prefix(c: Column | str) -> Column:
    return col(c).rlike(rf"(?i)^{SPACE}*ro")


def fnv1a(c: Column | str) -> Column:
    """32-bit FNV-1a over UTF-16 units, as a long."""
    raw = F.hex(F.encode(col(c), "UTF-16BE"))
    units = F.when(F.length(raw) > 0, F.transform(F.sequence(F.lit(0), (F.length(raw) / 4).cast("int") - 1), lambda i: F.conv(F.substring(raw, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    step = lambda h, u: (h.bitwiseXOR(u) * FNV_PRIME).bitwiseAND(F.lit(4294967295))
    return F.aggregate(units, F.lit(FNV_SEED).cast("bigint"), step)


def url_is_web(c: Column | str) -> Column:
    """Whether a text is an absolute http(s) URL with a host."""
    return F.coalesce(trimmed(c).rlike(r"(?i)^https?:[/\\]*[^/?#\\\s@:]"), F.lit(False)) & ~trimmed(c).rlike(r"(?i)^https?:[/\\]*(?:[^/?#\\@]*@)?[^/?#\\]*[\s<>^|%]")


def host_of(c: Column | str) -> Column:
    """The host of a URL in lower case without one leading www.; a label for what is no web URL."""
    found = F.regexp_extract(F.lower(trimmed(c)), r"^https?:[/\\]*(?:[^/?#\\@]*@)?(?:www\.)?([^/:?#\\\s]+)", 1)
    return F.when(url_is_web(c), F.coalesce(F.nullif(found, F.lit("")), F.lit(INVALID_HOST))).otherwise(F.lit(INVALID_HOST))


def instant(c: Column | str) -> Column:
    """An ISO 8601 text as a timestamp; null for others."""
    return F.when(col(c).rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?"), F.try_to_timestamp(col(c)))


def age_days(c: Column | str, now: str) -> Column:
    """Whole days from an ISO text to now; negative for the future, null if unparsable."""
    return age_between(instant(c), now)


def age_between(t: Column, now: str) -> Column:
    return F.floor((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(t)) / DAY_US).cast("int")


def freshness(age: Column | str) -> Column:
    a = col(age)
    return F.when(a.isNull(), FRESHNESS[4]).when(a <= 7, FRESHNESS[0]).when(a <= 30, FRESHNESS[1]).when(a <= 90, FRESHNESS[2]).otherwise(FRESHNESS[3])


def size_class(n: Column | str) -> Column:
    c = col(n)
    return F.when(c == 1, SIZES[0]).when(c <= 10, SIZES[1]).when(c <= 100, SIZES[2]).when(c <= 1000, SIZES[3]).otherwise(SIZES[4])


def link_state(code: Column | str) -> Column:
    c = col(code)
    return F.when(c.isNull(), "unreachable").when(c.isin(404, 410), "dead").when(c >= 400, "error").otherwise("ok")


def plain_county(c: Column | str) -> Column:
    return trimmed(F.regexp_replace(col(c), rf"(?i)^municipiul{SPACE}+", ""))


def window_start(today: str, since: Column | None = None, days: int = 10) -> Column:
    """First day of the last so many days, never the baseline day or before."""
    first = F.date_sub(F.lit(today).cast("date"), days - 1)
    return first if since is None else F.greatest(first, F.date_add(since, 1))


def log_scale(n: Column | str) -> Column:
    return F.log10(col(n) + 1)


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    return F.round(100 * part / whole, digits)
