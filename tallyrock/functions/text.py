"""String expressions with the semantics that the rules are defined by: UTF-16 lengths, Unicode white space, ASCII word edges."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What counts as white space, and the Romanian letters that fold to ASCII.
SPACE = r"[\s\x0B   -     　﻿]"
ROMANIAN = "ăâîșțşţĂÂÎȘȚŞŢ"
ROMANIAN_ASCII = "aaiststAAISTST"
#: An edge between ASCII word characters and others, whatever the letters of other alphabets.
EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
EMPTY_LABEL = "(gol)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: Column | str, pattern: str) -> Column:
    return col(c).rlike(pattern)


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"^{SPACE}+|{SPACE}+\z", "")


def is_blank(c: Column | str) -> Column:
    return trimmed(c) == ""


def utf16_length(c: Column | str) -> Column:
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def utf16_left(c: Column | str, n: int) -> Column:
    """The first n UTF-16 units; texts within the basic plane, nearly all, need no encoding."""
    whole = col(c)
    cut = F.decode(F.substring(F.encode(whole, "UTF-16BE"), 1, 2 * n), "UTF-16BE")
    return F.when(whole.rlike(r"[^\x{0}-\x{FFFF}]"), cut).otherwise(F.substring(whole, 1, n))


def ascii_folded(c: Column | str) -> Column:
    return F.translate(col(c), ROMANIAN, ROMANIAN_ASCII)


def fold_key(c: Column | str) -> Column:
    """A name reduced to a-z0-9 for matching."""
    return F.regexp_replace(F.lower(ascii_folded(c)), "[^a-z0-9]", "")


def normal_title(c: Column | str) -> Column:
    plain = F.lower(F.regexp_replace(col(c), "(?i)&amp;", "&"))
    return trimmed(F.regexp_replace(plain, SPACE + "+", " "))


def accent_free(c: Column | str) -> Column:
    """Lower case without accents, for comparing county names."""
    plain = F.translate(F.lower(col(c)), "áàâãäåāăąçćčďéèêëēėęěíìîïīįłñńňóòôõöøōřśšșşťțţúùûüūůýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiiilnnnooooooorsssstttuuuuuuyyzzz")
    return trimmed(plain)


@cache
def _nfkc():
    def normal(s):
        some = s.notna()
        return s.where(~some, None) if not some.any() else s.mask(some, s[some].map(lambda v: unicodedata.normalize("NFKC", v)))

    return F.pandas_udf(normal, StringType())


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility form. Spark has no such function; of ASCII texts, which it leaves alone, only a null goes to Python."""
    other = F.when(matches(c, r"[^\x00-\x7F]"), col(c))
    return F.coalesce(_nfkc()(other), col(c))


def latin_share(normal: Column | str) -> Column:
    """Share of Latin letters among the letters of an NFKC text; 1 below three letters."""
    letters = F.regexp_count(col(normal), F.lit(r"\p{L}"))
    return F.when(letters < 3, F.lit(1.0)).otherwise(F.regexp_count(col(normal), F.lit(r"\p{IsLatin}")) / letters)


def letters_only(normal: Column | str) -> Column:
    return F.regexp_replace(col(normal), r"[^\p{L}]", "")


def or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def or_label(c: Column | str, label: str = EMPTY_LABEL) -> Column:
    return F.coalesce(F.nullif(col(c), F.lit("")), F.lit(label))


def first_text(c: Column | str) -> Column:
    """The first element of an array of texts; "" if there is none."""
    return F.coalesce(F.try_element_at(col(c), F.lit(1)), F.lit(""))
