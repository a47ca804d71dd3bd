"""The same results in SQL for an independent engine, over the same tables. Its dialect has no lookarounds and no Java functions."""

from __future__ import annotations

from .functions.keys import FISCAL_WEIGHTS, FRESHNESS, INVALID_HOST, SIZES
from .operators import checks as C
from .samples import COMPANIES, LISTINGS

SPACES = r"[\s\x{A0}\x{FEFF}]"
HTML = r"</?[a-zA-Z][^>]*>|&([aA][mM][pP]|[qQ][uU][oO][tT]|[lL][tT]|[gG][tT]|[nN][bB][sS][pP]|[aA][pP][oO][sS]|#[0-9]+|#[xX][0-9a-fA-F]+);"
PHONE = r"(?:^|[^0-9])(?:(?:\+?40|0040)[\s.-]?|0)(?:7[0-9]{2}|[23][0-9]{2})[\s.().-]?[0-9]{3}[\s.().-]?[0-9]{3}(?:[^0-9]|$)"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def trim(c: str) -> str:
    return rf"regexp_replace({c}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def instant(c: str) -> str:
    return f"try_cast(replace(replace({c}, 'T', ' '), 'Z', '') AS TIMESTAMP)"


def fiscal_ok(key: str) -> str:
    total = " + ".join(f"{w} * TRY_CAST(substr(lpad(left({key}, length({key}) - 1), 9, '0'), {i}, 1) AS INT)" for i, w in enumerate(FISCAL_WEIGHTS, 1))
    return f"(length({key}) BETWEEN 2 AND 10 AND (({total}) * 10) % 11 % 10 = coalesce(TRY_CAST(right({key}, 1) AS INT), -1))"


def letters(c: str) -> str:
    return rf"regexp_replace({c}, '[^\p{{L}}]', '', 'g')"


def latin(c: str) -> str:
    return rf"CASE WHEN length({letters(c)}) < 3 THEN 1.0 ELSE length(regexp_replace({c}, '[^\p{{Latin}}]', '', 'g')) / length({letters(c)}) END"


def spaced(words: str) -> str:
    """A pattern of the rules with this dialect's flags and class of white space."""
    return words.replace("(?iu)", "(?i)").replace(C.S, SPACES).replace(C.S[1:-1], SPACES[1:-1])


def has_words(words: str) -> str:
    return rf"regexp_matches(title, '(?i)\b(?:{spaced(words)})\b')"


WEAK = "(" + " + ".join(f"CAST({has_words(w)} AS INT)" for w in C.ADULT_WEAK) + ")"


#: What each raw place of the sample gazetteer means, read off by hand: kind, value, how, county.
PLACES = {
    "Valdoria": ("fixed", "Valdoria", "exact", "Arbor"), "VALDORIA, Romania": ("fixed", "Valdoria", "exact", "Arbor"), "Str. Lunga nr. 4, Monteluna": ("fixed", "Monteluna", "exact", "Brezan"),
    "comuna Pietralunga": ("fixed", "Pietralunga", "alias", "Brezan"), "undeva langa Monteluna in sat": ("fixed", "Monteluna", "substring", "Brezan"), "Lunca": ("fixed", "Lunca", "exact", None), "Lunca, Brezan": ("fixed", "Lunca", "exact", "Brezan"),
    "Sector 3, București": ("fixed", "București", "sector to Bucuresti", "București"), "Bukarest": ("fixed", "București", "exact", "București"), "407123": ("fixed", "Poiana Alba", "postal-code", "Cornet"), "407124": ("junk", None, "not-a-place", None),
    "Pietralungacentru": ("fixed", "Pietralunga", "glued qualifier", "Brezan"), "Monteluma": ("fixed", "Monteluna", "typo-fixed (distance 1)", "Brezan"), "Valdxxia": ("international", "Valdxxia", "unknown-place", None), "maresta": ("junk", None, "unrecognised", None),
    "Bologna": ("international", "Bologna", "known-foreign", None), "kenya": ("international", "kenya", "known-foreign", None), "remote": ("junk", None, "placeholder", None), "Romania, all": ("junk", None, "placeholder", None), "": ("junk", None, "empty", None),
    "AB-1234-XY": ("junk", None, "not-a-place", None), "Fagetel, Dorna": ("fixed", "Fagetel", "exact (county-confirmed)", "Dorna"), "Fagetol, Dorna": ("fixed", "Fagetel", "typo-fixed (county-confirmed, distance 1)", "Dorna"),
    "Sf. Andrei": ("fixed", "Sfântu Andrei", "alias", "Cornet"), "Arbor": ("fixed", "Arbor", "exact", "Arbor"), "Monteluna": ("fixed", "Monteluna", "exact", "Brezan"),
}
_value = lambda v: "NULL" if v is None else f"'{v}'"
CASES = "places(raw, loc_kind, loc_value, loc_how, loc_county) AS (VALUES " + ", ".join(f"({', '.join(map(_value, (k, *v)))})" for k, v in PLACES.items()) + ")"
PLACE_CLASS = "CASE WHEN loc_kind = 'fixed' THEN CASE WHEN coalesce(loc_county, '') <> '' THEN 'placed' ELSE 'ambiguous' END WHEN loc_kind = 'international' THEN 'foreign' WHEN loc_how IN ('empty', 'placeholder') THEN loc_how ELSE 'gibberish' END"
BASE = f"""
{CASES}, listed AS ({LISTINGS}), company AS ({COMPANIES}),
catalog AS (SELECT regexp_replace(id, '^0+', '') AS key, max(id) AS id, max(company) AS name, max(status) AS status FROM company GROUP BY 1),
keyed AS (SELECT *, CASE WHEN url LIKE 'https://%' THEN regexp_extract(url, '^https://www\\.([^/]+)', 1) ELSE '{INVALID_HOST}' END AS host,
  regexp_replace(regexp_replace(regexp_replace(cif, '^[rR][oO]', ''), '[^0-9]', '', 'g'), '^0+', '') AS cif_key,
  CAST(floor((epoch({NOW}) - epoch({instant("date")})) / 86400) AS INT) AS age,
  {trim(rf"regexp_replace(lower(replace(title, '&amp;', '&')), '{SPACES}+', ' ', 'g')")} AS ntitle,
  CASE WHEN doc_id % 3 <> 0 THEN '' WHEN link_code IS NULL THEN 'unreachable' WHEN link_code IN (404, 410) THEN 'dead' WHEN link_code >= 400 THEN 'error' ELSE 'ok' END AS link,
  CASE WHEN doc_id % 31 <> 0 THEN CAST(DATE '2024-01-02' + CAST(doc_id % 30 AS INT) AS DATE) ELSE DATE '2024-02-01' END AS first_seen, doc_id % 31 = 0 AS is_new FROM listed),
l AS (SELECT k.*, p.loc_kind, p.loc_value, p.loc_how, p.loc_county, c.key IS NOT NULL AS found, c.name AS co_name, c.status AS co_status,
  CASE WHEN ntitle = '' THEN 0 ELSE row_number() OVER (PARTITION BY ntitle, cif_key, coalesce(nullif(p.loc_value, ''), lower(place)) ORDER BY date, url) - 1 END AS dup_index
  FROM keyed k LEFT JOIN catalog c ON nullif(k.cif_key, '') = c.key LEFT JOIN places p ON p.raw = k.place)"""
_IN = lambda values: ", ".join(f"'{v}'" for v in values)
RULES = {
    "missing_title": f"{trim('title')} = ''",
    "missing_company": f"{trim('company')} = ''",
    "missing_cif": f"{trim('cif')} = ''",
    "missing_location": "place = ''",
    "missing_date": "date = ''",
    "missing_workmode": "workmode = ''",
    "missing_tags": "tag_list = ''",
    "missing_salary": "pay = ''",
    "url_invalid": "url NOT LIKE 'https://%'",
    "title_too_long": "length(title) > 200",
    "title_html": f"regexp_matches(title, '{HTML}')",
    "title_untrimmed": rf"title <> {trim('title')} OR regexp_matches(title, '{SPACES}{{2,}}')",
    "company_not_uppercase": "company <> '' AND company <> upper(company)",
    "company_html": f"regexp_matches(company, '{HTML}')",
    "tags_diacritics": "regexp_matches(tag_list, '[ăâîșțşţĂÂÎȘȚŞŢ]')",
    "tags_not_lowercase": "tag_list <> lower(tag_list)",
    "tags_too_many": "tag_list <> '' AND len(string_split(tag_list, ',')) > 20",
    "workmode_invalid": f"workmode <> '' AND workmode NOT IN ({_IN(C.WORKMODES)})",
    "status_invalid": f"status NOT IN ({_IN(C.STATUSES)})",
    "title_other_alphabet": f"{latin('title')} < 0.5",
    "title_mixed_alphabets": f"{latin('title')} >= 0.85 AND {latin('title')} < 1",
    "title_fancy_letters": r"regexp_matches(title, '[\x{1D400}-\x{1D7FF}\x{FF21}-\x{FF5A}\x{2460}-\x{24FF}]')",
    "text_mojibake": f"regexp_matches(title, '{C.MOJIBAKE}') OR regexp_matches(company, '{C.MOJIBAKE}')",
    "company_status_invalid": f"found AND co_status NOT IN ({_IN(C.COMPANY_STATUSES)})",
    "date_invalid": f"date <> '' AND ({instant('date')} IS NULL OR {instant('date')} > {NOW} + INTERVAL 1 DAY)",
    "vdate_while_scraped": "vdate <> '' AND status = 'scraped'",
    "expiration_too_far": f"vdate <> '' AND expirationdate <> '' AND {instant('expirationdate')} > {instant('vdate')} + INTERVAL 30 DAY",
    "salary_bad_format": rf"pay <> '' AND NOT regexp_matches(pay, '^[0-9]+(\.[0-9]+)?-[0-9]+(\.[0-9]+)?\s+[A-Z]{{3}}$')",
    "cif_not_8_digits": "cif <> '' AND NOT regexp_matches(cif, '^[0-9]{8}$') AND NOT regexp_matches(cif, '^[rR][oO]')",
    "cif_ro_prefix": "regexp_matches(cif, '^[rR][oO]')",
    "cif_bad_checksum": f"cif <> '' AND NOT {fiscal_ok('cif_key')}",
    "cif_orphan": "cif <> '' AND NOT found",
    "company_mismatch": f"found AND company <> '' AND lower({trim('company')}) <> lower({trim('co_name')})",
    "company_not_active": f"found AND co_status IN ({_IN(C.NOT_ACTIVE)})",
    "loc_gibberish": "loc_kind = 'junk' AND loc_how IN ('unrecognised', 'not-a-place')",
    "loc_placeholder": "loc_kind = 'junk' AND loc_how = 'placeholder'",
    "loc_foreign": "loc_kind = 'international'",
    "loc_county_unknown": "loc_kind = 'fixed' AND coalesce(loc_county, '') = ''",
    "title_adult": f"{has_words(C.ADULT_STRONG_WORDS)} OR ({has_words(C.ADULT_GENERIC_WORDS)} AND NOT {has_words(C.ADULT_NEGATION_WORDS)}) OR (NOT regexp_matches(title, '{spaced(C.CHILDREN)}') AND ({WEAK} >= 2 OR ({WEAK} >= 1 AND {has_words(C.ADULT_CLUB_WORDS)})))",
    "contact_in_ad": rf"regexp_matches(title, '{PHONE}') OR regexp_matches(title, '(?:^|[^A-Za-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+\.[a-z]{{2,}}')",
    "title_too_short": f"{trim('title')} <> '' AND length({letters('title')}) < 3",
    "title_allcaps": f"length({letters('title')}) >= 6 AND {letters('title')} = upper({letters('title')}) AND {letters('title')} <> lower({letters('title')})",
    "repeated_listing": "dup_index > 0",
    "stale_scraped": "status = 'scraped' AND age > 30",
    "very_old": "age > 90",
    "url_error": "link = 'error'",
    "url_dead": "link = 'dead'",
}
_CIF = "cif || '  ' || company"
_TAGS = "replace(tag_list, ',', ', ')"
#: What is shown of a row that breaks a rule; its title where no other is given.
EVIDENCE = {
    "missing_cif": "company", "url_invalid": "l.url", "title_untrimmed": "'\"' || title || '\"'", "company_not_uppercase": "company", "company_html": "company", "tags_diacritics": _TAGS, "tags_not_lowercase": _TAGS,
    "tags_too_many": "len(string_split(tag_list, ',')) || ' tags: ' || array_to_string(string_split(tag_list, ',')[1:6], ', ') || '…'", "workmode_invalid": "workmode", "status_invalid": "status", "company_status_invalid": "company || '  → ' || co_status", "date_invalid": "date",
    "vdate_while_scraped": "title || '  vdate ' || vdate", "expiration_too_far": "'vdate ' || vdate || '  → ' || expirationdate", "salary_bad_format": "pay", "cif_not_8_digits": _CIF, "cif_ro_prefix": _CIF, "cif_bad_checksum": _CIF, "cif_orphan": _CIF,
    "company_mismatch": "company || '  ≠  ' || co_name", "company_not_active": "company || '  → ' || co_status", "loc_gibberish": "place", "loc_placeholder": "place", "loc_foreign": "place", "loc_county_unknown": "loc_value || ' (' || place || ')'",
    "repeated_listing": "title || '  → ' || coalesce(nullif(loc_value, ''), place)", "stale_scraped": "title || '  → ' || age || ' days'", "very_old": "title || '  → ' || age || ' days'", "url_error": "coalesce(CAST(link_code AS VARCHAR), '') || '  ' || l.url",
    "url_dead": "coalesce(CAST(link_code AS VARCHAR), '') || '  ' || l.url",
}
META = "meta(ordinal, check_id, question, severity) AS (VALUES " + ", ".join(f"({k}, '{c.id}', {repr(c.counts_for) if c.counts_for else 'NULL'}, '{c.severity}')" for k, c in enumerate(C.CATALOG)) + ")"
ISSUES = "issues AS (" + " UNION ALL ".join(f"SELECT doc_id, url, host, '{k}' AS check_id FROM l WHERE {v}" for k, v in RULES.items()) + ")"
BAD = "bad AS (SELECT DISTINCT i.doc_id FROM issues i JOIN meta m USING (check_id) WHERE m.severity = 'grav')"
R = "r AS (SELECT l.*, b.doc_id IS NOT NULL AS affected FROM l LEFT JOIN bad b USING (doc_id))"
WITH = f"WITH {BASE}, {META}, {ISSUES}, {BAD}, {R} "


def zero_filled(labels: tuple[str, ...], counts: str, value: str) -> str:
    """SELECT ordinal, value and a count column, of labels in order; counts is a query of (value, n)."""
    rows = ", ".join(f"({k}, '{v}')" for k, v in enumerate(labels))
    return f", labels(ordinal, value) AS (VALUES {rows}), counts AS ({counts}) SELECT ordinal, value, coalesce(n, 0) AS {value} FROM labels LEFT JOIN counts USING (value)"


def freshness(age: str) -> str:
    return f"CASE WHEN {age} IS NULL THEN '{FRESHNESS[4]}' WHEN {age} <= 7 THEN '{FRESHNESS[0]}' WHEN {age} <= 30 THEN '{FRESHNESS[1]}' WHEN {age} <= 90 THEN '{FRESHNESS[2]}' ELSE '{FRESHNESS[3]}' END"


def size_class(n: str) -> str:
    return f"CASE WHEN {n} = 1 THEN '{SIZES[0]}' WHEN {n} <= 10 THEN '{SIZES[1]}' WHEN {n} <= 100 THEN '{SIZES[2]}' WHEN {n} <= 1000 THEN '{SIZES[3]}' ELSE '{SIZES[4]}' END"
