"""The rule catalog: what can be wrong with a listing, as Column predicates over enriched rows.

A rule's count is the number of rows whose ``issues`` hold its id, and its list are those rows: nothing else computes either.
New rules are added with ``register_check``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as X
from ..functions.text import EDGE, SPACE

# Enumerations of the contract.
WORKMODES = ("remote", "on-site", "hybrid")
STATUSES = ("scraped", "tested", "verified", "published")
COMPANY_STATUSES = ("activ", "suspendat", "inactiv", "radiat")
NOT_ACTIVE = ("suspendat", "inactiv", "radiat")
# Patterns that decide results.
HTML = r"(?i)</?[a-z][^>]*>|&(amp|quot|lt|gt|nbsp|apos|#[0-9]+|#x[0-9a-f]+);"
FANCY = r"[\x{1D400}-\x{1D7FF}\x{FF21}-\x{FF5A}\x{2460}-\x{24FF}]"
MOJIBAKE = r"â€|Ã[¢©ª«¨ƒ]|Å[£¾]|Äƒ|È[™›]|Â[«»°ª ]"
ROMANIAN = "[" + X.ROMANIAN + "]"
PHONE = rf"(?:^|[^0-9])(?:(?:\+?40|0040)[{SPACE[1:-1]}.-]?|0)(?:7[0-9]{{2}}|[23][0-9]{{2}})[{SPACE[1:-1]}.().-]?[0-9]{{3}}[{SPACE[1:-1]}.().-]?[0-9]{{3}}(?![0-9])"
EMAIL = r"(?:^|[^A-Za-z0-9._%+-])[a-z0-9][a-z0-9._%+-]*@[a-z0-9-]+\.[a-z]{2,}"
PERSONAL_ID = rf"{EDGE}[1-8][0-9]{{12}}{EDGE}"
SALARY = rf"^[0-9]+(\.[0-9]+)?-[0-9]+(\.[0-9]+)?{SPACE}+[A-Z]{{3}}\z"


# Words that decide whether a listing is adult content; S stands for the white space between them.
S = SPACE
ADULT_STRONG_WORDS = rf"videochat|video{S}*chat|onlyfans|only{S}*fans|escort[aăe]?|masaj{S}+(?:erotic|senzual)|striptease|strip{S}*club|cam{S}*girl|webcam{S}*(?:model|studio)"
ADULT_GENERIC_WORDS = rf"adult{S}*(?:industry|content|entertainment)|(?:industri[ae]|con[țt]inut|filme){S}+pentru{S}+adul[țt]i|xxx"
ADULT_NEGATION_WORDS = rf"non[-{S[1:-1]}]?adult"
ADULT_CLUB_WORDS = rf"night{S}*club|club{S}*de{S}*noapte|passion{S}*club|hostess{S}*club"
ADULT_WEAK = ("dansatoare", "animatoare", "hostess", "masaj")
CHILDREN = rf"(?iu)copii|zile{S}*na[sș]tere|anivers[aă]r|mascot|botez|gr[aă]dini[tț]"


def _phrase(words: str) -> str:
    return f"(?iu){EDGE}(?:{words}){EDGE}"


ADULT_STRONG, ADULT_GENERIC, ADULT_NEGATION, ADULT_CLUB = map(_phrase, (ADULT_STRONG_WORDS, ADULT_GENERIC_WORDS, ADULT_NEGATION_WORDS, ADULT_CLUB_WORDS))

AVAILABILITY, CORRECTNESS, FORMAT = "exista", "adevar", "format"
GRAVE, MINOR, INFO = "grav", "minor", "info"


@dataclass(frozen=True)
class Question:
    """What a reader asks of a listing; a row fails it if one of its rules, but for measured ones, fires."""

    id: str
    label: str
    why: str
    owner: str


QUESTIONS = (
    Question(AVAILABILITY, "Is the job still there?", "The page is gone, or its company no longer operates.", "core"),
    Question(CORRECTNESS, "Is what it says right?", "Its place, company or content is missing, wrong or unfit.", "scraper"),
    Question(FORMAT, "Does it keep to the format?", "The contract is broken where a reader hardly sees it.", "scraper"),
)

Predicate = Callable[[str], Column]


@dataclass(frozen=True)
class Check:
    """One rule. test and show get the run's time; show is the value to put beside the rule, the title by default."""

    id: str
    question: str
    severity: str
    owner: str
    label: str
    fix: str
    test: Predicate
    show: Callable[[], Column] | None = None

    @property
    def counts_for(self) -> str | None:
        """The question that it can make a row fail."""
        return None if self.severity == INFO else self.question


def _c(name: str) -> Column:
    return F.col(name)


def _has_text(name: str) -> Column:
    return _c(name) != ""


def _any(name: str, test: Callable[[Column], Column]) -> Column:
    return F.exists(name, test)


def _joined(name: str, by: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.coalesce(x, F.lit(""))), by)


def contact_fields() -> list[Column]:
    return [_c("title"), _c("company"), _joined("location", " "), _joined("tags", " ")]


def has_contact(c: Column) -> Column:
    return c.rlike(PHONE) | c.rlike(EMAIL) | c.rlike(PERSONAL_ID)


def looks_adult(title: Column) -> Column:
    """A strong word; a general one that isn't negated; or two weak ones, or one and a club, unless children are meant."""
    weak = sum((title.rlike(_phrase(w)).cast("int") for w in ADULT_WEAK), F.lit(0))
    weakly = ~title.rlike(CHILDREN) & ((weak >= 2) | ((weak >= 1) & title.rlike(ADULT_CLUB)))
    return title.rlike(ADULT_STRONG) | (title.rlike(ADULT_GENERIC) & ~title.rlike(ADULT_NEGATION)) | weakly


def salary_is_bad() -> Column:
    first = X.first_text("salary")
    listed = (F.size("salary") != 1) | ~first.rlike(SALARY)
    return F.when(_c("salary_is_array"), listed).otherwise((first != "") & ~first.rlike(SALARY))


def salary_is_missing() -> Column:
    return F.when(_c("salary_is_array"), F.size("salary") == 0).otherwise(X.first_text("salary") == "")


def _shouted() -> Column:
    only = X.letters_only("_normal")
    return (X.utf16_length(only) >= 6) & (only == F.upper(only)) & (only != F.lower(only))


def _expires_late(now: str) -> Column:
    start, end = K.instant("vdate"), K.instant("expirationdate")
    return _has_text("vdate") & _has_text("expirationdate") & (F.unix_micros(end) > F.unix_micros(start) + 30 * K.DAY_US)


def _bad_date(now: str) -> Column:
    t = K.instant("date")
    return _has_text("date") & (t.isNull() | (F.unix_micros(t) > F.unix_micros(F.lit(now).cast("timestamp")) + K.DAY_US))


def _place_text() -> Column:
    return _joined("location", ", ")


def _two(a: Column, sign: str, b: Column) -> Column:
    return F.concat(a, F.lit(sign), F.coalesce(b.cast("string"), F.lit("")))


def _company_of(sign: str, field: str) -> Callable[[], Column]:
    return lambda: _two(_c("company"), sign, _c(f"co.{field}"))


_in_catalog = lambda now: _c("co").isNotNull()
_cif_and_company = lambda: _two(_c("cif"), "  ", _c("company"))
_aged = lambda: F.concat(_c("title"), F.lit("  → "), F.coalesce(_c("age").cast("string"), F.lit("")), F.lit(" days"))
_link = lambda: _two(F.coalesce(_c("link_code").cast("string"), F.lit("")), "  ", _c("url"))

CATALOG: list[Check] = [
    Check("missing_title", CORRECTNESS, GRAVE, "scraper", "No title", "Don't index a listing whose title selector found nothing.", lambda now: X.is_blank("title")),
    Check("missing_company", CORRECTNESS, GRAVE, "scraper", "No company", "Take the legal name from the page, or from the catalog by fiscal id.", lambda now: X.is_blank("company")),
    Check("missing_cif", CORRECTNESS, GRAVE, "scraper", "No fiscal id", "Find the fiscal id before indexing.", lambda now: X.is_blank("cif"), lambda: _c("company")),
    Check("missing_location", CORRECTNESS, GRAVE, "scraper", "No place", "Read the place from the page; say so where work is remote.", lambda now: F.forall("location", lambda x: X.is_blank(F.coalesce(x, F.lit(""))))),
    Check("missing_date", FORMAT, MINOR, "scraper", "No date", "Write the scraping date in ISO 8601, UTC.", lambda now: _c("date") == ""),
    Check("missing_workmode", FORMAT, MINOR, "scraper", "No work mode", "Derive remote, on-site or hybrid from the text.", lambda now: _c("workmode") == ""),
    Check("missing_tags", FORMAT, MINOR, "scraper", "No tags", "Make tags from title and description.", lambda now: F.size("tags") == 0),
    Check("missing_salary", FORMAT, INFO, "scraper", "No salary", "Give MIN-MAX CURRENCY where the page does.", lambda now: salary_is_missing()),
    Check("url_invalid", CORRECTNESS, GRAVE, "scraper", "Address is no web URL", "Build absolute addresses with scheme and host.", lambda now: ~K.url_is_web("url"), lambda: _c("url")),
    Check("title_too_long", FORMAT, MINOR, "scraper", "Title over 200 characters", "Take the job's name only.", lambda now: X.utf16_length("title") > 200),
    Check("title_html", FORMAT, MINOR, "scraper", "Markup in the title", "Decode entities and drop tags.", lambda now: X.matches("title", HTML)),
    Check("title_untrimmed", FORMAT, MINOR, "scraper", "Stray spaces in the title", "Trim, and join runs of spaces.", lambda now: (_c("title") != X.trimmed("title")) | X.matches("title", SPACE + "{2,}"), lambda: F.concat(F.lit('"'), _c("title"), F.lit('"'))),
    Check("company_not_uppercase", FORMAT, MINOR, "scraper", "Company not in capitals", "Write the legal name in capitals.", lambda now: _has_text("company") & (_c("company") != F.upper("company")), lambda: _c("company")),
    Check("company_html", FORMAT, MINOR, "scraper", "Markup in the company", "Decode entities and drop tags.", lambda now: X.matches("company", HTML), lambda: _c("company")),
    Check("tags_diacritics", FORMAT, MINOR, "scraper", "Diacritics in tags", "Fold tags to plain letters.", lambda now: _any("tags", lambda t: t.rlike(ROMANIAN)), lambda: _joined("tags", ", ")),
    Check("tags_not_lowercase", FORMAT, MINOR, "scraper", "Capitals in tags", "Write tags in lower case.", lambda now: _any("tags", lambda t: t != F.lower(t)), lambda: _joined("tags", ", ")),
    Check("tags_too_many", FORMAT, MINOR, "scraper", "More than 20 tags", "Keep the 20 that matter.", lambda now: F.size("tags") > 20, lambda: F.concat(F.size("tags").cast("string"), F.lit(" tags: "), F.array_join(F.slice("tags", 1, 6), ", "), F.lit("…"))),
    Check("workmode_invalid", FORMAT, MINOR, "scraper", "Unknown work mode", "Map to remote, on-site or hybrid.", lambda now: _has_text("workmode") & ~_c("workmode").isin(*WORKMODES), lambda: _c("workmode")),
    Check("status_invalid", FORMAT, MINOR, "scraper", "Unknown status", "Send new listings as scraped.", lambda now: ~_c("status").isin(*STATUSES), lambda: _c("status")),
    Check("title_other_alphabet", CORRECTNESS, GRAVE, "scraper", "Title in another alphabet", "Leave such listings out, or translate them.", lambda now: X.latin_share("_normal") < 0.5),
    Check("title_mixed_alphabets", FORMAT, MINOR, "scraper", "Look-alike letters in the title", "Use Latin letters; others can't be searched.", lambda now: (X.latin_share("_normal") >= 0.85) & (X.latin_share("_normal") < 1)),
    Check("title_fancy_letters", FORMAT, MINOR, "scraper", "Decorative letters in the title", "Normalise to NFKC.", lambda now: X.matches("title", FANCY)),
    Check("text_mojibake", FORMAT, MINOR, "scraper", "Wrongly decoded text", "Read the page as UTF-8.", lambda now: X.matches("title", MOJIBAKE) | X.matches("company", MOJIBAKE)),
    Check("company_status_invalid", FORMAT, MINOR, "core", "Unknown company status", "Map the register's status to the contract's.", lambda now: _in_catalog(now) & ~_c("co.status").isin(*COMPANY_STATUSES), _company_of("  → ", "status")),
    Check("date_invalid", FORMAT, MINOR, "scraper", "Date unreadable or in the future", "Check how the page's date is parsed.", _bad_date, lambda: _c("date")),
    Check("vdate_while_scraped", FORMAT, MINOR, "scraper", "Checked date on an unchecked job", "Set it only with tested or verified.", lambda now: _has_text("vdate") & (_c("status") == "scraped"), lambda: _two(_c("title"), "  vdate ", _c("vdate"))),
    Check("expiration_too_far", FORMAT, MINOR, "scraper", "Expires over 30 days after its check", "Limit the term to 30 days.", _expires_late, lambda: F.concat(F.lit("vdate "), _c("vdate"), F.lit("  → "), _c("expirationdate"))),
    Check("salary_bad_format", FORMAT, MINOR, "scraper", "Salary not MIN-MAX CURRENCY", "Write one text such as 3000-4500 RON.", lambda now: salary_is_bad(), lambda: F.array_join("salary", ",")),
    Check("cif_not_8_digits", FORMAT, MINOR, "scraper", "Fiscal id not of 8 digits", "Extract exactly the digits.", lambda now: _has_text("cif") & ~K.fiscal_shape_ok("cif") & ~K.fiscal_has_prefix("cif"), _cif_and_company),
    Check("cif_ro_prefix", FORMAT, MINOR, "scraper", "Fiscal id with RO", "Drop the prefix.", lambda now: K.fiscal_has_prefix("cif"), _cif_and_company),
    Check("cif_bad_checksum", CORRECTNESS, GRAVE, "scraper", "Fiscal id fails its checksum", "Check the last digit when extracting.", lambda now: _has_text("cif") & ~F.coalesce(K.fiscal_checksum_ok("cif"), F.lit(False)), _cif_and_company),
    Check("cif_orphan", CORRECTNESS, GRAVE, "scraper", "Company not in the catalog", "Add the company first.", lambda now: _has_text("cif") & _c("co").isNull(), _cif_and_company),
    Check("company_mismatch", FORMAT, MINOR, "scraper", "Company name differs from the catalog", "Use the catalog's name.", lambda now: _in_catalog(now) & _has_text("company") & (F.lower(X.trimmed("company")) != F.lower(X.trimmed("co.name"))), _company_of("  ≠  ", "name")),
    Check("company_not_active", AVAILABILITY, GRAVE, "core", "Company doesn't operate", "Remove the company and its listings.", lambda now: _in_catalog(now) & _c("co.status").isin(*NOT_ACTIVE), _company_of("  → ", "status")),
    Check("loc_gibberish", CORRECTNESS, GRAVE, "scraper", "Place is no place", "Extract the locality, not the address line.", lambda now: (_c("loc.kind") == "junk") & _c("loc.how").isin("unrecognised", "not-a-place"), _place_text),
    Check("loc_placeholder", CORRECTNESS, GRAVE, "scraper", "Place is a placeholder", "Use the work mode for remote work.", lambda now: (_c("loc.kind") == "junk") & (_c("loc.how") == "placeholder"), _place_text),
    Check("loc_foreign", CORRECTNESS, GRAVE, "scraper", "Place abroad", "Leave out jobs abroad, or mark them.", lambda now: _c("loc.kind") == "international", _place_text),
    Check("loc_county_unknown", FORMAT, MINOR, "scraper", "Place exists in several counties", "Give the county beside the place.", lambda now: (_c("loc.kind") == "fixed") & F.coalesce(_c("loc.county") == "", F.lit(True)), lambda: F.concat(_c("loc.value"), F.lit(" ("), _place_text(), F.lit(")"))),
    Check("title_adult", CORRECTNESS, GRAVE, "scraper", "Adult content", "Leave the source's adult sections out.", lambda now: looks_adult(_c("title"))),
    Check("contact_in_ad", CORRECTNESS, GRAVE, "scraper", "Personal contact data", "Remove phone numbers, addresses and personal ids.", lambda now: F.exists(F.array(*contact_fields()), has_contact), lambda: F.coalesce(F.try_element_at(F.filter(F.array(*contact_fields()), has_contact), F.lit(1)), _c("title"))),
    Check("title_too_short", CORRECTNESS, GRAVE, "scraper", "Title under three letters", "Reject the listing.", lambda now: ~X.is_blank("title") & (X.utf16_length(X.letters_only("_normal")) < 3)),
    Check("title_allcaps", FORMAT, MINOR, "scraper", "Title in capitals", "Write it normally.", lambda now: _shouted()),
    Check("repeated_listing", FORMAT, INFO, "scraper", "Same job listed again", "Put a stable id in the address.", lambda now: _c("dup_index") > 0, lambda: _two(_c("title"), "  → ", F.coalesce(F.nullif(_c("loc.value"), F.lit("")), _place_text()))),
    Check("stale_scraped", AVAILABILITY, GRAVE, "core", "Unchecked for over 30 days", "Check again, or remove.", lambda now: (_c("status") == "scraped") & (_c("age") > 30), _aged),
    Check("very_old", AVAILABILITY, GRAVE, "core", "Over 90 days old", "Remove expired listings.", lambda now: _c("age") > 90, _aged),
    Check("url_error", AVAILABILITY, GRAVE, "core", "Page answers with an error", "Check the address; a constant 403 is a block.", lambda now: _c("link") == "error", _link),
    Check("url_dead", AVAILABILITY, GRAVE, "core", "Page is gone", "Remove listings that answer 404.", lambda now: _c("link") == "dead", _link),
]


def register_check(check: Check, catalog: list[Check] | None = None) -> None:
    """Adds a rule at the catalog's end."""
    catalog = CATALOG if catalog is None else catalog
    if any(c.id == check.id for c in catalog):
        raise ValueError(f"there is a check named {check.id}")
    catalog.append(check)


def of_question(question: str, catalog: list[Check] | None = None) -> list[str]:
    return [c.id for c in catalog or CATALOG if c.counts_for == question]


def grave_ids(catalog: list[Check] | None = None) -> list[str]:
    return [c.id for c in catalog or CATALOG if c.severity == GRAVE]


def _ids(ids: list[str]) -> Column:
    return F.array(*map(F.lit, ids)) if ids else F.array().cast("array<string>")


def fails_any(ids: list[str], issues: str = "issues") -> Column:
    return F.arrays_overlap(F.col(issues), _ids(ids)) if ids else F.lit(False)


def is_affected(issues: str = "issues", catalog: list[Check] | None = None) -> Column:
    return fails_any(grave_ids(catalog), issues)


def questions_failed(issues: str = "issues", catalog: list[Check] | None = None) -> Column:
    return F.array_compact(F.array(*(F.when(fails_any(of_question(q.id, catalog), issues), q.id) for q in QUESTIONS)))


def with_issues(rows: DataFrame, now: str, catalog: list[Check] | None = None) -> DataFrame:
    """Adds issues: the ids of the rules that hold, in catalog order. A rule that meets a null doesn't hold.

    The catalog is evaluated in three projections, so that each compiles to code of a size that the JVM optimises.
    """
    catalog = catalog or CATALOG
    rows = rows.withColumn("_normal", X.nfkc("title"))
    parts = []
    for k in range(0, len(catalog), 16):
        parts.append(f"_issues_{k}")
        rows = rows.withColumn(parts[-1], F.array_compact(F.array(*(F.when(c.test(now), c.id) for c in catalog[k : k + 16]))))
    return rows.withColumn("issues", F.concat(*parts)).drop("_normal", *parts)


def exploded(rows: DataFrame, catalog: list[Check] | None = None) -> DataFrame:
    """A row for each issue of a row, with check_id."""
    return rows.withColumn("check_id", F.explode("issues"))


def with_evidence(issues: DataFrame, catalog: list[Check] | None = None) -> DataFrame:
    """Adds evidence to exploded rows: the value that breaks the rule, at most 120 UTF-16 units."""
    value = F.col("title")
    shown = [c for c in catalog or CATALOG if c.show]
    for c in reversed(shown):
        value = F.when(F.col("check_id") == c.id, c.show()).otherwise(value)
    return issues.withColumn("evidence", X.utf16_left(F.coalesce(value, F.lit("")), 120))


def catalog_frame(spark: SparkSession, catalog: list[Check] | None = None) -> DataFrame:
    """The catalog as a table, in order."""
    rows = [(k, c.id, c.question, c.counts_for, c.severity, c.owner, c.label, c.fix) for k, c in enumerate(catalog or CATALOG)]
    return spark.createDataFrame(rows, "ordinal int, check_id string, dimension string, question string, severity string, owner string, label string, fix string")


def question_frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, q.id, q.label, q.why, q.owner, of_question(q.id)) for k, q in enumerate(QUESTIONS)], "ordinal int, question string, label string, why string, owner string, checks array<string>")
