"""Each rule fires on a row made for it, and a clean row trips nothing but the missing salary."""

import pytest
from fixtures import NOW, companies, gazetteer, listings
from pyspark.sql import functions as F

from tallyrock.operators import checks as C
from tallyrock.operators import enrich

#: Rule, what differs from the clean row.
TRIPS = [
    ("missing_title", {"title": ""}), ("missing_title", {"title": "  "}), ("missing_company", {"company": ""}), ("missing_cif", {"cif": ""}), ("missing_location", {"location": []}), ("missing_location", {"location": ["", " "]}),
    ("missing_date", {"date": ""}), ("missing_workmode", {"workmode": ""}), ("missing_tags", {"tags": []}), ("missing_salary", {}), ("missing_salary", {"salary": [], "salary_is_array": True}),
    ("url_invalid", {"url": "ftp://exemplu.ro/1"}), ("url_invalid", {"url": "/job/7"}), ("title_too_long", {"title": "x" * 201}), ("title_html", {"title": "A&amp;B Inginer"}), ("title_html", {"title": "<b>Inginer</b>"}),
    ("title_untrimmed", {"title": " Inginer"}), ("title_untrimmed", {"title": "Inginer  constructor"}), ("company_not_uppercase", {"company": "Exemplu Soft Srl"}), ("company_html", {"company": "A&quot;B SRL"}),
    ("tags_diacritics", {"tags": ["șofer"]}), ("tags_not_lowercase", {"tags": ["Sofer"]}), ("tags_too_many", {"tags": [f"t{i}" for i in range(21)]}), ("workmode_invalid", {"workmode": "office"}),
    ("status_invalid", {"status": "activ"}), ("status_invalid", {"status": ""}), ("title_other_alphabet", {"title": "Водитель грузовика"}), ("title_mixed_alphabets", {"title": "Asistent Rаdiologie si imagistica medicala"}),
    ("title_fancy_letters", {"title": "𝐈𝐧𝐠𝐢𝐧𝐞𝐫"}), ("text_mojibake", {"title": "Junior â€“ Inginer"}), ("company_status_invalid", {"cif": "12345670", "company": "FIRMA CIUDATĂ SRL"}), ("date_invalid", {"date": "2027-01-01T00:00:00Z"}),
    ("date_invalid", {"date": "ieri"}), ("vdate_while_scraped", {"vdate": "2026-09-01T00:00:00Z"}), ("expiration_too_far", {"vdate": "2026-08-01T00:00:00Z", "expirationdate": "2026-09-15T00:00:00Z", "status": "verified"}),
    ("salary_bad_format", {"salary": ["3000 lei"]}), ("salary_bad_format", {"salary": [], "salary_is_array": True}), ("salary_bad_format", {"salary": ["1-2 RON", "3-4 RON"], "salary_is_array": True}), ("cif_not_8_digits", {"cif": "1234567"}),
    ("cif_ro_prefix", {"cif": "RO24973770"}), ("cif_bad_checksum", {"cif": "24973771"}), ("cif_orphan", {"cif": "12345678"}), ("company_mismatch", {"company": "ALTA FIRMĂ SRL"}),
    ("company_not_active", {"cif": "31468843", "company": "VECHEA FIRMĂ SA"}), ("loc_gibberish", {"location": ["XX-YY-ZZTOP, Romania"]}), ("loc_placeholder", {"location": ["Romania"]}), ("loc_foreign", {"location": ["Paris, Romania"]}),
    ("loc_county_unknown", {"location": ["Sânmartin"]}), ("title_adult", {"title": "Model videochat"}), ("title_adult", {"title": "Hostess si dansatoare la mare"}), ("title_adult", {"title": "Manager (Adult Industry)"}), ("title_adult", {"title": "Animatoare la night club"}),
    ("contact_in_ad", {"title": "Vanzator 0722 123 456"}), ("contact_in_ad", {"location": ["scrieti la birou@exemplu.ro"]}), ("contact_in_ad", {"tags": ["sunati", "0723697746"]}), ("contact_in_ad", {"title": "CNP 1900101123456"}),
    ("title_too_short", {"title": "12 X"}), ("title_allcaps", {"title": "SOFER CATEGORIA B"}), ("stale_scraped", {"date": "2026-07-01T00:00:00Z"}), ("very_old", {"date": "2026-05-01T00:00:00Z"}),
    ("repeated_listing", {"dup_index": 1}), ("url_error", {"link": "error"}), ("url_dead", {"link": "dead"}),
]
#: Rule, what must not trip it.
QUIET = [
    ("title_html", {"title": "Șofer & curier"}), ("company_not_uppercase", {"company": "S.C. ȚARA S.R.L."}), ("company_not_active", {"cif": "12345670"}), ("company_not_active", {"cif": "12345678"}), ("title_adult", {"title": "Webchat non-adult, program lejer"}),
    ("title_adult", {"title": "Animatoare si hostess, petreceri copii"}), ("title_adult", {"title": "Profesor pentru adulti"}), ("title_adult", {"title": "Masaj de recuperare"}), ("title_too_short", {"title": "𝐈𝐧𝐠𝐢𝐧𝐞𝐫"}), ("title_too_short", {"title": "Водитель"}),
    ("title_other_alphabet", {"title": "Operator relatii clienti - Bulgara/Български"}), ("title_mixed_alphabets", {"title": "Operator relatii clienti - Bulgara/Български"}), ("contact_in_ad", {"title": "Electrician, 2650-2800 EUR net/168 ore"}),
    ("contact_in_ad", {"tags": ["cod 135136138 piese"]}), ("contact_in_ad", {"title": "Specialist@Exemplu.ro"}), ("salary_bad_format", {"salary": ["3000-4500 RON"]}), ("salary_bad_format", {"salary": ["3000.5-4500 RON"], "salary_is_array": True}),
    ("missing_salary", {"salary": ["3000-4500 RON"]}), ("url_dead", {"link": "unreachable"}), ("url_error", {"link": "unreachable"}), ("title_too_long", {"title": "x" * 200}), ("date_invalid", {"date": "2026-09-06T11:00:00Z"}),
    ("cif_bad_checksum", {"cif": "RO24973770"}), ("very_old", {"date": ""}), ("loc_county_unknown", {"location": ["Sânmartin, Cluj"]}),
]


@pytest.fixture(scope="module")
def fired(spark):
    """The issues of each different row of the cases."""
    cases = [o for _, o in TRIPS + QUIET]
    extra = ("link", "dup_index")
    rows = listings(spark, *({**{k: v for k, v in o.items() if k not in extra}, "url": o.get("url", f"https://exemplu.ro/{i}")} for i, o in enumerate(cases)))
    rows = rows.coalesce(1).withColumn("n", F.monotonically_increasing_id())
    more = spark.createDataFrame([(i, o.get("link", ""), o.get("dup_index", 0)) for i, o in enumerate(cases)], "n long, link string, dup_index int")
    rows = enrich.jobs(rows.select("*"), enrich.companies(companies(spark)), gazetteer(spark), NOW).join(more, "n")
    rows = rows.withColumn("link_code", F.lit(None).cast("int"))
    done = C.with_issues(rows, NOW)
    shown = C.with_evidence(C.exploded(done)).select("n", "check_id", "evidence")
    evidence = {(r.n, r.check_id): r.evidence for r in shown.collect()}
    return {r.n: r.issues for r in done.select("n", "issues").collect()}, evidence


def test_every_rule_has_a_case():
    assert {c.id for c in C.CATALOG} == {rule for rule, _ in TRIPS}
    by = [c.severity for c in C.CATALOG]
    assert (len(by), by.count("grav"), by.count("minor"), by.count("info")) == (47, 19, 26, 2)


@pytest.mark.parametrize("n", range(len(TRIPS)))
def test_rule_fires(fired, n):
    assert TRIPS[n][0] in fired[0][n], (TRIPS[n], fired[0][n])


@pytest.mark.parametrize("n", range(len(QUIET)))
def test_rule_is_quiet(fired, n):
    assert QUIET[n][0] not in fired[0][len(TRIPS) + n], (QUIET[n], fired[0][len(TRIPS) + n])


def test_clean_row(fired):
    assert fired[0][next(i for i, c in enumerate(TRIPS) if c == ("missing_salary", {}))] == ["missing_salary"]


def test_issues_in_catalog_order(fired):
    order = [c.id for c in C.CATALOG]
    for issues in fired[0].values():
        assert issues == sorted(issues, key=order.index)


def test_evidence(fired):
    at = lambda rule: next(i for i, (r, _) in enumerate(TRIPS) if r == rule)
    assert fired[1][at("workmode_invalid"), "workmode_invalid"] == "office"
    assert fired[1][at("title_too_long"), "title_too_long"] == "x" * 120
    assert fired[1][at("company_not_active"), "company_not_active"] == "VECHEA FIRMĂ SA  → inactiv"


def test_register_check():
    extra = C.Check("too_plain", C.FORMAT, C.MINOR, "scraper", "x", "y", lambda now: F.lit(True))
    catalog = list(C.CATALOG)
    C.register_check(extra, catalog)
    assert catalog[-1] is extra and len(C.CATALOG) == 47
    with pytest.raises(ValueError):
        C.register_check(extra, catalog)
