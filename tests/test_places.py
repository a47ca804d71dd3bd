"""Place resolution over a small gazetteer."""

import random

import pytest
from fixtures import gazetteer
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyrock.operators import places
from tallyrock.operators.vocabulary import Vocabulary

#: Text, kind, value (None: not looked at), start of how.
CASES = [
    ("clujnapoca", "fixed", "Cluj-Napoca", "exact"), ("CLUJ NAPOCA", "fixed", "Cluj-Napoca", "exact"), ("Cluj-Napoca, Romania", "fixed", "Cluj-Napoca", "exact"), ("Str. Lunga nr. 4, ap. 2, 400632, Cluj-Napoca", "fixed", "Cluj-Napoca", "exact"),
    ("Sector 3, Romania", "fixed", "București", "sector"), ("SECTORUL 6 Bucuresti", "fixed", "București", "sector"), ("Timisora", "fixed", "Timișoara", "typo-fixed (distance 1)"), ("Rimnicusarat, Romania", "fixed", "Râmnicu Sărat", "typo-fixed"),
    ("Targu Mures", "fixed", "Târgu Mureș", "exact"), ("Sf. Gheorghe, Romania", "fixed", "Sfântu Gheorghe", "alias"), ("Campulung-Muscel", "fixed", "Câmpulung", "alias"), ("2 Mai", "fixed", "2 Mai", "exact"),
    ("Budeasa", "fixed", "Budeasa", "exact"), ("municipiul Sibiu", "fixed", "Sibiu", "alias"), ("langa Sibiu centru vechi", "fixed", "Sibiu", "substring"), ("Bucharest", "fixed", "București", "exact"), ("Kronstadt, Romania", "fixed", "Brașov", "exact"),
    ("Aleea Florilor, 507055, Romania", "fixed", "Cristian", "postal-code"), ("Targoviste", "fixed", "Târgoviște", "exact"), ("timisoaramall", "fixed", "Timișoara", "glued qualifier"), ("Gherla, Cluj", "fixed", "Cluj", None),
    ("Olanda, Romania", "international", "Olanda", "known-foreign"), ("Paris, Romania", "international", "Paris", "known-foreign"), ("Zanzibarul Mare", "international", "Zanzibarul Mare", "unknown-place"),
    ("Romania", "junk", None, "placeholder"), ("all, Romania", "junk", None, "placeholder"), ("Remote", "junk", None, "placeholder"), ("RO-XY-ABCDEFG, Romania", "junk", None, "not-a-place"), ("Toate, Romania", "junk", None, "placeholder"),
    ("Sediul Central, Romania", "junk", None, "not-a-place"), ("undeva pe langa noi", "junk", None, "unrecognised"), ("O descriere lunga care nu este un loc", "junk", None, "unrecognised"), ("", "junk", None, "empty"), ("  ", "junk", None, "empty"), (", ", "junk", None, "not-a-place"),
    ("2 Locations, Romania", "junk", None, "not-a-place"),
]
#: Text that must not become a Romanian place: a tie, a street, a short word, an abbreviation.
NEVER = ["Bucuresri", "str Jucului, Romania", "Pipera, Romania", "VN, Romania", "Praha 5, Romania"]


@pytest.fixture(scope="module")
def found(spark):
    texts = spark.createDataFrame([(c[0],) for c in CASES] + [(t,) for t in NEVER] + [("Sânmartin",), ("Sanmartin, Cluj",), ("Apahiida, Cluj",)], "raw string")
    return {r.raw: r for r in places.resolve(texts, gazetteer(spark)).collect()}


@pytest.mark.parametrize("text, kind, value, how", CASES)
def test_case(found, text, kind, value, how):
    r = found[text]
    assert r.kind == kind, r
    if value is not None:
        assert r.value == value, r
    if how is not None:
        assert r.how.startswith(how), r


@pytest.mark.parametrize("text", NEVER)
def test_never_fixed(found, text):
    assert found[text].kind != "fixed", found[text]


def test_counties(found):
    assert found["clujnapoca"].county == "Cluj"
    assert found["Targoviste"].county == "Dâmbovița"  # the seat outranks the village of another county
    assert found["Sânmartin"].county is None  # two villages tie
    assert found["Sanmartin, Cluj"].county == "Cluj"
    assert found["Sector 3, Romania"].county == "București"
    assert found["Romania"].county is None


def test_gazetteer(spark):
    g = gazetteer(spark)
    assert g.postal.filter("code = '527180'").count() == 0  # two places share it
    assert g.names.filter("key = 'dornacandrenilor'").count() == 1  # only a parent
    assert {r.key: r.county for r in g.county_of.collect()}["cluj"] == "Cluj"


def test_foreign_names():
    from tallyrock.operators.vocabulary import FOREIGN

    assert len(FOREIGN) == len(set(FOREIGN)) == 321
    assert {"bologna", "boston", "breda", "bristol", "bergen", "ankara", "kenya", "chennai", "estulgermaniei", "republicofmoldova"} <= set(FOREIGN)


def test_county_names_lose_their_rank(spark):
    from tallyrock.functions.keys import plain_county

    rows = spark.createDataFrame([("Municipiul  București",), ("municipiul\u00a0Iași",), ("Cluj",)], "c string")
    assert [r[0] for r in rows.select(plain_county("c")).collect()] == ["București", "Iași", "Cluj"]


def test_nearest_equals_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(3)
    word = lambda: rng.choice(["", "aaaa", "localitate"]) + "".join(rng.choice("ab1") for _ in range(rng.randint(4, 9)))
    names = sorted({(rng.choice("xy"), word()) for _ in range(150)})
    looked = sorted({(rng.choice("xy"), word()) for _ in range(150)})
    pairs = places._nearest(spark.createDataFrame(looked, "g string, k string"), spark.createDataFrame([(g, c, c.upper()) for g, c in names], "g string, candidate string, name string"), ["g"])
    found = {tuple(r) for r in pairs.withColumn("least", F.min("d").over(Window.partitionBy("g", "k"))).filter("d = least").select("g", "k", "candidate", "name", "d").collect()}
    near = [(g, k, c, c.upper(), distance(k, c)) for g, k in looked for h, c in names if g == h and distance(k, c) <= (1 if len(k) <= 9 else 2)]
    least = {(g, k): min(p[4] for p in near if p[:2] == (g, k)) for g, k, *_ in near}
    assert found == {p for p in near if p[4] == least[p[:2]]}
    assert {p[4] for p in found} == {0, 1, 2}


def test_fuzzy_stages_join_on_what_two_texts_share(spark):
    """Not on a first letter and a length, which very many names can have."""
    g, parts = gazetteer(spark), places.parts_of(spark.createDataFrame([("Timisora, Cluj",)], "raw string"), Vocabulary())
    for stage in (places.by_likeness, places.by_county):
        plan = stage(parts, g, F.lit(False))._jdf.queryExecution().optimizedPlan().toString()
        measured = [line for line in plan.splitlines() if "Join" in line and "levenshtein" in line]
        assert measured and all("_cut" in line for line in measured)
