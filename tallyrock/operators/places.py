"""Resolution of free-text places against a gazetteer.

Each different text is resolved once. Its parts give candidate keys with a rank; candidates meet the gazetteer by equi joins
and the best-ranked hit wins. Texts that no exact stage resolves go on to county-confirmed, postal, glued, foreign and
fuzzy stages, in this order, and last to a classification of what is left.

The result is a struct (kind, value, how, county); kind is fixed, international or junk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .vocabulary import ABBREVIATIONS, ADDRESS_WORDS, CAPITAL, Vocabulary

CAPITAL_KEY = "bucuresti"
NO_TYPE = 50
#: Stages in the order in which a hit counts.
STAGES = ("empty", "sector", "name", "county", "postal", "glued", "foreign", "fuzzy", "rest")


@dataclass(frozen=True)
class Gazetteer:
    """names (key, name); county_of (key, county; null if several counties tie); members (county_key, key, name);
    counties (key, name); postal (code, name)."""

    names: DataFrame
    county_of: DataFrame
    members: DataFrame
    counties: DataFrame
    postal: DataFrame


def build(index: DataFrame, localities: DataFrame | None, counties: DataFrame, vocabulary: Vocabulary | None = None) -> Gazetteer:
    """A gazetteer of index (key, name, county, type label), localities (name, county, type, type_label, postal_code, parent
    struct<name, type>) and counties (name).

    A name comes from the first of index, parents, counties and exonyms that has its key. Its county is that of the place with
    the lowest type code; if places of different counties tie, the name is ambiguous.
    """
    spark = index.sparkSession
    vocabulary = vocabulary or Vocabulary()
    if localities is None:
        localities = spark.createDataFrame([], "name string, county string, type int, type_label string, postal_code string, parent struct<name:string,type:int>")
    key = lambda c: X.fold_key(F.coalesce(c, F.lit("")))
    labels = localities.filter("type_label is not null and type is not null").groupBy("type_label").agg(F.min("type").alias("code"))
    indexed = index.join(labels, F.col("type").cast("string") == F.col("type_label"), "left").select(key(F.col("key")).alias("key"), "name", "county", "code")
    parents = localities.filter("parent.name is not null").select(key(F.col("parent.name")).alias("key"), F.col("parent.name").alias("name"), "county", F.col("parent.type").alias("code"))
    own = localities.select(key(F.col("name")).alias("key"), "name", "county", F.col("type").alias("code"))
    named = counties.select(key(F.col("name")).alias("key"), "name").filter("key <> ''").dropDuplicates(["key"])
    other = spark.createDataFrame(list(vocabulary.exonyms.items()), "alias string, name string").select(key(F.col("alias")).alias("key"), "name")

    layers = [d.select("key", "name", F.lit(k).alias("layer")) for k, d in enumerate((indexed, parents, named, other))]
    every = layers[0]
    for d in layers[1:]:
        every = every.unionByName(d)
    names = every.filter("key <> ''").groupBy("key").agg(F.min(F.struct("layer", "name")).alias("first")).select("key", "first.name")

    # the index's own name, not the key it is listed under, has its county
    ranked = indexed.select(key(F.col("name")).alias("key"), "county", "code").unionByName(parents.select("key", "county", "code")).unionByName(own.select("key", "county", "code"))
    ranked = ranked.filter("key <> '' and county is not null and county <> ''").withColumn("code", F.coalesce("code", F.lit(NO_TYPE)))
    ranked = ranked.unionByName(named.select("key", F.col("name").alias("county"), F.lit(0).alias("code")))
    ranked = ranked.filter(F.col("key") != CAPITAL_KEY).unionByName(spark.createDataFrame([(CAPITAL_KEY, CAPITAL, 0)], "key string, county string, code int"))
    least = ranked.groupBy("key").agg(F.min("code").alias("least")).withColumnRenamed("key", "_key")
    at_least = ranked.join(least, (F.col("key") == F.col("_key")) & (F.col("code") == F.col("least")))
    county_of = at_least.groupBy("key").agg(F.when(F.min("county") == F.max("county"), F.min("county")).alias("county"))

    within = own.select("county", "key", "name").unionByName(parents.select("county", "key", "name"))
    members = within.filter("key <> '' and county is not null and county <> ''").groupBy(key(F.col("county")).alias("county_key"), "key").agg(F.min("name").alias("name"))
    codes = localities.filter("postal_code is not null and postal_code <> ''").groupBy(F.col("postal_code").cast("string").alias("code"))
    postal = codes.agg(F.min("name").alias("name"), F.max("name").alias("_other")).filter("name = _other").select("code", "name")
    return Gazetteer(names, county_of, members, named, postal)


# --- parts of a text ----------------------------------------------------------------------------------------------------


def looks_like_code(part: Column) -> Column:
    p = X.trimmed(part)
    return (F.length(p) >= 6) & ~p.rlike("[a-z]") & p.rlike(r"^[A-Z0-9]+([-_/][A-Z0-9]+)+\z")


def is_street(part: Column, vocabulary: Vocabulary) -> Column:
    words = F.transform(F.split(part, X.SPACE + "+"), lambda w: F.lower(F.regexp_replace(w, "[.,]", "")))
    return F.arrays_overlap(words, F.array(*map(F.lit, vocabulary.street_words)))


def without_address(part: Column) -> Column:
    """The words of a part that are neither address words nor numbers."""
    noise = rf"(?i)^({'|'.join(ADDRESS_WORDS)})\.?\z"
    return X.trimmed(F.array_join(F.filter(F.split(part, X.SPACE + "+"), lambda w: ~w.rlike(noise) & ~w.rlike(r"^[^A-Za-z]+\z|^\z") | w.rlike(r"[^\x00-\x7F]") & ~w.rlike(r"^[^\p{L}]+\z")), " "))


def words_of(part: Column) -> Column:
    return F.filter(F.split(part, rf"(?:{X.SPACE}|-)+"), lambda w: w != "")


def other_forms(part: Column) -> Column:
    """Forms that an abbreviation or a dropped last or first word may stand for."""
    forms = [F.when(part.rlike(p), F.regexp_replace(part, p, r)) for p, r in ABBREVIATIONS]
    w = words_of(part)
    n = F.size(w)
    return F.array_compact(F.array(*forms, F.when(n > 1, F.array_join(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")), F.when(n > 1, F.array_join(F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))), " "))))


def word_runs(part: Column) -> Column:
    """Runs of at most four words, longer ones first, then from left to right."""
    w = words_of(part)
    n = F.size(w)
    of = lambda size: F.when(n >= size, F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(size)), " ")))
    return F.flatten(F.array_compact(F.array(*(of(size) for size in (4, 3, 2, 1)))))


def parts_of(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(raw, pos, part, key, code, street, bare): the parts of different raw texts."""
    blanked = F.regexp_replace(F.regexp_replace(X.trimmed("raw"), rf"{X.EDGE}[0-9]{{5,6}}{X.EDGE}", " "), X.SPACE + "+", " ")
    split = F.filter(F.transform(F.split(blanked, r"[,;/|]"), X.trimmed), lambda p: p != "")
    rows = texts.select("raw", F.posexplode(split).alias("pos", "part"))
    return rows.select("raw", "pos", "part", X.fold_key("part").alias("key"), looks_like_code(F.col("part")).alias("code"), is_street(F.col("part"), vocabulary).alias("street"), without_address(F.col("part")).alias("bare"))


# --- stages -------------------------------------------------------------------------------------------------------------


def _hit(rows: DataFrame, rank: list[str], stage: str, kind: str = "fixed") -> DataFrame:
    """(raw, stage, kind, value, how): the first row by rank of each text."""
    first = rows.groupBy("raw").agg(F.min(F.struct(*rank, "value", "how")).alias("best"))
    return first.select("raw", F.lit(STAGES.index(stage)).alias("stage"), F.lit(kind).alias("kind"), "best.value", "best.how")


def by_name(parts: DataFrame, g: Gazetteer) -> DataFrame:
    """A part as it is, in another form, without address words, or a run of its words."""
    whole = F.array(F.struct(F.lit(0).alias("sub"), F.lit(0).alias("nth"), F.col("key").alias("k"), F.lit("exact").alias("how")))
    ranked = lambda texts, sub, how: F.transform(texts, lambda t, i: F.struct(F.lit(sub).alias("sub"), i.alias("nth"), X.fold_key(t).alias("k"), F.lit(how).alias("how")))
    bare = F.when(F.col("bare") != "", F.concat(ranked(F.array("bare"), 2, "address-stripped"), ranked(word_runs(F.col("bare")), 3, "substring"))).otherwise(F.array().cast("array<struct<sub:int,nth:int,k:string,how:string>>"))
    candidates = parts.filter("not code").select("raw", "pos", F.explode(F.concat(whole, ranked(other_forms(F.col("part")), 1, "alias"), bare)).alias("c"))
    found = candidates.select("raw", "pos", "c.*").filter("k <> ''").join(g.names.withColumnRenamed("key", "k"), "k").withColumnRenamed("name", "value")
    return _hit(found, ["pos", "sub", "nth"], "name")


def _limit(k: Column) -> Column:
    return F.when(F.length(k) <= 9, 1).otherwise(2)


def _cuts(k: Column, n: int) -> Column:
    """The different texts that a text becomes when n of its characters go."""
    without = lambda c, i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1))
    size = F.length(k)
    if n == 0:
        return F.array(k)
    one = F.transform(F.sequence(F.lit(1), size), lambda i: without(k, i))
    if n == 1:
        return F.when(size > 0, F.array_distinct(one)).otherwise(F.array().cast("array<string>"))
    # after the i-th character, the next to go is at i or later
    two = F.flatten(F.transform(F.sequence(F.lit(1), size - 1), lambda i: F.transform(F.sequence(i, size - 1), lambda j: without(without(k, i), j))))
    return F.when(size > 1, F.array_distinct(two)).otherwise(F.array().cast("array<string>"))


def _meeting(rows: DataFrame, by: list[str], c: str, most: int) -> DataFrame:
    """Adds _cut, a row for each text that c becomes when at most so many of its characters go, as a hash with by."""
    cuts = F.flatten(F.array(*(_cuts(F.col(c), n) for n in range(most + 1))))
    return rows.withColumn("_cut", F.explode(cuts)).withColumn("_cut", F.xxhash64(*by, "_cut"))


def _within(looked: DataFrame, names: DataFrame, by: list[str], most: int) -> DataFrame:
    """Pairs (by, k, candidate, name, d) at a distance d of at most most.

    Two texts at a distance of n have a text in common that each becomes when at most n of its characters go, so an equi join finds
    every pair, whatever the beginnings that many names share. What else it finds, a distance of up to twice that, is measured
    and goes; a pair may come more than once.
    """
    near = _meeting(looked.select(*by, "k"), by, "k", most).join(_meeting(names.select(*by, "candidate", "name"), by, "candidate", most).withColumnsRenamed({c: f"_{c}" for c in by}), "_cut")
    for c in by:  # equal hashes are not yet equal keys
        near = near.filter(F.col(c) == F.col(f"_{c}"))
    return near.withColumn("d", F.levenshtein("k", "candidate", most)).filter("d >= 0").select(*by, "k", "candidate", "name", "d")


def _nearest(looked: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """Pairs (by, k, candidate, name, d) of looked (by, k; different rows) with the names (by, candidate, name) within the limit of
    k, among them all that are nearest.

    Only texts that are further than one letter from every name are cut twice, and for them only names of a length and group that
    one of them can meet.
    """
    one = _within(looked, names, by, 1)
    far = looked.filter(_limit(F.col("k")) > 1).join(one.select(*by, "k").distinct(), [*by, "k"], "left_anti")
    sizes = far.select(*by, F.explode(F.sequence(F.length("k") - 2, F.length("k") + 2)).alias("_size")).distinct()
    reached = names.withColumn("_size", F.length("candidate")).join(sizes, [*by, "_size"], "left_semi")
    return one.unionByName(_within(far, reached, by, 2))


def _unique_nearest(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of pairs (by, k, candidate, name, d) the nearest name where it is one and near enough."""
    near = pairs.groupBy(*by, "k").agg(F.min("d").alias("least")).withColumnsRenamed({c: f"_{c}" for c in (*by, "k")})
    on = [F.col(c) == F.col(f"_{c}") for c in (*by, "k")] + [F.col("d") == F.col("least")]
    one = pairs.join(near, on).groupBy(*by, "k").agg(F.min("d").alias("d"), F.min("name").alias("name"), F.max("name").alias("_other"), F.max(F.length("candidate")).alias("_long"))
    return one.filter((F.col("name") == F.col("_other")) & (F.col("d") / F.greatest(F.length("k"), F.col("_long")) <= 0.15)).drop("_other", "_long")


def by_county(parts: DataFrame, g: Gazetteer, known: Column) -> DataFrame:
    """A part that names, exactly or nearly, a place of a county that another part names."""
    counties = g.members.select(F.col("county_key").alias("key")).distinct()
    given = parts.join(counties, "key").select(F.col("raw").alias("_raw"), F.col("pos").alias("cpos"), F.col("key").alias("county_key"), F.col("part").alias("_county"))
    others = parts.filter(~F.col("street") & ~F.col("code") & (F.col("key") != "") & ~known)
    k = X.fold_key(F.when(F.col("bare") != "", F.col("bare")).otherwise(F.col("part")))
    pairs = others.join(given, (F.col("raw") == F.col("_raw")) & (F.col("part") != F.col("_county"))).select("raw", "cpos", "pos", "county_key", k.alias("k")).filter("k <> ''")
    members = g.members.withColumnsRenamed({"county_key": "_ck", "key": "candidate"})
    exact = pairs.join(members, (F.col("county_key") == F.col("_ck")) & (F.col("k") == F.col("candidate"))).select("raw", "cpos", "pos", F.lit(0).alias("sub"), F.col("name").alias("value"), F.lit("exact (county-confirmed)").alias("how"))
    looked = pairs.filter(F.length("k") >= 5).select("county_key", "k").distinct()
    near = _nearest(looked, g.members.withColumnRenamed("key", "candidate"), ["county_key"])
    best = _unique_nearest(near, ["county_key"])
    fuzzy = pairs.join(best, ["county_key", "k"]).select("raw", "cpos", "pos", F.lit(1).alias("sub"), F.col("name").alias("value"), F.concat(F.lit("typo-fixed (county-confirmed, distance "), F.col("d"), F.lit(")")).alias("how"))
    return _hit(exact.unionByName(fuzzy), ["cpos", "pos", "sub"], "county")


def by_postal(texts: DataFrame, g: Gazetteer) -> DataFrame:
    codes = F.regexp_extract_all("raw", F.lit(rf"{X.EDGE}[0-9]{{6}}{X.EDGE}"), F.lit(0))
    found = texts.select("raw", F.posexplode(codes).alias("pos", "code")).join(g.postal, "code").withColumnsRenamed({"name": "value"}).withColumn("how", F.lit("postal-code"))
    return _hit(found, ["pos"], "postal")


def by_glued_name(parts: DataFrame, g: Gazetteer) -> DataFrame:
    """The longest name of seven letters or more that a long part begins with, if at most eight letters follow."""
    n = F.length("key")
    cuts = F.sequence(n - 3, F.greatest(F.lit(7), n - 8), F.lit(-1))
    found = parts.filter(~F.col("street") & ~F.col("code") & (n >= 10)).select("raw", "pos", "key", F.explode(cuts).alias("cut")).withColumn("k", F.expr("left(key, cut)"))
    found = found.drop("key").join(g.names.withColumnRenamed("key", "k"), "k").select("raw", "pos", (-F.col("cut")).alias("short"), F.col("name").alias("value"), F.lit("glued qualifier").alias("how"))
    return _hit(found, ["pos", "short"], "glued")


def by_likeness(parts: DataFrame, g: Gazetteer, known: Column) -> DataFrame:
    """The one name nearest to a part, of those with its first letter."""
    k = X.fold_key(F.when(F.col("bare") != "", F.col("bare")).otherwise(F.col("part")))
    looked = parts.filter(~F.col("street")).select("raw", "pos", k.alias("key")).filter((F.col("key") != "") & ~known & (F.length("key") >= 6)).withColumnRenamed("key", "k")
    head = lambda c: F.left(c, F.lit(1)).alias("head")
    names = g.names.filter(F.length("key") >= 6).select(F.col("key").alias("candidate"), "name", head("key"))
    pairs = _nearest(looked.select("k", head("k")).distinct(), names, ["head"])
    found = looked.join(_unique_nearest(pairs, []), "k")
    how = F.when(F.col("d") > 0, F.concat(F.lit("typo-fixed (distance "), F.col("d"), F.lit(")"))).otherwise("exact")
    return _hit(found.select("raw", "pos", F.col("name").alias("value"), how.alias("how")), ["pos"], "fuzzy")


def of_the_rest(texts: DataFrame, parts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """What is left: a placeholder, no place, an unknown place by its look, or unrecognised."""
    listed = lambda c, words: c.isin(*words)
    split = F.filter(F.split("part", X.SPACE + "+"), lambda w: w != "")
    junk_phrase = (F.size(split) > 0) & F.forall(split, lambda w: listed(X.fold_key(w), vocabulary.junk))
    meant = ~listed(F.col("key"), vocabulary.junk) & ~junk_phrase & X.ascii_folded("part").rlike("[A-Za-z]") & ~F.col("street") & ~F.col("code")
    placeholder = listed(F.col("key"), vocabulary.placeholders) | F.forall(split, lambda w: listed(X.fold_key(w), vocabulary.placeholders))
    rows = parts.select("raw", F.when(meant, F.struct("pos", "part")).alias("meant"), placeholder.alias("placeholder"))
    found = rows.groupBy("raw").agg(F.min("meant").alias("first"), F.bool_and("placeholder").alias("all_placeholders"))
    part = F.col("first.part")
    unknown = X.ascii_folded(part).rlike("^[A-Z]") & (X.utf16_length(part) > 2) & (F.size(F.filter(F.split(part, X.SPACE + "+"), lambda w: w != "")) <= 4)
    none = F.col("first").isNull()
    how = F.when(none, F.when(F.coalesce("all_placeholders", F.lit(False)), "placeholder").otherwise("not-a-place")).when(unknown, "unknown-place").otherwise("unrecognised")
    kind = F.when(~none & unknown, "international").otherwise("junk")
    return texts.select("raw").join(found, "raw", "left").select("raw", F.lit(STAGES.index("rest")).alias("stage"), kind.alias("kind"), F.when(~none & unknown, part).alias("value"), how.alias("how"))


def resolve(texts: DataFrame, g: Gazetteer, vocabulary: Vocabulary | None = None, held: list[DataFrame] | None = None) -> DataFrame:
    """(raw, kind, value, how, county) of the different texts in the column raw.

    All stages read the different texts and their parts, which are few beside the rows; with a list in held these are persisted
    and appended to it, for the caller to give back.
    """

    def hold(df: DataFrame) -> DataFrame:
        if held is not None:
            held.append(df := df.persist())
        return df

    vocabulary = vocabulary or Vocabulary()
    texts = hold(texts.select(F.coalesce("raw", F.lit("")).alias("raw")).distinct())
    folded = F.lower(X.ascii_folded("raw"))
    sector = folded.contains("sector") & (folded.contains("bucure") | X.trimmed(folded).rlike(r"^sector\s*[0-9]"))
    blank = texts.filter(X.is_blank("raw")).select("raw", F.lit(0).alias("stage"), F.lit("junk").alias("kind"), F.lit(None).cast("string").alias("value"), F.lit("empty").alias("how"))
    capital = texts.filter(~X.is_blank("raw") & sector).select("raw", F.lit(1).alias("stage"), F.lit("fixed").alias("kind"), F.lit(CAPITAL).alias("value"), F.lit("sector to Bucuresti").alias("how"))
    open_texts = texts.filter(~X.is_blank("raw") & ~sector)
    parts = hold(parts_of(open_texts, vocabulary))
    named = hold(by_name(parts, g))
    left = open_texts.join(named.select("raw"), "raw", "left_anti")
    rest = parts.join(named.select("raw"), "raw", "left_anti")
    junk, foreign = F.col("key").isin(*vocabulary.junk), F.col("key").isin(*vocabulary.foreign)
    abroad = _hit(rest.filter((F.col("key") != "") & ~junk & foreign).select("raw", "pos", X.trimmed("part").alias("value"), F.lit("known-foreign").alias("how")), ["pos"], "foreign", "international")
    hits = named
    for stage in (blank, capital, by_county(rest, g, junk | foreign), by_postal(left, g), by_glued_name(rest, g), abroad, by_likeness(rest, g, junk | foreign), of_the_rest(left, rest, vocabulary)):
        hits = hits.unionByName(stage)
    best = hits.groupBy("raw").agg(F.min_by(F.struct("kind", "value", "how"), "stage").alias("loc")).select("raw", "loc.*")
    return with_county(best, parts, g)


def with_county(found: DataFrame, parts: DataFrame, g: Gazetteer) -> DataFrame:
    """Adds county: the capital's own, the gazetteer's, or one that another part names."""
    keyed = found.withColumn("key", F.when(F.col("kind") == "fixed", X.fold_key("value")))
    beside = parts.select("raw", "pos", "key").join(g.counties.withColumnRenamed("name", "_county"), "key").groupBy("raw").agg(F.min_by("_county", "pos").alias("_beside"))
    out = keyed.join(g.county_of, "key", "left").join(beside, "raw", "left")
    county = F.when(F.col("key") == CAPITAL_KEY, CAPITAL).when(F.col("kind") == "fixed", F.coalesce("county", "_beside"))
    return out.select("raw", "kind", "value", "how", county.alias("county"))
