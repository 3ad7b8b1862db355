"""Variant spellings of names typed by people.

Method: pigeonhole segment join. Two strings within k edits share at least one of k + 1 segments of the one,
shifted by at most k in the other; segments stand in an inverted index, shifted substrings are looked up in
it, and what meets is verified with banded edit distance. A swap of neighbours counts as one edit here, but
may break two segments, so strings are cut into 2k + 1. Strings too short for that many segments are met
by what is left of both after up to k deletions. Surnames are joined so among equal given names,
given names among equal surnames, so no list of the index gathers all bearers of a common name.
Reordered parts, titles, initials, abbreviations and nicknames are resolved before and after it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.session import cut_lineage

#: Edits (insertion, deletion, change, swap of neighbours) that two spellings of one part may be apart.
EDITS = 1
#: A changed letter in a part of fewer letters than this counts only if one spelling is so many times as frequent as the other.
SHORT, TIMES = 4, 4

# Fixed values, the default of a parameter: common short forms of given names, as "full: short short ...".
NICKNAMES = """
alexander: alex sasha xander sandy lex aleks
alexandra: alex sasha sandra lexi
anastasia: nastya stasia ana stacy
andrew: andy drew
anthony: tony
barbara: barb babs
benjamin: ben benny benji
catherine: cathy cate kate cat katie
charles: charlie chuck
christopher: chris kit
daniel: dan danny
david: dave davey
deborah: deb debbie
dorothea: thea dora dot dolly doro
edward: ed eddie ned ted ward
elizabeth: liz beth eliza betty lizzie bess libby
francisco: paco pancho cisco fran
frederick: fred freddie fritz
gabriella: gabi gabby ella gaby
guadalupe: lupe lupita
gregory: greg
henrietta: etta hettie harriet hetty
ingrid: inge inga
isabella: bella izzy isa bel
james: jim jimmy jamie
jennifer: jen jenny
johannes: hannes hans jo johan
jonathan: jon jonny johnny nathan
joseph: joe joey
katarzyna: kasia kaska
konstantin: kostya kostia
leonardo: leo leon
margaret: peggy maggie meg marge greta daisy
michael: mike mick
mikhail: misha mischa
nadia: nadya nadja
nicholas: nick nicky nico klaus
olivia: liv livvy livia
patricia: trish pat patty tricia
philippa: pip pippa
pradeep: prad deep
rebecca: becky
richard: dick rich rick ricky
robert: bob rob bobby robbie bert
rosalind: ros roz rosa
samuel: sam sammy
soledad: sole chole
stephen: steve
susan: sue suzy
theodore: ted theo teddy
thomas: tom tommy
ursula: uschi ulla
victoria: vicky tori vic
wanjiru: ciru shiru
william: bill will billy willy liam
xiomara: xio mara
yevgenia: zhenya
zachary: zach zack zak
"""
TARGETS: dict[str, list[str]] = {}
for _line in NICKNAMES.strip().splitlines():
    _full, _shorts = _line.split(":")
    for _short in _shorts.split():
        TARGETS.setdefault(_short, []).append(_full)

# What stands for no name, what stands beside one, and what marks an organisation.
PLACEHOLDERS = frozenset(
    """anonymous anon n/a na none null nil unknown others other et al etal tba tbd author authors various nobody noname
    nn xxx test""".split()
) | {"et al", "and others", "no author", "not available", "author unknown", "unknown author", "name withheld"}
TITLES = frozenset("dr prof professor mr mrs ms miss sir dame dipl ing rev".split())
DEGREES = frozenset("phd md msc bsc ma ba mba dsc dphil jr sr esq facs frs".split())
ORGANISATION = re.compile(
    r"\b(?:collaborations?|collab|consorti(?:um|a)|working group|group|team|initiative|network|project|society|association|committee)\b"
)
_LINKING = frozenset("the on behalf of for and".split())
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})

PARSED = T.StructType(
    [
        T.StructField("kind", T.StringType()),
        T.StructField("comma", T.BooleanType()),
        T.StructField("parts", T.ArrayType(T.StringType())),
        T.StructField("short", T.ArrayType(T.BooleanType())),
    ]
)


def fold(text: str) -> str:
    lower = unicodedata.normalize("NFKC", text).lower().translate(_LETTERS)
    return "".join(c for c in unicodedata.normalize("NFKD", lower) if not unicodedata.combining(c))


def parse_name(name: str | None) -> tuple[str, bool, list[str], list[bool]]:
    """(kind, comma, parts, short): kind is person, organisation or none; a part is short if abbreviated.

    With a comma the parts before it come last, as in natural order. Hyphens within a full part are dropped.
    """
    raw = name or ""
    if not raw.isupper():  # initials without points
        raw = re.sub(r"(?<![\w.-])([A-Z])([A-Z])(?![\w.-])", r"\1. \2.", raw)
    text = re.sub(r"\s+", " ", fold(raw)).strip()
    text = re.sub(r"\([^)]*\)|\[[^\]]*\]|[\"“”„«»][^\"“”„«»]*[\"“”„«»]", " ", text)
    text = re.sub(r"[*†‡§¶#\d¹²³°^~]+", " ", text).strip(" ,;")
    bare = re.sub(r"[\s.]+", " ", text).strip()
    if bare in PLACEHOLDERS or text in PLACEHOLDERS or not re.search(r"[^\W\d_]", text):
        return ("none", False, [], [])
    spaced = bare.replace("-", " ").replace(",", " ")
    if ORGANISATION.search(spaced):
        core = [w for w in ORGANISATION.sub(" ", spaced).split() if w not in _LINKING]
        return ("organisation", False, sorted(core) or spaced.split(), [])
    pieces = [p.strip() for p in text.split(",") if p.strip()]
    pieces = [p for p in pieces if p.replace(".", "").strip() not in DEGREES] or pieces[:1]
    comma = len(pieces) > 1
    ordered = " ".join([*pieces[1:], pieces[0]]) if comma else pieces[0]
    parts, short = [], []
    for token in re.findall(r"[^\s.]+\.?", ordered):
        dotted, word = token.endswith("."), token.strip(".'’-")
        plain = word.replace("-", "").replace("'", "").replace("’", "")
        if not plain or plain in TITLES and (dotted or not parts) or plain in DEGREES and parts:
            continue
        parts.append(plain)
        short.append(dotted or len(plain) == 1)
    if not parts:
        return ("none", False, [], [])
    return ("person", comma, parts, short)


@F.pandas_udf(PARSED)
def _parse(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_name(n) for n in names], columns=PARSED.names)


def edits_apart(a: Column, b: Column, edits: int) -> Column:
    """Whether at most ``edits`` insertions, deletions, changes and swaps of neighbours (one swap at most) turn ``a`` into ``b``."""
    swapped = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    places = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    with_swap = F.exists(places, lambda i: F.levenshtein(swapped(i), b, edits - 1) >= 0)
    return (F.levenshtein(a, b, edits) >= 0) | ((F.abs(F.length(a) - F.length(b)) < edits) & with_swap)


def _spread(df: DataFrame) -> DataFrame:
    """Small tables that are about to be exploded: over all cores, as AQE would put them into one task."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, 2))


def short_join(keys: DataFrame, within: str, text: str, edits: int, longest: int) -> DataFrame:
    """Pairs (within, a, b) with equal ``within`` of which one has at most ``longest`` letters: equal after up to ``edits`` deletions each.

    Texts of one letter name nobody and have no pairs.
    """
    base = keys.select(F.col(within).alias("w"), F.col(text).alias("t")).where(F.length("t").between(2, longest + edits)).distinct()
    left = _spread(base).select("w", "t", F.col("t").alias("v"))
    for _ in range(edits):
        shorter = left.where(F.length("v") > 0).select(
            "w", "t", F.explode(F.transform(F.sequence(F.lit(1), F.length("v")), lambda i: F.concat(F.substring(F.col("v"), F.lit(1), i - 1), F.substring(F.col("v"), i + 1, F.length("v"))))).alias("v")
        )
        left = left.unionByName(shorter).distinct()
    left = left.where("v <> ''")
    a, b = left.withColumnRenamed("t", "a"), left.withColumnRenamed("t", "b")
    met = a.where(F.length("a") <= longest).join(b, ["w", "v"]).where(F.col("a") != F.col("b")).select("w", "a", "b")
    return met.unionByName(met.select("w", F.col("b").alias("a"), F.col("a").alias("b"))).distinct().select(F.col("w").alias(within), "a", "b")


def segment_join(keys: DataFrame, within: str, text: str, edits: int = 2 * EDITS) -> DataFrame:
    """Pairs of different ``text`` with equal ``within`` at most ``edits`` apart: (within, a, b), both ways round.

    ``keys`` holds distinct (within, text). Each text is cut into ``edits`` + 1 segments, whose place follows from
    its length; a probe looks up, for each length within ``edits`` of its own, the substrings at most ``edits``
    off each segment's place. Texts shorter than ``edits`` + 1 have no segments and no pairs; see :func:`short_join`.
    """
    n = edits + 1
    base = _spread(keys.select(F.col(within).alias("w"), F.col(text).alias("t")).where(F.length("t") >= n).distinct())
    # Segment i of a text of length l: start floor(l * i / n), end floor(l * (i + 1) / n), counted from 0.
    index = base.select(
        "w",
        F.col("t").alias("b"),
        F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"),
        F.length("t").alias("l"),
    ).withColumn("s", F.expr(f"substring(b, cast(l * i div {n} as int) + 1, cast(l * (i + 1) div {n} - l * i div {n} as int))"))
    probe = (
        base.select("w", F.col("t").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
        .select("w", "a", "i", F.explode(F.expr(f"sequence(length(a) - {edits}, length(a) + {edits})")).alias("l"))
        .where(F.col("l") >= n)
        .select("w", "a", "i", "l", F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("shift"))
        .withColumn("p", F.expr(f"cast(l * i div {n} as int) + shift"))
        .withColumn("k", F.expr(f"cast(l * (i + 1) div {n} - l * i div {n} as int)"))
        .where((F.col("p") >= 0) & (F.col("p") + F.col("k") <= F.length("a")))
        .withColumn("s", F.expr("substring(a, p + 1, k)"))
        .select("w", "a", "i", "l", "s")
        .distinct()
    )
    met = probe.join(index, ["w", "i", "l", "s"]).where(F.col("a") != F.col("b")).select("w", "a", "b").distinct()
    return met.where(F.levenshtein("a", "b", edits) >= 0).select(F.col("w").alias(within), "a", "b")


def _forms(names: DataFrame) -> DataFrame:
    """(name, n, kind, surname, given, is_short) of each distinct name.

    Order without a comma: given names first, unless the last part is one that mostly stands first in other
    names and the first part is not.
    """
    parsed = names.withColumn("p", _parse("name")).select("name", "n", "p.*").where(F.col("kind") != "none")
    size = F.size("parts")
    parsed = parsed.withColumn("first", F.try_element_at("parts", F.lit(1))).withColumn("last", F.try_element_at("parts", F.lit(-1)))
    full = (size >= 2) & ~F.try_element_at("short", F.lit(1)) & ~F.try_element_at("short", F.lit(-1)) & (F.col("kind") == "person")
    parsed = cut_lineage(parsed.withColumn("both_full", full))
    seen = parsed.where("both_full")
    stand = (
        seen.select(F.col("first").alias("part"), F.lit(1).alias("f"), F.lit(0).alias("l"))
        .unionByName(seen.select(F.col("last").alias("part"), F.lit(0).alias("f"), F.lit(1).alias("l")))
        .groupBy("part")
        .agg(F.sum("f").alias("f"), F.sum("l").alias("l"))
        .where((F.col("f") >= 2) & (F.col("f") > 2 * F.col("l")))
        .select("part")
    )
    lead = stand.withColumnRenamed("part", "first").withColumn("first_given", F.lit(True))
    trail = stand.withColumnRenamed("part", "last").withColumn("last_given", F.lit(True))
    ordered = parsed.join(lead, "first", "left").join(trail, "last", "left")
    turned = (
        F.col("both_full") & ~F.col("comma") & F.col("last_given").isNotNull() & F.col("first_given").isNull()
    ) | ((F.col("kind") == "person") & (size >= 2) & ~F.try_element_at("short", F.lit(1)) & F.try_element_at("short", F.lit(-1)))
    surname = F.when(F.col("kind") == "organisation", F.array_join("parts", " ")).when(turned, F.col("first")).otherwise(F.col("last"))
    given_at = F.when(turned, F.lit(2)).otherwise(F.lit(1))
    given = F.when((F.col("kind") == "person") & (size >= 2), F.try_element_at("parts", given_at)).otherwise(F.lit(""))
    two = (F.col("kind") == "person") & (size >= 3) & ~F.try_element_at("short", given_at) & ~F.try_element_at("short", given_at + 1)
    forms = ordered.select(
        "name",
        "n",
        "kind",
        surname.alias("surname"),
        given.alias("given"),
        ((F.col("kind") == "person") & (size >= 2) & F.try_element_at("short", given_at)).alias("is_short"),
        F.when(two, F.concat(given, F.try_element_at("parts", given_at + 1))).alias("joined"),
    )
    # Two given names that others write with a hyphen are one.
    forms = cut_lineage(forms)
    hyphened = forms.where("NOT is_short").select("surname", F.col("given").alias("joined"), F.lit(True).alias("one")).distinct()
    return forms.join(hyphened, ["surname", "joined"], "left").withColumn("given", F.when(F.col("one"), F.col("joined")).otherwise(F.col("given"))).drop("joined", "one")


def slips(keys: DataFrame, within: str, text: str, edits: int) -> DataFrame:
    """(within, a, b), both ways round: different ``text`` with equal ``within`` at most ``edits`` apart, whatever their length."""
    long = segment_join(keys, within, text, 2 * edits)
    short = short_join(keys, within, text, edits, 2 * edits)
    return long.unionByName(short).distinct().where(edits_apart(F.col("a"), F.col("b"), edits))


def _roots(edges: DataFrame) -> DataFrame:
    """(key, root) for every key with an edge: the most frequent key (of equal ones the first) that edges lead to.

    Each round a key takes the best root among its own, its neighbours' and its root's, until none changes, so
    the number of rounds follows from the data and no link is lost, however long a chain is.
    """
    edges = cut_lineage(edges.select("key_a", "key_b", "n_a", "n_b"))
    best = lambda n, key: F.struct((-F.col(n)).alias("n"), F.col(key).alias("key"))
    roots = edges.groupBy(F.col("key_a").alias("key")).agg(
        F.least(F.min(best("n_a", "key_a")), F.min(best("n_b", "key_b"))).alias("root")
    )
    roots = cut_lineage(roots)
    while True:
        near = edges.join(roots.withColumnRenamed("key", "key_b"), "key_b").groupBy(F.col("key_a").alias("key")).agg(F.min("root").alias("near"))
        above = roots.select(F.col("key").alias("at"), F.col("root").alias("above"))
        after = (
            roots.join(near, "key", "left")
            .withColumn("at", F.col("root.key"))
            .join(above, "at", "left")
            .select("key", F.least("root", "near", "above").alias("next"), (F.least("root", "near", "above") != F.col("root")).alias("moved"))
        )
        after = cut_lineage(after)
        roots = after.select("key", F.col("next").alias("root"))
        if after.where("moved").isEmpty():
            return roots.select("key", F.col("root.key").alias("root"))


def link_names(authors: DataFrame, column: str = "name", edits: int = EDITS, nicknames: dict[str, list[str]] | None = None) -> DataFrame:
    """(name, entity): every distinct name that is no placeholder, exactly as stored, and what it stands for.

    Null, empty and placeholder names stand for nobody and are left out. A name of one part, or one whose initial
    or nickname fits several persons of about equal frequency, is an entity of its own. Repeated rows only
    add to the frequency of a spelling. ``nicknames`` gives the full names of each short form; the default is a
    table of common ones.
    """
    names = authors.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    table = TARGETS if nicknames is None else nicknames
    nick = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if table else None
    forms = _forms(names).withColumn("targets", nick[F.col("given")] if table else F.lit(None).cast("array<string>"))
    forms = cut_lineage(forms)
    short = F.col("is_short") | F.col("targets").isNotNull()

    key = F.concat_ws("|", "surname", "given")
    full = cut_lineage(forms.where(~short).groupBy("surname", "given").agg(F.sum("n").alias("n")).withColumn("key", key))
    # A person's surname among those of equal given name, an organisation's among those without one; given names among equal surnames.
    parts = full.select(F.concat(F.lit("s|"), "given").alias("w"), F.col("surname").alias("t")).unionByName(
        full.where(F.length("given") > 0).select(F.concat(F.lit("g|"), "surname").alias("w"), F.col("given").alias("t"))
    )
    whole = lambda part: F.when(F.col("w").startswith("s|"), F.concat_ws("|", part, F.substring("w", 3, 1 << 30))).otherwise(F.concat_ws("|", F.substring("w", 3, 1 << 30), part))
    apart = slips(parts, "w", "t", edits).select(whole("a").alias("key_a"), whole("b").alias("key_b"), "a", "b")
    weight = full.select("key", F.col("n"))
    brief = (F.length("a") == F.length("b")) & (F.length("a") < SHORT)
    edges = (
        apart.join(weight.select(F.col("key").alias("key_a"), F.col("n").alias("n_a")), "key_a")
        .join(weight.select(F.col("key").alias("key_b"), F.col("n").alias("n_b")), "key_b")
        .where(~brief | (F.greatest("n_a", "n_b") >= TIMES * F.least("n_a", "n_b")))
    )
    roots = _roots(edges)
    settled = cut_lineage(full.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key")))

    # Initials, abbreviations and nicknames go to the person of that surname they fit, if that is one. The bearers of
    # each beginning of a given name are added up first, so a common surname makes no more rows than it has bearers.
    shorts = (
        forms.where(short)
        .select("surname", "given", F.coalesce("targets", F.array("given")).alias("t"))
        .distinct()
        .select("surname", "given", F.explode(F.filter("t", lambda x: ~F.exists("t", lambda y: (y != x) & x.startswith(y)))).alias("start"))
    )
    bearers = (
        settled.where(F.length("given") > 0)
        .groupBy("surname", "root")
        .agg(F.sum("n").alias("n"), F.max(F.struct("n", "given"))["given"].alias("full_given"))
    )
    beginnings = (
        bearers.select("surname", "root", "n", F.explode(F.transform(F.sequence(F.lit(1), F.length("full_given")), lambda i: F.substring(F.col("full_given"), F.lit(1), i))).alias("start"))
        .groupBy("surname", "start")
        .agg(F.max(F.struct("n", "root")).alias("best"), F.sum("n").alias("all_n"))
    )
    fits = (
        shorts.join(beginnings, ["surname", "start"])
        .groupBy("surname", "given")
        .agg(F.max("best").alias("best"), F.sum("all_n").alias("all_n"))
        .where(F.col("best.n") * 4 >= F.col("all_n") * 3)
        .select("surname", "given", F.col("best.root").alias("root"))
    )
    of_full = forms.where(~short).join(settled.select("surname", "given", "root"), ["surname", "given"])
    of_short = forms.where(short).join(fits, ["surname", "given"], "left").withColumn("root", F.coalesce("root", key))
    return (
        of_full.select("name", F.col("root").alias("entity"))
        .unionByName(of_short.select("name", F.col("root").alias("entity")))
    )


def pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b) of all spellings of one entity, the smaller in binary order first."""
    a = linked.select(F.col("name").alias("name_a"), "entity")
    b = linked.select(F.col("name").alias("name_b"), "entity")
    return a.join(b, "entity").where(F.col("name_a") < F.col("name_b")).select("name_a", "name_b").distinct()


def found(authors: DataFrame) -> DataFrame:
    return pairs(link_names(authors))
