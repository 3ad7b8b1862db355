"""Full-text search: postings, boolean and phrase queries, BM25, snippets."""

from __future__ import annotations

import math
import re
from functools import partial
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.functions.text import _foldable, search_tokens

K1, B, FLOOR = 1.2, 0.75, 1e-6
OPERATORS = ("AND", "OR", "NOT", "NEAR")
TOKEN = re.compile(r"[^\W_]+")


class QueryError(ValueError):
    """A query that can't be read."""


@dataclass(frozen=True)
class Phrase:
    words: tuple[str, ...]


@dataclass(frozen=True)
class Node:
    op: str
    left: object
    right: object


def tokens_of(text: str) -> tuple[str, ...]:
    source, target = _foldable()
    return tuple(TOKEN.findall(text.translate(str.maketrans(source, target)).lower()))


def parse_query(query: str):
    """Phrases joined by AND (also adjacency), OR, NOT, from strong to weak NOT, AND, OR; None for a blank query.

    Operators count in upper case only; NEAR alone is a word. A leading or trailing operator raises QueryError.
    """
    parts = query.split()
    if not parts:
        return None
    operators = any(p in OPERATORS for p in parts)
    items = [p if operators and p in ("AND", "OR", "NOT") else Phrase(tokens_of(p)) for p in parts]
    items = [i for i in items if not (isinstance(i, Phrase) and not i.words)]
    if not items:
        return None
    if not isinstance(items[0], Phrase) or not isinstance(items[-1], Phrase):
        raise QueryError(f"misplaced operator: {query}")
    spelt: list = [items[0]]
    for item in items[1:]:
        if isinstance(item, Phrase) and isinstance(spelt[-1], Phrase):
            spelt.append("AND")
        elif not isinstance(item, Phrase) and not isinstance(spelt[-1], Phrase):
            raise QueryError(f"misplaced operator: {query}")
        spelt.append(item)
    for op in ("NOT", "AND", "OR"):
        out = [spelt[0]]
        for k in range(1, len(spelt), 2):
            if spelt[k] == op:
                out[-1] = Node(op, out[-1], spelt[k + 1])
            else:
                out += [spelt[k], spelt[k + 1]]
        spelt = out
    return spelt[0]


def phrases(node) -> list[Phrase]:
    if isinstance(node, Phrase):
        return [node]
    return phrases(node.left) + ([] if node.op == "NOT" else phrases(node.right)) if node else []


def postings(docs: DataFrame, key: list[str], text: str) -> DataFrame:
    """(key…, n_tokens, token, tf, positions). Documents without tokens have none. One shuffle-free pass."""
    tokenised = docs.select(*key, search_tokens(F.col(text)).alias("tokens")).where(F.size("tokens") > 0)
    return (
        tokenised.select(*key, F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("pos", "token"))
        .groupBy(*key, "n_tokens", "token")
        .agg(F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    )


def _frequency(phrase: Phrase):
    """How often the phrase stands in the text; ``spaced`` holds its tokens, each between blanks."""
    return F.regexp_count("spaced", F.lit(f"(?= {' '.join(phrase.words)} )"))


def _hits(docs: DataFrame, key: list[str], text: str, asked: list[Phrase]) -> DataFrame:
    """(key…, n_tokens, f0, f1, …): how often each phrase stands in each document, and its length."""
    spaced = F.concat(F.lit(" "), F.array_join(search_tokens(F.col(text)), " "), F.lit(" "))
    tokens = docs.select(*key, spaced.alias("spaced")).where(F.length("spaced") > 2)
    columns = [_frequency(p).alias(f"f{i}") for i, p in enumerate(asked)]
    return tokens.select(*key, (F.length(F.regexp_replace("spaced", "[^ ]", "")) - 1).alias("n_tokens"), *columns)


def _matches(node, index: dict[Phrase, int]):
    if isinstance(node, Phrase):
        return F.col(f"f{index[node]}") > 0
    left, right = _matches(node.left, index), _matches(node.right, index)
    return left & right if node.op == "AND" else left | right if node.op == "OR" else left & ~right


def _all_phrases(node) -> list[Phrase]:
    return [node] if isinstance(node, Phrase) else _all_phrases(node.left) + _all_phrases(node.right)


def _scored(hits: DataFrame, node, index: dict[Phrase, int], totals: dict, key: list[str], only) -> DataFrame:
    """(key…, score) of the rows that match, by frequencies per phrase and the statistics of the whole table."""
    kept = hits.where(_matches(node, index))
    if only is not None:
        kept = kept.where(only)
    score = F.lit(0.0)
    for p in phrases(node):
        i = index[p]
        n, f = totals[f"n{i}"] or 0, F.col(f"f{i}")
        idf = math.log((totals["n_docs"] - n + 0.5) / (n + 0.5))
        idf = FLOOR if idf <= 0 else idf
        length = F.col("n_tokens") / F.lit(totals["avg_tokens"] or 1.0)
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * length))
    return kept.select(*key, (-score).alias("score"))


def search(docs: DataFrame, query: str, key: list[str], text: str, only=None) -> DataFrame:
    """(key…, score), lower is better: BM25 over the phrases asked for; no rows for a blank query.

    Document frequencies and the average length are one row, which the driver reads first. Statistics are those of the
    whole table, also with ``only``, a filter on the rows that may come out.
    """
    node = parse_query(query)
    if node is None:
        return docs.select(*key, F.lit(0.0).alias("score")).where(F.lit(False))
    index = {p: i for i, p in enumerate(dict.fromkeys(_all_phrases(node)))}
    hits = _hits(docs, key, text, list(index))
    totals = hits.agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.avg("n_tokens").alias("avg_tokens"),
        *[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"n{i}") for i in index.values()],
    ).first()
    return _scored(hits, node, index, totals.asDict(), key, only)


BUCKETS = 256


def _back(by: int, place):
    return place - by


def write_index(docs: DataFrame, key: list[str], text: str, folder: str, buckets: int = BUCKETS) -> None:
    """Build the inverted index below ``folder``: ``postings`` (bucket, token, n_tokens, key…, positions) and ``stats``.

    Postings are partitioned by a hash of the token and sorted by token, so a query reads only the files, and in them
    the row groups, of the tokens that it asks for. A token with a third of all postings fills many files of its bucket, as
    the shuffle is on (bucket, document).
    """
    rows = postings(docs, key, text).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    spread = F.pmod(F.xxhash64(*key), F.lit(8))
    rows.repartition("bucket", spread).sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/postings")
    counted = docs.select(F.size(search_tokens(F.col(text))).alias("n")).where("n > 0")
    counted.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("n").alias("avg_tokens"), F.lit(buckets).alias("buckets")).write.mode("overwrite").parquet(f"{folder}/stats")


def search_index(spark: SparkSession, folder: str, query: str, key: list[str], only=None) -> DataFrame:
    """As :func:`search`, from an index: (key…, score). Documents aren't read; phrases are found by their tokens' positions."""
    node = parse_query(query)
    stats = spark.read.parquet(f"{folder}/stats").first()
    index = spark.read.parquet(f"{folder}/postings")
    if node is None:
        return index.select(*key, F.lit(0.0).alias("score")).where(F.lit(False))
    asked = {p: i for i, p in enumerate(dict.fromkeys(_all_phrases(node)))}
    tokens = sorted({w for p in asked for w in p.words})
    own = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(stats.buckets)).alias("b")).collect()
    rows = index.where(F.col("bucket").isin([r.b for r in own]) & F.col("token").isin(tokens))
    place = {t: f"p{i}" for i, t in enumerate(tokens)}
    none = F.array().cast("array<int>")
    per = rows.groupBy(*key).agg(
        F.first("n_tokens").alias("n_tokens"), *[F.coalesce(F.first(F.when(F.col("token") == t, F.col("positions")), ignorenulls=True), none).alias(c) for t, c in place.items()]
    )

    def frequency(p: Phrase):
        at = F.col(place[p.words[0]])
        for k, w in enumerate(p.words[1:], 1):
            at = F.array_intersect(at, F.transform(place[w], partial(_back, k)))
        return F.size(at)

    hits = per.select(*key, "n_tokens", *[frequency(p).alias(f"f{i}") for p, i in asked.items()])
    found = hits.agg(*[F.sum((F.col(f"f{i}") > 0).cast("int")).alias(f"n{i}") for i in asked.values()]).first()
    totals = {"n_docs": stats.n_docs, "avg_tokens": stats.avg_tokens} | found.asDict()
    return _scored(hits, node, asked, totals, key, only)


def snippet(text: str, words: list[tuple[str, ...]], size: int = 12) -> str:
    """The stretch of ``size`` tokens that shows most phrases, hits in brackets."""
    source, target = _foldable()
    found = list(TOKEN.finditer(text.translate(str.maketrans(source, target)).lower()))
    toks = [m.group() for m in found]
    n = len(toks)
    hits = sorted({(i, k) for k, w in enumerate(words) for i in range(n - len(w) + 1) if tuple(toks[i : i + len(w)]) == w})
    if not hits:
        return text

    def score(p: int) -> int:
        seen: set[int] = set()
        total = 0
        for o, k in hits:
            if p <= o < p + size:
                total += 1 if k in seen else 1000
                seen.add(k)
        return total

    sentences = [0] + [
        i for i in range(1, n) if re.search(r"[.:]\s+$", text[found[i - 1].end() : found[i].start()])
    ]
    best, start = -1, 0
    for o, k in hits:
        inside = [(i, j) for i, j in hits if o <= i < o + size]
        first, last = inside[0][0], max(i + len(words[j]) for i, j in inside)
        at = first - int((size - (last - first)) / 2)
        at = max(0, min(at, n - size)) if n > size else 0
        if score(o) > best:
            best, start = score(o), at
        if n > size:
            s = max(x for x in sentences if x <= o)
            if s < o and score(s) + (120 if s == 0 else 100) > best:
                best, start = score(s) + (120 if s == 0 else 100), s
    end = min(n, start + size)
    out = [" ... " if start else ""]
    at = found[start].start() if start else 0
    i = start
    while i < end:
        spans = [i + len(words[k]) for o, k in hits if o == i]
        if spans:
            stop = max(spans)
            out.append(text[at : found[i].start()] + "[" + text[found[i].start() : found[min(stop, n) - 1].end()] + "]")
            at, i = found[min(stop, n) - 1].end(), max(stop, i + 1)
        else:
            i += 1
    out.append(text[at:] if end >= n else text[at : found[end - 1].end()] + " ... " if at <= found[end - 1].end() else " ... ")
    return "".join(out)


def grep(docs: DataFrame, query: str, key: list[str], text: str, limit: int = 20, only=None) -> DataFrame:
    """(key…, score, snippet) of the best ``limit`` rows, ties by key. Snippets are made for these alone."""
    node = parse_query(query)
    best = search(docs, query, key, text, only).orderBy("score", *key).limit(limit)
    words = [p.words for p in phrases(node)] if node else []

    @F.pandas_udf(T.StringType())
    def shown(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: snippet(t, words))

    rows = docs.select(*key, text)
    return best.join(rows, key).select(*key, "score", shown(text).alias("snippet"))
