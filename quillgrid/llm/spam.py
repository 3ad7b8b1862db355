"""Keyword-stuffed and link-list pages.

Method: recurrence gaps and positional autocorrelation over the term sequence. Each run of text is judged by
how soon its content terms come back (gap to the nearest earlier or later occurrence), by how strongly the
sequence agrees with itself (at small lags within the run, at any lag within the page), and by whether function
words hold it together; long lists of nouns without function words and bare links or tags count as well. A page is spam if such runs make up
more than half of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """a about after all also although an and any are as at be because been before between both but by can could did
    do does each for from further had has have he her his how however i if in into is it its just like many may might
    more most much my near neither no none nor not of off on once one only or other our out over per rather re same
    she should since so some still such than that the their them then there these they this those through to too under
    until up upon was we were what when where whereas whether which while who whose why will with within without would
    yet you your
    aber alle als am an auch auf aus außer außerhalb bei bis da dabei damit das dass dem den denn der des die dies
    diese dieser doch durch ein eine einem einen einer eines er es etwas für gegen gegenüber hat ihr im ist kaum man
    mit nach nicht noch nur ob obwohl oder ohne sich sie sind so über um und unter vom von vor wenn werden wie wir wird
    wurde wurden zu zum zur zwischen
    au aux avec car ce ces cette comme comment contre d dans de des donc du elle en entre est et été il ils je l la
    le les leur lorsque mais même n ne nos notre nous on ont ou où par pas peu plus pour qu quand que qui reste s sa
    sans se ses si son sont sous sur un une vers y à
    al antes aunque con cómo como cuando cuya de del desde donde dos e el ella en entre era es esta este fue fuera ha
    hasta hay la las lo los más me muy ni no nos o para pero poco por porque que qué se sea ser si sin sobre son su
    sus también un una y ya""".split()
)

TOKEN = re.compile(r"(?:https?://|www\.)\S+|#[^\W_][\w-]*|\d+(?:[.,]\d+)+|[^\W_]+(?:['’][^\W_]+)*")
SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")


@dataclass(frozen=True)
class Rules:
    """Thresholds. Runs have ``run_terms`` terms, the last one as many as are left."""

    run_terms: int = 30
    #: A content term recurs closely if its nearest other occurrence is at most this many terms away.
    close_gap: int = 9
    #: The same for the recurring terms of a list.
    wide_gap: int = 240
    #: A run is stuffed if the share of closely recurring content terms is at least this, plus the share
    #: of function words: in prose both are tied to the length of sentences, in stuffing only the former grows.
    stuffed: float = 0.17
    #: Largest lag of the autocorrelation, and the agreement at the best lag that counts as regular.
    lags: int = 15
    regular: float = 0.35
    #: Share of a run's terms, function words aside, that stand again at one and the same distance, however far, and their least
    #: number of occurrences, from which the run is a repeated sentence. Entries of lists that differ in a name stay below.
    verbatim: float = 0.9
    verbatim_times: int = 4
    #: Function words per term below which a run is a list, and the share of recurring terms it then needs.
    listed: float = 0.12
    recurring: float = 0.6
    #: The same for runs with at most so many different function words, as in lists of one keyword per place.
    few_kinds: int = 4
    few_recurring: float = 0.5
    #: The same for runs that are next to nothing but nouns.
    nouns_only: float = 0.02
    nouns_recurring: float = 0.25
    #: Terms in a row without a function word from which they are a list even if none recurs.
    noun_list: int = 60
    #: Share of numbers from which a run is a table, not a list.
    numbers: float = 0.35
    #: Most terms beside a link for the line to count as a bare link.
    beside_link: int = 6
    page: float = 0.5
    #: A text without links and tags in which fewer content terms recur closely, and more function words stand, than in
    #: a text half of which is stuffed or listed, has no such runs; contents pages are among these texts. It is still
    #: searched for repeated sentences and for lists of nouns.
    plain_close: float = 0.1
    plain_held: float = 0.27


RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("spam_share", T.DoubleType()),
        T.StructField("close_recurrence", T.DoubleType()),
        T.StructField("autocorrelation", T.DoubleType()),
        T.StructField("function_share", T.DoubleType()),
        T.StructField("n_terms", T.LongType()),
    ]
)
FAR = 1 << 30


def recurrence_gaps(codes: np.ndarray) -> np.ndarray:
    """Distance of each position to the nearest other position with the same code; FAR if there is none."""
    gaps = np.full(len(codes), FAR, dtype=np.int64)
    if len(codes) > 1:
        order = np.argsort(codes, kind="stable")
        ranked = codes[order]
        step = np.where(ranked[1:] == ranked[:-1], order[1:] - order[:-1], FAR)
        nearest = np.minimum(np.append(step, FAR), np.append(FAR, step))
        gaps[order] = nearest
    return gaps


def autocorrelation(codes: np.ndarray, lags: int) -> np.ndarray:
    """Share of positions that agree with the one ``lag`` before, for lags 1 to ``lags`` (or half the length)."""
    n = len(codes)
    most = min(lags, n // 2)
    if most < 1:
        return np.zeros(1)
    i, j = np.nonzero(codes[:, None] == codes[None, :])
    apart = np.bincount((j - i)[j > i], minlength=most + 1)[1 : most + 1]
    return apart / (n - np.arange(1, most + 1))


def _begins(n: int, run_terms: int) -> np.ndarray:
    """Where the runs of a sequence begin; the last run is its last ``run_terms`` positions."""
    return np.minimum(np.arange(0, n, run_terms), max(n - run_terms, 0))


def best_agreements(codes: np.ndarray, begin: np.ndarray, length: np.ndarray, lags: int) -> np.ndarray:
    """The best ``autocorrelation`` of each run ``codes[begin : begin + length]``, for all runs at once."""
    best = np.zeros(len(begin))
    for lag in range(1, min(lags, int(length.max(initial=0)) // 2) + 1):
        agree = np.concatenate([[0], np.cumsum(codes[lag:] == codes[:-lag])])
        inside = np.maximum(length - lag, 1)
        share = (agree[np.minimum(begin + inside, len(agree) - 1)] - agree[begin.clip(max=len(agree) - 1)]) / inside
        best = np.where(lag <= length // 2, np.maximum(best, share), best)
    return best


def verbatim_share(at: np.ndarray, codes: np.ndarray, places: list[np.ndarray]) -> float:
    """Share of the positions ``at`` that agree with the ones before or after them at the best of all lags.

    ``places`` holds the positions of each code, one of them at least beside those of ``at``.
    """
    lags = np.concatenate([np.unique(np.abs(places[codes[i]] - i)) for i in at.tolist()])
    lags = lags[lags > 0]
    return float(np.unique(lags, return_counts=True)[1].max() / len(at))


def stretches_without(held: np.ndarray, first: np.ndarray | None = None) -> np.ndarray:
    """For each position, the length of the stretch around it in which ``held`` is false; 0 where it is true.

    ``first`` marks positions at which a new sequence begins, which no stretch crosses.
    """
    stretch = np.cumsum(held if first is None else held | first)
    return np.where(held, 0, np.bincount(stretch, weights=~held)[stretch]).astype(np.int64) if len(held) else np.zeros(0, dtype=np.int64)


def _kind(word: str, function_words: frozenset[str] = FUNCTION_WORDS) -> int:
    """0 content, 1 function word, 2 number, 3 tag, 4 link."""
    if word in function_words:
        return 1
    if word[0] == "#":
        return 3
    if word.startswith(("http://", "https://", "www.")):
        return 4
    return 2 if word[0].isdigit() else 0


def _chunks(text: str) -> list[tuple[int, int]]:
    """Sentences and lines."""
    at, chunks = 0, []
    for end in [m.end() for m in SENTENCE.finditer(text)] + [len(text)]:
        if end > at and not text[at:end].isspace():
            chunks.append((at, end))
        at = end
    return chunks


@dataclass
class Terms:
    """The terms of one text: ``codes`` tell them apart, ``gaps`` and ``unheld`` as from the functions above."""

    lower: str
    codes: np.ndarray
    kinds: np.ndarray
    gaps: np.ndarray
    often: np.ndarray
    unheld: np.ndarray
    bests: np.ndarray


def _mark(t: Terms, is_plain: bool, rules: Rules) -> tuple[float, float]:
    """(spam_share, strongest autocorrelation) of one text, by its runs, its lines and its noun lists."""
    n = len(t.codes)
    codes, kinds, often = t.codes, t.kinds, t.often
    content = kinds == 0
    chunks = _chunks(t.lower)
    size = np.array([len(TOKEN.findall(t.lower, a, b)) for a, b in chunks])
    if size.sum() != n:  # a term that runs over the end of a sentence is counted where it begins
        starts = np.array([a for a, _ in chunks])
        at = np.array([m.start() for m in TOKEN.finditer(t.lower)])
        chunk_of = np.searchsorted(starts, at, side="right") - 1
        size = np.bincount(chunk_of, minlength=len(chunks))
    else:
        chunk_of = np.repeat(np.arange(len(chunks)), size)
    length = np.array([b - a for a, b in chunks], dtype=np.float64)
    count = lambda mask: np.bincount(chunk_of, weights=mask, minlength=len(chunks))
    n_link, n_tag = count(kinds == 4), count(kinds == 3)
    bare = (n_link > 0) & (size - n_link <= rules.beside_link * n_link)
    spam = np.where(bare | (n_tag >= 0.5 * np.maximum(size, 1)), 1.0, 0.0)

    rest = np.flatnonzero(spam[chunk_of] == 0)
    marked, strongest = np.zeros(n), 0.0
    if len(rest):
        terms = rules.run_terms
        begin = _begins(len(rest), terms)
        width = min(len(rest), terms)
        runs = rest[begin[:, None] + np.arange(width)]
        bests = t.bests if len(rest) == n else best_agreements(codes[rest], begin, np.full(len(begin), width), rules.lags)
        inside, function = content[runs], kinds[runs] == 1
        n_inside = inside.sum(axis=1)
        judged = n_inside >= 3
        strongest = float(bests[judged].max(initial=0.0))
        gap = t.gaps[runs]
        close_run = ((gap <= rules.close_gap) & inside).sum(axis=1) / np.maximum(n_inside, 1)
        wide_run = ((gap <= rules.wide_gap) & inside).sum(axis=1) / np.maximum(n_inside, 1)
        held_run = function.sum(axis=1) / width
        ranked = np.sort(np.where(function, codes[runs], -1), axis=1)
        n_kinds = (ranked[:, 0] >= 0) + ((ranked[:, 1:] != ranked[:, :-1]) & (ranked[:, 1:] >= 0)).sum(axis=1)
        stuffed = close_run >= rules.stuffed + held_run
        regular = (bests >= rules.regular) & (close_run >= held_run + 0.05)
        few = (n_kinds <= rules.few_kinds) & (width == terms)
        listed = ((kinds[runs] == 2).sum(axis=1) / width < rules.numbers) & (
            ((held_run < rules.listed) & (wide_run >= rules.recurring))
            | (few & (wide_run >= rules.few_recurring))
            | ((held_run < rules.nouns_only) & (wide_run >= rules.nouns_recurring))
        )
        seen = judged & (stuffed | regular | listed) & (not is_plain)
        # Names, numbers and links between the run's terms count: where these change, it's a list with equal notes.
        counted = np.concatenate([[0], np.cumsum(kinds != 1)])
        recurs = np.concatenate([[0], np.cumsum((kinds != 1) & often)])
        lo, hi = runs[:, 0], runs[:, -1] + 1
        maybe = judged & ~seen & (recurs[hi] - recurs[lo] >= rules.verbatim * (counted[hi] - counted[lo]))
        if maybe.any():
            local = np.unique(codes, return_inverse=True)[1]
            places = np.split(np.argsort(local, kind="stable"), np.cumsum(np.bincount(local))[:-1])
            for r in np.flatnonzero(maybe):
                terms_at = lo[r] + np.flatnonzero(kinds[lo[r] : hi[r]] != 1)
                known = terms_at[often[terms_at]]
                seen[r] = verbatim_share(known, local, places) * len(known) >= rules.verbatim * len(terms_at)
        for r in np.flatnonzero(seen):
            marked[rest[r * terms : (r + 1) * terms]] = 1.0
    # Each stretch is judged as a whole, so where runs begin doesn't matter.
    nouns = t.unheld >= rules.noun_list
    if nouns.any():
        for a, b in zip(*(np.flatnonzero(np.diff(np.concatenate([[False], nouns, [False]]).astype(np.int8)))[k::2] for k in (0, 1))):
            if (kinds[a:b] == 2).mean() < rules.numbers:
                marked[a:b] = 1.0
    spam = np.maximum(spam, count(marked) / np.maximum(size, 1))
    return float((spam * length).sum() / length.sum()), strongest


class Judge:
    """Judges groups of texts; what is counted per term is counted for all texts of a group at once."""

    def __init__(self, rules: Rules = Rules(), function_words: frozenset[str] = FUNCTION_WORDS):
        self.rules, self.function_words = rules, function_words
        #: Code and kind of each term met; forgotten when too many have come.
        self.known: dict[str, int] = {}

    def _packed(self, words: list[str]) -> np.ndarray:
        if len(self.known) > 1_000_000:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = len(known) << 3 | _kind(w, self.function_words)
        return np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))

    def group(self, texts: list[str | None]) -> list[tuple[float, float, float, float, int]]:
        """A result of :func:`analyse` for each text."""
        rules = self.rules
        lowers = [(t or "").lower() for t in texts]
        lists = [TOKEN.findall(x) for x in lowers]
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        results: list = [(0.0, 0.0, 0.0, 0.0, 0)] * len(texts)
        if not size.sum():
            return results
        packed = self._packed([w for ws in lists for w in ws])
        codes, kinds = packed >> 3, (packed & 7).astype(np.int8)
        doc = np.repeat(np.arange(len(size)), size)
        start = np.concatenate([[0], np.cumsum(size)])
        own = codes * len(size) + doc
        gaps = recurrence_gaps(own)
        order = np.argsort(own, kind="stable")
        ranked = own[order]
        cuts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        often = np.empty(len(own), dtype=bool)
        often[order] = np.repeat(np.diff(np.append(cuts, len(own))) >= rules.verbatim_times, np.diff(np.append(cuts, len(own))))
        content, function = kinds == 0, kinds == 1
        per_text = lambda mask: np.bincount(doc, weights=mask, minlength=len(size))
        n_content = per_text(content)
        close = per_text(content & (gaps <= rules.close_gap)) / np.maximum(n_content, 1)
        held = per_text(function) / np.maximum(size, 1)
        opens = np.zeros(len(own), dtype=bool)
        opens[start[:-1][size > 0]] = True
        unheld = stretches_without(function, opens)
        is_plain = (close < rules.plain_close) & (held > rules.plain_held) & (per_text(kinds >= 3) == 0)

        n_runs = -(-size // rules.run_terms)
        run_of = np.repeat(np.arange(len(size)), n_runs)
        first_run = np.concatenate([[0], np.cumsum(n_runs)])
        within = (np.arange(len(run_of)) - first_run[run_of]) * rules.run_terms
        begin = start[run_of] + np.minimum(within, np.maximum(size[run_of] - rules.run_terms, 0))
        length = np.minimum(size[run_of], rules.run_terms)
        bests = best_agreements(own, begin, length, rules.lags)
        # Without a run most of whose terms occur often there is no repeated sentence.
        sums = lambda mask: (lambda c: c[begin + length] - c[begin])(np.concatenate([[0], np.cumsum(mask)]))
        repeats = sums(often & ~function) >= rules.verbatim * sums(~function)
        looked = ~is_plain | (np.bincount(run_of, weights=repeats, minlength=len(size)) > 0) | (per_text(unheld >= rules.noun_list) > 0)
        for i in np.flatnonzero(size > 0).tolist():
            a, b = start[i], start[i + 1]
            own_bests = bests[first_run[i] : first_run[i + 1]]
            share, strongest = 0.0, float(own_bests.max())
            if looked[i]:
                terms = Terms(lowers[i], codes[a:b], kinds[a:b], gaps[a:b], often[a:b], unheld[a:b], own_bests)
                share, strongest = _mark(terms, bool(is_plain[i]), rules)
            results[i] = (share, float(close[i]), strongest, float(held[i]), int(size[i]))
        return results


def analyse(text: str | None, rules: Rules = Rules(), function_words: frozenset[str] = FUNCTION_WORDS) -> tuple[float, float, float, float, int]:
    """(spam_share, close_recurrence, autocorrelation, function_share, n_terms) of one text.

    ``spam_share`` is by characters of the sentences and lines that hold the spam; ``autocorrelation`` the
    strongest of any run. A null or empty text, or one without terms, has zeros.
    """
    return Judge(rules, function_words).group([text])[0]


#: Frequent function words of the four listed languages; a text with fewer than one of them per so many characters is
#: looked at for words of a language that isn't listed.
_COMMON = r"(?i)[^\p{L}](?:the|of|and|to|in|der|die|und|das|von|de|la|le|et|les|que|y|el|en|los)(?=[^\p{L}])"
UNLISTED_CHARS = 80
#: A word that stands in this share of the documents of a language is one of its function words, if there are enough documents.
FREQUENT, LEAST_DOCUMENTS = 0.25, 100


def learned_function_words(documents: DataFrame, text: str = "text", lang: str = "lang") -> frozenset[str]:
    """Function words of languages that the fixed list doesn't cover, from document frequencies over all documents.

    Only documents that hardly hold words of the listed languages give words, but a word must stand in ``FREQUENT`` of
    all documents of its language, so keywords of spam in a listed language are none. At most as many words
    as a document has different ones, times four, come out per language.
    """
    if lang not in documents.columns:
        return frozenset()
    named = documents.select(F.coalesce(F.col(lang), F.lit("")).alias("l"), F.lower(text).alias("t"))
    unlisted = named.where((F.length("t") > 0) & (F.regexp_count("t", F.lit(_COMMON)) * UNLISTED_CHARS < F.length("t")))
    words = unlisted.select("l", F.explode(F.array_distinct(F.split("t", r"[^\p{L}]+"))).alias("w")).where("w <> ''")
    known = words.groupBy("l", "w").agg(F.count(F.lit(1)).alias("n"))
    totals = named.groupBy("l").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") >= LEAST_DOCUMENTS)
    rows = known.join(totals, "l").where(F.col("n") >= FREQUENT * F.col("all")).select("w").distinct().collect()
    return frozenset(r.w for r in rows)


#: Characters of texts that are judged together.
GROUP_CHARS = 2_000_000


def judge_documents(documents: DataFrame, rules: Rules = Rules(), doc: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, spam_share, close_recurrence, autocorrelation, function_share, n_terms), a row per document.

    One pass over whole texts where they are read: no shuffle, nothing gathered, each text judged by itself. Before it,
    one pass in the JVM learns the function words of languages that aren't listed.
    """
    function_words = FUNCTION_WORDS | learned_function_words(documents, text, lang)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(rules, function_words)

        def judged(ids: list, texts: list) -> pd.DataFrame:
            out = pd.DataFrame(judge.group(texts), columns=RESULT.names[1:])
            out.insert(0, "doc_id", pd.array(ids, dtype="Int64"))
            return out

        ids, texts, n = [], [], 0
        for batch in batches:
            for d, t in zip(batch["d"].tolist(), batch["t"].tolist()):
                ids.append(pd.NA if d != d or d is None else int(d))
                texts.append(t)
                n += len(t or "")
                if n >= GROUP_CHARS:
                    yield judged(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield judged(ids, texts)

    return documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInPandas(run, RESULT)


def found(documents: DataFrame, rules: Rules = Rules()) -> DataFrame:
    return judge_documents(documents, rules).where(F.col("spam_share") > rules.page).select("doc_id").distinct()
