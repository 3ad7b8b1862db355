"""Evaluation items that stand in corpus documents.

Method: size-partitioned MinHash containment search. Items are cut into every stretch of twenty words;
a document is cut into segments of at most forty (overlapping by half, as a whole long document would
leave no Jaccard similarity to a short stretch). Segments are partitioned by size; from a partition's
largest size and the containment sought follow the Jaccard similarity that a hit must have, and from that
the number of hash functions that miss it with less than the allowed probability. Hits are verified by exact
shingle containment and by an exact alignment with at most two edits.
"""

from __future__ import annotations

import html
import math
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgrid.session import cut_lineage

WORDS = 20
EDITS = 2
SHINGLE = 4
#: Largest number of shingles of each partition; a longer document is cut into segments of the last size.
SIZES = (18, 22, 27, 33, 40)
#: Most probability that the sketch misses a stretch that is there.
MISS = 1e-4
#: Items held in memory by each worker; more are taken in blocks of this many.
ITEM_BLOCK = 20_000
#: Items that share a first line from which that line is an instruction.
RECURRING = 3

INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
TAG = re.compile(r"</?[A-Za-z!][^<>]{0,400}>")
LINK = re.compile(r"\]\([^()\s]{0,400}\)")
COMMAND = re.compile(r"\\[A-Za-z]+\*?")
HYPHEN = re.compile(r"(?<=\w)[-\u2010\u2011](?:[ \t]*\r?\n[ \t>*|]*)?(?=\w)")
WORD = re.compile(r"[^\W_]+")
CHOICE = re.compile(r"^\s*\(?[A-Ha-h][).:]\s")


def normal_words(text: str) -> list[str]:
    """Words without case, punctuation, markup, hyphens, line layout and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = INVISIBLE.sub("", text)
    if "<" in text:
        text = TAG.sub(" ", text)
    if "](" in text:
        text = LINK.sub(" ", text)
    if "\\" in text:
        text = COMMAND.sub(" ", text)
    if "-" in text or "\u2010" in text or "\u2011" in text:
        text = HYPHEN.sub("", text)
    return WORD.findall(text.replace("\u2019", "").replace("'", "").replace("_", "").replace("*", "").lower())


def opening_of(text: str | None) -> str | None:
    """The first line of an item, if it may be an instruction: shorter than a stretch, and followed by more."""
    lines = (text or "").strip().split("\n")
    opening = lines[0].strip().lower()
    return opening if len(lines) > 1 and len(WORD.findall(opening)) < WORDS else None


def item_body(text: str | None, instructed: bool) -> list[str]:
    """Words of an item without its opening instruction and its answer choices, the last lines from the first like ``A)``."""
    lines = (text or "").strip().split("\n")[1 if instructed else 0 :]
    for i, line in enumerate(lines):
        if i and CHOICE.match(line):
            lines = lines[:i]
            break
    return normal_words("\n".join(lines))


def with_openings(items: DataFrame, recurring: int = RECURRING) -> DataFrame:
    """(i, t, instructed) of (i, t), repeats collapsed: an opening that at least ``recurring`` of all items have is an instruction.

    Counted over the whole table, whatever the blocks in which it is searched later; items per opening are
    counted after ``distinct``, combined on the map side.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(o=batch["t"].map(opening_of))

    opened = items.distinct().mapInPandas(run, "i long, t string, o string")
    often = (
        opened.where(F.col("o").isNotNull())
        .select("o", "i")
        .distinct()
        .groupBy("o")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= recurring)
        .select("o", F.lit(True).alias("instructed"))
    )
    return opened.join(often, "o", "left").select("i", "t", F.coalesce("instructed", F.lit(False)).alias("instructed"))


def word_code(word: str) -> int:
    return xxhash.xxh64_intdigest(word) >> 1


def shingle_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """A code per run of ``width`` words."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n].astype(np.uint64)
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Partition:
    """Segments of at most ``size`` shingles, searched with ``hashes`` functions."""

    size: int
    jaccard: float
    hashes: int


def partitions(words: int = WORDS, edits: int = EDITS, width: int = SHINGLE, sizes: tuple[int, ...] = SIZES, miss: float = MISS) -> list[Partition]:
    """Number of hash functions by size: a stretch keeps at least q - edits * width of its q shingles."""
    query = words - width + 1
    kept = query - edits * width
    result = []
    for size in sizes:
        jaccard = kept / (query + size - kept)
        result.append(Partition(size, jaccard, math.ceil(math.log(miss) / math.log(1 - jaccard))))
    return result


def _hash_constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def _scramble(codes: np.ndarray, a: np.uint64, b: np.uint64) -> np.ndarray:
    h = codes * a + b
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


class ItemIndex:
    """Sketches of all stretches of a block of items, and what is needed to verify hits."""

    def __init__(self, bodies: list[tuple[int, list[str]]], words: int = WORDS, edits: int = EDITS, width: int = SHINGLE):
        self.words, self.edits, self.width = words, edits, width
        self.parts = partitions(words, edits, width)
        self.most = max(p.hashes for p in self.parts)
        self.a, self.b = _hash_constants(self.most)
        self.codes = [(item, np.array([word_code(w) for w in ws], dtype=np.uint64)) for item, ws in bodies if len(ws) >= words]
        #: For each hash function: sorted smallest values of all stretches, and the items they come from.
        entries: list[list[tuple[int, int]]] = [[] for _ in range(self.most)]
        stretch = words - width + 1
        for i, (_, codes) in enumerate(self.codes):
            s = shingle_codes(codes, width)
            for k in range(self.most):
                h = _scramble(s, self.a[k], self.b[k])
                lows = np.lib.stride_tricks.sliding_window_view(h, stretch).min(axis=1)
                entries[k] += [(int(v), i) for v in np.unique(lows)]
        self.values, self.owners = [], []
        for pairs in entries:
            pairs.sort()
            self.values.append(np.array([v for v, _ in pairs], dtype=np.uint64))
            self.owners.append(np.array([i for _, i in pairs], dtype=np.int64))
        self.seed = (words - edits) // (edits + 1)
        self.grams = [self._grams(codes) for _, codes in self.codes]
        self.shingles = [set(shingle_codes(codes, width).tolist()) for _, codes in self.codes]

    def _grams(self, codes: np.ndarray) -> dict[int, list[int]]:
        places: dict[int, list[int]] = defaultdict(list)
        for at, gram in enumerate(shingle_codes(codes, self.seed).tolist()):
            places[gram].append(at)
        return places

    def search(self, codes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Candidates among documents laid end to end; document k has the words ``first[k]:first[k + 1]``.

        Yields (document, start, end, item): the segment's words ``start:end`` share a smallest value with a
        stretch of the item, and as many exact shingles as any hit must.
        """
        least = self.words - self.width + 1 - self.edits * self.width
        s = shingle_codes(codes, self.width)
        if not len(s) or not self.codes:
            return
        half, largest = self.parts[-1].size // 2, self.parts[-1].size
        ends = np.maximum(first[1:] - self.width + 1, first[:-1])
        sizes = ends - first[:-1]
        blocks = np.maximum(-(-sizes // half), 1)
        blocks[sizes < least] = 0
        doc_of = np.repeat(np.arange(len(sizes)), blocks)
        within = np.arange(len(doc_of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = first[:-1][doc_of] + within * half
        stops = np.minimum(starts + half, ends[doc_of])
        if not len(starts):
            return
        bounds = np.column_stack([starts, stops]).ravel()
        if bounds[-1] == len(s):
            bounds = bounds[:-1]
        single = blocks[doc_of] == 1
        joined = np.append(doc_of[1:] == doc_of[:-1], False)
        hashes = np.full(len(sizes), self.parts[-1].hashes)
        for p in reversed(self.parts[:-1]):
            hashes[sizes <= p.size] = p.hashes
        hashes = hashes[doc_of]
        seen: set[tuple[int, int]] = set()
        for k in range(self.most):
            low = np.minimum.reduceat(_scramble(s, self.a[k], self.b[k]), bounds)[::2]
            pair = low.copy()
            pair[:-1][joined[:-1]] = np.minimum(low[:-1], low[1:])[joined[:-1]]
            values = self.values[k]
            at = np.searchsorted(values, pair)
            ok = (values[np.minimum(at, len(values) - 1)] == pair) & (joined | single) & (hashes > k)
            for g in np.flatnonzero(ok):
                j, value = at[g], pair[g]
                while j < len(values) and values[j] == value:
                    seen.add((int(g), int(self.owners[k][j])))
                    j += 1
        shingles: dict[int, list[int]] = {}
        for g, i in seen:
            stop = int(min(starts[g] + largest, ends[doc_of[g]]))
            if g not in shingles:
                shingles[g] = s[starts[g] : stop].tolist()
            if sum(map(self.shingles[i].__contains__, shingles[g])) >= least:
                yield int(doc_of[g]), int(starts[g]), stop + self.width - 1, i

    def contains(self, i: int, codes: np.ndarray) -> bool:
        """Whether a stretch of item ``i`` stands in ``codes`` with at most ``edits`` edits.

        Each common run of ``seed`` words, of which such a stretch has at least one, is extended to both
        sides with all splits of the edits.
        """
        grams = self.grams[i]
        a, d = self.codes[i][1].tolist(), codes.tolist()
        done: set[tuple[int, int]] = set()
        for at, gram in enumerate(shingle_codes(codes, self.seed).tolist()):
            for place in grams.get(gram, ()):
                done.add((place, at))
                if (place - 1, at - 1) in done:
                    continue
                right = _reach(a, d, place + self.seed, at + self.seed, 1, self.edits)
                left = _reach(a, d, place - 1, at - 1, -1, self.edits)
                if max(right[e] + left[self.edits - e] for e in range(self.edits + 1)) + self.seed >= self.words:
                    return True
        return False

    def leaks(self, codes: np.ndarray, first: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) of all verified hits."""
        found: set[tuple[int, int]] = set()
        for k, start, end, i in self.search(codes, first):
            if (k, i) not in found:
                lo = max(int(first[k]), start - 2 * self.words)
                hi = min(int(first[k + 1]), end + 2 * self.words)
                if self.contains(i, codes[lo:hi]):
                    found.add((k, i))
        return found


def _reach(a: list[int], d: list[int], i: int, j: int, step: int, edits: int) -> list[int]:
    """Words of the item passed from (i, j) in the direction ``step`` with at most 0, 1, … edits."""
    best = [0] * (edits + 1)
    front = {(i, j)}
    for e in range(edits + 1):
        after = set()
        for x, y in front:
            while 0 <= x < len(a) and 0 <= y < len(d) and a[x] == d[y]:
                x, y = x + step, y + step
            best[e] = max(best[e], abs(x - i), best[e - 1] if e else 0)
            if 0 <= x < len(a):
                after |= {(x + step, y + step), (x + step, y)}
            after.add((x, y + step))
        front = after
    return best


FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])
#: Words whose code a worker remembers; when more have come, it starts anew.
REMEMBERED = 2_000_000
#: Words of documents that a worker searches at once.
GROUP_WORDS = 400_000


_INDEX: list[tuple[str, ItemIndex]] = []


def _index_of(name: str, shipped) -> ItemIndex:
    """The index of a broadcast block of items; a worker that is used again keeps the last one."""
    if not _INDEX or _INDEX[0][0] != name:
        _INDEX[:] = [(name, ItemIndex(shipped.value))]
    return _INDEX[0][1]


def leaked_items(
    documents: DataFrame,
    benchmark: DataFrame,
    item_block: int = ITEM_BLOCK,
    doc: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id) for every document that holds a stretch of an item.

    Items are the stated query set: they are read in blocks of at most ``item_block``, each block is shipped
    to the workers, and every document is searched for all of it where it is read; documents are never
    shuffled. With more items than a block holds, the documents are passed over once per block, and a block's items are
    released before the next; what an item's instruction is doesn't depend on the blocks. Null
    and empty texts and items with fewer than twenty words have no cases; repeated rows give one case.
    """
    rows = benchmark.select(F.col(item).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull())
    context = documents.sparkSession.sparkContext

    def scan(shipped) -> DataFrame:
        name = uuid.uuid4().hex

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = _index_of(name, shipped)
            known: dict[str, int] = {}

            def judge(ids: list[int], texts: list[list[str]]) -> pd.DataFrame:
                words = [w for ws in texts for w in ws]
                if len(known) > REMEMBERED:
                    known.clear()
                for w in set(words).difference(known):
                    known[w] = word_code(w)
                codes = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))
                first = np.cumsum([0, *map(len, texts)])
                hits = [(ids[k], index.codes[i][0]) for k, i in index.leaks(codes, first)]
                return pd.DataFrame(hits, columns=FOUND.names).astype("int64")

            ids, texts, n = [], [], 0
            for batch in batches:
                for d, t in zip(batch["d"].tolist(), batch["t"].tolist()):
                    words = normal_words(t) if t else []
                    if len(words) >= WORDS - EDITS:
                        ids.append(d)
                        texts.append(words)
                        n += len(words)
                    if n >= GROUP_WORDS:
                        yield judge(ids, texts)
                        ids, texts, n = [], [], 0
            if ids:
                yield judge(ids, texts)

        return documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).where(F.col("d").isNotNull()).mapInPandas(run, FOUND)

    parts: list[DataFrame] = []
    block: list[tuple[int, list[str]]] = []

    def search_block(last: bool) -> None:
        shipped = context.broadcast(list(block))
        block.clear()
        hits = scan(shipped)
        if last and not parts:
            parts.append(hits)
        else:  # one of several blocks: its hits are written, so that its items needn't stay
            parts.append(cut_lineage(hits))
            shipped.destroy()

    for row in with_openings(rows).toLocalIterator():
        if len(block) == item_block:
            search_block(False)
        block.append((row.i, item_body(row.t, row.instructed)))
    search_block(True)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.distinct()
