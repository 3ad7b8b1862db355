"""Filling fixed-capacity containers with items of varying length.

Method: vector best-fit. A container has three capacities: tokens, documents, and attention cost (the sum of
squared lengths). Items are taken from large to small; of the containers in which all three fit, the item
goes to the one whose remaining capacities have the smallest weighted norm afterwards (or the largest
weighted dot product with the item). An item that alone costs more attention than a container allows is not
split for it, but has a container of its own.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenisation of the public byte-level BPE (a fixed value that belongs to the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@dataclass(frozen=True)
class Capacity:
    """What a container holds at most; the three capacities are checked for every item."""

    tokens: int = 2_048
    documents: int = 32
    #: In squared tokens. Below the square of the token capacity, else the token capacity would always bind first.
    attention: float = 0.55 * 2_048.0**2
    #: Weights of tokens, documents and attention cost, each taken as a share of its capacity.
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    rule: str = "norm"


_ENCODERS: dict[str, object] = {}


def rank_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(path: str, content: bytes | None = None):
    """The tokenizer of a rank file, or of its content; built once per Python worker."""
    if path not in _ENCODERS:
        import tiktoken

        lines = (rank_file(path) if content is None else content).splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODERS[path] = tiktoken.Encoding(
            os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODERS[path]


def best_fit(sizes: np.ndarray, capacity: Capacity) -> np.ndarray:
    """Container number of each item; every size must be at most ``capacity.tokens``.

    Open containers are held in arrays sorted by nothing; each item scores those with room at once.
    Containers with less room than the smallest item still to come are closed, which changes no choice.
    """
    order = np.argsort(-sizes, kind="stable")
    placed = np.zeros(len(sizes), dtype=np.int64)
    w = np.asarray(capacity.weights)
    smallest = sizes[order[::-1]]
    room = np.empty((len(sizes), 3))
    names = np.empty(len(sizes), dtype=np.int64)
    n_open = n_all = 0
    least = int(smallest[0]) if len(sizes) else 0
    for k, i in enumerate(order):
        size = float(sizes[i])
        need = np.array([size / capacity.tokens, 1.0 / capacity.documents, size * size / capacity.attention])
        at = -1
        if n_open:
            after = room[:n_open] - need
            fits = (after >= -1e-9).all(axis=1)
            if fits.any():
                if capacity.rule == "dot":
                    score = np.where(fits, -(room[:n_open] * (w * need)).sum(axis=1), np.inf)
                else:
                    score = np.where(fits, (w * after * after).sum(axis=1), np.inf)
                at = int(score.argmin())
        if at < 0:
            at = n_open
            room[at] = 1.0
            names[at] = n_all
            n_open += 1
            n_all += 1
        room[at] -= need
        placed[i] = names[at]
        spent = room[at, 2] * capacity.attention < least * least - 1e-6
        if spent or room[at, 0] * capacity.tokens < least - 1e-6 or room[at, 1] * capacity.documents < 1 - 1e-6:
            n_open -= 1
            room[at], names[at] = room[n_open], names[n_open]
    return placed


PACKED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("token_from", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("container", T.LongType()),
        T.StructField("position", T.IntegerType()),
    ]
)

#: Documents packed together; more leave less space in the last containers, and take more of a task's time.
GROUP = 8_192


def _pack_group(ids: list, sizes: list[int], capacity: Capacity, first: int) -> tuple[pd.DataFrame, int]:
    """Place one group. Documents over the capacity are cut into full containers and a rest."""
    rows_id, part, start, length = [], [], [], []
    for doc, size in zip(ids, sizes):
        at = k = 0
        while True:
            n = min(size - at, capacity.tokens)
            rows_id.append(doc)
            part.append(k)
            start.append(at)
            length.append(n)
            at += n
            k += 1
            if at >= size:
                break
    lengths = np.asarray(length, dtype=np.int64)
    container = best_fit(lengths, capacity) if len(lengths) else lengths
    frame = pd.DataFrame(
        {"doc_id": pd.array(rows_id, dtype="Int64"), "part": part, "token_from": start, "n_tokens": lengths, "container": container + first}
    )
    frame["position"] = frame.groupby("container").cumcount()
    return frame, first + (int(container.max()) + 1 if len(container) else 0)


def pack_documents(
    documents: DataFrame,
    capacity: Capacity = Capacity(),
    tokenizer: str = TOKENIZER,
    group: int = GROUP,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Assignment of every document to containers: (doc_id, part, token_from, n_tokens, container, position).

    Tokenised and packed where the rows are read, in groups of ``group`` documents: no shuffle, no text leaves
    its task, and memory is bounded by the group. A container belongs to one task; its number is the
    task's partition times 2^33 plus a running number, so a task that is run again gives the same. A
    document of at most ``capacity.tokens`` tokens is never split; a longer one is cut into full containers
    and a rest that is packed like a document. Null and empty texts have no tokens and are still
    assigned (0 tokens take a place among the documents of a container). Repeated rows are
    packed as often as they are stored. The driver reads the tokenizer's file, whose size is fixed, and ships it.
    """
    shipped = documents.sparkSession.sparkContext.broadcast(rank_file(tokenizer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer, shipped.value).encode_ordinary
        base = TaskContext.get().partitionId() << 33
        ids, sizes, first = [], [], 0
        for batch in batches:
            ids += batch["d"].tolist()
            sizes += [len(encode(t)) if t else 0 for t in batch["t"]]
            while len(ids) >= group:
                out, first = _pack_group(ids[:group], sizes[:group], capacity, first)
                out["container"] += base
                ids, sizes = ids[group:], sizes[group:]
                yield out
        if ids:
            out, first = _pack_group(ids, sizes, capacity, first)
            out["container"] += base
            yield out

    return documents.select(F.col(doc).alias("d"), F.col(text).alias("t")).mapInPandas(run, PACKED)


def container_report(packed: DataFrame, capacity: Capacity = Capacity()) -> DataFrame:
    """One row: containers, tokens, share of the capacity in use, and the fewest containers possible."""
    per = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d"))
    tokens = F.sum("n")
    return per.agg(
        F.count(F.lit(1)).alias("n_containers"),
        tokens.alias("n_tokens"),
        F.max("n").alias("fullest"),
        F.max("d").alias("most_documents"),
        (tokens / (F.count(F.lit(1)) * F.lit(capacity.tokens))).alias("utilisation"),
        F.ceil(tokens / F.lit(capacity.tokens)).alias("least_containers"),
    )


def breaches(documents: DataFrame, packed: DataFrame, capacity: Capacity = Capacity(), doc: str = "doc_id") -> DataFrame:
    """(id, breach): what an assignment must not have; no rows if it is right.

    A container over a capacity (in attention only if it holds more than one part), a document that isn't assigned as often as it is
    stored, one whose parts leave a gap, and one that was split although it fits. Sums are combined on the map side.
    """
    per = packed.groupBy(F.col("container").alias("id")).agg(
        F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("a")
    )
    over = (
        F.when(F.col("n") > capacity.tokens, "tokens")
        .when(F.col("d") > capacity.documents, "documents")
        .when((F.col("a") > capacity.attention) & (F.col("d") > 1), "attention")
    )
    stored = documents.groupBy(F.col(doc).alias("id")).agg(F.count(F.lit(1)).alias("stored"))
    placed = packed.groupBy(F.col("doc_id").alias("k")).agg(
        F.sum((F.col("part") == 0).cast("int")).alias("placed"),
        F.sum("n_tokens").alias("n"),
        F.count(F.lit(1)).alias("parts"),
        F.sum(((F.col("token_from") != F.col("part") * capacity.tokens)).cast("int")).alias("gaps"),
    )
    wrong = (
        F.when(~F.col("stored").eqNullSafe(F.col("placed")), "not assigned once")
        .when(F.col("gaps") > 0, "gap")
        .when((F.col("parts") > F.col("placed")) & (F.col("n") <= F.col("placed") * capacity.tokens), "split")
    )
    return (
        per.select("id", over.alias("breach"))
        .unionByName(stored.join(placed, F.col("id").eqNullSafe(F.col("k")), "full_outer").select(F.coalesce("id", "k").alias("id"), wrong.alias("breach")))
        .where(F.col("breach").isNotNull())
    )
