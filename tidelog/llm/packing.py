"""Harmonic packing of documents into sequences of a fixed capacity.

Class k holds pieces of at most capacity // k tokens, and a sequence of class k takes exactly k of them, so any worker
can fill a class's sequences by counting. A document is cut into full sequences (class 1) and a remainder; a remainder
that would leave over WASTE of its slot empty gives up a piece that fills a smaller slot exactly, and so on, which keeps
both the padding and the number of cuts low. Only the last, incomplete sequence of each class (at most k - 1 pieces, so
under capacity * ln(capacity) pieces in all, however large the corpus) is packed first-fit-decreasing by the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize
from tidelog.llm.tokens import small_batches, tokenizer

CAPACITY = 2048
WASTE = 1 / 32
SMALLEST_CUT = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, row long"


def cut(tokens: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document, in order; the lengths add up to `tokens`."""
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        slot = capacity // k
        if rest < SMALLEST_CUT or slot - rest <= WASTE * slot:
            return [*out, (rest, k)]
        k = -(-capacity // rest)
        out.append((capacity // k, k))
        rest -= capacity // k
    return out


class Plans:
    """The pieces of every number of tokens below the capacity, as flat arrays."""

    def __init__(self, capacity: int) -> None:
        plans = [cut(n, capacity) for n in range(capacity)]
        self.capacity, self.counts = capacity, np.array([len(p) for p in plans])
        self.starts = np.cumsum(self.counts) - self.counts
        self.lengths, self.classes = np.array([x for p in plans for x in p], np.int64).reshape(-1, 2).T

    def apply(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, start, length and class of every piece of documents with these numbers of tokens."""
        full, rest = tokens // self.capacity, tokens % self.capacity
        count = full + self.counts[rest]
        doc = np.repeat(np.arange(len(tokens)), count)
        inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) - full[doc]  # below 0: full sequences
        at = np.maximum(self.starts[rest][doc] + inner, 0)
        length, kind = np.where(inner < 0, self.capacity, self.lengths[at]), np.where(inner < 0, 1, self.classes[at])
        ends = np.cumsum(length)
        return doc, ends - length - np.repeat(np.cumsum(tokens) - tokens, count), length, kind


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every document's pieces with the CRC-32 of their ids; each id lies in exactly one piece. `row` differs for each
    piece of a run, repeated documents included, and means nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        plans, row = Plans(capacity), TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, "text"):
            ids, offsets = tokenizer(vocabulary).encode(batch.column("text"))
            tokens = np.diff(offsets)
            doc, start, length, kind = plans.apply(tokens)
            data, firsts = memoryview(ids).cast("B"), 4 * (offsets[:-1][doc] + start)
            crcs = [zlib.crc32(data[a:b]) for a, b in zip(firsts.tolist(), (firsts + 4 * length).tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64()), pa.array(tokens[doc]), pa.array(kind.astype(np.int32)), pa.array(row + np.arange(len(doc)))]
            row += len(doc)
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def fit_tails(lengths: list[int], capacity: int) -> list[int]:
    """First-fit-decreasing: the bin of each length."""
    bins: list[int] = []
    where = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, free in enumerate(bins) if free >= lengths[i]), len(bins))
        if b == len(bins):
            bins.append(capacity)
        bins[b] -= lengths[i]
        where[i] = b
    return where


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece.

    A null or empty text is a document of its end token alone; repeated rows are packed as often as they occur; an empty
    table gives no rows; other columns are not read. Pieces are numbered within hash buckets of about
    max(1000, sqrt(pieces)) rows of a class, shifted by the bucket's start, so no task holds a whole class, however often
    one id or row occurs.
    """
    spark = docs.sparkSession
    cut_docs = materialize(pieces(docs, id_col, text_col, capacity, vocabulary), "pieces")
    counts = {r["class"]: r["n"] for r in cut_docs.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    per = max(1000, isqrt(sum(counts.values())))
    table, sequences = [], 0
    for k in sorted(counts):
        table.append((k, ceil(counts[k] / per), sequences, counts[k] // k * k))
        sequences += counts[k] // k
    classes = F.broadcast(spark.createDataFrame(table, "class int, buckets int, first_sequence long, whole long"))
    dealt = cut_docs.join(classes, "class").withColumn("bucket", F.pmod(F.xxhash64("row"), F.col("buckets")))
    sizes = dealt.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("class", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = Window.partitionBy("class", "bucket").orderBy("row")
    numbered = dealt.withColumn("rank", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["class", "bucket"])
    numbered = materialize(numbered.withColumn("index", F.col("first") + F.col("rank")).drop("rank", "first", "bucket", "buckets", "row"), "numbered")
    tails = numbered.where(F.col("index") >= F.col("whole")).select("class", "index", "length").collect()
    bins = fit_tails([r["length"] for r in tails], capacity)
    extra = spark.createDataFrame([(r["class"], r["index"], sequences + b) for r, b in zip(tails, bins, strict=True)], "class int, index long, tail long")
    placed = numbered.join(F.broadcast(extra), ["class", "index"], "left")
    placed = placed.withColumn("sequence_id", F.coalesce("tail", F.col("first_sequence") + F.expr("index div class")))
    ahead = Window.partitionBy("sequence_id").orderBy("class", "index").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
