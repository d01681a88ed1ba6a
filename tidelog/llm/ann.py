"""Nearest neighbours by inner product through low-dimensional stable projections and a k-d tree.

Inner products become distances: with M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes
(q, 0), so |q - x|^2 = |q|^2 + M^2 - 2 <q, x>. Rows are projected on DIMS Gaussian (2-stable) directions: a projected
squared distance over the true one is chi-square with DIMS degrees of freedom. Rows are visited by their projected
distance; the search stops at projected distance r when chi2(r^2 / d_k^2) reaches `confidence`, d_k being the true
distance of the k-th best so far: a nearer row would have shown up by then with that probability.

The k-d tree's upper levels are fitted on a bounded sample (SAMPLE_ROWS vectors) and deal every row to a leaf; leaves are
cut by a hash of the id into blocks of about BLOCK_ROWS, so equal vectors, however many, spread over blocks. A block is
one task's unit and has a k-d tree of its own, whose leaves are visited nearest first. Each query first searches the
blocks of its own leaf, which bounds d_k, and then the leaves that its test still leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, frexp, fsum

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize

DIMS = 8
SAMPLE_ROWS = 20_000
BLOCK_ROWS = 4096
INNER_LEAF = 64
QUERIES_AT_ONCE = 2048
SEED = 20240731


@dataclass
class Tree:
    """Projection, centre and upper k-d tree. splits: (dimension, value), as a heap; leaf boxes hold every point that the
    splits send there, open towards the outside."""

    directions: np.ndarray
    largest: float
    splits: list[tuple[int, float]]

    @property
    def leaves(self) -> int:
        return len(self.splits) + 1

    def project(self, vectors: np.ndarray, rows: bool) -> np.ndarray:
        last = np.sqrt(np.maximum(0.0, self.largest**2 - (vectors**2).sum(axis=1))) if rows else np.zeros(len(vectors))
        return np.column_stack([vectors, last]) @ self.directions

    def leaf(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        depth = (len(self.splits) + 1).bit_length() - 1
        dims, values = np.array([s[0] for s in self.splits] or [0]), np.array([s[1] for s in self.splits] or [0.0])
        for _ in range(depth):
            right = points[np.arange(len(points)), dims[node]] >= values[node]
            node = 2 * node + 1 + right
        return node - len(self.splits)

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        d = self.directions.shape[1]
        low, high = np.full((1, d), -np.inf), np.full((1, d), np.inf)
        at = 0
        while at < len(self.splits):
            n = len(low)
            low, high = np.repeat(low, 2, axis=0), np.repeat(high, 2, axis=0)
            for i in range(n):
                dim, value = self.splits[at + i]
                high[2 * i, dim] = min(high[2 * i, dim], value)
                low[2 * i + 1, dim] = max(low[2 * i + 1, dim], value)
            at += n
        return low, high


def chi2_quantile(p: float, dims: int) -> float:
    """For an even number of dimensions: the distribution function is 1 - exp(-x/2) * sum (x/2)^i / i!."""

    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - exp(-x / 2) * total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return high


def usable(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column) -> DataFrame:
    """id, v (doubles), query, most (largest magnitude): rows whose vector is neither null nor zero, with finite components."""
    v = F.col(vector_col).cast("array<double>")
    own = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    own = own.where("id is not null and v is not null").where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return own.withColumn("most", F.array_max(F.transform("v", F.abs))).where(F.col("most") > 0)


def scaled(rows: DataFrame, unit: float) -> DataFrame:
    """Adds w, the vector times `unit` (a power of two, so that no bit is lost and squares do not overflow), and its norm."""
    w = F.transform("v", lambda x: x * F.lit(unit))
    return rows.withColumn("w", w).withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda a, x: a + x * x))).drop("most")


def product(a: np.ndarray, b: np.ndarray) -> float:
    """The inner product, rounded once."""
    try:
        return fsum((a * b).tolist())
    except OverflowError:
        return float(a @ b)


def fit(rows: DataFrame, count: int, width: int, largest: float, dims: int, block_rows: int) -> Tree:
    """Directions, and splits at the medians of a sample's widest dimension; enough leaves for `block_rows` rows each, at
    most as many as the sample can tell apart (INNER_LEAF sample rows each)."""
    directions = np.random.default_rng(SEED).standard_normal((width + 1, dims))
    share = min(1.0, SAMPLE_ROWS / max(1, count))
    drawn = rows.where(F.shiftrightunsigned(F.xxhash64("id"), 11) / F.lit(float(1 << 53)) < share).select("w")
    tree = Tree(directions, largest, [])

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([*map(pa.array, tree.project(w, True).T)], names)

    names = [f"p{d}" for d in range(dims)]  # the driver gets these only, however wide the vectors are
    sample = drawn.mapInArrow(project, ", ".join(f"{n} double" for n in names)).limit(2 * SAMPLE_ROWS).toArrow()
    points = np.column_stack([sample.column(n).to_numpy() for n in names])
    parts, splits = [points], []
    while len(parts) * block_rows < count and len(parts) * 2 * INNER_LEAF <= len(points):
        halves = []
        for part in parts:
            dim = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
            value = float(np.median(part[:, dim])) if len(part) else 0.0
            splits.append((dim, value))
            right = part[:, dim] >= value
            halves += [part[~right], part[right]]
        parts = halves
    return Tree(directions, largest, splits)


class Block:
    """One block's rows under a k-d tree whose leaves hold about INNER_LEAF rows."""

    def __init__(self, tree: Tree, ids: np.ndarray, vectors: np.ndarray, unit: float = 1.0) -> None:
        """vectors: as given; the search works on `unit` times them."""
        own = vectors * unit
        points = tree.project(own, True)
        order, cuts = np.arange(len(ids)), [(0, len(ids))]
        while cuts and cuts[0][1] - cuts[0][0] > INNER_LEAF:
            halves = []
            for a, b in cuts:
                part = points[order[a:b]]
                if b - a > 1:
                    dim = int(np.argmax(np.ptp(part, axis=0)))
                    order[a:b] = order[a:b][np.argpartition(part[:, dim], (b - a) // 2)]
                halves += [(a, (a + b) // 2), ((a + b) // 2, b)]
            cuts = [c for c in halves if c[0] < c[1]]
        self.ids, self.vectors, self.own, self.points = ids[order], vectors[order], own[order], points[order]
        equal = np.ascontiguousarray(self.vectors).view(np.dtype((np.void, self.vectors.itemsize * self.vectors.shape[1]))).ravel()
        self.same = np.unique(equal, return_inverse=True)[1]  # rows of one vector have one number
        starts = [a for a, _ in cuts]
        self.cuts = cuts
        self.low, self.high = np.minimum.reduceat(self.points, starts), np.maximum.reduceat(self.points, starts)
        self.largest = tree.largest

    def search(self, query: int, vector: np.ndarray, point: np.ndarray, k: int, bound: float, stop: float, unit: float = 1.0) -> list[tuple[float, int]]:
        """The block's k best (score, id), given the k-th best squared distance so far; ties to the smaller id.

        Leaves come nearest first. Once the next leaf's projected distance passes stop * d_k^2 no leaf is opened, and
        rows beyond it are not verified. Products are first summed in any order; whatever is within their rounding error
        of the k-th best is then summed exactly, once for each distinct vector, so that no row is cut by rounding.
        """
        gap = np.maximum(0.0, np.maximum(self.low - point, point - self.high))
        near = (gap**2).sum(axis=1)
        order = np.argsort(near)
        asked = vector * unit
        norm2, found = float(asked @ asked) + self.largest**2, []
        slack = 4 * len(vector) * np.finfo(float).eps * np.sqrt(float(asked @ asked)) * self.largest  # of a product's sum
        floor = (norm2 - bound) / 2  # products below it are not among the k best (minus infinity without a bound)
        seen = np.zeros(0)
        at, step = 0, 4
        while at < len(order) and near[order[at]] <= stop * bound:
            rows = np.concatenate([np.arange(*self.cuts[c]) for c in order[at : at + step] if near[c] <= stop * bound])
            at, step = at + step, step * 2
            rows = rows[((self.points[rows] - point) ** 2).sum(axis=1) <= stop * bound]
            rows = rows[self.ids[rows] != query]
            products = self.own[rows] @ asked
            high = products >= floor - slack
            found.append(rows[high])
            seen = np.concatenate([seen, products[high]])
            if len(seen) >= k:
                kth = np.partition(seen, -k)[-k]
                bound = min(bound, max(0.0, norm2 - 2 * kth) + 1e-9 * norm2)
        rows = np.concatenate([*found, np.zeros(0, np.int64)])
        if len(rows) > k:
            rows = rows[seen >= np.partition(seen, -k)[-k] - 2 * slack]
        distinct, first, which = np.unique(self.same[rows], return_index=True, return_inverse=True)
        exact = np.array([product(self.vectors[r], vector) for r in rows[first]])[which]
        best = np.lexsort((self.ids[rows], -exact))[:k]
        return list(zip(exact[best].tolist(), self.ids[rows[best]].tolist(), strict=True))


def _search_blocks(pairs: DataFrame, rows: DataFrame, tree: Tree, k: int, stop: float, unit: float) -> DataFrame:
    """query_id, vec_id, score: each pair's query against its block (pairs: block, id, v, bound; rows: block, id, v)."""

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return table.column("id").to_numpy(), vectors.reshape(table.num_rows, -1)

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if asked.num_rows and own.num_rows:
            block = Block(tree, *arrays(own), unit)
            ids, vectors = arrays(asked)
            for q, v, p, bound in zip(ids.tolist(), vectors, tree.project(vectors * unit, False), asked.column("bound").to_pylist(), strict=True):
                out += [(q, i, s) for s, i in block.search(q, v, p, k, bound, stop, unit)]
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

    pairs = pairs.select(*[F.col(c).alias(c) for c in ("block", "part", "id", "v", "bound")])  # names of its own
    rows = rows.select(*[F.col(c).alias(c) for c in ("block", "part", "id", "v")])
    return pairs.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, confidence: float = 0.98, dims: int = DIMS, block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest rows by inner product, other than those of its id.

    confidence: of the chi-square test; the expected share of true neighbours found. Vectors that are null, zero or hold
    null or non-finite components, and null ids, take no part, nor do vectors of another length than most have (the
    longer, if two are as frequent); ties go to the smaller id; repeated rows count one by one as candidates and a repeated
    query is one query; an empty table gives no rows; other columns are not read. Vectors may be of any magnitude. Scores
    are exactly rounded sums of the original vectors' products.
    """
    spark = vectors.sparkSession
    fit_for_use = usable(vectors, id_col, vector_col, is_query)
    length = fit_for_use.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("width")).first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count, width, unit = length["n"], length["width"], 2.0 ** max(-1000, min(1000, -frexp(length["most"])[1]))
    rows = materialize(scaled(fit_for_use.where(F.size("v") == width), unit), "vectors")
    largest = rows.agg(F.max("norm")).first()[0]
    tree = fit(rows, count, width, largest, dims, block_rows)
    stop = chi2_quantile(confidence, dims)
    low, high = tree.boxes()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) * unit
            own, asked = tree.leaf(tree.project(v, True)), tree.leaf(tree.project(v, False))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(asked)], [*batch.schema.names, "leaf", "home"])

    placed = materialize(rows.select("id", "v", "query").mapInArrow(place, "id long, v array<double>, query boolean, leaf long, home long"), "placed")
    sizes = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    blocks = sizes.select("leaf", F.ceil(F.col("n") / block_rows).cast("long").alias("blocks"))  # one row for each leaf
    dealt = placed.join(F.broadcast(blocks), "leaf").withColumn("block", F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("id"), F.col("blocks")))
    queries = placed.where("query").dropDuplicates(["id"]).select("id", "v", "home")

    def searched(asking: DataFrame) -> DataFrame:
        """Every query (id, leaf, bound) against every block of its leaf. A block's rows are sent once for each
        QUERIES_AT_ONCE queries that ask it, so neither side of a task outgrows its bound."""
        spread = asking.join(F.broadcast(blocks), "leaf").withColumn("sub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        pairs = materialize(spread.select((F.col("leaf") * (1 << 32) + F.col("sub")).alias("block"), "id", "bound"), "asked-blocks")
        parts = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES_AT_ONCE).cast("long").alias("parts"))
        left = pairs.join(parts, "block").join(queries.select("id", "v"), "id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        right = dealt.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", "v")
        return _search_blocks(left, right, tree, k, stop, unit)

    home = queries.select("id", F.col("home").alias("leaf"), F.lit(float("inf")).alias("bound"))
    first = materialize(_top(searched(home), k), "first-round")
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    again = queries.join(kth, queries["id"] == kth["query_id"], "left").select("id", "v", "home", "kth", F.coalesce("n", F.lit(0)).alias("n"))

    def open_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) * unit
            points = tree.project(v, False)
            full = batch.column("n").to_numpy() >= k
            kth_score = np.where(full, batch.column("kth").to_numpy(zero_copy_only=False).astype(float) * unit * unit, 0.0)
            norm2 = (v**2).sum(axis=1) + largest**2
            bound = np.where(full, np.maximum(0.0, norm2 - 2 * kth_score) + 1e-9 * norm2, np.inf)
            home_leaf = batch.column("home").to_numpy()
            for at in range(0, batch.num_rows, 256):
                p = points[at : at + 256, None, :]
                near = (np.maximum(0.0, np.maximum(low[None] - p, p - high[None])) ** 2).sum(axis=2)
                hit = near <= stop * bound[at : at + 256, None]
                hit[np.arange(len(hit)), home_leaf[at : at + 256]] = False
                q, leaf = np.nonzero(hit)
                pick = pa.array(q + at)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pick), pa.array(leaf), pa.array(bound[q + at])], ["id", "leaf", "bound"])

    second = searched(again.mapInArrow(open_leaves, "id long, leaf long, bound double"))
    return _top(first.select("query_id", "vec_id", "score").unionByName(second), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
