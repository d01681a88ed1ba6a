"""Vector similarities as column expressions, and exact nearest vectors by blocks of matrix products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries that are broadcast at a time; rows of a task that are drawn at a time, and queries that meet these at once.
BLOCK, ROWS, TILE = 10_000, 4_096, 1_024
#: Norms between which products of doubles neither vanish nor overflow.
TAME = 1e-100, 1e100


def _sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0).cast("double"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    """0 where the lengths differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))).otherwise(F.lit(0.0))


def euclidean(a: Column, b: Column) -> Column:
    """Infinite where the lengths differ."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(_sum(squares))).otherwise(F.lit(float("inf")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is zero or the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best by cosine, rounded before ranking, ties to the smaller id.

    queries (query_id, query) is a stated set, which meets all vectors in blocks of about BLOCK queries, one broadcast
    each. The vectors are dealt to all cores; a task multiplies matrices of ROWS by TILE, and keeps what may be among its own
    k best of each query (see `_Best`), which is all that is shuffled.
    """
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    spark, total = vectors.sparkSession, vectors.count()
    blocks = max(1, -(-queries.count() // BLOCK))
    own = vectors.select("vec_id", "embedding").where("vec_id is not null")
    dealt = own.repartition(max(spark.sparkContext.defaultParallelism, -(-total // (8 * ROWS))), "vec_id")
    asked = queries.select("query_id", "query").where("query_id is not null")
    types = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {own.schema['vec_id'].dataType.simpleString()}, score double"
    out = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)
        known = spark.sparkContext.broadcast(part.toArrow())

        def search(batches, known=known):
            return _Best(known.value, k, digits).of(batches)

        scored = dealt.mapInArrow(search, types).withColumn("score", F.round("score", digits))
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        out = best if out is None else out.unionByName(best)
    return out


def _ids(column):
    """A column of ids as a numpy array that can be sorted."""
    import numpy as np
    import pyarrow as pa

    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.to_pylist())


class _Rows:
    """Vectors of an Arrow list column: ids, lengths (-1: null, or with a null inside), and one matrix a length."""

    def __init__(self, ids, lists):
        import numpy as np

        self.ids = _ids(ids)
        self.length = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype("int64")
        sizes, flat = np.maximum(self.length, 0), lists.flatten()
        values, starts = flat.to_numpy(zero_copy_only=False).astype("float64"), np.cumsum(sizes) - sizes
        if flat.null_count:
            holes = np.repeat(np.arange(len(sizes)), sizes)[flat.is_null().to_numpy(zero_copy_only=False)]
            self.length[holes] = -1
        self.place, self.parts = np.zeros(len(sizes), "int64"), {}
        for n in (int(n) for n in np.unique(self.length) if n > 0):
            at = np.flatnonzero(self.length == n)
            self.place[at] = np.arange(len(at))
            m = values[starts[at][:, None] + np.arange(n)]
            norm = np.sqrt(_in_order(m, m))
            self.parts[n] = at, m, norm, ~((norm == 0) | ((norm > TAME[0]) & (norm < TAME[1])))


def _in_order(a, b):
    """Row by row, the dot product summed from the first number to the last, as `dot` does it."""
    import numpy as np

    out = np.zeros(len(a))
    with np.errstate(all="ignore"):
        for j in range(a.shape[1]):
            out += a[:, j] * b[:, j]
    return out


class _Best:
    """What may be among the k best vectors of each query, of the batches of one task.

    Products of whole matrices say which vectors are near a query's k-th best; only these are scored as `cosine` does it,
    number by number. A score that may round either way is kept in both places, so the ranks can be given by Spark, which
    rounds. Memory is bounded by a tile, and by k rows a query.
    """

    def __init__(self, queries, k: int, digits: int):
        import numpy as np

        self.k, self.unit = k, 10.0**digits
        self.near, self.slack, self.rough = 2 / self.unit + 1e-12, max(1e-5, self.unit * 1e-15), max(1e-4, self.unit * 1e-13)
        column = lambda t, n: t.column(n).combine_chunks()
        self.types = queries.schema.field("query_id").type
        q = [_Rows(column(t, "query_id"), column(t, "query")) for t in (queries.slice(at, TILE) for at in range(0, len(queries), TILE))]
        self.names, of = np.unique(np.concatenate([t.ids for t in q]) if q else np.zeros(0, "int64"), return_inverse=True)
        self.tiles = list(zip(q, np.split(of, np.cumsum([len(t.ids) for t in q])[:-1]), strict=True)) if q else []
        n = len(self.names)
        self.least, self.round = np.full(n, -np.inf), np.full(n, -np.inf)  # the k-th best: its score, and that rounded down
        self.last, self.kept = None, None

    def of(self, batches):
        import pyarrow as pa

        kind = None
        for batch in batches:
            kind = batch.schema.field("vec_id").type
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = _Rows(part.column("vec_id"), part.column("embedding"))
                for tile, of in self.tiles:
                    self._meet(tile, of, rows)
        if self.kept is not None:
            q, v, s = self.kept
            for at in range(0, len(q), 10_000):
                end = at + 10_000
                yield pa.RecordBatch.from_arrays([pa.array(self.names[q[at:end]], self.types), pa.array(v[at:end], kind), pa.array(s[at:end])], ["query_id", "vec_id", "score"])

    def _meet(self, tile: _Rows, of, rows: _Rows) -> None:
        import numpy as np

        about = np.zeros((len(tile.ids), len(rows.ids)))
        with np.errstate(all="ignore"):
            for n in tile.parts.keys() & rows.parts.keys():
                (at_q, m_q, norm_q, odd_q), (at_v, m_v, norm_v, odd_v) = tile.parts[n], rows.parts[n]
                norms = norm_q[:, None] * norm_v[None, :]
                found = np.where(norms > 0, (m_q @ m_v.T) / norms, 0.0)
                found[odd_q], found[:, odd_v] = np.inf, np.inf  # always scored exactly
                about[np.ix_(at_q, at_v)] = found
        about[tile.ids[:, None] == rows.ids[None, :]] = -np.inf
        bound = self.least[of]
        if np.isneginf(bound).any() and len(rows.ids) > self.k:
            bound = np.maximum(bound, np.partition(about, len(rows.ids) - self.k, axis=1)[:, len(rows.ids) - self.k])
        q, v = np.nonzero((about >= (bound - self.near)[:, None]) & (about > -np.inf))
        if self.last is not None:
            up = np.floor(about[q, v] * self.unit + 0.5 + self.rough)
            fit = (up > self.round[of[q]]) | ((up == self.round[of[q]]) & (np.isneginf(self.least[of[q]]) | (rows.ids[v] <= self.last[of[q]])))
            q, v = q[fit], v[fit]
        if len(q):
            score = np.concatenate([self._score(tile, q[i : i + 65_536], rows, v[i : i + 65_536]) for i in range(0, len(q), 65_536)])
            self._keep(of[q], rows.ids[v], score)

    @staticmethod
    def _score(tile: _Rows, q, rows: _Rows, v):
        import numpy as np

        out = np.zeros(len(q))
        for n in tile.parts.keys() & rows.parts.keys():
            at = np.flatnonzero((tile.length[q] == n) & (rows.length[v] == n))
            (_, m_q, norm_q, _), (_, m_v, norm_v, _) = tile.parts[n], rows.parts[n]
            a, b = rows.place[v[at]], tile.place[q[at]]
            with np.errstate(all="ignore"):
                norms = norm_v[a] * norm_q[b]
                out[at] = np.where((norms > 0) | np.isnan(norms), _in_order(m_v[a], m_q[b]) / norms, 0.0)
        return out

    def _keep(self, q, v, score) -> None:
        import numpy as np

        if self.kept is not None:
            q, v, score = (np.concatenate(x) for x in zip(self.kept, (q, v, score), strict=True))
        down, up = (np.where(np.isnan(score), np.inf, np.floor(score * self.unit + 0.5 + d)) for d in (-self.slack, self.slack))
        order = np.lexsort((v, -down, q))
        q, v, score, down, up = (x[order] for x in (q, v, score, down, up))
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        count = np.diff(np.append(first, len(q)))
        full = count >= self.k
        if self.last is None:
            self.last = np.zeros(len(self.names), v.dtype) if v.dtype.kind != "U" else np.full(len(self.names), "", object)
        kth = first[full] + self.k - 1
        self.round[q[kth]], self.last[q[kth]] = down[kth], v[kth]
        self.least[q[kth]] = np.where(np.isnan(score[kth]), np.inf, score[kth])
        fit = np.isneginf(self.least[q]) | (up > self.round[q]) | ((up == self.round[q]) & (v <= self.last[q]))
        self.kept = q[fit], v[fit], score[fit]
