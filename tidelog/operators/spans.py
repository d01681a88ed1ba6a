"""Work in order without one task for the whole order: rows are cut into spans of a number, and spans meet through their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1_000_000
BINS = 1024


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores before it until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def carried(targets: DataFrame, at: str, points: DataFrame, point: str, value: Column, name: str, span: int = SPAN) -> DataFrame:
    """`targets` with `name`: the largest `value` (a column of `points`, nulls aside) among the points at or before `at`.

    An as-of join where values grow with the points, and a running maximum else. Both tables are put on one axis; within a
    span the maximum is carried forward, and each span starts from that of the spans before it (one row a span). Targets
    keep their rows, repeated ones too; a null `at` has no points before it.
    """
    row = F.struct(*[F.col(c) for c in targets.columns])
    left = targets.select(row.alias("_row"), F.col(at).cast("long").alias("_at"))
    right = points.where(F.col(point).isNotNull()).select(F.col(point).cast("long").alias("_at"), value.alias("_value"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_span", F.expr(f"_at div {span}"))
    inside = Window.partitionBy("_span").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = both.groupBy("_span").agg(F.max("_value").alias("_most")).select("_span", F.max("_most").over(ahead).alias("_before"))  # one row a span
    seen = both.withColumn("_here", F.max("_value").over(inside)).where("_row is not null").join(starts, F.col("_at").isNotNull() & (both["_span"] == starts["_span"]), "left")
    return seen.select("_row.*", F.greatest("_here", "_before").alias(name))


def numbered(df: DataFrame, span: Column, order: list[Column], name: str, keys: list[str] | None = None) -> DataFrame:
    """Adds `name`: the rank from 0 in `order`, within equal `keys`. `span` must not fall along the order; each span is
    ranked by one task, and starts at the count of the spans before it."""
    keys = keys or []
    at, rank, start = (free_name(df, n) for n in ("_span", "_rank", "_start"))
    own = df.withColumn(at, span)
    counts = own.groupBy(*keys, at).agg(F.count(F.lit(1)).alias("n"))
    before = (Window.partitionBy(*keys) if keys else Window).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col(at).alias("_at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    ranked = own.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, at).orderBy(*order)) - 1)
    same = F.col(at).eqNullSafe(F.col("_at"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return ranked.join(starts, same).withColumn(name, F.col(start) + F.col(rank)).select(*df.columns, name)


def in_order(df: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """Adds `name`: the rank from 0 in order of columns of any type. The rows are dealt in ranges, each sorted by one task and
    kept with its rows' places; a range starts at the count of those before it, and the driver sees one row a range."""
    durable, at = bool(df.sparkSession.sparkContext.getCheckpointDir()), free_name(df, "_at")
    by = [order] if isinstance(order, str) else order
    ranges = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    ranges = ranges.checkpoint() if durable else ranges.persist()
    part, place = F.shiftright(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))  # as that function numbers rows
    counts = dict(ranges.groupBy(part.cast("int").alias("part")).count().collect())
    starts = [0]
    for k in range(max(counts, default=0)):
        starts.append(starts[-1] + counts.get(k, 0))
    return ranges.withColumn(name, F.get(F.lit(starts), part.cast("int")).cast("long") + place).drop(at)


def nth_smallest(df: DataFrame, column: str, n: int) -> tuple[int, int]:
    """The n-th smallest value (from 1) of a whole-number column, and how many rows are below it. Counts of BINS bins are
    narrowed until a bin is one value, so nothing is sorted and the driver sees BINS rows a round."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        raise ValueError("no rows")
    below = 0
    while True:
        width = (high - low) // BINS + 1
        inside = df.where(F.col(column).between(low, high))
        rows = inside.groupBy(F.call_function("div", F.col(column) - F.lit(low), F.lit(width).cast("long")).alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
        for r in sorted(rows, key=lambda r: r["bin"]):
            if below + r["n"] >= n:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            below += r["n"]
        else:
            raise ValueError(f"there are fewer than {n} rows")
        if low == high:
            return low, below
