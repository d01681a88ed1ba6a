"""Virtual shards, fan-out merges, task readiness, pressure, storage tiers and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.causal import check_acyclic
from tidelog.operators.spans import carried, nth_smallest, numbered

#: Fixed task classes, by priority, and pressure thresholds in percent.
CLASSES = {"maintenance": 0, "summary": 1, "index": 2, "compress": 3, "seal": 4}
LEVELS = (("critical", 90), ("high", 70), ("moderate", 40))
PROMOTE_AT = 2


def route(events: DataFrame, shards: int, mapping: dict[int, int] | None = None) -> DataFrame:
    """Adds vshard: the entity's shard modulo `shards`, or an explicit map whose default is 0."""
    if mapping is None:
        return events.withColumn("vshard", F.pmod(F.col("shard"), F.lit(shards).cast("long")))
    table = F.create_map(*[F.lit(x).cast("long") for pair in mapping.items() for x in pair]) if mapping else None
    return events.withColumn("vshard", F.coalesce(table[F.col("shard")], F.lit(0).cast("long")) if table is not None else F.lit(0).cast("long"))


def partition_sequences(routed: DataFrame, span: int = 1_000_000) -> DataFrame:
    """Adds local_sequence: each virtual shard numbered from 0 in arrival order.

    Rows are ranked within spans of the global sequence and shifted by the counts of earlier spans, so a shard may be any
    size without one task ordering it.
    """
    return numbered(routed, F.expr(f"sequence div {span}"), [F.col("sequence")], "local_sequence", ["vshard"])


def shard_filter(entity: Column | None = None, schema: int | None = None, clock: int | None = None, low: int | None = None, high: int | None = None) -> Column:
    """Inclusive valid-time bounds, which count only with a clock."""
    out = F.lit(True) if entity is None else entity
    if schema is not None:
        out &= F.col("schema_id") == schema
    if clock is not None:
        out &= F.col("valid_clock") == clock
        if low is not None:
            out &= F.col("valid_ticks") >= low
        if high is not None:
            out &= F.col("valid_ticks") <= high
    return out


def fan_out(routed: DataFrame, predicate: Column) -> DataFrame:
    """Every shard's matches in one total order; the virtual shard breaks ties of shard-local sequences."""
    return routed.where(predicate).orderBy("valid_clock", "valid_ticks", "source", "epoch", "sequence", "vshard")


def merge_places(merged: DataFrame, span: int) -> DataFrame:
    """Adds place: the position of each row of `fan_out` in its order, numbered within spans of valid ticks."""
    order = [F.col(c) for c in ("valid_ticks", "source", "epoch", "sequence", "vshard")]
    return numbered(merged, F.struct("valid_clock", F.expr(f"valid_ticks div {span}").alias("part")), order, "place")


def ready_tasks(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Pending tasks (id, class, status) whose dependencies (id, needs) are all completed; highest class first, then id."""
    done = tasks.where("status = 'completed'").select(F.col("id").alias("needs"))
    blocked = dependencies.join(done, "needs", "left_anti").select("id").distinct()
    return tasks.where("status = 'pending'").join(blocked, "id", "left_anti").orderBy(F.col("class").desc(), "id")


def check_tasks(tasks: DataFrame, dependencies: DataFrame) -> None:
    """Raises if a task depends on one that does not exist, or, through others, on itself."""
    if missing := missing_dependencies(tasks, dependencies).take(1):
        raise LookupError(f"task {missing[0]['id']} needs {missing[0]['needs']}, which does not exist")
    check_acyclic(dependencies.select(F.col("needs").alias("cause"), F.col("id").alias("effect")))


def missing_dependencies(tasks: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Dependencies on tasks that do not exist: none may be registered."""
    return dependencies.join(tasks.select(F.col("id").alias("needs")), "needs", "left_anti")


def pressure(depth: Column, limit: Column) -> Column:
    """normal, moderate, high or critical, from whole percents; no limit is normal."""
    percent = F.when(limit > 0, F.floor(depth * 100 / limit)).otherwise(F.lit(0))
    out = F.lit("normal")
    for name, at in reversed(LEVELS):
        out = F.when(percent >= at, name).otherwise(out)
    return out


def should_throttle(level: Column) -> Column:
    return level.isin("high", "critical")


def should_yield(level: Column, task_class: Column) -> Column:
    """Critical: every task; high: all but sealing; moderate: indexing and below."""
    return (
        F.when(level == "critical", F.lit(True))
        .when(level == "high", task_class != CLASSES["seal"])
        .when(level == "moderate", task_class <= CLASSES["index"])
        .otherwise(F.lit(False))
    )


def place_tiers(segments: DataFrame, hot_bytes: int, warm_bytes: int) -> DataFrame:
    """Adds placed: the tier after least-recently-used demotion (segments: segment_id, bytes, tier, accesses, last_access).

    Cold segments read PROMOTE_AT times count as warm; the least recently used hot ones move to warm until the rest fit,
    then warm ones to cold. A tier keeps the longest most-recent prefix that fits, as one-by-one demotion does. Segments
    are metadata; the running sums order one tier each.
    """
    tier = F.when((F.col("tier") == "cold") & (F.col("accesses") >= PROMOTE_AT), "warm").otherwise(F.col("tier"))
    own = segments.withColumn("_tier", tier)
    recent = Window.partitionBy("_tier").orderBy(F.col("last_access").desc(), F.col("segment_id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("_run", F.sum("bytes").over(recent))
    own = own.withColumn("_tier", F.when((F.col("_tier") == "hot") & (F.col("_run") > hot_bytes), "warm").otherwise(F.col("_tier")))
    own = own.withColumn("_run", F.sum("bytes").over(recent))
    return own.withColumn("placed", F.when((F.col("_tier") == "warm") & (F.col("_run") > warm_bytes), "cold").otherwise(F.col("_tier"))).drop("_tier", "_run")


def tier_bytes(placed: DataFrame) -> DataFrame:
    return placed.groupBy("placed").agg(F.count(F.lit(1)).alias("segments"), F.sum("bytes").alias("bytes"))


def reclaimable(events: DataFrame, now: int, max_age: int | None = None, max_events: int | None = None, holds: list[tuple[int, int]] | None = None) -> DataFrame:
    """Sequences past the age limit (on valid time) or among the oldest above the count limit, less the held ranges.

    The cut for the count is one sequence number: logs are contiguous, so it follows from the count and the smallest one;
    otherwise it is narrowed down by counts.
    """
    out = F.lit(False)
    if max_age is not None:
        out |= F.greatest(F.lit(now) - F.col("valid_ticks"), F.lit(0)) > max_age
    if max_events is not None:
        facts = events.agg(F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last")).first()
        excess = facts["n"] - max_events
        if excess > 0:
            if facts["last"] - facts["first"] + 1 == facts["n"]:
                out |= F.col("sequence") < facts["first"] + excess
            else:
                out |= F.col("sequence") <= nth_smallest(events.select("sequence"), "sequence", excess)[0]
    kept = F.lit(False)
    for first, last in holds or []:
        kept |= F.col("sequence").between(first, last)
    return events.where(out & ~kept).select("sequence").distinct()


def held(events: DataFrame, holds: DataFrame) -> DataFrame:
    """Sequences that a table of holds (first, last) covers, for more holds than a condition should list: those up to the
    furthest end of the holds that begin at or before them."""
    ends = carried(events.select("sequence"), "sequence", holds, "first", F.col("last"), "until")
    return ends.where("sequence <= until").select("sequence")


def branch_holds(branches: DataFrame) -> DataFrame:
    """branch, first, last: what living branches need of their ancestors' events, up to each fork. One row a branch."""
    rows = {r["id"]: r for r in branches.collect()}  # the branch table is a small control table
    out = set()
    for row in rows.values():
        at, end = row, None
        while row["lifecycle"] != "retired" and at["parent"] is not None:
            end = at["fork_sequence"] if end is None else min(end, at["fork_sequence"])
            parent = rows[at["parent"]]
            first = 0 if parent["parent"] is None else parent["fork_sequence"] + 1
            if first <= end:
                out.add((at["parent"], first, end))
            at = parent
    return branches.sparkSession.createDataFrame(sorted(out), "branch long, first long, last long")


def retired_prefix(frames: DataFrame, holds: list[tuple[int, int]] | None = None) -> DataFrame:
    """The leading frames (frame, first, last, sealed) that are sealed and not held: those before the first blocked one."""
    hold = F.lit(False)
    for first, last in holds or []:
        hold |= (F.col("first") <= last) & (F.col("last") >= first)
    blocked = frames.where(~F.col("sealed") | hold).agg(F.min("frame").alias("stop"))
    return frames.crossJoin(F.broadcast(blocked)).where(F.col("stop").isNull() | (F.col("frame") < F.col("stop"))).drop("stop")  # one row


def segment_of(sequences: DataFrame, manifest: DataFrame) -> DataFrame:
    """The sealed segment (segment, first, last; segments do not overlap) that holds each sequence, or nulls."""
    found = carried(sequences, "sequence", manifest, "first", F.struct("first", "last", "segment"), "_found")
    hit = F.col("sequence") <= F.col("_found.last")
    return found.select(*sequences.columns, *[F.when(hit, F.col(f"_found.{c}")).alias(c) for c in ("segment", "first", "last")])
