"""Live subscriptions, streaming state, converters of consumer events, and cadence clocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidelog.model import ENTITY
from tidelog.operators.causal import KINDS
from tidelog.plans.compile import column, condition, field
from tidelog.plans.ir import Scan
from tidelog.plans.parse import parse


def stream_log(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """A log as a stream. `files_per_batch` is the back-pressure of a subscription."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def files_within(capacity: int, bucket: int) -> int:
    """How many files a micro-batch of a log may have (see `stream_log`) so that it never holds over `capacity` events: a file
    holds a bucket of sequences at most (see `write_log`)."""
    return max(1, capacity // bucket)


def subscription(stream: DataFrame, text: str, from_sequence: int = 0, snapshot_end: int | None = None, limit_ignored: bool = False) -> DataFrame:
    """Matching events of a stream, past ones and new ones under the same predicates, with is_live.

    Every clause of the query applies to both phases, each event is delivered once, and nothing is lost between them,
    since both are one replayable source with one checkpoint. A SELECT projects, and `sequence` is kept with what it names;
    without one all columns stay. A LIMIT is an error, as a stream has no end, unless it is to be ignored. There is no
    watermark: late valid times are legal and stay.
    """
    query = parse(text)
    if not isinstance(query, Scan):
        raise ValueError("only scans can be subscribed to")
    if query.limit is not None and not limit_ignored:
        raise ValueError("a subscription has no limit")
    out = stream.where(F.col("sequence") >= from_sequence).where(condition(stream, query))
    if query.where is not None:
        out = out.where(column(stream, query.where))
    live = F.lit(True) if snapshot_end is None else F.col("sequence") >= snapshot_end
    if query.select is None:
        return out.withColumn("is_live", live)
    names = query.select if "sequence" in query.select else ("sequence", *query.select)
    return out.select(*[field(stream, n).alias(n) for n in names], live.alias("is_live"))


def deliver(matches: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start a subscription: `sink` gets each micro-batch in sequence order and its number, to make writes idempotent."""
    writer = matches.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: sink(df.orderBy("sequence"), n))
    return (writer.trigger(availableNow=True) if once else writer).start()


#: Which folders each mode of a migration writes, the authoritative one first: old system only, old mirrored to new, new
#: mirrored to old, new only.
MODES = {"old_only": ("old",), "shadow": ("old", "new"), "new_first": ("new", "old"), "new_only": ("new",)}


class BackpressureError(RuntimeError):
    """The mirror holds as many events as it may."""


def dual_sink(first: str, second: str) -> Callable[[DataFrame, int], None]:
    """Mirror each micro-batch to two folders; a repeated batch overwrites its own files."""
    return mirror_sink(first, second, "shadow")


def mirror_sink(old: str, new: str, mode: str = "shadow", capacity: int | None = None) -> Callable[[DataFrame, int], None]:
    """A sink for `deliver` that writes each micro-batch to the folders of its mode, the authoritative one first; a repeated
    batch overwrites its own files, so both end up with each event once. A micro-batch of over `capacity` events is refused
    with a BackpressureError before anything is written: read fewer files a batch (see `stream_log`)."""
    folders = [{"old": old, "new": new}[f] for f in MODES[mode]]

    def write(df: DataFrame, n: int) -> None:
        df.persist()
        try:
            if capacity is not None and (held := df.count()) > capacity:
                raise BackpressureError(f"{held} events at once, {capacity} allowed")
            for path in folders:
                df.write.mode("overwrite").parquet(f"{path}/batch={n}")
        finally:
            df.unpersist()

    return write


def last_values(matches: DataFrame, value: str) -> DataFrame:
    """Streaming current state: the last value of each entity, kept by Spark's state store (update mode)."""
    return matches.groupBy(*ENTITY).agg(F.max("sequence").alias("sequence"), F.max_by(value, "sequence").alias(value))


def fold_stream(matches: DataFrame, reducer: Callable[[dict | None, dict], dict | None], columns: list[str], schema: str) -> DataFrame:
    """A user's fold over each entity's events as they arrive: the entity and its state after every micro-batch.

    The state lives in Spark's state store, so it is checkpointed with the offsets and moves with its key; within a batch
    an entity's events are folded in sequence order (the log's order must follow its files).
    """
    import json

    import pandas as pd

    names = [f.strip().split()[0] for f in schema.split(",")]

    def fold(key, batches, state):
        now = json.loads(state.get[0]) if state.exists else None
        parts = list(batches)
        rows = parts[0] if len(parts) == 1 else pd.concat(parts)
        taken = {c: rows[c].tolist() for c in rows.columns}
        order = sorted(range(len(rows)), key=taken["sequence"].__getitem__)
        for i in order:  # an entity has few rows a batch: lists cost less than a sorted table of them
            now = reducer(now, {c: v[i] for c, v in taken.items()})
        if now is None:
            state.remove()
            return
        state.update((json.dumps(now),))
        yield pd.DataFrame({n: [v] for n, v in zip((*ENTITY, *names), (*key, *[now.get(n) for n in names]), strict=True)})

    keyed = matches.select(*ENTITY, "sequence", *columns).groupBy(*ENTITY)
    return keyed.applyInPandasWithState(fold, f"shard long, slot long, generation long, {schema}", "state string", "update", "NoTimeout")


#: Fields of the consumer's events of each kind, and whether their time counts as observed.
CONSUMER = {
    "percept": (("organ_id", "sensor_id", "cadence", "media_uri", "media_hash", "media_bytes", "features"), True),
    "intention": (("organ_id", "cell_id", "goal_label", "policy_id", "target_features"), False),
    "action": (("action_id", "intention_ref", "motor_command", "parameters"), False),
    "outcome": (("action_id", "reward", "state_delta"), True),
}


def convert(events: DataFrame, kind: str, ticks: str, causes: Column | None = None, clock: int = 1, schema_id: int | None = None) -> DataFrame:
    """Consumer events of one kind as canonical columns (all but the event id); kinds are put together by unionByName.

    The kind's fields (see CONSUMER; a column that `events` lacks is null) become a JSON payload, nulls left out. All times
    are `ticks`. An outcome needs the action that caused it.
    """
    fields, observed = CONSUMER[kind]
    if kind == "outcome" and causes is None:
        raise ValueError("an outcome needs its action as a cause")
    payload = F.to_json(F.struct(*[F.col(f) for f in fields if f in events.columns]))
    at, of = F.col(ticks).cast("long"), F.lit(clock).cast("long")
    none = F.array().cast("array<struct<source:bigint,epoch:bigint,sequence:bigint>>")
    return events.select(
        *ENTITY, F.lit(KINDS[kind] if schema_id is None else schema_id).cast("long").alias("schema_id"), of.alias("valid_clock"), at.alias("valid_ticks"),
        F.when(F.lit(observed), of).alias("observed_clock"), F.when(F.lit(observed), at).alias("observed_ticks"), of.alias("known_clock"), at.alias("known_ticks"),
        F.encode(payload, "UTF-8").alias("payload"), (none if causes is None else causes).alias("causes"), F.lit(kind).alias("kind"),
    )


#: Fixed rates of the four cadence clocks, in ticks a second.
CADENCES = {1: 120.0, 2: 20.0, 3: 1.0, 4: 0.1}


def cadence_ticks(events: DataFrame, elapsed_seconds: str) -> DataFrame:
    """clock, tick: how far each clock has come after the elapsed time of every row."""
    clocks = F.array(*[F.struct(F.lit(c).alias("clock"), F.floor(F.col(elapsed_seconds) * r).cast("long").alias("tick")) for c, r in CADENCES.items()])
    return events.select("*", F.explode(clocks).alias("_c")).select("*", "_c.clock", "_c.tick").drop("_c")


def cadence_stream(spark: SparkSession, rows_per_second: int = 120) -> DataFrame:
    """timestamp, clock, tick: the four clocks driven by one rate source, a row whenever a clock comes to a new tick."""
    fastest = max(CADENCES.values())
    source = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    ticking = cadence_ticks(source.withColumn("_seconds", F.col("value") / F.lit(float(rows_per_second))), "_seconds")
    before = F.floor((F.col("value") - 1) / F.lit(float(rows_per_second)) * F.element_at(F.create_map(*[F.lit(x) for pair in CADENCES.items() for x in pair]), F.col("clock")))
    assert rows_per_second >= fastest, "the source must be as fast as the fastest clock"
    return ticking.where((F.col("value") == 0) | (F.col("tick") > before)).select("timestamp", "clock", "tick")
