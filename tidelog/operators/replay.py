"""State by replay: last-writer reducers, snapshots, a generic reducer, and the deterministic generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import ENTITY
from tidelog.operators.spans import carried

_MASK = (1 << 64) - 1


class ReplayError(ValueError):
    """The history does not reach the target, or has a gap."""


def check_target(events: DataFrame, target: int) -> None:
    """The target must exist, and no sequence up to it may be missing."""
    facts = events.where(F.col("sequence") <= target).agg(F.max("sequence").alias("last"), F.min("sequence").alias("first"), F.count_distinct("sequence").alias("n")).first()
    if facts["last"] != target:
        raise ReplayError(f"sequence {target} does not exist")
    if facts["last"] - facts["first"] + 1 != facts["n"]:
        raise ReplayError("the history has a gap")


def raw_state(events: DataFrame, target: int | None = None, value: Column | None = None) -> DataFrame:
    """Each entity's last payload: one combined aggregate, no sort of the history."""
    own = events if target is None else events.where(F.col("sequence") <= target)
    value = F.struct("schema_id", "payload") if value is None else value
    return own.groupBy(*ENTITY).agg(F.max("sequence").alias("sequence"), F.max_by(value, "sequence").alias("state"))


def schema_state(updates: DataFrame, target: int | None = None) -> DataFrame:
    """Sparse updates folded by field: entity, schema_id, field, value, sequence, is_null.

    updates: entity, sequence, schema_id, op ('upsert' or 'delete'), fields: map<string, value>. A delete is a barrier:
    rows up to an entity's last one do not count, later ones build it anew with the schema of the first. A field set to
    null is present and null; a field never set is absent.
    """
    own = updates if target is None else updates.where(F.col("sequence") <= target)
    barrier = own.groupBy(*ENTITY).agg(F.max(F.when(F.col("op") == "delete", F.col("sequence"))).alias("barrier"))
    live = own.where(F.col("op") == "upsert").join(barrier, list(ENTITY)).where(F.col("barrier").isNull() | (F.col("sequence") > F.col("barrier")))
    first = live.groupBy(*ENTITY).agg(F.min_by("schema_id", "sequence").alias("schema_id"))
    fields = live.select(*ENTITY, "sequence", F.explode("fields").alias("field", "value"))
    last = fields.groupBy(*ENTITY, "field").agg(F.max_by(F.struct("value"), "sequence").alias("v"), F.max("sequence").alias("sequence"))
    return last.join(first, list(ENTITY)).select(*ENTITY, "schema_id", "field", F.col("v.value").alias("value"), "sequence", F.col("v.value").isNull().alias("is_null"))


def incomplete(state: DataFrame, required: list[str]) -> DataFrame:
    """Entities of a folded state that lack one of the required fields."""
    have = state.where(F.col("field").isin(required) & ~F.col("is_null")).groupBy(*ENTITY).agg(F.count_distinct("field").alias("n"))
    return state.select(*ENTITY).distinct().join(have, list(ENTITY), "left").where(F.coalesce("n", F.lit(0)) < len(required)).select(*ENTITY)


def snapshot(state: DataFrame, path: str, sequence: int) -> None:
    """Save a state as of a sequence; one folder for each checkpoint."""
    state.withColumn("checkpoint", F.lit(sequence).cast("long")).write.mode("overwrite").parquet(f"{path}/checkpoint={sequence}")


def load_snapshot(spark: SparkSession, path: str, target: int) -> tuple[int, DataFrame]:
    """The state at the latest saved checkpoint that does not pass `target`; only that folder is read."""
    saved = spark.read.parquet(path)
    found = saved.where(F.col("checkpoint") <= target).agg(F.max("checkpoint")).first()[0]
    if found is None:
        raise ReplayError(f"no checkpoint at or before {target}")
    return found, saved.where(F.col("checkpoint") == found).drop("checkpoint")


def checkpoints_as_of(targets: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """target, checkpoint: the as-of join of many targets with a table of checkpoints (null: none before).

    Both are put on one axis and cut into spans (see spans.carried), so no task orders the whole axis.
    """
    return carried(targets.select("target"), "target", checkpoints, "checkpoint", F.col("checkpoint"), "checkpoint")


def resolve_handles(entities: DataFrame, handles: DataFrame) -> DataFrame:
    """handles (shard, slot, generation) and whether each is current, stale or unknown: a reused slot has a newer
    generation, which makes older handles invalid."""
    newest = entities.groupBy("shard", "slot").agg(F.max("generation").alias("newest"))
    status = F.when(F.col("newest").isNull() | (F.col("generation") > F.col("newest")), "unknown").when(F.col("generation") < F.col("newest"), "stale").otherwise("current")
    return handles.join(newest, ["shard", "slot"], "left").withColumn("status", status).drop("newest")


def latest_checkpoint(checkpoints: list[int], target: int) -> int | None:
    """As-of lookup: the largest checkpoint that does not pass the target."""
    return max((c for c in checkpoints if c <= target), default=None)


def state_from_checkpoint(state: DataFrame, checkpoint: int, events: DataFrame, target: int, value: Column) -> DataFrame:
    """A raw state at `target`, from the state at `checkpoint` and the events after it; equal to a full replay."""
    delta = events.where((F.col("sequence") > checkpoint) & (F.col("sequence") <= target)).select(*ENTITY, "sequence", value.alias("state"))
    both = state.select(*ENTITY, "sequence", "state").unionByName(delta)
    return both.groupBy(*ENTITY).agg(F.max("sequence").alias("sequence"), F.max_by("state", "sequence").alias("state"))


def reduce_entities(events: DataFrame, reducer: Callable[[dict | None, dict], dict | None], columns: list[str], schema: str) -> DataFrame:
    """A user's fold over each entity's events in sequence order; the state after the last event, unless it is None.

    Events are dealt by entity and sorted within partitions, then read in batches; of an entity only the state is kept, so
    a history may be longer than a task's memory.
    """
    names = [f.strip().split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple | None = None
        state: dict | None = None
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                key = tuple(row[c] for c in ENTITY)
                if key != now:
                    if state is not None:
                        rows.append(dict(zip(ENTITY, now, strict=True)) | state)
                    now, state = key, None
                state = reducer(state, row)
            yield pd.DataFrame(rows, columns=[*ENTITY, *names])
        if state is not None:
            yield pd.DataFrame([dict(zip(ENTITY, now, strict=True)) | state], columns=[*ENTITY, *names])

    dealt = events.select(*ENTITY, "sequence", *columns).repartition(*ENTITY).sortWithinPartitions(*ENTITY, "sequence")
    return dealt.mapInPandas(run, f"shard long, slot long, generation long, {schema}")


#: Fixed: the last generation of a slot.
LAST_GENERATION = (1 << 32) - 1


def next_handles(entities: DataFrame, last: int = LAST_GENERATION) -> DataFrame:
    """shard, slot, generation, retired: the handle that each slot's next entity gets; a slot whose generations are used up
    is retired and has none."""
    newest = entities.groupBy("shard", "slot").agg(F.max("generation").alias("newest"))
    retired = F.col("newest") >= last
    return newest.select("shard", "slot", F.when(~retired, F.col("newest") + 1).alias("generation"), retired.alias("retired"))


class SplitMix:
    """The deterministic generator of replays: SplitMix64 with one warm-up step."""

    #: Fixed constants of SplitMix64.
    GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def __init__(self, seed: int) -> None:
        self.seed, self.state, self.steps = seed & _MASK, seed & _MASK, 0
        self.next()
        self.steps = 0

    def next(self) -> int:
        self.state = (self.state + self.GAMMA) & _MASK
        self.steps += 1
        z = self.state
        z = (z ^ z >> 30) * self.FIRST & _MASK
        z = (z ^ z >> 27) * self.SECOND & _MASK
        return z ^ z >> 31

    def uniform(self) -> float:
        return (self.next() >> 11) / (1 << 53)

    def save(self) -> tuple[int, int, int]:
        return self.seed, self.state, self.steps

    @classmethod
    def load(cls, saved: tuple[int, int, int]) -> SplitMix:
        out = cls(saved[0])
        out.seed, out.state, out.steps = saved
        return out


def random_stream(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """step, value: the generator's first n numbers. SplitMix64's state is seed + gamma * step, so any step is computed
    alone and the stream needs no order."""

    def values(batches):
        for pdf in batches:
            steps = pdf["id"].tolist()
            out = []
            for i in steps:
                g = SplitMix(seed)
                g.state = (seed + SplitMix.GAMMA * (i + 1)) & _MASK
                out.append(g.uniform())
            yield pd.DataFrame({"step": steps, "value": out})

    return spark.range(n).mapInPandas(values, "step long, value double")
