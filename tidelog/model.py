"""Identities, schemas and typed records of the event history."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAUSE = T.StructType([T.StructField(n, T.LongType(), False) for n in ("source", "epoch", "sequence")])

#: The canonical event: ids and the three time axes are flat columns, so Parquet statistics apply to each.
EVENT = T.StructType(
    [T.StructField(n, T.LongType(), n.startswith("observed")) for n in ("source", "epoch", "sequence", "shard", "slot", "generation", "schema_id", "valid_clock", "valid_ticks", "observed_clock", "observed_ticks", "known_clock", "known_ticks")]
    + [T.StructField("payload", T.BinaryType()), T.StructField("causes", T.ArrayType(CAUSE, False))]
)

ENTITY = ("shard", "slot", "generation")
EVENT_ID = ("source", "epoch", "sequence")
AXES = {axis: (f"{axis}_clock", f"{axis}_ticks") for axis in ("valid", "observed", "known")}


class ModelError(ValueError):
    """A literal, schema or record that the data model does not admit."""


def _number(text: str, what: str) -> int:
    if not text.isdecimal() or not text.isascii():
        raise ModelError(f"{what} must be an unsigned number: {text!r}")
    value = int(text)
    if value >= 1 << 63:
        raise ModelError(f"{what} is out of range: {text}")
    return value


@dataclass(frozen=True, order=True)
class EntityId:
    shard: int
    slot: int
    generation: int

    @classmethod
    def parse(cls, text: str) -> EntityId:
        """`[#]shard:slot:generation`, or a bare slot, which stands for 0:slot:1."""
        parts = text.strip().removeprefix("#").strip().split(":")
        if len(parts) == 1:
            return cls(0, _number(parts[0], "slot"), 1)
        if len(parts) != 3:
            raise ModelError(f"not an entity: {text!r}")
        return cls(*(_number(p, n) for p, n in zip(parts, ENTITY, strict=True)))

    def __str__(self) -> str:
        return f"{self.shard}:{self.slot}:{self.generation}"

    def column(self) -> Column:
        return (F.col("shard") == self.shard) & (F.col("slot") == self.slot) & (F.col("generation") == self.generation)


@dataclass(frozen=True, order=True)
class EventId:
    source: int
    epoch: int
    sequence: int

    @classmethod
    def parse(cls, text: str) -> EventId:
        """`[$]source:epoch:sequence`."""
        parts = text.strip().removeprefix("$").strip().split(":")
        if len(parts) != 3:
            raise ModelError(f"not an event id: {text!r}")
        return cls(*(_number(p, n) for p, n in zip(parts, EVENT_ID, strict=True)))

    def __str__(self) -> str:
        return f"{self.source}:{self.epoch}:{self.sequence}"

    def column(self) -> Column:
        return (F.col("source") == self.source) & (F.col("epoch") == self.epoch) & (F.col("sequence") == self.sequence)


@dataclass(frozen=True)
class TimeRange:
    """Half-open, within one clock; other clocks lie outside. start = end is empty."""

    start: int
    end: int
    clock: int = 1

    @classmethod
    def parse(cls, text: str, clock: int = 1) -> TimeRange:
        parts = text.split("..")
        if len(parts) != 2:
            raise ModelError(f"not a range: {text!r}")
        return cls(_number(parts[0].strip(), "start"), _number(parts[1].strip(), "end"), clock)

    def column(self, axis: str = "valid") -> Column:
        if self.start > self.end:
            raise ModelError(f"range ends before it starts: {self.start}..{self.end}")
        clock, ticks = AXES[axis]
        return (F.col(clock) == self.clock) & (F.col(ticks) >= self.start) & (F.col(ticks) < self.end)


_KINDS = {"bool": T.BooleanType(), "i64": T.LongType(), "u64": T.DecimalType(20, 0), "f64": T.DoubleType(), "utf8": T.StringType(), "bytes": T.BinaryType()}


@dataclass(frozen=True)
class Field:
    id: int
    name: str
    kind: str
    nullable: bool = True
    unit: str = ""


@dataclass(frozen=True)
class RecordSchema:
    """A versioned set of typed fields, kept in order of their ids."""

    id: int
    version: int
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        ids, names = [f.id for f in self.fields], [f.name for f in self.fields]
        if self.version < 1 or len(ids) > 4096 or len(set(ids)) < len(ids) or len(set(names)) < len(names) or any(f.kind not in _KINDS for f in self.fields):
            raise ModelError("a schema needs a version of 1 or more and up to 4096 fields with distinct ids and names of known kinds")
        object.__setattr__(self, "fields", tuple(sorted(self.fields, key=lambda f: f.id)))

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, _KINDS[f.kind], f.nullable, {"id": f.id, "unit": f.unit}) for f in self.fields])

    def violations(self, updates: DataFrame) -> DataFrame:
        """Rows of `updates` (key columns, field, value_kind, is_null) that name an unknown field, carry another type or
        set a required field to null, with the reason."""
        known = updates.sparkSession.createDataFrame([(f.name, f.kind, f.nullable) for f in self.fields], "field string, _kind string, _nullable boolean")
        joined = updates.join(F.broadcast(known), "field", "left")
        reason = (
            F.when(F.col("_kind").isNull(), "unknown field")
            .when(F.col("is_null") & ~F.col("_nullable"), "null in a required field")
            .when(~F.col("is_null") & (F.col("value_kind") != F.col("_kind")), "type mismatch")
        )
        return joined.withColumn("reason", reason).where("reason is not null").drop("_kind", "_nullable")


def entity_text() -> Column:
    return F.concat_ws(":", *ENTITY)
