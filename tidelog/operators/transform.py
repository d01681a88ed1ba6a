"""Registered transformations with metered budgets and lineage."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    steps: int = 100_000
    bytes: int = 10 << 20


@dataclass(frozen=True)
class Manifest:
    """What a transformation is called, its version and kind, and what one row may cost."""

    name: str
    version: str
    kind: str
    budget: Budget = Budget()


@dataclass
class Registry:
    """Named DataFrame functions: the user-defined-function surface."""

    entries: dict[str, tuple[Manifest, Callable[..., DataFrame]]] = field(default_factory=dict)

    def register(self, manifest: Manifest, run: Callable[..., DataFrame]) -> None:
        if len(manifest.version.split(".")) != 3:
            raise ValueError(f"not a semantic version: {manifest.version}")
        self.entries[manifest.name] = (manifest, run)

    def apply(self, name: str, df: DataFrame, **options) -> DataFrame:
        if name not in self.entries:
            raise LookupError(f"transformation {name} is not registered")
        manifest, run = self.entries[name]
        return df.transform(lambda d: run(d, manifest, **options))


def event_to_observation(events: DataFrame, manifest: Manifest, feature: str = "payload") -> DataFrame:
    """sequence, feature, value, steps, bytes, outcome: 'ok', 'empty' (which leaves lineage) or 'over budget' (which does
    not). A row costs 10 steps and one a payload byte, and 128 bytes of memory and the payload."""
    if manifest.kind != "event_to_observation":
        raise ValueError(f"{manifest.name} is of kind {manifest.kind}")
    size = F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long")
    steps, memory = size + 10, size + 128
    outcome = F.when((steps > manifest.budget.steps) | (memory > manifest.budget.bytes), "over budget").when(size == 0, "empty").otherwise("ok")
    value = F.when(outcome == "ok", F.decode("payload", "UTF-8"))
    return events.select("sequence", F.lit(feature).alias("feature"), value.alias("value"), steps.alias("steps"), memory.alias("bytes"), outcome.alias("outcome"))


def episode_consolidation(episodes: DataFrame, manifest: Manifest) -> DataFrame:
    """episode, steps, bytes, outcome (episodes: episode, label, observations: array). 50 steps and 5 an observation; an
    episode without observations fails and leaves no lineage."""
    if manifest.kind != "episode_to_pattern":
        raise ValueError(f"{manifest.name} is of kind {manifest.kind}")
    n = F.size("observations").cast("long")
    steps, memory = n * 5 + 50, F.octet_length("label").cast("long") + 256
    outcome = F.when((steps > manifest.budget.steps) | (memory > manifest.budget.bytes), "over budget").when(n <= 0, "empty").otherwise("ok")
    return episodes.select("episode", steps.alias("steps"), memory.alias("bytes"), outcome.alias("outcome"))


def lineage(results: DataFrame, manifest: Manifest, silent: tuple[str, ...] = ("over budget",)) -> DataFrame:
    """The rows of a result that leave a record: transformation, version and receipt."""
    return results.where(~F.col("outcome").isin(*silent)).withColumns({"transformation": F.lit(manifest.name), "version": F.lit(manifest.version), "success": F.col("outcome") == "ok"})
