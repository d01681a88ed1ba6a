"""Fitness formulas, audit rules and the lifecycle of physical-design candidates."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed weights and limits.
PROMOTION_THRESHOLD = 0.05
MAX_STEPS, MAX_MEMORY = 10_000_000, 512 << 20


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def _gain(before: Column, after: Column) -> Column:
    return F.when(before > 0, (before - after) / before).otherwise(F.lit(0.0))


def net_benefit(base: dict[str, Column], own: dict[str, Column]) -> Column:
    """Weighted gains of latency, memory, storage and amplification over a baseline, less added background cost."""
    gains = {n: _gain(base[n], own[n]) for n in ("latency", "memory", "storage", "amplification")}
    return 0.35 * gains["latency"] + 0.25 * gains["memory"] + 0.25 * gains["storage"] + 0.15 * gains["amplification"] - 0.10 * (own["background"] - base["background"])


def storage_fitness(raw: Column, packed: Column, latency_us: Column, cycles: Column, amplification: Column) -> Column:
    ratio = F.when(raw > 0, packed / raw).otherwise(F.lit(1.0))
    space = F.greatest(1.0 - ratio, F.lit(0.0))
    latency = 1.0 - _clamp(latency_us / 1000.0, 0.0, 1.0)
    cpu = 1.0 - _clamp(cycles / 10_000.0, 0.0, 1.0)
    amp = 1.0 - _clamp(amplification, 1.0, 5.0) / 5.0
    return 0.40 * space + 0.30 * latency + 0.15 * cpu + 0.15 * amp


def checkpoint_score(interval: Column, events_per_s: Column, snapshot_us: Column) -> Column:
    """Higher is better: recovery takes half an interval's replay, and a snapshot's cost is spread over its interval."""
    recovery = interval / 2.0 / F.greatest(events_per_s, F.lit(1.0))
    amortised = snapshot_us / 1_000_000.0 / F.greatest(interval, F.lit(1))
    return 1.0 / (1.0 + recovery + 10.0 * amortised)


def rule_score(support: Column, against: Column, confidence: Column) -> Column:
    accuracy = support / (support + against)
    return F.when(support == 0, F.lit(0.0)).otherwise(F.greatest(accuracy * confidence - against * 0.5, F.lit(0.0)))


class ConstitutionError(ValueError):
    """An action that the fixed rules forbid."""


def check_action(kind: str, *, manual: bool = False, approver: str | None = None, steps: int = 1, memory: int = 1, gate_passed: bool = False, exact_bypass: bool = False) -> None:
    """Evidence and the rules themselves never change; promotion is manual and approved; evaluation has a budget; the
    mutation policy changes only after its gate; semantic search never replaces exact storage."""
    bad = {
        "mutate_evidence": "evidence is immutable",
        "mutate_constitution": "the rules cannot change themselves",
        "promote": None if manual and approver else "promotion needs manual approval",
        "evaluate": None if 0 < steps <= MAX_STEPS and 0 < memory <= MAX_MEMORY else "evaluation exceeds its limits",
        "mutate_policy": None if gate_passed else "the gate has not passed",
        "semantic_query": "semantic search cannot bypass exact storage" if exact_bypass else None,
    }
    if kind not in bad:
        raise ValueError(f"unknown action: {kind}")
    if bad[kind]:
        raise ConstitutionError(bad[kind])


def audit(candidates: DataFrame) -> DataFrame:
    """id, violation (candidates: id, operator, rationale, status, incumbent)."""
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = F.array_compact(F.array(
        F.when(missing("operator"), "no mutation operator"),
        F.when(missing("rationale"), "no rationale"),
        F.when(F.col("incumbent") & (F.col("status") != "promoted"), "incumbent is not promoted"),
    ))
    return candidates.select("id", F.explode(checks).alias("violation"))


@dataclass
class Lifecycle:
    """Candidates of one slot: registered, proposed, evaluated, promoted; a rollback brings the previous incumbent back."""

    status: dict[str, str] = field(default_factory=dict)
    benefit: dict[str, float] = field(default_factory=dict)
    history: list[str] = field(default_factory=list)
    evolving: bool = True

    def register(self, name: str) -> None:
        if name in self.status:
            raise ValueError(f"{name} exists")
        self.status[name] = "registered"

    def propose(self, name: str, gate_passed: bool) -> None:
        if not gate_passed:
            raise ConstitutionError("the gate has not passed")
        self.status[name] = "proposed"

    def evaluate(self, name: str, benefit: float, steps: int, memory: int) -> None:
        check_action("evaluate", steps=steps, memory=memory)
        self.benefit[name] = benefit
        self.status[name] = "evaluated"

    def promote(self, name: str, approver: str | None) -> None:
        check_action("promote", manual=True, approver=approver)
        if self.status.get(name) != "evaluated" or self.benefit[name] < PROMOTION_THRESHOLD:
            raise ConstitutionError(f"{name} has no sufficient evaluation")
        if self.history:
            self.status[self.history[-1]] = "superseded"
        self.history.append(name)
        self.status[name] = "promoted"

    def rollback(self) -> str | None:
        """The incumbent after taking the last promotion back."""
        if not self.history:
            raise ConstitutionError("nothing was promoted")
        self.status[self.history.pop()] = "rolled back"
        if self.history:
            self.status[self.history[-1]] = "promoted"
        return self.history[-1] if self.history else None

    def mutate_policy(self, gate_passed: bool, current_yield: float, new_yield: float) -> bool:
        """A new mutation policy is taken only if evolution is on, the gate passed and the yield is strictly higher."""
        if not self.evolving:
            return False
        check_action("mutate_policy", gate_passed=gate_passed)
        return new_yield > current_yield
