"""Logical queries: what the three dialects parse to."""

from __future__ import annotations

from dataclasses import dataclass

from tidelog.model import EntityId, EventId, TimeRange

COMPARISONS = ("=", "!=", "<", "<=", ">", ">=")


@dataclass(frozen=True)
class Literal:
    value: int | float | str | bool


@dataclass(frozen=True)
class Field:
    name: str


@dataclass(frozen=True)
class Not:
    operand: Expr


@dataclass(frozen=True)
class Binary:
    """op: one of COMPARISONS, `and` or `or`."""

    op: str
    left: Expr
    right: Expr


Expr = Literal | Field | Not | Binary


@dataclass(frozen=True)
class Bound:
    """A one-sided or strict bound on valid time."""

    op: str
    ticks: int


@dataclass(frozen=True)
class Scan:
    entity: EntityId | None = None
    schema: int | None = None
    valid: TimeRange | None = None
    bounds: tuple[Bound, ...] = ()
    known_as_of: int | None = None
    where: Expr | None = None
    select: tuple[str, ...] | None = None
    limit: int | None = None
    clock: int = 1


@dataclass(frozen=True)
class CausalTrace:
    origin: EventId
    direction: str
    depth: int | None = None
    limit: int | None = None


@dataclass(frozen=True)
class SpatialScan:
    """Chunks of `chunk` cells that a box (inclusive corners, two or three axes) touches; no box: everything."""

    box: tuple[tuple[int, ...], tuple[int, ...]] | None = None
    chunk: int = 16
    limit: int | None = None


Query = Scan | CausalTrace | SpatialScan


@dataclass(frozen=True)
class Budget:
    """rows limits results; pages enforce the others (see scan.page), whole queries do not, since Spark spills."""

    rows: int = 1000
    scanned: int = 100_000
    bytes: int = 64 << 20


def show(e: Expr) -> str:
    match e:
        case Literal(bool() as v):
            return "true" if v else "false"
        case Literal(str() as v):
            return f"'{v}'"
        case Literal(v):
            return str(v)
        case Field(name):
            return name
        case Not(x):
            return f"NOT {show(x)}"
        case Binary(op, a, b):
            return f"({show(a)} {op.upper()} {show(b)})"
    raise TypeError(e)
