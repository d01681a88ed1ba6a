"""Logical queries to DataFrames. Types are checked here, before anything runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.functions.morton import box_intervals
from tidelog.model import entity_text
from tidelog.plans.ir import Binary, Budget, CausalTrace, Expr, Field, Literal, Not, Query, Scan, SpatialScan, show


class AnalysisError(ValueError):
    """An unknown field, or operands that the operator does not take."""


#: Pseudo-columns of every event.
PSEUDO = {
    "entity": lambda: entity_text(),
    "schema": lambda: F.col("schema_id"),
    "valid_time": lambda: F.col("valid_ticks"),
    "known_time": lambda: F.col("known_ticks"),
    "sequence": lambda: F.col("sequence"),
}
DEFAULT_SELECT = tuple(PSEUDO)
FEW_INTERVALS = 8


def field(events: DataFrame, name: str) -> Column:
    """A pseudo-column, or a column of the table (typed payload fields included)."""
    if name in PSEUDO:
        return PSEUDO[name]()
    if name in events.columns:
        return F.col(name)
    raise AnalysisError(f"unknown field: {name}")


def _kind(events: DataFrame, e: Expr) -> str:
    match e:
        case Literal(bool()):
            return "bool"
        case Literal(int()):
            return "int"
        case Literal(float()):
            return "float"
        case Literal(str()):
            return "string"
        case Field(name):
            found = events.select(field(events, name).alias("x")).schema["x"].dataType
            if isinstance(found, T.IntegralType):
                return "int"
            if isinstance(found, T.FractionalType):
                return "float"
            return {"boolean": "bool", "string": "string"}.get(found.typeName(), found.typeName())
    return "bool"


def column(events: DataFrame, e: Expr) -> Column:
    """A condition as a Column. Equality of different types is constant; order needs two numbers of one type; NOT, AND and
    OR take booleans only."""
    match e:
        case Literal(value):
            return F.lit(value)
        case Field(name):
            return field(events, name)
        case Not(x):
            if _kind(events, x) != "bool":
                raise AnalysisError(f"NOT takes a boolean: {show(e)}")
            return ~column(events, x)
        case Binary(op, a, b):
            kinds = (_kind(events, a), _kind(events, b))
            left, right = column(events, a), column(events, b)
            if op in ("and", "or"):
                if kinds != ("bool", "bool"):
                    raise AnalysisError(f"{op.upper()} takes booleans: {show(e)}")
                return left & right if op == "and" else left | right
            if op in ("=", "!="):
                if kinds[0] != kinds[1]:
                    return F.lit(op == "!=")
                return left == right if op == "=" else left != right
            if kinds not in (("int", "int"), ("float", "float")):
                raise AnalysisError(f"{op} takes two numbers of one type: {show(e)}")
            return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
    raise TypeError(e)


def condition(events: DataFrame, scan: Scan, compat: bool = False) -> Column:
    """The conjunction of all predicates of a scan."""
    out = F.lit(True)
    if scan.entity is not None:
        out &= scan.entity.column()
    if scan.schema is not None and not compat:
        out &= F.col("schema_id") == scan.schema
    if scan.valid is not None:
        out &= scan.valid.column("valid")
    if scan.bounds and not compat:
        out &= F.col("valid_clock") == scan.clock
        for b in scan.bounds:
            out &= {"<": F.col("valid_ticks") < b.ticks, "<=": F.col("valid_ticks") <= b.ticks, ">": F.col("valid_ticks") > b.ticks, ">=": F.col("valid_ticks") >= b.ticks}[b.op]
    if scan.known_as_of is not None:
        out &= (F.col("known_clock") == scan.clock) & (F.col("known_ticks") <= scan.known_as_of)
    return out


def scan_frame(events: DataFrame, scan: Scan, budget: Budget | None = None, compat: bool = False) -> DataFrame:
    """Rows in sequence order. By default the residual condition comes before the limit, LIMIT 0 is empty, and an unknown
    projected field is an error.

    compat=True keeps three historical habits: the limit (1 at least) applies before the residual condition, unknown
    projected fields vanish, and one-sided valid-time bounds and schema equality are ignored.
    """
    rows = min(x for x in (scan.limit, budget.rows if budget else None, 1 << 31) if x is not None)
    out = events.where(condition(events, scan, compat))
    residual = None
    if scan.where is not None:
        if _kind(events, scan.where) != "bool":
            if not compat:
                raise AnalysisError(f"not a condition: {show(scan.where)}")
            residual = F.lit(False)
        else:
            residual = column(events, scan.where)
    limited = scan.limit is not None or budget is not None
    if compat:
        out = out.orderBy("sequence").limit(max(1, rows)) if limited else out.orderBy("sequence")
        out = out.where(residual) if residual is not None else out
    else:
        out = out.where(residual) if residual is not None else out
        out = out.orderBy("sequence").limit(rows) if limited else out.orderBy("sequence")
    names = scan.select or DEFAULT_SELECT
    if compat:
        names = [n for n in names if n in PSEUDO]
    return out.select(*[field(events, n).alias(n) for n in names])


def spatial_frame(events: DataFrame, scan: SpatialScan, chunk_code: str = "chunk_code") -> DataFrame:
    """Rows whose chunk code lies in one of the box's Morton intervals: BETWEENs on one stored column, or a range semi-join
    with the intervals if there are many."""
    out = events
    if scan.box is not None:
        intervals = box_intervals(*scan.box, scan.chunk)
        if len(intervals) <= FEW_INTERVALS:
            hit = F.lit(False)
            for low, high in intervals:
                hit |= F.col(chunk_code).between(low, high)
            out = out.where(hit)
        else:  # the list follows the box, not the data
            table = events.sparkSession.createDataFrame(intervals, "_low long, _high long")
            out = out.join(F.broadcast(table), F.col(chunk_code).between(F.col("_low"), F.col("_high")), "left_semi")
    out = out.orderBy("sequence")
    return out.limit(scan.limit) if scan.limit is not None else out


def explain(query: Query) -> str:
    """The operator, what it pushes down, and its constant cost."""
    match query:
        case Scan():
            parts = []
            if query.entity is not None:
                parts.append(f"entity={query.entity}")
            if query.schema is not None:
                parts.append(f"schema={query.schema}")
            if query.valid is not None:
                parts.append(f"valid_range={query.valid.start}..{query.valid.end}")
            parts += [f"valid_time{b.op}{b.ticks}" for b in query.bounds]
            if query.known_as_of is not None:
                parts.append(f"known_as_of={query.known_as_of}")
            if query.where is not None:
                parts.append(f"pushdown_filter={show(query.where)}")
            if query.select is not None:
                parts.append(f"projection=[{', '.join(query.select)}]")
            if query.limit is not None:
                parts.append(f"limit={query.limit}")
            zones = query.valid is not None or bool(query.bounds) or query.known_as_of is not None or query.entity is not None
            parts.append(f"pushdown_zone_maps={str(zones).lower()}, pushdown_bloom={str(query.entity is not None).lower()}")
            return "\n".join(["StorageScan (cost=10)", *("  " + p for p in parts)])
        case CausalTrace():
            return "\n".join(["CausalWalk (cost=5)", f"  origin={query.origin}", f"  direction={query.direction}", f"  max_depth={query.depth if query.depth is not None else 16}", f"  limit={query.limit}"])
        case SpatialScan():
            n = len(box_intervals(*query.box, query.chunk)) if query.box else 1
            return "\n".join(["SpatialIndexLookup (cost=8)", f"  morton_intervals_count={n}", f"  limit={query.limit}"])
    raise TypeError(query)
