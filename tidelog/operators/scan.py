"""History scans, keyset pages and point lookups."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.model import AXES, EntityId, EventId, TimeRange


@dataclass(frozen=True)
class HistoryFilter:
    """Conjunction of an entity, a half-open range on one axis, and an inclusive known-as-of cutoff."""

    entity: EntityId | None = None
    axis: str = "valid"
    range: TimeRange | None = None
    known_as_of: int | None = None
    clock: int = 1

    def column(self) -> Column:
        out = F.lit(True)
        if self.entity is not None:
            out &= self.entity.column()
        if self.range is not None:
            out &= self.range.column(self.axis)
        if self.known_as_of is not None:
            out &= (F.col("known_clock") == self.clock) & (F.col("known_ticks") <= self.known_as_of)
        return out

    def fingerprint(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]


class CursorError(ValueError):
    """A cursor that belongs to another filter or log."""


class BudgetError(ValueError):
    """The first event of a page does not fit its byte budget."""


class NotFoundError(LookupError):
    """No event with this id."""


@dataclass(frozen=True)
class Cursor:
    """Where the next page starts, the snapshot it belongs to, and the filter and log (source, epoch) it was made for."""

    next: int
    snapshot_end: int
    filter: str
    log: tuple[int, int] | None = None


@dataclass
class Page:
    """Rows, the cursor of the next page (None at the end), and what the page cost: events looked at and bytes of matches."""

    rows: DataFrame
    cursor: Cursor | None
    scanned: int = 0
    bytes: int = 0


#: Bytes of an event beside its payload and causes, and of one cause: what the flat columns of the canonical schema take.
EVENT_BYTES, CAUSE_BYTES = 13 * 8, 3 * 8


def event_bytes(events: DataFrame) -> Column:
    payload = F.coalesce(F.octet_length("payload"), F.lit(0)) if "payload" in events.columns else F.lit(0)
    causes = F.greatest(F.size("causes"), F.lit(0)) * CAUSE_BYTES if "causes" in events.columns else F.lit(0)
    return (payload + causes + EVENT_BYTES).cast("long")


def history(events: DataFrame, flt: HistoryFilter | None = None) -> DataFrame:
    """Matching events in sequence order; every predicate is a comparison of stored columns and is pushed to the scan."""
    flt = flt or HistoryFilter()
    return events.where(flt.column()).orderBy("sequence")


def _log_of(events: DataFrame) -> tuple[int, int] | None:
    """The source and epoch of a log, from one of its events: admission keeps them constant."""
    row = events.select("source", "epoch").take(1) if {"source", "epoch"} <= set(events.columns) else []
    return tuple(row[0]) if row else None


def cursor_from(sequence: int, snapshot_end: int, flt: HistoryFilter, log: tuple[int, int] | None = None) -> Cursor:
    """A cursor that starts at a sequence; `log` None fits any log."""
    return Cursor(sequence, snapshot_end, flt.fingerprint(), log)


def page(events: DataFrame, flt: HistoryFilter, rows: int, cursor: Cursor | None = None, max_scanned: int | None = None, max_bytes: int | None = None) -> Page:
    """The next `rows` events by key, without an offset: a page costs the same wherever it lies.

    The snapshot is pinned by the first page's end, so later appends do not move a reader. One row more is fetched, as a
    sequence number and a size, to know whether the result is truncated. A page also ends before it has looked at more than
    `max_scanned` sequences, or before its matches exceed `max_bytes`; if the first of them does, it is a BudgetError. A page
    may be empty and still have a successor, when nothing matched within its scan budget.
    """
    if rows < 1:
        raise ValueError("a page needs at least one row")
    if cursor is not None and cursor.filter != flt.fingerprint():
        raise CursorError("the cursor belongs to another filter")
    if cursor is not None and cursor.log is not None and cursor.log != _log_of(events):
        raise CursorError("the cursor belongs to another log")
    if cursor is None:
        end = events.agg(F.max("sequence")).first()[0]
        cursor = cursor_from(0, (-1 if end is None else end) + 1, flt, _log_of(events))
    stop = cursor.snapshot_end if max_scanned is None else min(cursor.snapshot_end, cursor.next + max_scanned)
    own = events.where(flt.column()).where((F.col("sequence") >= cursor.next) & (F.col("sequence") < stop))
    found = own.select("sequence", event_bytes(events).alias("b")).orderBy("sequence").limit(rows + 1).collect()
    following = found[rows]["sequence"] if len(found) > rows else stop
    used = 0
    for r in found[:rows]:
        if max_bytes is not None and used + r["b"] > max_bytes:
            if not used:
                raise BudgetError(f"the event at {r['sequence']} has {r['b']} bytes, the page {max_bytes}")
            following = r["sequence"]
            break
        used += r["b"]
    done = following >= cursor.snapshot_end
    rest = None if done else Cursor(following, cursor.snapshot_end, cursor.filter, cursor.log)
    return Page(own.where(F.col("sequence") < following).orderBy("sequence"), rest, following - cursor.next, used)


def point(events: DataFrame, event: EventId) -> DataFrame:
    return events.where(event.column())


def get(events: DataFrame, event: EventId):
    """The event's row; an unknown id is an error."""
    found = point(events, event).take(1)
    if not found:
        raise NotFoundError(str(event))
    return found[0]


def known_clock_mismatch(events: DataFrame, clock: int) -> DataFrame:
    """Clocks other than `clock` that known times use: a known-as-of query on them is an error for the caller to raise."""
    return events.where(F.col("known_clock") != clock).select("known_clock").distinct()


def axis_slice(events: DataFrame, axis: str, start: int, end: int, clock: int = 1) -> DataFrame:
    """Half-open slice on any axis; events without that time never match."""
    if axis not in AXES:
        raise ValueError(f"unknown axis: {axis}")
    return events.where(TimeRange(start, end, clock).column(axis))
