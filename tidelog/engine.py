"""One object for a log: query, explain, history, append, state, branches, causes, subscriptions and provenance."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.functions import morton
from tidelog.model import EventId
from tidelog.operators import admit, branches, causal, replay, scan
from tidelog.plans import compile as plans
from tidelog.plans.ir import Budget, CausalTrace, Query, Scan, SpatialScan
from tidelog.plans.parse import parse, parse_expr
from tidelog.plans.rewrite import Rewritten, simplify
from tidelog.sources.events import claim, release_claim, write_log
from tidelog.streaming.subscribe import deliver, stream_log, subscription


@dataclass
class Result:
    """Rows, and whether more would have matched (known once asked for)."""

    rows: DataFrame
    query: Query
    _more: DataFrame | None = None

    @property
    def truncated(self) -> bool:
        return self._more is not None and bool(self._more.take(1))

    def metrics(self) -> dict[str, int | bool]:
        """Runs the query once: rows returned, events that reached the filter and bytes of files read for them (after files
        and row groups were skipped), and whether more would have matched."""
        execution = self.rows._jdf.queryExecution()
        total = len(execution.executedPlan().executeCollect())
        scanned = size = 0
        leaves = execution.executedPlan().collectLeaves()
        todo = [leaves.apply(i) for i in range(leaves.size())]
        while todo:
            leaf = todo.pop()
            if leaf.nodeName().endswith("QueryStage"):  # adaptive plans keep their stages as leaves
                inner = leaf.plan().collectLeaves()
                todo += [inner.apply(i) for i in range(inner.size())]
                continue
            for name, add in (("numOutputRows", "rows"), ("filesSize", "bytes")):
                metric = leaf.metrics().get(name)
                value = metric.get().value() if metric.isDefined() else 0
                scanned, size = (scanned + value, size) if add == "rows" else (scanned, size + value)
        return {"rows": total, "events_scanned": scanned, "bytes_read": size, "truncated": self.truncated}


class Engine:
    """events: canonical columns (see tidelog.model); typed payload fields may be columns too."""

    def __init__(self, spark: SparkSession, events: DataFrame, path: str | None = None, clock: int = 1, axes: tuple[str, ...] = ("x", "y")) -> None:
        self.spark, self.events, self.path, self.clock = spark, events, path, clock
        self.branches = branches.open_branches(spark)
        self._clock: int | None = None
        self.axes = axes

    def query(self, text: str, budget: Budget | None = None, compat: bool = False) -> Result:
        """Any dialect; the result is lazy."""
        q = parse(text, self.clock)
        match q:
            case Scan():
                if q.known_as_of is not None and self._known_clock() not in (None, q.clock):
                    raise ValueError(f"the log's known clock is {self._known_clock()}, not {q.clock}")
                rows = plans.scan_frame(self.events, q, budget, compat)
                limit = min((x for x in (q.limit, budget.rows if budget else None) if x is not None), default=None)
                unlimited = Scan(q.entity, q.schema, q.valid, q.bounds, q.known_as_of, q.where, ("sequence",), None, q.clock)
                more = None if limit is None else plans.scan_frame(self.events, unlimited).offset(limit)
                return Result(rows, q, more)
            case CausalTrace():
                depth = 16 if q.depth is None else q.depth
                rows = self.trace(q.origin, q.direction, depth)
                return Result(rows if q.limit is None else rows.limit(q.limit), q, None if q.limit is None else rows.offset(q.limit))
            case SpatialScan():
                rows = plans.spatial_frame(self._chunked(q.chunk), replace(q, limit=None))
                return Result(rows if q.limit is None else rows.limit(q.limit), q, None if q.limit is None else rows.offset(q.limit))
        raise TypeError(q)

    def _chunked(self, size: int) -> DataFrame:
        """The events with the chunk code of their coordinates, which are the engine's `axes`."""
        if "chunk_code" in self.events.columns:
            return self.events
        cells = [morton.chunk(F.col(a), size) for a in self.axes]
        return self.events.withColumn("chunk_code", morton.encode2(*cells) if len(cells) == 2 else morton.encode3(*cells))

    def _known_clock(self) -> int | None:
        """The known clock of the log, from one of its events: admission keeps it constant."""
        if self._clock is None and (row := self.events.select("known_clock").take(1)):
            self._clock = row[0][0]
        return self._clock

    def explain(self, text: str) -> str:
        """The logical operator, and Spark's plan under it."""
        q = parse(text, self.clock)
        if not isinstance(q, Scan):
            return plans.explain(q)
        return plans.explain(q) + "\n" + plans.scan_frame(self.events, q)._jdf.queryExecution().simpleString()

    def history(self, flt: scan.HistoryFilter | None = None) -> DataFrame:
        return scan.history(self.events, flt)

    def get(self, event: str):
        return scan.get(self.events, EventId.parse(event))

    def append(self, batch: DataFrame) -> None:
        """Check a batch and add it to the log, as a whole or not at all. Of two writers of a stored log that saw the same
        end, the second is refused, and must open the log anew."""
        last = self.events.agg(F.max("sequence").alias("s"), F.max_by(F.struct("known_clock", "known_ticks"), "sequence").alias("k")).first()
        known = None if last["k"] is None else (last["k"]["known_clock"], last["k"]["known_ticks"])
        first = 0 if last["s"] is None else last["s"] + 1
        checked = admit.admit(batch, first, known)
        if self.path is None:
            self.events = self.events.unionByName(checked, allowMissingColumns=True)
        else:
            if not claim(self.spark, self.path, first):
                raise admit.AdmissionError(f"another writer appends from {first}")
            try:
                write_log(checked.repartition(1), self.path, ordered=True)  # one task writes the batch, but does not make it
            except BaseException:
                release_claim(self.spark, self.path, first)
                raise
            self.events = self.spark.read.schema(self.events.schema).parquet(self.path)

    def state(self, sequence: int) -> DataFrame:
        """Raw state of every entity at a sequence."""
        replay.check_target(self.events, sequence)
        return replay.raw_state(self.events, sequence)

    def fork(self, name: str, parent: int, sequence: int) -> None:
        end = self.events.agg(F.max("sequence")).first()[0]
        self.branches = branches.fork(self.branches, name, parent, sequence, (-1 if end is None else end) + 1)

    def trace(self, origin: EventId, direction: str = "causes", depth: int = 16, limit: int | None = None) -> DataFrame:
        own = self.events.where((F.col("source") == origin.source) & (F.col("epoch") == origin.epoch))
        graph = causal.edges(own).persist()  # read by every level
        out = causal.trace(graph, origin.sequence, direction, depth).orderBy("depth", "node")
        graph.unpersist()
        return out if limit is None else out.limit(limit)

    def subscribe(self, text: str, sink, checkpoint: str, from_sequence: int = 0, once: bool = False, from_now: bool = False) -> StreamingQuery:
        """Deliver past and new events of a stored log to `sink(batch, number)`; from_now: new ones only."""
        if self.path is None:
            raise ValueError("only a stored log can be subscribed to")
        last = self.events.agg(F.max("sequence")).first()[0]
        end = (-1 if last is None else last) + 1
        stream = stream_log(self.spark, self.path, self.events.schema)
        return deliver(subscription(stream, text, end if from_now else from_sequence, end), sink, checkpoint, once)

    @staticmethod
    def rewrite(condition: str) -> Rewritten:
        return simplify(parse_expr(condition))
