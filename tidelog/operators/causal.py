"""The causal graph: edges, bounded traces, ancestry, topological levels, adjacency and action traces.

Events are named by their sequence within one source and epoch, or by any other single column; an edge leads from a cause
to its effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tidelog.operators.spans import in_order

FRONTIER_LIMIT = 100_000
#: Edges that one task peels at a time.
BLOCK_EDGES = 2_000_000


class CycleError(ValueError):
    """An event that is its own ancestor."""


def edges(events: DataFrame) -> DataFrame:
    """cause, effect: one row for each distinct declared cause."""
    return events.select(F.explode(F.array_distinct("causes")).alias("c"), F.col("sequence").alias("effect")).select(F.col("c.sequence").alias("cause"), "effect")


def causes_of(graph: DataFrame, event: int) -> DataFrame:
    return graph.where(F.col("effect") == event).select("cause")


def effects_of(graph: DataFrame, event: int) -> DataFrame:
    return graph.where(F.col("cause") == event).select("effect")


def _step(graph: DataFrame, frontier: set[int], here: str, there: str) -> set[int]:
    """The nodes at the other end of the frontier's edges, FRONTIER_LIMIT + 1 of them at most."""
    if len(frontier) <= 256:
        step = graph.where(F.col(here).isin(sorted(frontier)))
    else:
        ends = graph.sparkSession.createDataFrame([(x,) for x in sorted(frontier)], f"{here} long")
        step = graph.join(F.broadcast(ends), here, "left_semi")  # about FRONTIER_LIMIT rows at most
    return {r[0] for r in step.select(there).distinct().limit(FRONTIER_LIMIT + 1).collect()}


def trace(graph: DataFrame, root: int, direction: str = "causes", depth: int = 16) -> DataFrame:
    """node, depth: breadth-first from `root` (depth 0), each node at its first visit."""
    return walk(graph, {root}, direction, depth)


def walk(graph: DataFrame, roots: set[int], direction: str = "causes", depth: int | None = 16) -> DataFrame:
    """node, depth: breadth-first from several roots at once, to the end if `depth` is None.

    The frontier stays with the driver while it is small (FRONTIER_LIMIT nodes) and filters the edges as literals; beyond
    that it is a checkpointed DataFrame that Spark joins. Every level is one job over the edges; a graph partitioned by
    the followed end is pruned in each.
    """
    spark = graph.sparkSession
    here, there = ("effect", "cause") if direction == "causes" else ("cause", "effect")
    seen, frontier, level = dict.fromkeys(roots, 0), set(roots), 0
    while frontier and (depth is None or level < depth) and len(seen) <= FRONTIER_LIMIT:
        level += 1
        step = _step(graph, frontier, here, there)
        found = step - seen.keys()
        if len(step) > FRONTIER_LIMIT:  # cut short, whatever of it was seen before
            return _wide_trace(graph, spark.createDataFrame(sorted(seen.items()), "node long, depth int"), here, there, level - 1, depth)
        frontier = found
        seen |= dict.fromkeys(found, level)
    out = spark.createDataFrame(sorted(seen.items()), "node long, depth int")
    return _wide_trace(graph, out, here, there, level, depth) if frontier and (depth is None or level < depth) else out


def _wide_trace(graph: DataFrame, seen: DataFrame, here: str, there: str, level: int, depth: int | None, until: int | None = None) -> DataFrame:
    """The same walk with the visited set as a checkpointed table; to the end if `depth` is None, or until a node is met."""
    if not seen.sparkSession.sparkContext.getCheckpointDir():
        raise ValueError("a trace of this width needs spark.checkpoint.dir")
    seen = seen.checkpoint()
    while depth is None or level < depth:
        level += 1
        frontier = seen.where(F.col("depth") == level - 1).select(F.col("node").alias(here))
        found = graph.join(frontier, here, "left_semi").select(F.col(there).alias("node")).distinct()
        fresh = found.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)).checkpoint()
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh).checkpoint()
        if until is not None and fresh.where(F.col("node") == until).take(1):
            break
    return seen


def traced_edges(graph: DataFrame, visited: DataFrame, depth: int, direction: str = "causes") -> DataFrame:
    """cause, effect: every edge out of the expanded nodes (those above the depth limit), to visited nodes too."""
    here = "effect" if direction == "causes" else "cause"
    return graph.join(visited.where(F.col("depth") < depth).select(F.col("node").alias(here)), here, "left_semi").select("cause", "effect")


def is_ancestor(graph: DataFrame, ancestor: int, event: int) -> bool:
    """Whether `ancestor` is `event` or one of its direct or indirect causes, however far. Stops at the level that finds it,
    or when no new cause is left; a walk that grows beyond FRONTIER_LIMIT nodes goes on as a table."""
    if ancestor == event:
        return True
    frontier, seen = {event}, {event}
    while frontier:
        found = _step(graph, frontier, "effect", "cause") - seen
        if ancestor in found:
            return True
        if len(seen) + len(found) > FRONTIER_LIMIT:  # the last step may have been cut short: it is taken again below
            rows = [(x, 1) for x in sorted(seen - frontier)] + [(x, 2) for x in sorted(frontier)]
            start = graph.sparkSession.createDataFrame(rows, "node long, depth int")
            return bool(_wide_trace(graph, start, "effect", "cause", 2, None, ancestor).where(F.col("node") == ancestor).take(1))
        seen |= found
        frontier = found
    return False


def _peel(edges: list[tuple[int, int]]) -> dict[int, int] | None:
    """Level of every node of the edges (cause, effect); None if there is a cycle."""
    effects: dict[int, list[int]] = {}
    waiting: dict[int, int] = {}
    for c, e in edges:
        effects.setdefault(c, []).append(e)
        waiting[e] = waiting.get(e, 0) + 1
    front, level, out = [c for c in effects if c not in waiting], 0, {}
    while front:
        out |= dict.fromkeys(front, level)
        level, following = level + 1, []
        for c in front:
            for e in effects.get(c, ()):
                waiting[e] -= 1
                if not waiting[e]:
                    following.append(e)
        front = following
    return out if len(out) == len(effects.keys() | waiting.keys()) else None


def _ascends(graph: DataFrame) -> bool:
    """Whether every cause has a smaller id than its effect (of whole numbers), so that there can be no cycle."""
    whole = all(isinstance(graph.schema[c].dataType, (LongType, IntegerType)) for c in ("cause", "effect"))
    return whole and not graph.where(F.col("cause").isNull() | F.col("effect").isNull() | (F.col("cause") >= F.col("effect"))).take(1)


def check_acyclic(graph: DataFrame) -> None:
    """CycleError if there is a cycle. One runs through an edge whose ids do not ascend, and all of its nodes are ancestors of
    that edge's cause: only these are peeled, and nothing where all edges ascend."""
    if _ascends(graph):
        return
    inner = graph.select("cause", "effect")
    start = {r[0] for r in inner.where(F.col("cause") >= F.col("effect")).select("cause").distinct().limit(FRONTIER_LIMIT + 1).collect()}
    if len(start) <= FRONTIER_LIMIT:
        reached = walk(graph, start, "causes", None).select(F.col("node").alias("effect"))
        inner = inner.join(reached, "effect", "left_semi")
    ends = inner.select(F.col("cause").alias("node")).unionByName(inner.select(F.col("effect").alias("node")))
    topological_levels(inner, ends)


def _peel_block(batches):
    """node, level of the effects of one block, from the edges inside it (cause, effect) and what its effects have from
    elsewhere (effect, least). Fronts are peeled as whole arrays."""
    import numpy as np
    import pyarrow as pa

    batches = list(batches)
    if not batches:
        return
    table = pa.Table.from_batches(batches)
    cause, effect, least = (table.column(c).combine_chunks() for c in ("cause", "effect", "least"))
    inside = cause.is_valid().to_numpy(zero_copy_only=False)
    effect = effect.to_numpy(zero_copy_only=False)
    c = cause.drop_null().to_numpy(zero_copy_only=False)
    ids, at = np.unique(np.concatenate([c, effect]), return_inverse=True)
    c, e = at[: len(c)], at[len(c) :]
    level, is_effect = np.zeros(len(ids), "int64"), np.zeros(len(ids), bool)
    is_effect[e] = True
    level[e[~inside]] = least.to_numpy(zero_copy_only=False)[~inside]
    e = e[inside]
    order = np.argsort(c, kind="stable")
    c, e = c[order], e[order]
    first, waiting = np.searchsorted(c, np.arange(len(ids) + 1)), np.bincount(e, minlength=len(ids))
    front = np.flatnonzero(waiting == 0)
    while len(front):
        size = first[front + 1] - first[front]
        edge = np.repeat(first[front] - np.cumsum(size) + size, size) + np.arange(size.sum())
        to = e[edge]
        np.maximum.at(level, to, np.repeat(level[front], size) + 1)
        np.subtract.at(waiting, to, 1)
        front = np.unique(to[waiting[to] == 0])
    found = np.flatnonzero(is_effect)
    yield pa.RecordBatch.from_arrays([pa.array(ids[found]), pa.array(level[found].astype("int32"))], ["node", "level"])


def _levels_in_blocks(graph: DataFrame) -> DataFrame:
    """node, level of all effects of a graph whose ids ascend. Effects are cut into blocks of about BLOCK_EDGES edges, in order
    of their ids: the causes of a block lie in it or before it. Levels of those before it come by a join with the blocks that
    hold them, and one task peels what lies inside, so it never holds more than a block."""
    durable = bool(graph.sparkSession.sparkContext.getCheckpointDir())
    edge = graph.select(F.col("cause").cast("long"), F.col("effect").cast("long")).distinct().repartitionByRange("effect").sortWithinPartitions("effect").persist()
    blocks = -(-edge.count() // BLOCK_EDGES)
    cuts = edge.agg(F.percentile_approx("effect", [i / blocks for i in range(1, blocks)], 10_000)).first()[0] if blocks > 1 else []
    cuts = sorted(set(cuts))
    block = lambda c: sum([(F.col(c) > cut).cast("int") for cut in cuts], F.lit(0))
    needs: dict[int, set[int]] = {}
    for e, c in edge.select(block("effect").alias("e"), block("cause").alias("c")).distinct().collect():
        needs.setdefault(e, set()).add(c)
    parts: dict[int, DataFrame] = {}
    for b in sorted(needs):
        own = edge
        if b > 0:
            own = own.where(F.col("effect") > cuts[b - 1])
        if b < len(cuts):
            own = own.where(F.col("effect") <= cuts[b])
        inside = own if b == 0 else own.where(F.col("cause") > cuts[b - 1])
        rows = inside.select("cause", "effect", F.lit(None).cast("int").alias("least"))
        if b > 0:
            known = None
            for k in sorted(needs[b] - {b}):
                if k in parts:
                    known = parts[k] if known is None else known.unionByName(parts[k])
            before = own.where(F.col("cause") <= cuts[b - 1])
            at = before.join(known, before["cause"] == known["node"], "left") if known is not None else before.withColumn("level", F.lit(0))
            least = at.groupBy("effect").agg((F.max(F.coalesce("level", F.lit(0))) + 1).cast("int").alias("least"))
            rows = rows.unionByName(least.select(F.lit(None).cast("long").alias("cause"), "effect", "least"))
        made = rows.repartition(1).mapInArrow(_peel_block, "node long, level int").persist()
        parts[b] = made.checkpoint() if durable else made
        if durable:
            made.unpersist()
        else:
            made.count()
    edge.unpersist()
    out = None
    for part in parts.values():
        out = part if out is None else out.unionByName(part)
    return out


def topological_levels(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, level: longest path from a root, so every cause has a smaller level than its effects. nodes: node.

    A graph of FRONTIER_LIMIT edges or less is peeled by the driver. In a larger one whose ids ascend from cause to effect, as
    those of a log do, blocks of effects are peeled one after another (see `_levels_in_blocks`), so the cost does not grow with
    the depth. Of any other graph, roots are peeled off, level by level, by joins that read the remaining edges only, which are
    checkpointed each round (persisted, and released, where no checkpoint folder is set); edges that remain when nothing can
    be peeled are a cycle, and raise CycleError at once.
    """
    spark = graph.sparkSession
    few = graph.select("cause", "effect").distinct().limit(FRONTIER_LIMIT + 1).collect()
    if len(few) <= FRONTIER_LIMIT:
        levels = _peel([(r["cause"], r["effect"]) for r in few])
        if levels is None:
            raise CycleError("the graph has a cycle")
        found = spark.createDataFrame(list(levels.items()), "node long, level int")
        return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
    if _ascends(graph):
        found = _levels_in_blocks(graph)
        return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("level", F.lit(0)).alias("level"))
    durable, level = bool(spark.sparkContext.getCheckpointDir()), 0
    keep = lambda df: df.checkpoint() if durable else df.persist()
    left, rest = keep(nodes.select("node").distinct()), keep(graph.select("cause", "effect").distinct())
    out, held = None, []
    while not rest.isEmpty():
        roots = keep(left.join(rest.select(F.col("effect").alias("node")).distinct(), "node", "left_anti"))
        causes = rest.select("cause").distinct().join(rest.select(F.col("effect").alias("cause")).distinct(), "cause", "left_anti")
        later = keep(rest.join(causes, "cause", "left_anti"))
        if causes.isEmpty():
            raise CycleError("the graph has a cycle")
        out = roots.withColumn("level", F.lit(level)) if out is None else out.unionByName(roots.withColumn("level", F.lit(level)))
        held += [left, rest]
        left, rest, level = keep(left.join(roots, "node", "left_anti")), later, level + 1
    last = left.withColumn("level", F.lit(level))
    out = keep(last if out is None else out.unionByName(last))
    if not durable:
        out.count()
        for df in held:
            df.unpersist()
    return out


def topological_order(graph: DataFrame, nodes: DataFrame, span: int = 1_000_000) -> DataFrame:
    """node, level, place: an order from 0 in which every cause comes before its effects: by level, then by id. Nodes are
    numbered in ranges that follow the data; `span` is accepted and no longer needed."""
    return in_order(topological_levels(graph, nodes), ["level", "node"], "place")


def add_edges(graph: DataFrame, new: DataFrame) -> DataFrame:
    """The graph with new edges (cause, effect; repeated ones count once), or a CycleError that names none of them added.

    A new cycle runs through a new edge, so only what the new effects reach is examined.
    """
    both = graph.select("cause", "effect").unionByName(new.select("cause", "effect")).distinct()
    start = {r[0] for r in new.select("effect").distinct().limit(FRONTIER_LIMIT + 1).collect()}
    if len(start) > FRONTIER_LIMIT:
        raise ValueError(f"add the causes of {FRONTIER_LIMIT} events at most at a time")
    reached = walk(both, start, "effects", None)
    inner = both.join(reached.select(F.col("node").alias("cause")), "cause", "left_semi")
    topological_levels(inner, reached.select("node"))
    return both


def csr(graph: DataFrame, span: int = 1_000_000) -> DataFrame:
    """effect, causes (ascending), start: the rows of a compressed sparse matrix, and where each begins in the array of all
    causes in order of their effects. Offsets are summed within spans of effects and shifted by the spans' totals."""
    rows = graph.groupBy("effect").agg(F.array_sort(F.collect_set("cause")).alias("causes")).withColumn("_span", F.expr(f"effect div {span}"))
    totals = rows.groupBy("_span").agg(F.sum(F.size("causes")).alias("n"))
    ahead = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_span", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_first"))  # one row a span
    inside = Window.partitionBy("_span").orderBy("effect").rowsBetween(Window.unboundedPreceding, -1)
    own = rows.withColumn("_before", F.coalesce(F.sum(F.size("causes")).over(inside), F.lit(0))).join(starts, "_span")
    return own.select("effect", "causes", (F.col("_first") + F.col("_before")).alias("start"))


#: Fixed schema ids of the consumer's events.
KINDS = {"percept": 101, "intention": 102, "action": 103, "outcome": 104, "belief": 105, "gap": 106}
TRACE_DEPTH = 32


class LeakageError(ValueError):
    """Evidence that became known after the decision it supposedly led to."""


def action_trace(events: DataFrame, graph: DataFrame, action: int, kinds: dict[str, int] | None = None) -> DataFrame:
    """kind, sequence, ticks: what led to an action, what it led to, and a gap row for each missing required step.

    events: sequence, schema_id, valid_ticks, known_ticks. The action must exist and be one; evidence known later than the
    action raises LeakageError.
    """
    kinds = kinds or KINDS
    row = events.where((F.col("sequence") == action) & (F.col("schema_id") == kinds["action"])).select("known_ticks").first()
    if row is None:
        raise LookupError(f"no action {action}")
    known = row["known_ticks"]
    visited = trace(graph, action, "causes", TRACE_DEPTH)
    reached = events.join(visited, events["sequence"] == visited["node"])
    if reached.where((F.col("known_ticks") > known) & (F.col("sequence") != action)).take(1):
        raise LeakageError(f"evidence of action {action} is newer than the action")
    names = {v: k for k, v in kinds.items()}
    kind = F.lit(None).cast("string")
    for number in (kinds["percept"], kinds["intention"], kinds["belief"]):
        kind = F.when(F.col("schema_id") == number, names[number]).otherwise(kind)
    nodes = reached.where(F.col("sequence") != action).select(kind.alias("kind"), "sequence", F.col("valid_ticks").alias("ticks")).where("kind is not null")
    required = events.sparkSession.createDataFrame([("percept", "perception", max(0, known - 10)), ("intention", "intention selection", max(0, known - 2))], "kind string, step string, ticks long")
    gaps = required.join(nodes.select("kind").distinct(), "kind", "left_anti").select(F.concat(F.lit("gap: "), "step").alias("kind"), F.lit(None).cast("long").alias("sequence"), "ticks")
    own = events.sparkSession.createDataFrame([("action", action, known)], "kind string, sequence long, ticks long")
    outcomes = events.where(F.col("schema_id") == kinds["outcome"]).join(effects_of(graph, action), F.col("sequence") == F.col("effect"), "left_semi")
    outcomes = outcomes.select(F.lit("outcome").alias("kind"), "sequence", F.col("valid_ticks").alias("ticks"))
    return nodes.unionByName(gaps).unionByName(own).unionByName(outcomes)
