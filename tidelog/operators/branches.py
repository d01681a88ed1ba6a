"""Timelines: forks of the history, their intervals and their state.

Sequences are global: a child's first event has the number after its fork point, whatever branch it forks from, and a
child sees its ancestors only up to each fork.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.admit import assign_sequences

BRANCHES = "id long, name string, parent long, fork_sequence long, lifecycle string, created_at_ms long"
LIFECYCLES = ("active", "temporary", "candidate", "promoted", "retired")


class BranchError(ValueError):
    """A fork, append or lifecycle change that the branch table does not allow."""


def open_branches(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, "main", None, None, "active", 0)], BRANCHES)


def fork(branches: DataFrame, name: str, parent: int, sequence: int, parent_end: int, now_ms: int = 0) -> DataFrame:
    """A child of `parent` after `sequence`, which the parent's timeline must contain; events are not copied."""
    known = {r["id"]: r for r in branches.collect()}  # the branch table is a small control table
    if parent not in known:
        raise BranchError(f"no branch {parent}")
    if known[parent]["lifecycle"] == "retired":
        raise BranchError("the parent is retired")
    if not 0 <= sequence < parent_end:
        raise BranchError(f"the parent has no sequence {sequence}")
    return branches.unionByName(branches.sparkSession.createDataFrame([(max(known) + 1, name, parent, sequence, "active", now_ms)], BRANCHES))


def set_lifecycle(branches: DataFrame, branch: int, lifecycle: str) -> DataFrame:
    if lifecycle not in LIFECYCLES:
        raise BranchError(f"unknown lifecycle: {lifecycle}")
    return branches.withColumn("lifecycle", F.when(F.col("id") == branch, lifecycle).otherwise(F.col("lifecycle")))


def check_append(branches: DataFrame, branch: int) -> None:
    row = branches.where(F.col("id") == branch).first()
    if row is None or row["lifecycle"] == "retired":
        raise BranchError(f"branch {branch} takes no events")


def append(events: DataFrame, branches: DataFrame, branch: int, batch: DataFrame, order: str) -> DataFrame:
    """The events with a batch added to a branch, numbered from its next sequence: after its last own event, or after its
    fork. Rows of any number are numbered in one go, as batches of MAX_RECORDS that follow each other would be."""
    check_append(branches, branch)
    row = branches.where(F.col("id") == branch).first()
    last = events.where(F.col("branch") == branch).agg(F.max("sequence")).first()[0]
    start = -1 if row["fork_sequence"] is None else row["fork_sequence"]
    following = max(start, -1 if last is None else last) + 1
    own = assign_sequences(batch.drop("sequence", "branch"), following, order).withColumn("branch", F.lit(branch).cast("long"))
    return events.unionByName(own, allowMissingColumns=True)


def timeline(branches: DataFrame, branch: int, compat: bool = False) -> DataFrame:
    """branch, first, last (null: open) from the root to `branch`; empty intervals are dropped unless compat."""
    known = {r["id"]: r for r in branches.collect()}
    if branch not in known:
        raise BranchError(f"no branch {branch}")
    chain: list[tuple[int, int, int | None]] = []
    at, end = branch, None
    while at is not None:
        row = known[at]
        first = 0 if row["parent"] is None else row["fork_sequence"] + 1
        chain.append((at, first, end))
        cut = row["fork_sequence"]
        end = cut if compat or end is None or cut is None else min(end, cut)
        at = row["parent"]
    kept = [c for c in reversed(chain) if compat or c[2] is None or c[1] <= c[2]]
    return branches.sparkSession.createDataFrame(kept, "branch long, first long, last long")


def branch_events(events: DataFrame, line: DataFrame) -> DataFrame:
    """Events (with a `branch` column) that a timeline contains: a range join with its few intervals."""
    own = (F.col("branch") == F.col("_branch")) & (F.col("sequence") >= F.col("first")) & (F.col("last").isNull() | (F.col("sequence") <= F.col("last")))
    intervals = line.select(F.col("branch").alias("_branch"), "first", "last")  # one row for each ancestor
    return events.join(F.broadcast(intervals), own).drop("_branch", "first", "last")
