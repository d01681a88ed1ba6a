"""Admission of event batches: set-based checks before an append."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.spans import free_name, in_order

#: Fixed limits of a batch.
MAX_RECORDS, MAX_PAYLOAD, MAX_CAUSES = 65_536, 1 << 20, 64


class AdmissionError(ValueError):
    """The batch as a whole is rejected."""


def regressions(events: DataFrame, span: int = 1_000_000) -> DataFrame:
    """sequence, previous_ticks, known_ticks where known time goes back, within each known clock.

    The log is compared in spans of sequence numbers, each in one task; the seams between spans are compared over one row
    a span, so no task orders the whole log.
    """
    keyed = events.select("known_clock", "sequence", "known_ticks", F.expr(f"sequence div {span}").alias("span"))
    inside = Window.partitionBy("known_clock", "span").orderBy("sequence")
    within = keyed.withColumn("previous_ticks", F.lag("known_ticks").over(inside)).where("previous_ticks > known_ticks")
    edge = keyed.groupBy("known_clock", "span").agg(F.min_by("known_ticks", "sequence").alias("known_ticks"), F.min("sequence").alias("sequence"), F.max_by("known_ticks", "sequence").alias("end_ticks"))
    seams = edge.withColumn("previous_ticks", F.lag("end_ticks").over(Window.partitionBy("known_clock").orderBy("span"))).where("previous_ticks > known_ticks")
    return within.select("sequence", "previous_ticks", "known_ticks").unionByName(seams.select("sequence", "previous_ticks", "known_ticks"))


def late_evidence(events: DataFrame) -> DataFrame:
    """Events known after they were valid; these are legal."""
    return events.where((F.col("valid_clock") == F.col("known_clock")) & (F.col("valid_ticks") < F.col("known_ticks")))


def is_contiguous(events: DataFrame) -> DataFrame:
    """source, epoch, first, last, records, contiguous."""
    out = events.groupBy("source", "epoch").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("records"), F.count_distinct("sequence").alias("distinct"))
    return out.withColumn("contiguous", (F.col("last") - F.col("first") + 1 == F.col("records")) & (F.col("distinct") == F.col("records"))).drop("distinct")


def violations(batch: DataFrame) -> DataFrame:
    """sequence, reason of rows that no batch may hold: oversize payloads, too many causes, causes that do not precede.

    Payloads are measured where they are made or read, so that no row takes its payload along."""
    own = batch.select("sequence", "source", "epoch", F.octet_length("payload").alias("_bytes"), "causes")
    not_before = F.exists("causes", lambda c: (c["source"] == F.col("source")) & (c["epoch"] == F.col("epoch")) & (c["sequence"] >= F.col("sequence")))
    reason = (
        F.when(F.col("_bytes") > MAX_PAYLOAD, "payload too large")
        .when(F.size("causes") > MAX_CAUSES, "too many causes")
        .when(not_before, "cause does not precede")
    )
    return own.select("sequence", reason.alias("reason")).where("reason is not null")


def admit(batch: DataFrame, next_sequence: int, last_known: tuple[int, int] | None, max_records: int = MAX_RECORDS) -> DataFrame:
    """The batch, if every check passes; otherwise an AdmissionError and nothing is written.

    last_known: clock and ticks of the log's last event; a batch must stay on that clock and not go back.
    """
    facts = batch.agg(
        F.count(F.lit(1)).alias("n"), F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count_distinct("sequence").alias("distinct"),
        F.count_distinct("source", "epoch").alias("logs"), F.count_distinct("known_clock").alias("clocks"), F.min("known_clock").alias("clock"), F.min_by("known_ticks", "sequence").alias("start"),
    ).first()
    if not facts["n"]:
        raise AdmissionError("empty batch")
    if facts["n"] > max_records:
        raise AdmissionError(f"more than {max_records} records")
    if facts["logs"] > 1:
        raise AdmissionError("more than one source or epoch")
    if facts["first"] != next_sequence or facts["last"] - facts["first"] + 1 != facts["n"] or facts["distinct"] != facts["n"]:
        raise AdmissionError(f"sequences must follow from {next_sequence} without a gap")
    if facts["clocks"] > 1 or (last_known and facts["clock"] != last_known[0]):
        raise AdmissionError("known clock changed")
    if (last_known and facts["start"] < last_known[1]) or regressions(batch).take(1):
        raise AdmissionError("known time goes back")
    if bad := violations(batch).take(1):
        raise AdmissionError(f"{bad[0]['reason']} at {bad[0]['sequence']}")
    return batch


def assign_sequences(batch: DataFrame, next_sequence: int, order: str) -> DataFrame:
    """Number rows from `next_sequence` in the order of a column, whether they make one batch or many that follow each other."""
    at = free_name(batch, "_place")
    return in_order(batch, order, at).withColumn("sequence", F.col(at) + F.lit(next_sequence).cast("long")).drop(at)
