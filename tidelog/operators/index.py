"""Block summaries, data skipping, and posting-list projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions.morton import chunk, encode2, in_box
from tidelog.model import EntityId, TimeRange
from tidelog.operators.scan import HistoryFilter

BLOOM_BITS, BLOOM_HASHES = 512, 4


def _schema_bit() -> Column:
    return F.when(F.col("schema_id") < 64, F.expr("shiftleft(1L, cast(schema_id as int))")).otherwise(F.lit(0).cast("long"))


def _bloom_positions(shard: Column, slot: Column, generation: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), shard, slot, generation), F.lit(BLOOM_BITS)) for i in range(BLOOM_HASHES)]


def block_summaries(events: DataFrame, block: Column, bloom: bool = False) -> DataFrame:
    """One row for each block: count, ranges of sequence, entity and times, clocks, a 64-bit schema mask and, if wanted, a
    512-bit Bloom filter of entities as the set of its bits."""
    entity = F.struct("shard", "slot", "generation")
    aggs = [
        F.count(F.lit(1)).alias("records"),
        F.min("sequence").alias("first"), F.max("sequence").alias("last"),
        F.min("valid_ticks").alias("valid_min"), F.max("valid_ticks").alias("valid_max"),
        F.min("known_ticks").alias("known_min"), F.max("known_ticks").alias("known_max"),
        F.min("valid_clock").alias("valid_clock_min"), F.max("valid_clock").alias("valid_clock_max"),
        F.min("known_clock").alias("known_clock_min"), F.max("known_clock").alias("known_clock_max"),
        F.min(entity).alias("entity_min"), F.max(entity).alias("entity_max"),
        F.bit_or(_schema_bit()).alias("schema_mask"),
    ]
    own = events.withColumn("block", block)
    if not bloom:
        return own.groupBy("block").agg(*aggs)
    bits = own.select("block", F.explode(F.array(*_bloom_positions(F.col("shard"), F.col("slot"), F.col("generation")))).alias("bit")).distinct()
    return own.groupBy("block").agg(*aggs).join(bits.groupBy("block").agg(F.collect_set("bit").alias("bloom")), "block")


def segment_summaries(blocks: DataFrame, segment: Column) -> DataFrame:
    """Blocks rolled up into segments: every range, clock, mask and, if the blocks have them, Bloom filter, so that
    `must_scan` applies to segments as it does to blocks."""
    own = blocks.withColumn("segment", segment)
    out = own.groupBy("segment").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum("records").alias("records"), F.min("first").alias("first"), F.max("last").alias("last"),
        *[f(f"{axis}_{n}").alias(f"{axis}_{n}") for axis in ("valid", "known", "valid_clock", "known_clock", "entity") for n, f in (("min", F.min), ("max", F.max))],
        F.bit_or("schema_mask").alias("schema_mask"),
    )
    if "bloom" not in blocks.columns:
        return out
    blooms = own.select("segment", F.explode("bloom").alias("bit")).groupBy("segment").agg(F.collect_set("bit").alias("bloom"))
    return out.join(blooms, "segment")


def must_scan(flt: HistoryFilter, blooms: bool = False) -> Column:
    """Whether a block may hold a match: false only if its summary rules one out. Blocks of several clocks are never
    skipped by time, observed time never skips, and Bloom filters have no false negatives."""
    out = F.lit(True)
    if flt.entity is not None:
        e = F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip(("shard", "slot", "generation"), (flt.entity.shard, flt.entity.slot, flt.entity.generation), strict=True)])
        out &= (e >= F.col("entity_min")) & (e <= F.col("entity_max"))
        if blooms:
            for p in _bloom_positions(*[F.lit(v).cast("long") for v in (flt.entity.shard, flt.entity.slot, flt.entity.generation)]):
                out &= F.array_contains("bloom", p)
    if flt.known_as_of is not None:
        one = (F.col("known_clock_min") == flt.clock) & (F.col("known_clock_max") == flt.clock)
        out &= ~one | (F.col("known_min") <= flt.known_as_of)
    if flt.range is not None and flt.axis in ("valid", "known"):
        low, high = f"{flt.axis}_min", f"{flt.axis}_max"
        one = (F.col(f"{flt.axis}_clock_min") == flt.range.clock) & (F.col(f"{flt.axis}_clock_max") == flt.range.clock)
        out &= ~one | ((F.col(high) >= flt.range.start) & (F.col(low) < flt.range.end))
    return out


def pruned_history(events: DataFrame, block: Column, summaries: DataFrame, flt: HistoryFilter) -> DataFrame:
    """Matching events of the blocks that must be scanned; equal to a full scan. With `block` as the partition column the
    semi-join becomes dynamic partition pruning."""
    kept = summaries.where(must_scan(flt, "bloom" in summaries.columns)).select("block")
    return events.withColumn("block", block).join(kept, "block", "left_semi").where(flt.column()).drop("block")


#: Sequences that one row of a posting list covers, so that a key's share of a long log never is one row.
LIST_SPAN = 1 << 17


def _lists(events: DataFrame, span: int, *keys: Column | str) -> DataFrame:
    return events.groupBy(*keys, F.expr(f"sequence div {span}").alias("span")).agg(F.array_sort(F.collect_list("sequence")).alias("sequences"))


def by_entity(events: DataFrame, span: int = LIST_SPAN) -> DataFrame:
    """entity, span, sequences (ascending): the posting lists of entities, one row for each span of sequences."""
    return _lists(events, span, "shard", "slot", "generation")


def by_schema(events: DataFrame, span: int = LIST_SPAN) -> DataFrame:
    """schema_id, span, sequences."""
    return _lists(events, span, "schema_id")


def by_chunk(events: DataFrame, x: str, y: str, size: int, span: int = LIST_SPAN) -> DataFrame:
    """chunk_code, span, sequences: the posting lists of a chunked plane, in Z order when sorted by code."""
    return _lists(events, span, chunk_code(F.col(x), F.col(y), size).alias("chunk_code"))


def at_times(events: DataFrame, clock: int, start: int, end: int) -> DataFrame:
    """Sequences with valid time in an inclusive range."""
    return events.where((F.col("valid_clock") == clock) & F.col("valid_ticks").between(start, end)).select("sequence")


def chunk_code(x: Column, y: Column, size: int) -> Column:
    return encode2(chunk(x, size), chunk(y, size))


def in_chunks(events: DataFrame, axes: tuple[str, ...], low: tuple[int, ...], high: tuple[int, ...], size: int) -> DataFrame:
    """Events of every chunk that a box touches: a superset of the box. Equal to the box's code intervals over a stored
    code column (see spatial_frame), and cheaper where only the coordinates are stored."""
    return events.where(in_box([chunk(F.col(a), size) for a in axes], [v // size for v in low], [v // size for v in high]))


def intersect(events: DataFrame, entity: EntityId | None = None, schema: int | None = None, times: TimeRange | None = None, box: tuple[tuple[int, int], tuple[int, int]] | None = None, size: int = 16, x: str = "x", y: str = "y") -> DataFrame:
    """Sequences that every given projection contains; none given: no sequence. Projections meet as one conjunction, so
    the lists are never built. `times` is inclusive at both ends."""
    if entity is None and schema is None and times is None and box is None:
        return events.select("sequence").limit(0)
    out = events
    if entity is not None:
        out = out.where(entity.column())
    if schema is not None:
        out = out.where(F.col("schema_id") == schema)
    if times is not None:
        out = out.where((F.col("valid_clock") == times.clock) & F.col("valid_ticks").between(times.start, times.end))
    if box is not None:
        out = in_chunks(out, (x, y), *box, size)
    return out.select("sequence").distinct()
