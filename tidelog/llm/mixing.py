"""Poisson replication towards target weights per source.

A source's mean repetition rate is its target share of the output bytes over its share of the input bytes. A document's
count is the inverse of the Poisson distribution function at a uniform number hashed from its id and the seed, so each
document is decided alone, on any worker, and again the same; it is then exploded into its copies, and copies are
shuffled globally by another hash. Counts of zero drop documents: that is the sampling itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import free, materialize, shuffle_partitions

SEED = 17
#: Share of a source in the output ~ (its input bytes) ** TEMPERATURE.
TEMPERATURE = 0.5
MAX_RATE = 4.0
LARGE_RATE = 500.0
#: Sources up to which their rates are sent to every task; more of them meet the documents in a shuffled join.
BROADCAST_SOURCES = 20_000
_SCALE = float(1 << 52)


def uniform(*parts: Column) -> Column:
    """52 bits of the parts' MD5, as a number in [0, 1)."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(_SCALE)


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE, max_rate: float = MAX_RATE) -> DataFrame:
    """source, rate: mean repetitions that move each source's bytes to its target share, the total kept.

    Sources are weighed by text bytes (null: none); a null source is a source of its own. No rate exceeds `max_rate`
    (small sources are not repeated endlessly): a source at the cap has its target there, and what it lacks goes to the
    others by their weights, until none of them exceeds the cap. One row for each source.
    """
    sizes = docs.groupBy(F.col(source_col).alias("_mix_source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")).alias("b"))
    sizes = materialize(sizes, "source-bytes")
    weight, held = F.pow("b", F.lit(temperature)), None
    w, t = sizes.agg(F.sum(weight), F.sum("b")).first()
    every, capped = t or 0, 0
    while w and t > 0:  # each round only adds sources to those at the cap
        over = weight / F.lit(w) * F.lit(t) / F.col("b") > max_rate
        n, b, free = sizes.where("b > 0").agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("b"))), F.sum(F.when(~over, weight))).first()
        if n == capped:
            break
        capped, w, t = n, free, every - max_rate * b
    if w and t > 0:
        held = F.least(F.lit(max_rate), weight / F.lit(w) * F.lit(t) / F.col("b"))
    rate = F.when(F.col("b") > 0, F.lit(max_rate) if held is None else held).otherwise(F.lit(1.0))
    return sizes.select("_mix_source", F.round(rate, 9).alias("_mix_rate"))


def distribution(rate: Column) -> Column:
    """The distribution function at 0, 1, 2 and so on, as far as a uniform number of 52 bits can reach; for rates up to
    LARGE_RATE."""
    steps = (rate + 12 * F.sqrt(rate) + 20).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    every = F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda acc: acc["c"])
    return F.filter(every, lambda c: c <= 1 - 1 / _SCALE)


def poisson_count(rate: Column, u: Column) -> Column:
    """Smallest n whose distribution function exceeds u, added up by logarithms, since exp(-rate) would vanish for large
    rates. Each rate bounds how far its function must be added up."""
    steps = (rate + 12 * F.sqrt(rate) + 20).cast("int")
    zero = F.struct((-rate).alias("l"), F.exp(-rate).alias("c"), F.lit(0).alias("n"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["l"] + F.coalesce(F.log(rate / k), F.lit(0.0))
        return F.struct(log.alias("l"), (acc["c"] + F.exp(log)).alias("c"), F.when(u >= acc["c"], k).otherwise(acc["n"]).cast("int").alias("n"))

    return F.aggregate(F.sequence(F.lit(1), steps), zero, step, lambda acc: acc["n"])


def replicate(docs: DataFrame, weights: DataFrame | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_rate: float = MAX_RATE) -> DataFrame:
    """All columns of `docs` for each copy, and `_mix_copy` (from 1), `_mix_copies`, `_mix_key` (order of the shuffle); these
    get more underscores where `docs` has such columns.

    weights: a table like that of `rates`, which is the default; a source that it lacks has rate 1. Rows with the same id
    get the same count and keys, repeated rows too, and lie beside each other; a null id counts as one more id. Null texts
    weigh nothing and are copied like others; an empty table gives an empty result.

    A source's distribution function is made once; a document looks its number up in it, beside the scan, since up to
    BROADCAST_SOURCES rates are sent to every task. Keys are uniform, so a key's partition is known without sampling: the
    result has spark.sql.shuffle.partitions of them, ascending by `_mix_key`, and each is sorted.
    """
    spark = docs.sparkSession
    weights = rates(docs, source_col, text_col, max_rate=max_rate) if weights is None else weights
    of, rate, steps, u, copies, copy, key = (free(docs, f"_mix_{n}") for n in ("of", "rate", "steps", "u", "copies", "copy", "key"))
    known = F.when(F.col("_mix_rate") <= LARGE_RATE, distribution(F.col("_mix_rate")))
    weights = materialize(weights.select(F.col("_mix_source").alias(of), F.col("_mix_rate").alias(rate), known.alias(steps)), "rates")
    if weights.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        weights = F.broadcast(weights)
    joined = docs.join(weights, F.col(source_col).eqNullSafe(F.col(of)), "left")
    joined = joined.withColumns({u: uniform(F.lit(seed), F.col(id_col)), steps: F.when(F.col(rate).isNull(), distribution(F.lit(1.0))).otherwise(F.col(steps))})
    looked_up = F.size(F.filter(F.col(steps), lambda c: c <= F.col(u)))
    counted = joined.withColumn(copies, F.when(F.col(steps).isNull(), poisson_count(F.col(rate), F.col(u))).otherwise(looked_up)).where(F.col(copies) > 0)
    every = counted.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    keyed = every.withColumn(key, uniform(F.lit(seed + 1), F.col(id_col), F.col(copy)))
    parts = shuffle_partitions(spark)
    out = keyed.select(*[docs[c] for c in docs.columns], copy, copies, key)
    return out.repartitionById(parts, F.floor(F.col(key) * parts).cast("int")).sortWithinPartitions(key)


ORACLE = f"""
WITH sizes AS (SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS b FROM documents GROUP BY source),
ranked AS (SELECT source, b, b ^ {TEMPERATURE} AS w, row_number() OVER (ORDER BY b, source) AS i, sum(b) OVER () AS total FROM sizes WHERE b > 0),
tails AS (SELECT *, coalesce(sum(b) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM ranked),
first AS (SELECT min(i) AS i FROM tails WHERE w / free * (total - {MAX_RATE} * before) / b <= {MAX_RATE}),
rates AS (SELECT s.source, CASE WHEN s.b = 0 THEN 1.0 WHEN f.i IS NULL OR r.i < f.i THEN {MAX_RATE} ELSE round(r.w / t.free * (t.total - {MAX_RATE} * t.before) / r.b, 9) END AS rate
  FROM sizes s CROSS JOIN first f LEFT JOIN ranked r ON r.source IS NOT DISTINCT FROM s.source LEFT JOIN tails t ON t.i = f.i),
steps AS (SELECT source, k, sum(exp(-rate) * rate ^ k / gamma(k + 1)) OVER (PARTITION BY source ORDER BY k) AS c FROM rates, range(0, {int(MAX_RATE + 12 * MAX_RATE**0.5 + 20)}) t(k)),
drawn AS (SELECT doc_id, source, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / {_SCALE} AS u FROM documents),
counted AS (SELECT d.doc_id, d.source, (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source AND s.c <= d.u) AS copies FROM drawn d)
SELECT doc_id, source, copies::INT AS copies, copy::INT AS copy,
  ('0x' || substr(md5('{SEED + 1}:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy), 1, 13))::BIGINT / {_SCALE} AS shuffle_key
FROM counted, range(1, copies + 1) t(copy)
"""
