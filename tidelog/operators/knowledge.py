"""Beliefs: contradictions, inference, retraction, provenance, predictions, calibration and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.operators.causal import FRONTIER_LIMIT, walk
from tidelog.operators.spans import SPAN, free_name, in_order, nth_smallest

#: Fixed antonyms; matched as substrings, so "inactive" also holds "active".
ANTONYMS = (("true", "false"), ("alive", "dead"), ("active", "inactive"), ("healthy", "critical"), ("open", "closed"))


def normal(proposition: Column) -> Column:
    return F.lower(F.trim(proposition))


def checked_confidence(confidence: Column) -> Column:
    """The confidence itself; a row outside [0, 1], or not a number, fails the query."""
    bad = confidence.isNull() | F.isnan(confidence) | (confidence < 0) | (confidence > 1)
    return F.when(bad, F.raise_error(F.concat(F.lit("confidence out of range: "), F.coalesce(confidence.cast("string"), F.lit("null")))).cast("double")).otherwise(confidence)


def record(items: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New observations, claims or rules appended with the next ids, in the order of a column."""
    last, at = items.agg(F.max("id")).first()[0], free_name(new, "_place")
    numbered = in_order(new, order, at).withColumn("id", F.col(at) + F.lit(1 if last is None else last + 1).cast("long"))
    return items.unionByName(numbered.select(*items.columns))


def contradicts(a: Column, b: Column) -> Column:
    """Two normalised propositions: one negates the other, or they hold the two sides of an antonym."""
    out = (b == F.concat(F.lit("not "), a)) | (a == F.concat(F.lit("not "), b))
    for x, y in ANTONYMS:
        out |= (a.contains(x) & b.contains(y)) | (a.contains(y) & b.contains(x))
    return out


#: Beliefs that ask for a tag, or hold it, and meet in one group of a join.
GROUP = 2_048


def contradictions(beliefs: DataFrame) -> DataFrame:
    """item_a < item_b: every contradicting pair of beliefs (id, proposition).

    Pairs are never formed blindly: negations meet by equality of the proposition, and antonyms by the words they hold, so
    a pair is only compared if it contradicts. (Contradicting pairs themselves are the output and may be many.) Of the tags
    by which a pair meets, only the first in order makes it, so no pairs are held to find repeated ones. Those who ask for a
    tag are dealt into groups of about GROUP, and those who hold it too, and each group meets each, so a common tag is the
    work of many tasks.
    """
    rows = _tagged(beliefs).distinct()
    asks, holds = rows.where("asks").select(F.col("id").alias("a"), "tag"), rows.where("not asks").select(F.col("id").alias("b"), "tag")
    sizes = rows.groupBy("tag").agg(F.count(F.when(F.col("asks"), 1)).alias("n_a"), F.count(F.when(~F.col("asks"), 1)).alias("n_b")).where("n_a > 0 and n_b > 0")
    groups = lambda n: F.ceil(F.col(n) / GROUP).cast("int")
    sizes = sizes.select("tag", groups("n_a").alias("g_a"), groups("n_b").alias("g_b"))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bit = F.lit(0).cast("long")
    for i, word in enumerate(sorted({w for pair in ANTONYMS for w in pair})):
        bit = F.when(F.col("tag") == f"#{word}", F.lit(1 << i).cast("long")).otherwise(bit)
    of = lambda test: [F.bit_or(F.when(test, bit).otherwise(F.lit(0).cast("long"))), F.collect_set(F.when(test & (bit == 0), F.col("tag")))]
    facts = [c.alias(n) for c, n in zip([*of(F.col("asks")), *of(~F.col("asks"))], ("asked", "asked_word", "held", "held_word"), strict=True)]
    marks = rows.groupBy("id").agg(*facts)  # antonyms as bits; whole propositions by name, one an id where ids differ
    mark = lambda c: marks.select(F.col("id").alias(c), *[F.col(n).alias(f"{n}_{c}") for n in ("asked", "asked_word", "held", "held_word")])
    kept = lambda c: [f"{n}_{c}" for n in ("asked", "asked_word", "held", "held_word")]
    left = asks.join(sizes, "tag").join(mark("a"), "a").select("a", "tag", bit.alias("bit"), *kept("a"), own("a", "g_a").alias("x"), every("g_b").alias("y"))
    right = holds.join(sizes, "tag").join(mark("b"), "b").select("b", "tag", *kept("b"), own("b", "g_b").alias("y"), every("g_a").alias("x"))
    pairs = left.join(right, ["tag", "x", "y"]).where("a <> b")
    back = F.col("asked_b").bitwiseAND(F.col("held_a"))
    common = F.col("asked_a").bitwiseAND(F.col("held_b")).bitwiseOR(back)
    by_bit = (common.bitwiseAND(-common) == F.col("bit")) & ((F.col("a") < F.col("b")) | (back.bitwiseAND(F.col("bit")) == 0))
    words = F.array_intersect("asked_word_b", "held_word_a")
    by_word = (common == 0) & (F.col("tag") == F.array_min(F.concat(F.array_intersect("asked_word_a", "held_word_b"), words))) & ((F.col("a") < F.col("b")) | ~F.array_contains(words, F.col("tag")))
    once = F.when(F.col("bit") != 0, by_bit).otherwise(by_word)
    return pairs.where(once).select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))


def _tagged(beliefs: DataFrame) -> DataFrame:
    """id, tag, asks: two beliefs contradict each other if one asks for a tag that the other holds."""
    own = beliefs.select("id", normal(F.col("proposition")).alias("p"))
    tags = F.concat(F.array(F.concat(F.lit("="), F.col("p"))), F.array_compact(F.array(*[F.when(F.col("p").contains(w), F.lit(f"#{w}")) for w in sorted({w for pair in ANTONYMS for w in pair})])))
    asks = F.concat(F.array(F.concat(F.lit("=not "), F.col("p"))), F.array_compact(F.array(*[F.when(F.col("p").contains(x), F.lit(f"#{y}")) for x, y in ANTONYMS])))
    return own.select("id", F.explode(tags).alias("tag"), F.lit(False).alias("asks")).unionByName(own.select("id", F.explode(asks).alias("tag"), F.lit(True).alias("asks")))


def challengers(beliefs: DataFrame, span: int = SPAN) -> DataFrame:
    """id, by: the first later belief that contradicts each belief that has one.

    No pair is formed: for each tag, ids are looked through in spans, and a span's first asker and holder serve all spans
    before it. A tag that every belief holds costs as many rows as there are beliefs.
    """
    rows = _tagged(beliefs).withColumn("span", F.expr(f"id div {span}"))
    rows = rows.withColumns({"asker": F.when(F.col("asks"), F.col("id")), "holder": F.when(~F.col("asks"), F.col("id"))})
    later = Window.partitionBy("tag", "span").orderBy(F.col("id").desc()).rangeBetween(Window.unboundedPreceding, -1)
    beyond = Window.partitionBy("tag").orderBy(F.col("span").desc()).rowsBetween(Window.unboundedPreceding, -1)
    firsts = rows.groupBy("tag", "span").agg(F.min("asker").alias("asker"), F.min("holder").alias("holder"))
    firsts = firsts.select("tag", "span", F.min("asker").over(beyond).alias("next_asker"), F.min("holder").over(beyond).alias("next_holder"))
    seen = rows.select("id", "tag", "span", "asks", F.min("asker").over(later).alias("asker"), F.min("holder").over(later).alias("holder")).join(firsts, ["tag", "span"])
    by = F.when(F.col("asks"), F.coalesce("holder", "next_holder")).otherwise(F.coalesce("asker", "next_asker"))
    return seen.groupBy("id").agg(F.min(by).alias("by")).where("by is not null")


def infer(beliefs: DataFrame, conflicts: DataFrame | None = None) -> DataFrame:
    """Adds status after inferring all beliefs in order of their ids, each against those active by then.

    A belief stays active until the first later one that conflicts with it (its challenger); a new belief starts
    contradicted exactly if it is the challenger of one that started active. Challengers form a forest. A node with a
    child that began active is settled, and one whose children all began contradicted; a node that waits for one child
    only began as the opposite of that child, and such chains are followed by doubling, so rounds grow with the logarithm
    of the forest's depth. Beliefs without conflicts take no part. conflicts: (item_a < item_b), else contradictions.
    """
    if conflicts is None:
        challenger = challengers(beliefs)
    else:
        challenger = conflicts.groupBy("item_a").agg(F.min("item_b").alias("by")).withColumnRenamed("item_a", "id")
    durable = bool(beliefs.sparkSession.sparkContext.getCheckpointDir())
    keep = lambda df: df.checkpoint() if durable else df.persist()
    challenger = keep(challenger)
    nodes = challenger.select("id").unionByName(challenger.select(F.col("by").alias("id"))).distinct().join(challenger, "id", "left")
    none = F.lit(None)
    state = keep(nodes.withColumns({"began": none.cast("boolean"), "of": none.cast("long"), "flip": none.cast("boolean")}))
    while not state.where("began is null").isEmpty():
        open_ = F.col("began").isNull()
        kids = state.where("by is not null").groupBy(F.col("by").alias("id")).agg(F.max("began").alias("any"), F.sum(open_.cast("int")).alias("open"), F.min(F.when(open_, F.col("id"))).alias("only"))
        state = state.join(kids, "id", "left")
        settled = F.when(F.coalesce("any", F.lit(False)), F.lit(False)).when(F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        chain = F.col("of").isNull() & (F.col("open") == 1)
        state = keep(state.select("id", "by", F.coalesce("began", settled).alias("began"), F.when(chain, F.col("only")).otherwise(F.col("of")).alias("of"), F.when(chain, F.lit(True)).otherwise(F.col("flip")).alias("flip")))
        ends = state.select(F.col("id").alias("of"), F.col("began").alias("end_began"), F.col("of").alias("end_of"), F.col("flip").alias("end_flip"))
        turn = lambda c: F.when(F.col("flip"), ~c).otherwise(c)
        on = F.col("end_of").isNotNull()
        joined = state.join(ends, "of", "left")
        state = keep(joined.select("id", "by", F.coalesce("began", turn(F.col("end_began"))).alias("began"), F.when(on, F.col("end_of")).otherwise(F.col("of")).alias("of"), F.when(on, turn(F.col("end_flip"))).otherwise(F.col("flip")).alias("flip")))
    lost = state.where(~F.col("began") | F.col("by").isNotNull()).select("id", F.lit(True).alias("_hit"))
    return beliefs.join(lost, "id", "left").withColumn("status", F.when(F.col("_hit"), "contradicted").otherwise("active")).drop("_hit")


def dependents(premises: DataFrame) -> DataFrame:
    """cause, effect: a retracted premise reaches every belief that rests on it (premises: id, premise)."""
    return premises.select(F.col("premise").alias("cause"), F.col("id").alias("effect"))


def retract(beliefs: DataFrame, premises: DataFrame, ids: DataFrame) -> DataFrame:
    """Beliefs with status retracted for `ids` (node) and everything that transitively rests on them."""
    links = dependents(premises).persist()
    start = {r[0] for r in ids.select("node").distinct().limit(FRONTIER_LIMIT + 1).collect()}
    if len(start) > FRONTIER_LIMIT:
        raise ValueError(f"retract at most {FRONTIER_LIMIT} beliefs at a time")
    gone = walk(links, start, "effects", None)
    links.unpersist()
    return beliefs.join(gone.withColumn("_gone", F.lit(True)), beliefs["id"] == gone["node"], "left").withColumn("status", F.when(F.col("_gone"), "retracted").otherwise(F.col("status"))).drop("_gone", "node", "depth")


def why(beliefs: DataFrame, premises: DataFrame, target: int) -> DataFrame:
    """node, parent, depth, path: the provenance tree of a belief, however deep; a shared premise occurs on each path to it.

    Only premises that are beliefs are followed, and a path never repeats a node. Each level is checkpointed where a
    folder is set for that.
    """
    root = beliefs.where(F.col("id") == target).select(F.col("id").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    if root.isEmpty():
        raise LookupError(f"no belief {target}")
    known = premises.join(beliefs.select(F.col("id").alias("premise")), "premise", "left_semi")
    durable, d, out, level = bool(beliefs.sparkSession.sparkContext.getCheckpointDir()), 0, root, root
    while True:
        d += 1
        level = level.join(known, level["node"] == known["id"]).where(~F.array_contains("path", F.col("premise")))
        level = level.select(F.col("premise").alias("node"), F.col("node").alias("parent"), F.lit(d).alias("depth"), F.concat("path", F.array("premise")).alias("path"))
        level = level.checkpoint() if durable else level.persist()
        if level.isEmpty():
            return out
        out = out.unionByName(level)


def active_as_of(beliefs: DataFrame, cutoff: int) -> DataFrame:
    """Beliefs that are active now and were learned by the cutoff (ticks of any clock)."""
    return beliefs.where((F.col("status") == "active") & (F.col("learned_ticks") <= cutoff))


def resolve(predictions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Predictions with outcome matched, refuted or pending (outcomes: id, observed_value, observed_ticks)."""
    joined = predictions.join(outcomes, "id", "left")
    same = F.lower("predicted_value") == F.lower(F.trim("observed_value"))
    return joined.withColumn("outcome", F.when(F.col("observed_ticks").isNull(), "pending").when(same, "matched").otherwise("refuted"))


def brier(predictions: DataFrame, cutoff: int) -> DataFrame:
    """resolved, brier: mean squared error of the confidences of predictions emitted and observed by the cutoff; null if
    there are none (which callers report as an error)."""
    own = predictions.where((F.col("outcome") != "pending") & (F.col("emitted_ticks") <= cutoff) & (F.col("observed_ticks") <= cutoff))
    hit = F.when(F.col("outcome") == "matched", 1.0).otherwise(0.0)
    return own.agg(F.count(F.lit(1)).alias("resolved"), F.avg((F.col("confidence") - hit) ** 2).alias("brier"))


def evict(items: DataFrame, most: int) -> DataFrame:
    """Adds tier: of the active items (id, accesses) the least used, then lowest ids, above `most` go to the archive.

    The last one to go is found by counts, so nothing is sorted."""
    total = items.count()
    if total <= most:
        return items.withColumn("tier", F.lit("active"))
    used, below = nth_smallest(items, "accesses", total - most)
    last, _ = nth_smallest(items.where(F.col("accesses") == used), "id", total - most - below)
    out = (F.col("accesses") < used) | ((F.col("accesses") == used) & (F.col("id") <= last))
    return items.withColumn("tier", F.when(out, "archive").otherwise("active"))


def consolidate(observations: DataFrame, label: str, signature: str, pattern: int) -> tuple[DataFrame, DataFrame]:
    """An episode's observations (id) in the reference tier, and the new pattern with one occurrence."""
    spark = observations.sparkSession
    return observations.withColumn("tier", F.lit("reference")), spark.createDataFrame([(pattern, signature, 1, label)], "id long, signature string, occurrences long, concept string")
