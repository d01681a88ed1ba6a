"""K-d tree sharding: recursive weighted medians over document metadata, DataFrame functions only.

A document weighs its UTF-8 bytes plus 16. The tree splits the corpus along its widest metadata dimension (bytes,
characters, lines; each in units of its standard deviation) at a weighted quantile, until a leaf holds one shard's
share. All dimensions derive from the text, and ties are ordered by the text's CRC-32, so equal texts lie together.

No cut can balance what weighs a good part of a shard by itself. Groups of equal texts of over 1 / HEAVY of a shard (at
most HEAVY * shards of them, as their weights add up) are therefore given whole to the emptiest shards, heaviest first,
and the leaves of the tree take what is left to each shard's share. Only a group that outweighs a shard is torn, into runs of
as many of its rows as fill one.

Every dimension is first cut into bins of near-equal weight, from counts over all rows: floating-point-like classes of
the value (a power of two in 128 steps), each divided by its weight. A level of the tree is then one pass over a table of
numbers, in which Spark sums the bins and picks each node's cut; the driver sees two rows a node. Assigning a row needs
no shuffle: the finished tree is one CASE expression.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import free, materialize

HEAVY = 32
#: Bins of a dimension hold at most about 1 / BINS of the weight, unless one text does.
BINS = 8192
DIMS = ("_kd_bytes", "_kd_chars", "_kd_lines")
BIN = tuple(f"{d}_bin" for d in DIMS)
_MAX_VALUE = (1 << 31) - 1


@dataclass
class Node:
    """A node: its shards' share of the light weight, and, once split, the dimension and the first bin of the right side."""

    wants: list[float]
    first: int
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    dim: str = DIMS[0]
    cut: int = 0
    children: list[Node] = field(default_factory=list)

    def leaves(self) -> list[Node]:
        return [x for c in self.children for x in c.leaves()] if self.children else [self]

    def split(self) -> None:
        half = len(self.wants) // 2
        self.children = [Node(self.wants[:half], self.first), Node(self.wants[half:], self.first + half)]

    def column(self) -> Column:
        """The first shard of the leaf that a row falls into."""
        if not self.children:
            return F.lit(self.first)
        left, right = (c.column() for c in self.children)
        return F.when(F.col(f"{self.dim}_bin") < F.lit(self.cut), left).otherwise(right)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Metadata of each document; a null text counts as empty. _kd_row tells rows apart once the table is written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long")
    cap = lambda c: F.least(c.cast("long"), F.lit(_MAX_VALUE))
    return docs.select(
        F.col(id_col).alias("_kd_id"),
        F.monotonically_increasing_id().alias("_kd_row"),
        (size + 16).alias("_kd_size"),
        F.crc32(text.cast("binary")).alias("_kd_crc"),
        cap(size).alias("_kd_bytes"),
        cap(F.length(text)).alias("_kd_chars"),
        cap(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).alias("_kd_lines"),
    )


def value_class(dim: str) -> Column:
    """Values below 256 by themselves, larger ones by their exponent and seven more bits; larger values, larger classes."""
    return F.expr(f"256L * greatest(length(bin({dim})) - 8, 0) + shiftright({dim}, greatest(length(bin({dim})) - 8, 0))")


def _inside(dim: str) -> Column:
    """Where in its class a row lies, from 0 up to 1: by the value's other bits, then by the text's checksum."""
    shift = f"greatest(length(bin({dim})) - 8, 0)"
    rest = f"({dim} - shiftleft(shiftright({dim}, {shift}), {shift}))"
    return F.expr(f"({rest} * 4294967296D + _kd_crc) / (4294967296D * shiftleft(1L, {shift}))")


def _deal_heavy(heavy: list, total: int, shards: int) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """(crc, bytes, first, end, shard) of the heavy groups' rows, by their rank in the group, and the light weight that each
    shard should get. heavy: _kd_crc, _kd_bytes, w (weight) and n (rows) of each group."""
    share, items = total / shards, []
    for r in heavy:
        each = max(1, int(share * r["n"] / r["w"])) if r["w"] > share else r["n"]
        items += [(min(each, r["n"] - a) * r["w"] // r["n"], r["_kd_crc"], r["_kd_bytes"], a, min(a + each, r["n"])) for a in range(0, r["n"], each)]
    loads, given = [(0, i) for i in range(shards)], []
    for w, *run in sorted(items, key=lambda x: (-x[0], x[1:])):
        load, shard = heapq.heappop(loads)
        heapq.heappush(loads, (load + w, shard))
        given.append((*run, shard))
    own = {i: load for load, i in loads}
    light, level = total - sum(own.values()), 0.0
    filled = sorted(own.values())
    for n in range(1, shards + 1):  # the level that the light weight fills the emptiest shards to
        level = (light + sum(filled[:n])) / n
        if n == shards or level <= filled[n]:
            break
    return given, [max(0.0, level - own[i]) for i in range(shards)]


def _values(rows: list[tuple[int, ...]], names: str, spark) -> DataFrame:
    """A literal table of whole numbers."""
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"0L AS {n}" for n in names.split(", ")) + " WHERE false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(f"{x}L" for x in r) + ")" for r in rows) + f" AS t({names})")


def _binned(meta: DataFrame, total: int) -> DataFrame:
    """Adds the bin of each dimension. One row for each class that occurs (some thousands at most) is broadcast."""
    classes = meta.select("_kd_size", *[value_class(d).alias(f"{d}_class") for d in DIMS])
    light = classes.select("_kd_size", F.explode(F.array(*[F.struct(F.lit(k).alias("dim"), F.col(f"{d}_class").alias("class")) for k, d in enumerate(DIMS)])).alias("c"))
    weights = light.groupBy("c.dim", "c.class").agg(F.sum("_kd_size").alias("w"))
    weights = weights.withColumn("parts", F.ceil(F.col("w") * F.lit(2.0 * BINS / max(1, total))).cast("long"))
    before = Window.partitionBy("dim").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(weights.select("dim", "class", "parts", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("start")), "kd-classes")
    out = meta
    for k, d in enumerate(DIMS):
        own = starts.where(F.col("dim") == k).select(F.col("class").alias(f"{d}_class"), F.col("parts").alias(f"{d}_parts"), F.col("start").alias(f"{d}_start"))
        out = out.withColumn(f"{d}_class", value_class(d)).join(F.broadcast(own), f"{d}_class")
        place = F.least(F.floor(_inside(d) * F.col(f"{d}_parts")).cast("long"), F.col(f"{d}_parts") - 1)
        out = out.withColumn(f"{d}_bin", (F.col(f"{d}_start") + place).cast("int"))
    return out.drop(*[f"{d}_{x}" for d in DIMS for x in ("class", "parts", "start")])


def _by_leaf(nodes: list[Node], value, default) -> Column:
    """value(node) by the leaf's number, as a literal array."""
    known = {x.first: value(x) for x in nodes}
    return F.get(F.array(*[F.lit(known.get(i, default)) for i in range(max(known) + 1)]), F.col("leaf"))


def build_tree(light: DataFrame, wants: list[float], spread: dict[str, float]) -> Node:
    """Split `light` (binned) into one leaf for each of `wants`, in the proportion of these; one pass for each level."""
    root = Node(wants, 0)
    facts = [f(d).alias(f"{n}{d}") for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]

    def learn(node: Node, row) -> None:
        node.ranges = {d: (row[f"lo{d}"], row[f"hi{d}"]) for d in DIMS}
        node.dim = max(DIMS, key=lambda d: (node.ranges[d][1] - node.ranges[d][0]) / (spread[d] or 1))

    whole = light.agg(F.count(F.lit(1)).alias("n"), *facts).first()
    if whole["n"]:
        learn(root, whole)
    while nodes := [x for x in root.leaves() if len(x.wants) > 1]:
        open_ = [x for x in nodes if x.ranges and sum(x.wants) > 0]
        if open_:
            leaf, share = root.column(), lambda x: sum(x.wants[: len(x.wants) // 2]) / sum(x.wants)
            chosen = _by_leaf(open_, lambda x: DIMS.index(x.dim) + 1, 1)
            rows = light.select(leaf.alias("leaf"), "_kd_size", *DIMS, *BIN).where(F.col("leaf").isin([x.first for x in open_]))
            bins = rows.groupBy("leaf", F.element_at(F.array(*BIN), chosen).alias("bin")).agg(F.sum("_kd_size").alias("w"), *facts)
            up_to = Window.partitionBy("leaf").orderBy("bin")  # a node's bins: some thousands at any size of the input
            bins = bins.withColumns({"below": F.sum("w").over(up_to), "all": F.sum("w").over(Window.partitionBy("leaf"))})
            off = F.abs(F.col("below") - F.col("all") * _by_leaf(open_, share, 0.0))
            bins = bins.withColumn("off", off).withColumn("last", F.min_by("bin", F.struct("off", "bin")).over(Window.partitionBy("leaf")))
            bins = bins.withColumn("least", F.min("off").over(Window.partitionBy("leaf")))
            none = F.col("all") * _by_leaf(open_, share, 0.0) < F.col("least")  # nothing on the left is nearer than any cut
            sides = bins.groupBy("leaf", (none | (F.col("bin") > F.col("last"))).alias("right"))
            again = [f(n + d).alias(n + d) for d in DIMS for n, f in (("lo", F.min), ("hi", F.max))]
            found = {(r["leaf"], r["right"]): r for r in sides.agg(F.min("bin").alias("first"), F.max("bin").alias("end"), *again).collect()}
        for x in nodes:
            x.split()
            if x not in open_:
                continue
            left, right = found.get((x.first, False)), found.get((x.first, True))
            x.cut = left["end"] + 1 if left else right["first"]
            for child, row in zip(x.children, (left, right), strict=True):
                if row:
                    learn(child, row)
    return root


def _placed_heavy(meta: DataFrame, heavy: list, given: list[tuple[int, int, int, int, int]], per: int) -> DataFrame:
    """The rows of heavy groups with their shard. Rows of torn groups are ranked within hash buckets of about `per` rows."""
    group = ["_kd_crc", "_kd_bytes"]
    runs: dict[tuple[int, int], int] = {}
    for crc, size, *_ in given:
        runs[crc, size] = runs.get((crc, size), 0) + 1
    whole = _values([(c, b, s) for c, b, _, _, s in given if runs[c, b] == 1], "_kd_crc, _kd_bytes, shard", meta.sparkSession)
    out = meta.join(F.broadcast(whole), group)
    torn = [(c, b, x, y, s) for c, b, x, y, s in given if runs[c, b] > 1]
    if not torn:
        return out
    counts = [(r["_kd_crc"], r["_kd_bytes"], ceil(r["n"] / per)) for r in heavy if runs[r["_kd_crc"], r["_kd_bytes"]] > 1]
    own = meta.join(F.broadcast(_values(counts, "_kd_crc, _kd_bytes, _kd_buckets", meta.sparkSession)), group)
    own = own.withColumn("_kd_bucket", F.pmod(F.xxhash64("_kd_row"), F.col("_kd_buckets")))
    before = Window.partitionBy(*group).orderBy("_kd_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(*group, "_kd_bucket").agg(F.count(F.lit(1)).alias("k")).select(*group, "_kd_bucket", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("_kd_start"))
    inside = F.row_number().over(Window.partitionBy(*group, "_kd_bucket").orderBy("_kd_row")) - 1
    ranked = own.withColumn("_kd_rank", inside).join(F.broadcast(starts), [*group, "_kd_bucket"]).withColumn("_kd_rank", F.col("_kd_rank") + F.col("_kd_start"))
    ranges = _values(torn, "_kd_crc, _kd_bytes, _kd_first, _kd_end, shard", meta.sparkSession)
    ranked = ranked.join(F.broadcast(ranges), group).where("_kd_rank >= _kd_first and _kd_rank < _kd_end")
    return out.unionByName(ranked.select(*out.columns))


def kd_shards(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each document: id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Null ids and null texts are ordinary rows; repeated rows get slots of their own; an empty table gives an empty
    result. Other columns of `docs` are not looked at. Equal texts lie in one shard unless all of them together outweigh
    one. Slots are counted within hash buckets of about max(1000, sqrt(rows)) rows and shifted by the bucket's start, so no
    task sorts a whole shard, however often one id or row occurs.
    """
    spark = docs.sparkSession
    meta = materialize(measure(docs, id_col, text_col), "kd-meta")
    facts = meta.agg(F.sum("_kd_size").alias("w"), F.count(F.lit(1)).alias("n"), *[F.stddev_pop(d).alias(d) for d in DIMS]).first()
    total, rows = facts["w"] or 0, facts["n"]
    limit = total / (HEAVY * shards)
    heavy = meta.groupBy("_kd_crc", "_kd_bytes").agg(F.sum("_kd_size").alias("w"), F.count(F.lit(1)).alias("n")).where(F.col("w") > limit).collect()
    given, wants = _deal_heavy(heavy, total, shards)
    names = ["_kd_id", "_kd_row", "_kd_size", "_kd_crc"]
    light = meta
    if given:
        listed = _values([(r["_kd_crc"], r["_kd_bytes"]) for r in heavy], "_kd_crc, _kd_bytes", spark)  # HEAVY * shards rows at most
        light = meta.join(F.broadcast(listed), ["_kd_crc", "_kd_bytes"], "left_anti")
    light = materialize(_binned(light, int(sum(wants))), "kd-bins")
    tree = build_tree(light, wants, {d: facts[d] for d in DIMS})
    per = max(1000, isqrt(rows))
    placed = light.select(*names, tree.column().alias("shard"))
    if given:
        placed = placed.unionByName(_placed_heavy(meta, heavy, given, per).select(*names, "shard"))
    placed = placed.withColumn("shard", F.col("shard").cast("int"))
    placed = placed.withColumn("_kd_bucket", F.pmod(F.xxhash64("_kd_row"), F.lit(max(1, ceil(rows / shards / per)))))
    sizes = placed.groupBy("shard", "_kd_bucket").agg(F.count(F.lit(1)).alias("_kd_n"))
    before = Window.partitionBy("shard").orderBy("_kd_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_kd_bucket", F.coalesce(F.sum("_kd_n").over(before), F.lit(0)).alias("_kd_start"))
    inside = Window.partitionBy("shard", "_kd_bucket").orderBy("_kd_row")
    ranked = placed.withColumn("_kd_rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), ["shard", "_kd_bucket"]).select(
        F.col("_kd_id").alias(id_col),
        F.col("_kd_size").alias("size"),
        F.col("_kd_crc").alias("text_crc32"),
        F.col("shard"),
        (F.col("_kd_start") + F.col("_kd_rank")).cast("long").alias("slot"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write whole documents as one folder of Parquet files per shard (`_shard`, or that with more underscores if `docs` has
    such a column), all columns kept. Of a torn group, all rows of one id and text go to the first of their shards."""
    own, of_id, of_crc, folder = (free(docs, n) for n in ("_kd_own", "_kd_of", "_kd_sum", "_shard"))
    placed = kd_shards(docs, shards, id_col, text_col).groupBy(F.col(id_col).alias(of_id), F.col("text_crc32").alias(of_crc)).agg(F.min("shard").alias(folder))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    joined = docs.withColumn(own, crc).join(placed, (F.col(own) == F.col(of_crc)) & F.col(id_col).eqNullSafe(F.col(of_id)))
    joined.select(*docs.columns, folder).write.partitionBy(folder).parquet(path)
