"""Groups of texts whose sets of word shingles are similar: SimHash links first, and an exact join for the rest.

Two texts link when the Jaccard similarity of their sets of distinct shingles is 4/5 or more, and groups are the connected
components of all links. Equal sets are one node, under a 128-bit hash of the set.

1. The sets' SimHash fingerprints go through the trie self-join; its links, and equal fingerprints, are candidates that the
   sets confirm. Most copies are in one group after this. A similarity of 0.8 leaves 10 of 64 bits different on average,
   which no trie can find without comparing nearly all pairs, so that fingerprints alone would lose such links.
2. Under any one order of all shingles, two similar sets share a shingle among the first n // 5 + 1 of each: texts that are
   in different groups still meet by these, and no link is lost. The order only decides the cost: shingles that a sample
   shows to be frequent come last.

Candidates must agree in size, then in a bitmap of the parities of their shingles' cells (sets that differ in d shingles
differ in at most d parities), and what remains is decided by the sets. Shingles that many nodes share first link their
nodes to a pivot; pairs of nodes that these links have joined already need no comparison, and all others are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import materialize
from tidelog.llm.graph import components
from tidelog.llm.shingles import shingle_set
from tidelog.llm.simhash import CONTRACT, links, majority
from tidelog.llm.tokens import small_batches

BATCH = 2 << 20
#: One text in SAMPLE is asked for frequent shingles, which have OFTEN texts there; at most LISTED are put last.
SAMPLE = 16
OFTEN = 4
LISTED = 200_000
#: Nodes of a shingle up to which all pairs are compared at once; rounds of pivots for the others.
FEW = 16
ROUNDS = 4


def prefix(own: np.ndarray, often: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The first n // 5 + 1 of a set by (times of the frequent ones, hash). often: ascending."""
    count = len(own) // 5 + 1
    if not len(often):
        return own[:count]
    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
    return own[np.lexsort((own, np.where(often[at] == own, times[at], 0)))[:count]]


def parities(own: np.ndarray) -> bytes:
    """A bit for each of 2 ** k cells, two for each shingle at least: whether it holds an odd number of them."""
    cells = max(64, 1 << (2 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """At most the number of shingles in one set only; the longer bitmap is folded to the cells of the shorter."""
    x, y = (np.frombuffer(v, np.uint8) for v in (a, b))
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that are frequent in a sample of the texts, ascending, and how often; only costs depend on them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH):
            for t in batch.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, words).view(np.int64))], ["h"])

    sample = texts.where(F.col("text_crc32") % SAMPLE == 0).dropDuplicates(["text_crc32"]).select("text").mapInArrow(run, "h long")
    counts = sample.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= OFTEN)
    found = counts.orderBy(F.desc("n"), "h").limit(LISTED).toArrow()
    often, times = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(often)
    return often[order], times[order]


def _signatures(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, text_crc32, key, n, fp, prefix, bits of every row."""
    often, times = _frequent(texts, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in small_batches(batches, "text", BATCH):
            sets = [shingle_set(t, words) for t in batch.column("text").to_pylist()]
            made = [
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([majority(s) for s in sets], pa.binary()),
                pa.array([prefix(s, often, times).view(np.int64) for s in sets], pa.list_(pa.int64())),
                pa.array([parities(s) for s in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_crc32"), *made], ["doc_id", "text_crc32", "key", "n", "fp", "prefix", "bits"])

    return texts.mapInArrow(run, "doc_id long, text_crc32 long, key binary, n long, fp binary, prefix array<long>, bits binary")


def _confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "n"))
            keep = [9 * parity_distance(x, y) <= m for x, y, m in zip(a, b, n, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH):
            own = [shingle_set(t, words).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(own, pa.list_(pa.int64()))], ["node", "own"])

    ends = nodes.select("node", "n", "bits")
    met = pairs.join(ends.toDF("a", "n_a", "bits_a"), "a").join(ends.toDF("b", "n_b", "bits_b"), "b")
    met = met.select("a", "b", "bits_a", "bits_b", (F.col("n_a") + F.col("n_b")).alias("n"))
    met = materialize(met.mapInArrow(near, "a long, b long"), "candidates")
    asked = met.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = materialize(nodes.join(asked, "node", "left_semi").select("node", "rep.*"), "asked").toDF("node", "rep_id", "rep_crc")
    named = texts.join(asked, (F.col("text_crc32") == F.col("rep_crc")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("node", "text")
    held = materialize(named.mapInArrow(sets, "node long, own array<long>").dropDuplicates(["node"]), "shingle-sets")
    both = met.join(held.toDF("a", "own_a"), "a").join(held.toDF("b", "own_b"), "b")
    return materialize(both.where(_SIMILAR).select("a", "b"), "links")


#: Jaccard similarity of 4/5 or more, in whole numbers: what the sizes allow, and what the sets say.
_SIZES = "5 * least(n, n_b) >= 4 * greatest(n, n_b)"
#: What the places allow: of the first shingle that two sets share, all others that they share come after it in both.
_PLACES = "9 * least(n - pos, n_b - pos_b) >= 4 * (n + n_b)"
_SIMILAR = "9 * size(array_intersect(own_a, own_b)) >= 4 * (size(own_a) + size(own_b))"


def _all_pairs(entries: DataFrame) -> DataFrame:
    """a, b: nodes of one shingle (h, node, n, pos, root) that are not in one group yet and may be similar if it is the first
    one that they share; a similar pair passes at that one. Texts that are mostly one common passage, each with a rest of
    its own, do not become pairs unless their rests are short enough."""
    other = entries.select("h", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("root").alias("root_b"))
    met = entries.join(other, "h").where((F.col("node") < F.col("b")) & (F.col("root") != F.col("root_b")) & F.expr(_SIZES) & F.expr(_PLACES))
    return met.select(F.col("node").alias("a"), "b").distinct()


def _pivot_pairs(entries: DataFrame, turn: int) -> DataFrame:
    """a, b: each node of a shingle and the shingle's pivot. First that is the node with the largest share of its prefix
    in common with others, as the origin of edited copies has; later, another one each time."""
    rank = F.col("share") if turn == 0 else F.xxhash64(F.lit(turn), "node").alias("share")
    order = F.struct(rank, "node", "n", "pos", "root")
    pivots = materialize(entries.groupBy("h").agg(F.max(order).alias("p")).select("h", F.col("p.node").alias("b"), F.col("p.n").alias("n_b"), F.col("p.pos").alias("pos_b"), F.col("p.root").alias("root_b")), "pivots")
    met = entries.join(pivots, "h").where((F.col("root") != F.col("root_b")) & F.expr(_SIZES) & F.expr(_PLACES))
    return met.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct()


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """a, b: candidates by fingerprint. The least node of each fingerprint with the others, and with that of each
    fingerprint that the trie join links to it."""
    hubs = materialize(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("h")).select("fp", F.col("h.node").alias("hub"), F.col("h.n").alias("n_b")), "hubs")
    same = nodes.join(hubs, "fp").where(F.col("node") != F.col("hub")).where(_SIZES).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    ends = hubs.select(F.col("fp").alias("b"), F.col("hub").alias("node"), F.col("n_b").alias("n"))
    near = links(hubs.select("fp"), CONTRACT).join(hubs.withColumnRenamed("fp", "a"), "a").join(ends, "b").where(_SIZES)
    return same.unionByName(near.select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))).distinct()


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """Entries with the `root` of their node."""
    return materialize(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")


def _joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the components after more edges. Only the groups that the edges join take part: each group is one node."""
    ends = roots.toDF("node", "top")
    for end in ("a", "b"):
        edges = edges.join(ends.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    more = materialize(components(edges.where("a <> b").select("a", "b")), "joined-groups")
    moved = roots.join(more.toDF("root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return materialize(moved.unionByName(more), "groups-so-far")


def _roots(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """node, root of every node that is not itself a root: the components of all links between nodes."""
    roots = components(_confirmed(_fingerprint_pairs(nodes), nodes, texts, words))
    entries = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    times = entries.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = materialize(entries.join(times, "h").select("h", "m", "node", "n", "pos"), "shared")
    few = _rooted(shared.where(F.col("m") <= FEW), roots)
    roots = _joined(roots, _confirmed(_all_pairs(few), nodes, texts, words))
    many = shared.where(F.col("m") > FEW)
    if many.isEmpty():
        return roots
    share = shared.groupBy("node").agg((F.count(F.lit(1)) / (F.expr("first(n) div 5") + 1)).alias("share"))
    many = materialize(many.join(share, "node").select("h", "node", "n", "pos", "share"), "many")
    for turn in range(ROUNDS + 1):
        now = _rooted(many, roots)
        apart = now.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y")
        apart = materialize(apart.select("h", "m"), "apart")
        pairs, rows = apart.agg(F.sum(F.col("m").cast("double") * F.col("m") / 2), F.sum("m")).first()
        if not rows:
            break
        last = turn == ROUNDS or pairs <= FEW * rows
        now = now.join(apart.select("h"), "h", "left_semi")
        roots = _joined(roots, _confirmed(_all_pairs(now) if last else _pivot_pairs(now, turn), nodes, texts, words))
        if last:
            break
    return roots


def similar_groups(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_crc32, component_id (smallest id of the group) of every row.

    Texts without words have the empty set, and link with each other alone; null ids count as larger than any id, and a
    group of null ids alone has a null component_id; repeated rows come out as often as they went in; an empty table
    gives an empty result; other columns are not read.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), crc.alias("text_crc32"), F.col(text_col).alias("text"))
    rows = materialize(_signatures(texts, words), "signatures")
    rep = F.min(F.struct("doc_id", "text_crc32")).alias("rep")
    nodes = rows.groupBy("key").agg(F.min("doc_id").alias("first"), rep, F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "distinct-sets")
    joined = nodes.join(_roots(nodes, texts, words), "node", "left").select("key", "first", F.coalesce("root", "node").alias("root"))
    joined = materialize(joined, "roots")
    groups = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(groups, "root").select("key", "component_id")
    return rows.select("doc_id", "text_crc32", "key").join(named, "key").select("doc_id", "text_crc32", "component_id")
