"""SimHash near-duplicates by a binary trie self-join.

A fingerprint bit is 1 when it is set in over half of a document's shingle hashes. Fingerprints that differ in at most
`budget` bits link, and documents are grouped by the connected components of these links.

The trie is never built as pointers: its nodes are ranges of the sorted fingerprints. Pairs of nodes are taken down
level by level together, adding up the bits in which they differ, and a pair is dropped as soon as the sum exceeds the
budget. To spread the join, every fingerprint enters one trie for each rotation of its bits, under the subtrie of the
rotation's first bits; budget + 1 rotations by disjoint blocks find every link, since one block of a linking pair must be
equal. Equal fingerprints are one entry, so groups of copies cost nothing here.

Pairs of nodes with over CAP fingerprints are not left to one task: both nodes are cut at their next STEP bits, and each
pair of children within the budget is a pair of its own, dealt anew, until all are small. That is the same descent, done
by the cluster instead of within a task, so no size changes what is found.

`keep_one` drops near-duplicates: links of fingerprints come first, and the shingle sets decide (see setjoin).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import free, materialize
from tidelog.llm.graph import components
from tidelog.llm.shingles import shingle_hashes
from tidelog.llm.tokens import small_batches

CAP = 2048
STEP = 4
LEAF_PAIRS = 64
CHUNK = 1 << 16
BATCH = 2 << 20


@dataclass(frozen=True)
class Spec:
    """words: shingle length; budget: differing bits (of 64) that still link; tables: (first bit, width) of the block that
    must be equal, for each rotation: budget + 1 disjoint blocks; cap: fingerprints that a task joins by itself."""

    words: int
    budget: int
    tables: tuple[tuple[int, int], ...]
    cap: int = CAP


#: 64-bit fingerprints of 3-word shingles, links at 2 bits.
CONTRACT = Spec(3, 2, ((0, 22), (22, 21), (43, 21)))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many values have each of the 64 bits set, highest bit first."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), CHUNK):
        bits = np.unpackbits(h[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        full = len(bits) // 255 * 255
        total += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[full:].sum(axis=0, dtype=np.int64)
    return total


def majority(h: np.ndarray) -> bytes:
    """The fingerprint of shingle hashes, big-endian; all zero without any."""
    return np.packbits(2 * _bit_counts(h) > len(h)).tobytes()


def fingerprint(text: str | None, words: int) -> bytes:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, spec: Spec, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_crc32, fp of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH):
            texts = batch.column("text").to_pylist()
            crc = [zlib.crc32((t or "").encode()) for t in texts]
            fps = [fingerprint(t, spec.words) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(crc, pa.int64()), pa.array(fps, pa.binary())], ["doc_id", "text_crc32", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, text_crc32 long, fp binary")


def _words(fps: pa.Array) -> np.ndarray:
    """Fingerprints as unsigned words."""
    return np.frombuffer(b"".join(fps.to_pylist()), dtype=">u8").astype(np.uint64)


def _rotated(words: np.ndarray, first: int) -> np.ndarray:
    """The bits from `first` on, then those before."""
    return (words << np.uint64(first)) | (words >> np.uint64(64 - first)) if first else words


def _join_all(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union-find over arrays: hooks larger roots under smaller ones until all pairs agree."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def trie_join(words: np.ndarray, u: np.ndarray, v: np.ndarray, err: np.ndarray, depth: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as pairs of rows, of the links within pairs of nodes.

    words: fingerprints, ascending within each node; u, v: the nodes' (first, end) rows, equal or u before v; a node's rows
    share `depth` bits, and those of u and v differ in `err` of them.
    """
    n, bits = len(words), 64
    root = np.arange(n)
    forest: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    while len(u):
        pairs = (u[:, 1] - u[:, 0]) * (v[:, 1] - v[:, 0])
        small = (pairs <= LEAF_PAIRS) | (depth >= bits)
        _verify(words, root, u[small], v[small], budget, forest)
        u, v, err = u[~small], v[~small], err[~small]
        if not len(u):
            break
        least, most = (f.reduceat(np.append(root, n), u.ravel())[::2] for f in (np.minimum, np.maximum))
        other_least, other_most = (f.reduceat(np.append(root, n), v.ravel())[::2] for f in (np.minimum, np.maximum))
        open_ = ~((least == most) & (other_least == least) & (other_most == least))
        u, v, err = u[open_], v[open_], err[open_]
        ones = np.concatenate([[0], np.cumsum(words >> np.uint64(63 - depth) & np.uint64(1), dtype=np.int64)])
        mid_u, mid_v = (x[:, 1] - (ones[x[:, 1]] - ones[x[:, 0]]) for x in (u, v))
        u0, u1 = np.stack([u[:, 0], mid_u], 1), np.stack([mid_u, u[:, 1]], 1)
        v0, v1 = np.stack([v[:, 0], mid_v], 1), np.stack([mid_v, v[:, 1]], 1)
        other = u[:, 0] != v[:, 0]
        u, v = np.concatenate([u0, u1, u0, u1[other]]), np.concatenate([v0, v1, v1, v0[other]])
        err = np.concatenate([err, err, err + 1, err[other] + 1])
        alive = (err <= budget) & (u[:, 0] < u[:, 1]) & (v[:, 0] < v[:, 1]) & ~((u[:, 0] == v[:, 0]) & (u[:, 1] - u[:, 0] < 2))
        u, v, err = u[alive], v[alive], err[alive]
        depth += 1
    return np.concatenate([a for a, _ in forest]), np.concatenate([b for _, b in forest])


def _verify(words: np.ndarray, root: np.ndarray, u: np.ndarray, v: np.ndarray, budget: int, forest: list) -> None:
    """Compare the fingerprints under small node pairs and join those within the budget, nearest first (Boruvka)."""
    step = CHUNK // LEAF_PAIRS * 4
    for at in range(0, len(u), step):
        a, b = u[at : at + step], v[at : at + step]
        width = b[:, 1] - b[:, 0]
        count = (a[:, 1] - a[:, 0]) * width
        which = np.repeat(np.arange(len(a)), count)
        k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        i, j = a[which, 0] + k // width[which], b[which, 0] + k % width[which]
        keep = i < j
        keep[keep] = root[i[keep]] != root[j[keep]]
        i, j = i[keep], j[keep]
        far = np.bitwise_count(words[i] ^ words[j]).astype(np.int64)
        near = far <= budget
        i, j, far = i[near], j[near], far[near]
        while len(i):
            _, ends = np.unique(np.concatenate([root[i], root[j]]), return_inverse=True)
            best = np.full(int(ends.max()) + 1, 1 << 62)
            np.minimum.at(best, ends, np.tile((far << 32) + np.arange(len(i)), 2))
            picked = np.unique(best & (1 << 32) - 1)
            forest.append((i[picked], j[picked]))
            _join_all(root, i[picked], j[picked])
            apart = root[i] != root[j]
            i, j, far = i[apart], j[apart], far[apart]


PAIRS = "key binary, side int, err int, fp binary"
_BOTH, _LEFT, _RIGHT = 0, 1, 2


def _entries(nodes: DataFrame, spec: Spec) -> DataFrame:
    """Each fingerprint once for each rotation, under the subtrie of the bits that lead it.

    key: rotation and leading bits, 8 bytes, then the chunks of the pair's two nodes, a byte for each STEP bits below;
    side: of the pair whose node the fingerprint is under; err: bits in which the two nodes' paths differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, none = _words(batch.column("fp")), pa.array(np.zeros(batch.num_rows, np.int32))
            for t, (first, width) in enumerate(spec.tables):
                lead = (_rotated(words, first) >> np.uint64(64 - width)) | np.uint64(t << 48)
                raw = lead.astype(">u8").tobytes()
                keys = [raw[a : a + 8] for a in range(0, len(raw), 8)]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), none, none, batch.column("fp")], ["key", "side", "err", "fp"])

    return nodes.select("fp").mapInArrow(run, PAIRS)


def _children(pairs: DataFrame, spec: Spec, depth: int) -> DataFrame:
    """Pairs of nodes cut at their next STEP bits: the fingerprints under every pair of children within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = np.arange(1 << STEP)
        for batch in batches:
            keys, side, err = batch.column("key").to_pylist(), batch.column("side").to_numpy(), batch.column("err").to_numpy()
            words, table = _words(batch.column("fp")), np.array([k[1] for k in keys])
            own = np.zeros(len(words), np.int64)
            for t, (first, width) in enumerate(spec.tables):
                at = np.uint64(64 - width - depth - STEP)
                own = np.where(table == t, (_rotated(words, first) >> at & np.uint64((1 << STEP) - 1)).astype(np.int64), own)
            for other in chunks:
                far = err + np.bitwise_count(own ^ other).astype(np.int32)
                rows = np.flatnonzero(far <= spec.budget)
                a, b, s = own[rows], np.full(len(rows), other), side[rows]
                turn = np.where(s == _BOTH, a > b, s == _RIGHT)
                a, b = np.where(turn, b, a), np.where(turn, a, b)
                new = np.where(s == _BOTH, np.where(own[rows] == other, _BOTH, np.where(turn, _RIGHT, _LEFT)), s)
                longer = [keys[r] + bytes([c]) for r, c in zip(rows.tolist(), (a << STEP | b).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(longer, pa.binary()), pa.array(new.astype(np.int32)), pa.array(far[rows].astype(np.int32)), batch.column("fp").take(pa.array(rows))], ["key", "side", "err", "fp"])

    return pairs.mapInArrow(run, PAIRS)


def _joined_pairs(pairs: DataFrame, spec: Spec, depth: int) -> DataFrame:
    """a, b: a spanning forest of the links within each pair of nodes, whose paths are `depth` bits below the subtries'."""

    def linked(table: pa.Table, groups: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps, keys = table.column("fp").combine_chunks(), table.column("key").to_pylist()
        words, which = _words(fps), np.array([k[1] for k in keys])
        side, err = table.column("side").to_numpy(), table.column("err").to_numpy()
        for t in np.unique(which).tolist():
            rows = np.flatnonzero(which == t)
            turned = _rotated(words[rows], spec.tables[t][0])
            order = np.lexsort((turned, side[rows], groups[rows]))
            rows, turned = rows[order], turned[order]
            g, s = groups[rows], side[rows]
            first = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])))
            node = np.stack([first, np.append(first[1:], len(rows))], 1)
            alone = (s[first] == _BOTH) & (node[:, 1] - node[:, 0] > 1)
            left = np.flatnonzero((s[first[:-1]] == _LEFT) & (s[first[1:]] == _RIGHT) & (g[first[:-1]] == g[first[1:]]))
            u, v = np.concatenate([node[alone], node[left]]), np.concatenate([node[alone], node[left + 1]])
            i, j = trie_join(turned, u, v, err[rows[u[:, 0]]].astype(np.int64), spec.tables[t][1] + depth, spec.budget)
            if len(i):
                yield pa.RecordBatch.from_arrays([fps.take(pa.array(rows[i])), fps.take(pa.array(rows[j]))], ["a", "b"])

    def numbered(table: pa.Table) -> np.ndarray:
        keys = np.frombuffer(b"".join(table.column("key").to_pylist()), np.uint8).reshape(table.num_rows, -1)
        return np.cumsum(np.append(False, (keys[1:] != keys[:-1]).any(axis=1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK:
                table = pa.Table.from_batches(held)
                groups = numbered(table)
                last = int(np.searchsorted(groups, groups[-1]))  # its pair may go on in the next batch
                if last:
                    yield from linked(table.slice(0, last), groups[:last])
                held = table.slice(last).combine_chunks().to_batches()
                n = table.num_rows - last
        if n:
            table = pa.Table.from_batches(held)
            yield from linked(table, numbered(table))

    return pairs.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a binary, b binary")


def links(nodes: DataFrame, spec: Spec) -> DataFrame:
    """a, b: edges with the same components as all links between the distinct fingerprints of `nodes` (fp).

    Each round joins the pairs that are small and cuts the others; fingerprints are distinct, so that pairs at the last
    bits are small, and there are as many rounds as the largest subtrie's overlong paths, one as a rule.
    """
    if len(spec.tables) <= spec.budget or sum(w for _, w in spec.tables) > 64:
        raise ValueError("links need one more disjoint block than bits of budget")
    pairs, depth, found = _entries(nodes, spec), 0, []
    deepest = 64 - max(w for _, w in spec.tables) - STEP
    while True:
        sizes = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
        sizes = materialize(sizes.where((F.col("n") > spec.cap) & ((F.col("low") == _BOTH) | (F.col("low") < F.col("high")))).select("key"), "large-pairs")
        if depth > deepest or sizes.isEmpty():
            found.append(_joined_pairs(pairs, spec, depth))
            return reduce(DataFrame.unionByName, found)
        found.append(materialize(_joined_pairs(pairs.join(sizes, "key", "left_anti"), spec, depth), "links"))
        pairs = materialize(_children(pairs.join(sizes, "key", "left_semi"), spec, depth), "node-pairs")
        depth += STEP


def near_duplicates(docs: DataFrame, spec: Spec = CONTRACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_crc32, fp, component_id (smallest id of the group) of every row.

    Null and empty texts have the zero fingerprint and link like any other; null ids count as larger than any id, and a
    group of null ids alone has a null component_id; repeated rows come out as often as they went in; an empty table
    gives an empty result; other columns are not read. Documents meet their group by fingerprint, in a join that Spark
    may split where a fingerprint is hot; everything before sees distinct fingerprints only.
    """
    fps = materialize(fingerprints(docs, spec, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(nodes, spec))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    joined = materialize(joined, "roots")
    groups = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(groups, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "text_crc32", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` (all columns) without near-duplicates: of each group the row with the smallest id stays.

    Rows link when the Jaccard similarity of their sets of `words`-word shingles is 0.8 or more, and only then. Texts that
    are null, empty or without words have the empty set and are one group. Of repeated rows (same id and text) one stays.
    Rows without an id stay unless a row with an id is in their group. An empty table gives an empty result.
    """
    from tidelog.llm.setjoin import similar_groups

    own_id, own_crc, of = free(docs, "sim_id"), free(docs, "sim_crc"), free(docs, "sim_of")
    found = materialize(similar_groups(docs, words, id_col, text_col), "groups")
    times = found.groupBy("doc_id", "text_crc32", "component_id").agg(F.count(F.lit(1)).alias("times"))
    first = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = times.where(~first).select(F.col("doc_id").alias(own_id), F.col("text_crc32").alias(own_crc))
    again = times.where(first & (F.col("times") > 1)).select(F.col("doc_id").alias(own_id), F.col("text_crc32").alias(own_crc))
    marked = docs.withColumn(of, F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    same = (F.col(of) == F.col(own_crc)) & F.col(id_col).eqNullSafe(F.col(own_id))
    kept = marked.join(gone, same, "left_anti")
    again = materialize(again, "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(again, same, "left_anti")
    return once.unionByName(kept.join(again, same, "left_semi").dropDuplicates([id_col, of])).select(*docs.columns)
