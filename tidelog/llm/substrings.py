"""Substring deduplication by relative Lempel-Ziv parsing against an indexed reference.

The reference is every document. A document is parsed into factors: a factor copies a run of WINDOW words or more from a
document with a smaller id, and says from where. The parse is greedy: a factor begins at the first word from which WINDOW
words stand in the reference, and goes on as long as its reference does. At its end the windows across the boundary are
looked up as well, so that a copy from elsewhere that begins inside the factor is found, and shorter agreements are no
factors. Together the factors cover exactly the windows that start in a document with a smaller id; where several earlier
documents hold a passage, which of them a factor names may depend on how documents were dealt to tasks.

The index is cut into blocks that need not meet in one task:

1. Each window of 13 words is anchored at its least hashed 5-word group (leftmost of equals). Equal windows have equal
   anchors, and one word in five or so is an anchor; anchors are looked up first (`shared_anchors`).
2. A block holds the words around the anchors of a hash range that more than one document has, as 96-bit hashes of the
   windows at each. There every occurrence of an anchor is matched with the least document that has the same window, and
   the match is extended over the windows that follow while the reference goes on (`block_factors`).
3. At a document's home partition the pieces that go on from each other, anchor by anchor, become whole factors.

Before either lookup a task settles what its own documents tell and sends each distinct anchor or window once, so a
passage that a third of all documents share is as many rows as there are tasks. Lookups travel as packed columns, one blob
from a task to a partition; a partition's blobs are held as arrays, so there are as many partitions as the texts have
PART_BYTES (spark.sql.shuffle.partitions at least). A document's home partition follows from its id: what was found out
about its text is sent there, ahead of the text itself. What goes between the steps is written to the shared folder.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidelog.llm.common import free, free_shuffles, materialize, shuffle_partitions
from tidelog.llm.tokens import small_batches

WINDOW = 13
ANCHOR = 5
BATCH = 2 << 20
#: Anchors or windows that a task settles together.
HELD = 1 << 18
#: Bytes of text to a partition of the lookups.
PART_BYTES = 16 << 20
_ODD = np.random.default_rng(20240607).integers(1, 1 << 63, size=(2, 64), dtype=np.uint64) | np.uint64(1)


class Words:
    """The words of a batch of texts: two 64-bit hashes each, and each text's first word."""

    def __init__(self, texts: list[str | None]) -> None:
        import xxhash

        lists = pc.ascii_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        flat = lists.flatten()
        real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end gives empty words
        coded = flat.filter(pa.array(real)).dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in coded.dictionary.cast(pa.large_binary()).to_pylist())
        pool = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        which = coded.indices.to_numpy(zero_copy_only=False)
        self.high, self.low = pool[which, 0], pool[which, 1]
        kept = np.concatenate([[0], np.cumsum(real)])
        self.first = kept[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        self.owner = np.repeat(np.arange(len(texts)), np.diff(self.first))

    @staticmethod
    def groups(hashes: np.ndarray, n: int, row: int = 0) -> np.ndarray:
        """A hash of each n consecutive words."""
        size = max(0, len(hashes) - n + 1)
        total = np.zeros(size, np.uint64)
        for k in range(n):
            total += hashes[k : k + size] * _ODD[row, k]
        total = (total ^ (total >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        return total ^ (total >> np.uint64(29))

    def windows(self, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the windows that lie within one text, the anchor of each, and the hashes of all word groups."""
        grams = self.groups(self.high, anchor)
        size = max(0, len(self.high) - window + 1)
        starts = np.flatnonzero(self.owner[:size] == self.owner[window - 1 : window - 1 + size])
        span = window - anchor + 1
        least, at = grams[:size].copy(), np.zeros(size, np.int64)
        for k in range(1, span):
            less = grams[k : k + size] < least
            np.copyto(least, grams[k : k + size], where=less)
            at[less] = k
        return starts, starts + at[starts], grams


def _pack(*columns: np.ndarray) -> bytes:
    """Integer columns in one blob: unsigned 64- and 32-bit ones (hashes) as they are, others less their minimum in as few
    bytes as the rest needs."""
    out = [struct.pack("<I", len(columns[0]))]
    for c in columns:
        if c.dtype in (np.uint64, np.uint32):
            out += [struct.pack("<Bq", 0x80 | c.itemsize, 0), c.tobytes()]
            continue
        base = int(c.min()) if len(c) else 0
        rest = c.astype(np.int64) - base
        width = next(w for w in (1, 2, 4, 8) if not len(c) or int(rest.max()) < 1 << 8 * w)
        out += [struct.pack("<Bq", width, base), rest.astype(f"<u{width}").tobytes()]
    return b"".join(out)


def _unpack(blob: bytes) -> list[np.ndarray]:
    (n,), at, out = struct.unpack_from("<I", blob), 4, []
    while at < len(blob):
        code, base = struct.unpack_from("<Bq", blob, at)
        width = code & 0x7F
        raw = np.frombuffer(blob, f"<u{width}", n, at + 9)
        out.append(raw if code & 0x80 else raw.astype(np.int64) + base)
        at += 9 + n * width
    return out


def _joined(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)]


BLOBS = "_sub_bucket int, _sub_kind int, _sub_blob binary"
_LOOKUP, _SETTLED = 0, 1


def _sliced(places: np.ndarray, kind: int, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows dealt to partitions: one blob for each partition number in `places` (ascending)."""
    if not len(places):
        return
    starts = np.append(np.flatnonzero(np.append(True, places[1:] != places[:-1])), len(places)).tolist()
    blobs = [_pack(*(c[a:b] for c in columns)) for a, b in zip(starts, starts[1:], strict=False)]
    yield pa.RecordBatch.from_arrays([pa.array(places[starts[:-1]], pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["_sub_bucket", "_sub_kind", "_sub_blob"])


def _place(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The partition of a hash; ascending hashes have ascending partitions."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _home(parts: int) -> Column:
    """The partition of a document: by its id, or by its text's checksum where it has none."""
    return F.pmod(F.coalesce("_sub_id", "_sub_crc"), F.lit(parts).cast("long")).cast("int")


def _parts(docs: DataFrame, text_col: str) -> int:
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-size // PART_BYTES))


def anchor_blobs(docs: DataFrame, window: int, anchor: int, parts: int) -> DataFrame:
    """What a task cannot settle by itself about the anchors of its documents.

    To look up: every distinct anchor once, with the home partition of its document if only one has it here. Settled:
    anchors that two documents of the task have, for each of these documents' homes.
    """

    def settle(anchors: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((ids, anchors))
        anchors, ids = anchors[order], ids[order]
        fresh = np.append(True, (anchors[1:] != anchors[:-1]) | (ids[1:] != ids[:-1]))
        anchors, homes = anchors[fresh], np.mod(ids[fresh], parts)
        distinct, first, count = np.unique(anchors, return_index=True, return_counts=True)
        yield from _sliced(_place(distinct, parts), _LOOKUP, distinct, homes[first], (count == 1).astype(np.int64))
        shared = np.repeat(count > 1, count)
        pairs = np.unique(np.stack([homes[shared].astype(np.uint64), anchors[shared]], 1), axis=0)
        yield from _sliced(pairs[:, 0].astype(np.int64), _SETTLED, pairs[:, 1].copy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in small_batches(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist())
            _, at, grams = words.windows(window, anchor)
            at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at  # anchors never go back
            held.append((grams[at], batch.column("_sub_id").to_numpy()[words.owner[at]]))
            n += len(at)
            if n >= HELD:
                yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held, n = [], 0
        if n:
            yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.where("_sub_id is not null").select("_sub_id", "text").mapInArrow(run, BLOBS)


def shared_anchors(blobs: DataFrame) -> DataFrame:
    """For each home, the anchors of its documents that another document has too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = pc.equal(batch.column("_sub_kind"), _SETTLED)
            yield batch.filter(settled)
            held += batch.filter(pc.invert(settled)).column("_sub_blob").to_pylist()
        if held:
            anchors, homes, alone = _joined(held)
            order = np.argsort(anchors, kind="stable")
            anchors, homes, alone = anchors[order], homes[order], alone[order]
            again = anchors[1:] == anchors[:-1]
            hit = (np.append(again, False) | np.append(False, again)) & (alone == 1)
            anchors, homes = anchors[hit], homes[hit]
            order = np.argsort(homes, kind="stable")
            yield from _sliced(homes[order], _SETTLED, anchors[order])

    return blobs.mapInArrow(run, BLOBS)


def _extended(ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray, of: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matched windows, each with the document (`of`) and place (`at`) of its reference, as pieces of factors: texts, first
    starts, numbers of windows, references. A piece goes on while both the text and the reference do."""
    order = np.lexsort((starts, crcs, ids))
    ids, crcs, starts, of, at = (c[order] for c in (ids, crcs, starts, of, at))
    on = (ids[1:] == ids[:-1]) & (crcs[1:] == crcs[:-1]) & (starts[1:] == starts[:-1] + 1) & (of[1:] == of[:-1]) & (at[1:] == at[:-1] + 1)
    first = np.flatnonzero(np.append(True, ~on))
    return ids[first], crcs[first], starts[first], np.diff(np.append(first, len(starts))), of[first], at[first]


def _settled(ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray, of: np.ndarray, at: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    if not len(ids):
        return
    pieces = _extended(ids, crcs, starts.astype(np.int64), of, at.astype(np.int64))
    homes = np.mod(pieces[0], parts)
    order = np.argsort(homes, kind="stable")
    yield from _sliced(homes[order], _SETTLED, *(c[order] for c in pieces))


def _matched(high: np.ndarray, low: np.ndarray, ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that groups equal windows, for each row in it the row of its reference (of the least id, text and start that
    has the window), and whether the reference is another document's with a smaller id."""
    order = np.lexsort((starts, crcs, ids, low, high))
    high, low, sorted_ids = high[order], low[order], ids[order]
    fresh = np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1]))
    reference = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return order, order[reference], sorted_ids > sorted_ids[reference]


def window_blobs(docs: DataFrame, window: int, anchor: int, parts: int) -> DataFrame:
    """What a task cannot settle about the windows at shared anchors. docs: a home's blobs first, then its texts.

    Settled: windows that the task also sees under a smaller id, as pieces of factors. To look up, in the block of their
    anchor: the windows of the least id here.
    """

    def settle(high: np.ndarray, low: np.ndarray, ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray, blocks: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, reference, later = _matched(high, low, ids, crcs, starts)
        gone, of = order[later], reference[later]
        yield from _settled(ids[gone], crcs[gone], starts[gone], ids[of], starts[of], parts)
        kept = order[~later]
        kept = kept[np.argsort(blocks[kept], kind="stable")]
        yield from _sliced(blocks[kept], _LOOKUP, high[kept], low[kept], ids[kept], crcs[kept], starts[kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, wanted, held, n = [], None, [], 0
        for batch in batches:
            listed = batch.column("_sub_blob").is_valid()
            blobs += batch.filter(listed).column("_sub_blob").to_pylist()
            for part in small_batches(iter([batch.filter(pc.invert(listed))]), "text", BATCH):
                if wanted is None:
                    wanted = np.unique(_joined(blobs)[0]) if blobs else np.zeros(0, np.uint64)
                if not len(wanted):
                    continue
                words = Words(part.column("text").to_pylist())
                starts, at, grams = words.windows(window, anchor)
                found = np.minimum(np.searchsorted(wanted, grams[at]), len(wanted) - 1)
                hit = wanted[found] == grams[at]
                starts, blocks = starts[hit], _place(grams[at[hit]], parts)
                own = words.owner[starts]
                ids, crcs = (part.column(c).to_numpy()[own] for c in ("_sub_id", "_sub_crc"))
                low = words.groups(words.low, window, 1)[starts].astype(np.uint32)
                held.append((words.groups(words.high, window)[starts], low, ids, crcs, starts - words.first[own], blocks))
                n += len(starts)
                if n >= HELD:
                    yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield from settle(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return docs.mapInArrow(run, BLOBS)


def block_factors(blobs: DataFrame, parts: int) -> DataFrame:
    """For each home, the pieces of its texts' factors that lie at the anchors of this block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            settled = pc.equal(batch.column("_sub_kind"), _SETTLED)
            yield batch.filter(settled)
            held += batch.filter(pc.invert(settled)).column("_sub_blob").to_pylist()
        if held:
            high, low, ids, crcs, starts = _joined(held)
            held.clear()
            order, reference, later = _matched(high, low, ids, crcs, starts)
            gone, of = order[later], reference[later]
            yield from _settled(ids[gone], crcs[gone], starts[gone], ids[of], starts[of], parts)

    return blobs.mapInArrow(run, BLOBS)


def _with_blobs(docs: DataFrame, blobs: DataFrame, parts: int) -> DataFrame:
    """Each home's blobs and documents in one partition, the blobs first."""
    both = docs.withColumn("_sub_bucket", _home(parts)).unionByName(blobs.select("_sub_bucket", "_sub_blob"), allowMissingColumns=True)
    return both.repartitionById(parts, "_sub_bucket").sortWithinPartitions(F.col("_sub_blob").isNull())


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Adds _sub_id and _sub_crc."""
    return docs.withColumns({"_sub_id": F.col(id_col).cast("long"), "_sub_crc": F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))})


def factor_pieces(docs: DataFrame, parts: int, repeated: bool, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blobs of (id, crc, start, windows, reference id, reference start), by home: pieces of factors.

    crc is the text's CRC-32 where ids repeat, else 0: rows with one id and different texts are judged each on its own,
    and are references together. Rows without an id are neither judged nor references.
    """
    slim = _identified(docs, id_col, text_col).where("_sub_id is not null").select("_sub_id", "_sub_crc", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if not repeated:
        slim = slim.withColumn("_sub_crc", F.lit(0).cast("long"))
    shared = materialize(shared_anchors(anchor_blobs(slim, window, anchor, parts).repartitionById(parts, "_sub_bucket")), "shared-anchors")
    windows = window_blobs(_with_blobs(slim, shared, parts), window, anchor, parts)
    return materialize(block_factors(windows.repartitionById(parts, "_sub_bucket"), parts), "factor-pieces")


def _repeated(docs: DataFrame, id_col: str) -> bool:
    return not docs.groupBy(F.col(id_col)).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty()


#: (first word, words, reference's id, its first word there)
Factor = tuple[int, int, int, int]


def joined_factors(starts: list[int], counts: list[int], of: list[int], at: list[int], window: int = WINDOW) -> list[Factor]:
    """Pieces of one text, by start, as whole factors: those that go on from each other are one. Pieces come twice where a
    row does."""
    out: list[Factor] = []
    for s, n, r, p in zip(starts, counts, of, at, strict=True):
        if out:
            a, words, r0, p0 = out[-1]
            end = a + words - window + 1  # the start after the factor's last window
            if s + n <= end:
                continue
            if s <= end and r == r0 and p - s == p0 - a:
                out[-1] = (a, s + n - a + window - 1, r0, p0)
                continue
            s, n, p = max(s, end), n - max(0, end - s), p + max(0, end - s)
        out.append((s, n + window - 1, r, p))
    return out


def with_factors(docs: DataFrame, change: Callable[[pa.RecordBatch, list[list[Factor]]], pa.RecordBatch], schema: str | StructType, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """change(batch, factors) of every batch of `docs`, with the factors of each row's text. docs: no columns named _sub_*."""
    parts, repeated, names = _parts(docs, text_col), _repeated(docs, id_col), docs.columns
    pieces = factor_pieces(docs, parts, repeated, window, anchor, id_col, text_col)
    free_shuffles(docs.sparkSession)  # those of the lookups, before the texts are shuffled again

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, place, table = [], None, []
        for batch in batches:
            listed = batch.column("_sub_blob").is_valid()
            blobs += batch.filter(listed).column("_sub_blob").to_pylist()
            for part in small_batches(iter([batch.filter(pc.invert(listed))]), text_col, BATCH):
                if place is None:
                    place = {}
                    if blobs:
                        ids, crcs, first, *_ = table = _joined(blobs)
                        order = np.lexsort((first, crcs, ids))
                        table = [c[order] for c in table]
                        bounds = np.flatnonzero(np.append(True, (np.diff(table[0]) != 0) | (np.diff(table[1]) != 0)))
                        ends = np.append(bounds[1:], len(ids)).tolist()
                        place = {(i, c): (a, b) for i, c, a, b in zip(table[0][bounds].tolist(), table[1][bounds].tolist(), bounds.tolist(), ends, strict=True)}
                found: list[list[Factor]] = []
                for i, c in zip(part.column("_sub_id").to_pylist(), part.column("_sub_crc").to_pylist(), strict=True):
                    a, b = place.get((i, c if repeated else 0), (0, 0))
                    found.append(joined_factors(*(t[a:b].tolist() for t in table[2:]), window) if b else [])
                yield change(part.select(names), found)

    return _with_blobs(_identified(docs, id_col, text_col), pieces, parts).mapInArrow(run, schema)


def kept_words(text: str | None, factors: list[Factor]) -> tuple[int, list[bytes]]:
    """Number of words, and the words outside every factor. Factors overlap where a window crosses a boundary."""
    words = (text or "").encode().split()
    if not factors:
        return len(words), words
    kept, at = [], 0
    for a, n, _, _ in factors:
        kept += words[at:a]
        at = max(at, a + n)
    return len(words), kept + words[at:]


def parse(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ref_id, ref_start: the factors of every text, in words; what is in no factor is literal.

    Null and empty texts, rows without an id and texts without a repeated window have no factors; repeated rows (one id)
    are never references of each other and have the same factors each; an empty table gives an empty result; other columns
    are not read.
    """

    def change(batch: pa.RecordBatch, factors: list[list[Factor]]) -> pa.RecordBatch:
        rows = [(doc, *f) for doc, own in zip(batch.column("doc_id").to_pylist(), factors, strict=True) for f in own]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ref_id", "ref_start"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_factors(slim, change, "doc_id long, start long, length long, ref_id long, ref_start long", window)


def digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row.

    Null and empty texts have no words; repeated rows (one id) are never duplicates of each other and come out as often
    as they went in; rows without an id keep all words; an empty table gives an empty result; other columns are not read.
    """

    def change(batch: pa.RecordBatch, factors: list[list[Factor]]) -> pa.RecordBatch:
        rows = []
        for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), factors, strict=True):
            n, kept = kept_words(text, own)
            rows.append((doc, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_factors(slim, change, "doc_id long, n_words long, n_removed long, kept_sha256 string", window)


def remove_duplicates(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs`, factors cut from the text: kept words joined by one space. Texts without a factor stay, null
    ones too; repeated rows stay repeated; an empty table gives an empty result."""
    own = {c: free(docs, f"own_{i}") for i, c in enumerate(docs.columns) if c.lower().startswith("_sub_")}
    renamed = docs.withColumnsRenamed(own)

    def change(batch: pa.RecordBatch, factors: list[list[Factor]]) -> pa.RecordBatch:
        texts = [t if not f else b" ".join(kept_words(t, f)[1]).decode() for t, f in zip(batch.column(text_col).to_pylist(), factors, strict=True)]
        columns = [pa.array(texts, c.type) if n == text_col else c for n, c in zip(batch.schema.names, batch.columns, strict=True)]
        return pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return with_factors(renamed, change, renamed.schema, window, id_col=id_col, text_col=text_col).toDF(*docs.columns)


ORACLE = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w WHERE len(words) >= {WINDOW})),
firsts AS (SELECT g, min(doc_id) AS f FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM windows JOIN firsts USING (g), range(0, {WINDOW}) t(k) WHERE f < doc_id),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
