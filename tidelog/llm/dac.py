"""Directly addressable codes: token ids in chunk levels with continuation bitmaps and rank directories.

Level j holds the j-th 8-bit chunk (low first) of the ids that need it, one byte each, and a bitmap with a one for each
id that goes on in level j + 1. The position there is the rank of that one, which a directory of 32-bit counts for every
512 bits gives in constant time, so any id is read without decoding another.

File: MAGIC, then little-endian u32 levels, u64 ids, u64 documents; for each level u64 entries; document ids (i64, with
a null mask byte each), document starts (u64, one more than documents); for each level its chunks, its bitmap (padded
to 64 bits) and its rank directory.

A corpus is a folder of such files in ascending document order and a manifest table, written by Spark's own commit
protocol: files that a lost or repeated task left behind are not listed and never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import materialize, shared_dir, shuffle_partitions
from tidelog.llm.storage import Files
from tidelog.llm.tokens import small_batches, tokenizer

MAGIC = b"TIDEDAC1"
SUPER = 512
FILE_IDS = 4 << 20
_HEAD = struct.Struct("<8sIQQ")


def _ranks(words: np.ndarray) -> np.ndarray:
    """Ones before each run of SUPER bits; `words` are the bitmap's u64."""
    ones = np.bitwise_count(words).astype(np.uint32)
    runs = np.add.reduceat(ones, np.arange(0, len(ones), SUPER // 64)) if len(ones) else np.zeros(0, np.uint32)
    return (np.cumsum(runs) - runs).astype("<u4")


def encode(ids: np.ndarray, docs: list[int | None], starts: np.ndarray) -> bytes:
    """One file's bytes. starts: the documents' offsets in `ids`, and their end."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.zeros(-(-len(rest) // 64) * 8, dtype=np.uint8)
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        levels.append(((rest & 255).astype(np.uint8), bits, _ranks(bits.view("<u8"))))
        if not more.any():
            break
        rest = rest[more] >> 8
    out = [_HEAD.pack(MAGIC, len(levels), len(ids), len(docs)), b"".join(struct.pack("<Q", len(c)) for c, _, _ in levels)]
    out += [np.array([d or 0 for d in docs], dtype="<i8").tobytes(), bytes(d is None for d in docs), starts.astype("<u8").tobytes()]
    out += [part.tobytes() for level in levels for part in level]
    return b"".join(out)


class DacFile:
    """Random access to one file; `read(offset, n)` fetches bytes, e.g. by seeking in a stream."""

    def __init__(self, read) -> None:
        self._read = read
        magic, levels, self.n_ids, self.n_docs = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = _HEAD.size
        sizes = struct.unpack(f"<{levels}Q", read(at, 8 * levels))
        self._docs_at = at + 8 * levels
        at = self._docs_at + 9 * self.n_docs + 8 * (self.n_docs + 1)
        self._levels = []
        for n in sizes:
            words = -(-n // 64)
            self._levels.append((n, at, at + n, at + n + 8 * words))
            at += n + 8 * words + 4 * (-(-words * 64 // SUPER))

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        raw = self._read(self._docs_at, 17 * self.n_docs + 8)
        null = raw[8 * self.n_docs : 9 * self.n_docs]
        docs = [None if x else d for d, x in zip(np.frombuffer(raw, "<i8", self.n_docs).tolist(), null, strict=True)]
        return docs, np.frombuffer(raw, "<u8", self.n_docs + 1, 9 * self.n_docs).astype(np.int64)

    def access(self, i: int) -> int:
        """The i-th id: one chunk, one bit and one rank for each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (_, chunks, bitmap, ranks) in enumerate(self._levels):
            value |= self._read(chunks + i, 1)[0] << 8 * level
            run, bit = divmod(i, SUPER)
            bits = np.frombuffer(self._read(bitmap + run * SUPER // 8, bit // 64 * 8 + 8), "<u8")
            word = int(bits[bit // 64])
            if not word >> bit % 64 & 1:
                break
            before = int(np.bitwise_count(bits[: bit // 64]).sum()) + (word & (1 << bit % 64) - 1).bit_count()
            i = struct.unpack("<I", self._read(ranks + 4 * run, 4))[0] + before
        return value

    def decode(self) -> np.ndarray:
        """All ids, level by level from the last."""
        values = None
        for n, chunks, bitmap, ranks in reversed(self._levels):
            own = np.frombuffer(self._read(chunks, n), np.uint8).astype("<u4")
            if values is not None:
                more = np.unpackbits(np.frombuffer(self._read(bitmap, ranks - bitmap), np.uint8), count=n, bitorder="little").view(bool)
                own[more] |= values << 8
            values = own
        return values if values is not None else np.zeros(0, "<u4")


def opened(files: Files, name: str) -> DacFile:
    stream = files.open(name)

    def read(offset: int, n: int) -> bytes:
        stream.seek(offset)
        return stream.read(n)

    return DacFile(read)


def write_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, path: str | None = None) -> tuple[str, DataFrame]:
    """Write all documents in ascending id order (nulls first, equal ids in order of their text); each ends with id 1.

    Returns the folder and its manifest: file, part, number, n_docs, n_ids. A null text is an empty one.
    """
    spark = docs.sparkSession
    root = path or shared_dir(spark, "dac")
    schema = "file string, part int, number int, n_docs long, n_ids long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, files, number = TaskContext.get().partitionId(), Files(root), 0
        names = [f.partition(" ")[0] for f in schema.split(", ")]
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            nonlocal held, number
            name = f"ids-{part:06d}-{number:06d}-{uuid.uuid4().hex}.dac"
            ids = np.concatenate([h[1] for h in held])
            lengths = np.concatenate([np.diff(h[2]) for h in held])
            owners = [d for h in held for d in h[0]]
            with files.create(name) as f:
                f.write(encode(ids, owners, np.concatenate([[0], np.cumsum(lengths)])))
            held, number = [], number + 1
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.string()), (part, pa.int32()), (number - 1, pa.int32()), (len(owners), pa.int64()), (len(ids), pa.int64()))], names)

        for batch in small_batches(batches, "text"):
            ids, offsets = tokenizer(vocabulary).encode(batch.column("text"))
            held.append((batch.column("doc_id").to_pylist(), ids, offsets))
            if sum(len(h[1]) for h in held) >= FILE_IDS:
                yield flush()
        if held:
            yield flush()

    sorted_ = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sorted_ = sorted_.repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return root, materialize(sorted_.mapInArrow(run, schema), "dac-manifest")


def read_corpus(root: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document, from the files alone.

    The manifest has one row for each FILE_IDS ids or so; only its running sum is computed in one task.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    based = based.repartition(shuffle_partitions(manifest.sparkSession), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist(), strict=True):
                coded = opened(files, name)
                docs, starts = coded.documents()
                data = memoryview(coded.decode().tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
