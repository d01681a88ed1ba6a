"""Media columns: payloads as lossless 8-bit images in tar archives, and a Spark data source over archive folders.

Writing: each task appends PNG members (8-bit grey, 576 samples a row) to archives of its own; a side file lists each
member's place and checksum, and a manifest table, committed by Spark, names the archives that count.

Reading (`format("tidelog_media")`): the planner cuts archives into byte ranges from their sizes alone; a reader takes
the members that start in its range in one forward pass over one open file, streams them as Arrow batches of about
BATCH_BYTES, and fetches a member again, at its own offset, when a read fails or its checksum differs, without touching
its neighbours.

Options: path; rangeBytes (64 MB); retries (3); onError = fail (the default: after the retries the task fails, and Spark
repeats it) or record (a row with `error` set and no content).
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidelog.llm.common import shared_dir
from tidelog.llm.storage import Files
from tidelog.llm.tokens import small_batches

ROW = 576
PAD = 255
ARCHIVE_BYTES = 128 << 20
BATCH_BYTES = 4 << 20
_PNG = b"\x89PNG\r\n\x1a\n"
_ENTRY = "<QQI"
_SCHEMA = "member string, archive string, offset long, content binary, error string"


def to_payload(text: str | None) -> bytes:
    """UTF-8 bytes, padded with 255 (which UTF-8 never holds) to a positive multiple of 576. Null: empty."""
    data = (text or "").encode()
    return data + bytes([PAD]) * ((max(1, -(-len(data) // ROW)) * ROW) - len(data))


def to_image(payload: bytes) -> bytes:
    """PNG, 8-bit grey, 576 samples wide, no filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    raw = np.concatenate([np.zeros((len(rows), 1), np.uint8), rows], axis=1).tobytes()

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))

    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """The payload of an image that `to_image` made."""
    if image[:8] != _PNG:
        raise ValueError("not a PNG")
    at, data, width, height = 8, [], 0, 0
    while at < len(image):
        n, kind = struct.unpack_from(">I4s", image, at)
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", image, at + 8)
        elif kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean, standard deviation and entropy of the samples, and an 8 x 8 average hash of the whole image."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    p = counts[counts > 0] / len(x)
    blocks = np.add.reduceat(x, np.linspace(0, len(x), 64, endpoint=False).astype(np.int64), dtype=np.int64)
    sizes = np.diff(np.append(np.linspace(0, len(x), 64, endpoint=False).astype(np.int64), len(x)))
    bits = np.packbits(blocks / sizes > x.mean()).tobytes().hex()
    return f"{len(x) // ROW}x{ROW}:{x.mean():.3f}:{x.std():.3f}:{-(p * np.log2(p)).sum():.4f}:{bits}"


def member_name(doc: object) -> str:
    """The id as text, `null` for a null one; an id that reads `null`, or starts with =, gets a = before it."""
    if doc is None:
        return "null"
    name = str(doc)
    return "=" + name if name == "null" or name.startswith("=") else name


def member_id(name: str) -> str | None:
    """The id that a member was named by."""
    return None if name == "null" else name.removeprefix("=")


def write_archives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> str:
    """Write each text's payload as one member, named by its id (of 100 UTF-8 bytes at most); returns the folder. No shuffle.

    Null ids make members named `null`; null and empty texts make one row of padding; repeated rows make a member each;
    an empty table makes a folder without archives. Other columns are not read.
    """
    root = path or shared_dir(docs.sparkSession, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, out, name, at, entries, done = Files(root), None, "", 0, [], []

        def close() -> None:
            nonlocal out, at, entries
            if out is not None:
                out.write(bytes(1024))
                out.close()
                with files.create(name + ".idx") as f:
                    f.write(b"".join(struct.pack(_ENTRY, *e) for e in entries))
                done.append((name, at + 1024, len(entries)))
            out, at, entries = None, 0, []

        for batch in small_batches(batches, "text"):
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.tar"
                    out = files.create(name)
                image = to_image(to_payload(text))
                info = tarfile.TarInfo(member_name(doc))
                info.size = len(image)
                out.write(info.tobuf(tarfile.USTAR_FORMAT))
                out.write(image)
                out.write(bytes(-len(image) % 512))
                entries.append((at + 512, len(image), zlib.crc32(image)))
                at += 512 + len(image) + -len(image) % 512
                if at >= ARCHIVE_BYTES:
                    close()
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["archive", "bytes", "members"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    slim.mapInArrow(run, "archive string, bytes long, members long").write.parquet(f"{root}/_manifest")
    return root


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.range_bytes = int(options.get("rangebytes", 64 << 20))
        self.retries = int(options.get("retries", 3))
        self.fail = options.get("onerror", "fail") == "fail"

    def partitions(self) -> list[ByteRange]:
        files = Files(self.root)
        try:
            parts = Files(f"{self.root}/_manifest").list(".parquet")
        except FileNotFoundError:
            found = files.list(".tar")
        else:
            import pyarrow.parquet as pq

            found = []
            for part, _ in parts:
                with files.open(f"_manifest/{part}") as f:
                    table = pq.read_table(io.BytesIO(f.read()))
                found += zip(table.column("archive").to_pylist(), table.column("bytes").to_pylist(), strict=True)
        return [ByteRange(a, at, min(at + self.range_bytes, n)) for a, n in sorted(found) for at in range(0, n, self.range_bytes)]

    def _members(self, files: Files, archive: str, start: int, end: int) -> list[tuple[int, int, int | None]]:
        """(offset, size, checksum) of the members that start in the range; without a side file, tar headers are walked."""
        try:
            with files.open(archive + ".idx") as f:
                entries = list(struct.iter_unpack(_ENTRY, f.read()))
        except FileNotFoundError:
            with files.open(archive) as f, tarfile.open(fileobj=f) as tar:
                entries = [(m.offset_data, m.size, None) for m in tar]
        return [e for e in entries if start <= e[0] < end]

    @staticmethod
    def _take(stream: BinaryIO, offset: int, size: int, crc: int | None) -> tuple[str, bytes]:
        """A member's name and content; the stream only moves if the member is not where it stands."""
        if stream.tell() != offset - 512:
            stream.seek(offset - 512)
        data = stream.read(512 + size)
        if len(data) != 512 + size or crc not in (None, zlib.crc32(data[512:])):
            raise OSError("checksum or length differs")
        stream.read(-size % 512)
        return tarfile.TarInfo.frombuf(data[:512], "utf-8", "surrogateescape").name, data[512:]

    def _fetch(self, files: Files, archive: str, offset: int, size: int, crc: int | None) -> tuple[str | None, bytes | None, str | None]:
        """One member alone, by an open file of its own each time."""
        error = ""
        for attempt in range(self.retries):
            if attempt:
                time.sleep(min(5.0, 0.1 * 2**attempt))
            try:
                with files.open(archive) as f:
                    return *self._take(f, offset, size, crc), None
            except (OSError, tarfile.TarError) as e:
                error = f"{type(e).__name__}: {e}"
        return None, None, error

    def _stream(self, files: Files, archive: str, entries: list[tuple[int, int, int | None]]) -> Iterator[tuple[int, str | None, bytes | None, str | None]]:
        """(offset, member, content, error) in order. A failed read closes the stream; the next member opens it anew."""
        stream: BinaryIO | None = None
        for offset, size, crc in entries:
            try:
                stream = stream or files.open(archive)
                yield offset, *self._take(stream, offset, size, crc), None
                continue
            except (OSError, tarfile.TarError) as e:
                error = f"{type(e).__name__}: {e}"
            if stream is not None:
                stream.close()
                stream = None
            member, content, again = self._fetch(files, archive, offset, size, crc)
            error = again or error
            if content is None and self.fail:
                raise OSError(f"{archive} at {offset}: {error}")
            yield offset, member, content, None if content is not None else error
        if stream is not None:
            stream.close()

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # how Spark reads a folder without archives
            return
        schema = pa.schema([("member", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
        files, rows, held = Files(self.root), [], 0
        entries = self._members(files, partition.archive, partition.start, partition.end)
        for offset, member, content, error in self._stream(files, partition.archive, entries):
            rows.append((member, partition.archive, offset, content, error))
            held += len(content or b"")
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class MediaArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog_media"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, **options: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("tidelog_media").options(path=path, **options).load()


def features(members: DataFrame) -> DataFrame:
    """Digests and the feature of each stored image, from its stored bytes; doc_id is the id as text."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, image in zip(batch.column("member").to_pylist(), batch.column("content").to_pylist(), strict=True):
                payload = from_image(image)
                rows.append((member_id(member), len(payload.rstrip(bytes([PAD]))), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)))
            if rows:
                types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return members.select("member", "content").mapInArrow(run, schema)
