"""Event tables: binding the driver's tables to the canonical schema, reading and writing logs."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog.operators.runtime import retired_prefix

SCHEMA_IDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}
SKEW_TICKS = 60_000_000
SPAN = 1_000_000
#: Files that the driver has copied at a time, and tasks that list a log's folders.
COPIERS, LISTERS = 16, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a history, without causes: no shuffle, and filters on user_id, event_id and ts reach the scan.

    Valid time lags known time by up to six minutes, so late evidence is genuine; a fifth of the rows is unobserved.
    """
    known = F.unix_micros(F.col("ts").cast("timestamp"))
    kinds = F.lit(None).cast("long")
    for name, number in SCHEMA_IDS.items():
        kinds = F.when(F.col("event_type") == name, F.lit(number).cast("long")).otherwise(kinds)
    one = F.lit(1).cast("long")
    unobserved = F.col("event_id") % 5 == 0
    return table(spark, sf_dir, "events").select(
        one.alias("source"),
        one.alias("epoch"),
        F.col("event_id").alias("sequence"),
        (F.col("user_id") % 8).alias("shard"),
        F.col("user_id").alias("slot"),
        F.lit(0).cast("long").alias("generation"),
        kinds.alias("schema_id"),
        one.alias("valid_clock"),
        (known - F.col("event_id") % 7 * SKEW_TICKS).alias("valid_ticks"),
        F.when(~unobserved, one).alias("observed_clock"),
        F.when(~unobserved, known).alias("observed_ticks"),
        one.alias("known_clock"),
        known.alias("known_ticks"),
        F.encode(F.concat(F.lit("v="), F.round("value", 2).cast("decimal(20,2)").cast("string")), "UTF-8").alias("payload"),
        F.col("value"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        "event_type",
    )


def with_causes(events: DataFrame) -> DataFrame:
    """Adds declared causes: the entity's previous event, and the event at half the sequence; both are earlier.

    Previous events are found within spans of sequences, and across them by each span's last one, so that no task orders a
    whole entity."""
    span = F.expr(f"sequence div {SPAN}")
    entity = ["shard", "slot", "generation"]
    ends = events.groupBy(*entity, span.alias("_span")).agg(F.max("sequence").alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*entity).orderBy("_span"))).drop("_end")  # one row an entity and span
    events = events.withColumn("_span", span).withColumn("_previous", F.lag("sequence").over(Window.partitionBy(*entity, "_span").orderBy("sequence")))
    events = events.join(ends, [*entity, "_span"]).select(*[c for c in events.columns if c not in ("_span", "_previous")], F.coalesce("_previous", "_carried").alias("_previous"))
    previous = F.col("_previous")
    half = F.when(F.col("sequence") > 0, F.expr("sequence div 2"))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.array(previous, half))))
    return events.withColumn("causes", F.transform(ids, lambda s: F.struct(F.lit(1).cast("long").alias("source"), F.lit(1).cast("long").alias("epoch"), s.alias("sequence")))).drop("_previous")


@contextmanager
def _few_listers(spark: SparkSession):
    """Spark lists a log of many buckets with up to 10,000 tasks, whose overhead is most of the time and of what they send."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), LISTERS)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    with _few_listers(spark):
        return spark.read.parquet(path)


def write_log(events: DataFrame, path: str, bucket: int = 1_000_000, mode: str = "append", ordered: bool = False) -> None:
    """Append in sequence order, partitioned by sequence bucket: time slices and sequence ranges skip files and row groups,
    entity lookups skip pages by Bloom filter. A failed append leaves nothing behind; readers that list the folder while
    files are being committed may see some of them. A filter is sized for the entities that a bucket can hold, since Parquet
    would give each file a mebibyte. ordered: the events come in sequence order already, as from another log, so that tasks
    sort what they read and nothing is sampled or shuffled."""
    out = events.withColumn("seq_bucket", F.expr(f"sequence div {bucket}"))
    (
        (out if ordered else out.repartitionByRange("seq_bucket", "sequence"))
        .sortWithinPartitions("seq_bucket", "sequence")
        .write.mode(mode)
        .partitionBy("seq_bucket")
        .option("parquet.bloom.filter.enabled#slot", "true")
        .option("parquet.bloom.filter.expected.ndv#slot", str(min(bucket, SPAN)))
        .parquet(path)
    )


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(conf), own, jvm, conf


def claim(spark: SparkSession, path: str, first: int) -> bool:
    """Whether this writer is the only one that may append from a sequence: the first to make the claim's file is. The folder
    is not read as data. A claim without data, left by a writer that was lost, is taken back by `release_claim`."""
    fs, own, jvm, _ = _files(spark, path)
    return fs.createNewFile(jvm.org.apache.hadoop.fs.Path(own, f"_claims/{first:020d}"))


def release_claim(spark: SparkSession, path: str, first: int) -> None:
    fs, own, jvm, _ = _files(spark, path)
    fs.delete(jvm.org.apache.hadoop.fs.Path(own, f"_claims/{first:020d}"), False)


def seal(spark: SparkSession, path: str, out: str, bucket: int = 1_000_000) -> DataFrame:
    """Write each complete sequence bucket of a log that is not sealed yet as one segment, and return the manifest of all.

    A segment, once written, is never touched again; sealing twice does nothing. Buckets that still miss sequences stay.
    """
    log = read_log(spark, path).drop("seq_bucket").withColumn("seq_bucket", F.expr(f"sequence div {bucket}"))
    full = log.groupBy("seq_bucket").agg(F.count_distinct("sequence").alias("n")).where(F.col("n") == bucket).select("seq_bucket")
    fs, own, _, _ = _files(spark, out)
    if fs.exists(own):
        full = full.join(read_log(spark, out).select("seq_bucket").distinct(), "seq_bucket", "left_anti")
    todo = [r[0] for r in full.collect()]  # buckets sealed by one call
    if todo:
        write_log(log.where(F.col("seq_bucket").isin(todo)).drop("seq_bucket"), out, bucket)
    if not fs.exists(own):
        return spark.createDataFrame([], "seq_bucket int, first long, last long, records long")
    return read_log(spark, out).groupBy("seq_bucket").agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("records"))


def retire(spark: SparkSession, path: str, sealed: DataFrame, holds: list[tuple[int, int]] | None = None) -> list[int]:
    """Delete the leading buckets of a log that are sealed (see `seal`; with the log's own bucket size) and not held, and name
    them. What is deleted stays readable in its segments."""
    fs, own, jvm, _ = _files(spark, path)
    frames = read_log(spark, path).groupBy(F.col("seq_bucket").cast("long").alias("frame")).agg(F.min("sequence").alias("first"), F.max("sequence").alias("last"), F.count(F.lit(1)).alias("n"))
    known = sealed.select(F.col("seq_bucket").cast("long").alias("frame"), F.col("records").alias("kept"))
    frames = frames.join(known, "frame", "left").withColumn("sealed", F.coalesce(F.col("kept") >= F.col("n"), F.lit(False)))
    gone = sorted(r["frame"] for r in retired_prefix(frames, holds).select("frame").collect())
    for bucket in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(own, f"seq_bucket={bucket}"), True)
    return gone


def _copy(spark: SparkSession, path: str, out: str) -> None:
    """Copy a folder to a new one, COPIERS of its entries at a time."""
    fs, own, jvm, conf = _files(spark, path)
    to, target, _, _ = _files(spark, out)
    entries, util = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(own)), jvm.org.apache.hadoop.fs.FileUtil
    if not to.mkdirs(target):
        raise OSError(f"{out} could not be made")
    n = len(entries)
    cuts = sorted({n * i // COPIERS for i in range(COPIERS + 1)})
    parts = [entries[a:b] for a, b in zip(cuts, cuts[1:])]
    with ThreadPoolExecutor(COPIERS) as pool:
        done = pool.map(lambda part: util.copy(fs, part, to, target, False, False, conf), parts)
    if not all(done):
        raise OSError(f"{path} could not be copied")


def backup(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Copy a log's files to a new folder, file by file through Hadoop, and write its manifest beside it (`out`.manifest),
    which is returned; a copy that differs from its source is an error."""
    to, target, _, _ = _files(spark, out)
    if to.exists(target):
        raise FileExistsError(out)
    _copy(spark, path, out)
    backup_manifest(spark, path).write.parquet(f"{out}.manifest")
    made = spark.read.parquet(f"{out}.manifest")
    if bad := verify_backup(made, backup_manifest(spark, out)).take(1):
        raise OSError(f"{bad[0]['file']}: {bad[0]['problem']}")
    return made


def restore(spark: SparkSession, copy: str, path: str) -> DataFrame:
    """Bring a backup back to a folder that does not exist yet, after checking it against its manifest, and read it."""
    to, target, _, _ = _files(spark, path)
    if to.exists(target):
        raise FileExistsError(path)
    if bad := verify_backup(spark.read.parquet(f"{copy}.manifest"), backup_manifest(spark, copy)).take(1):
        raise OSError(f"{bad[0]['file']}: {bad[0]['problem']}")
    _copy(spark, copy, path)
    return read_log(spark, path)


def media_reference(rows: DataFrame, uri: Column, content: str) -> DataFrame:
    """Adds uri, content_hash (SHA-256, lowercase hex) and byte_size of a content column (a string counts as UTF-8)."""
    data = F.col(content).cast("binary")
    return rows.withColumns({"uri": uri, "content_hash": F.sha2(data, 256), "byte_size": F.octet_length(data).cast("long")})


def verify_media(references: DataFrame, contents: DataFrame, content: str = "content") -> DataFrame:
    """uri, problem: referenced contents (uri, `content`) that are missing, or differ in size or hash."""
    data = F.col(content).cast("binary")
    own = contents.select("uri", F.sha2(data, 256).alias("_hash"), F.octet_length(data).cast("long").alias("_size"))
    problem = (
        F.when(F.col("_size").isNull(), "missing")
        .when(F.col("_size") != F.col("byte_size"), "size differs")
        .when(F.col("_hash") != F.col("content_hash"), "hash differs")
    )
    return references.join(own, "uri", "left").select("uri", problem.alias("problem")).where("problem is not null")


def backup_manifest(spark: SparkSession, path: str) -> DataFrame:
    """file (its path below `path`), bytes, crc32 of every file under `path`: compare two of these to verify a copy or a restore."""
    with _few_listers(spark):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = urlparse(path).path.rstrip("/") + "/"
    return files.select(F.substring_index("path", root, -1).alias("file"), F.col("length").alias("bytes"), F.crc32("content").alias("crc32"))


def verify_backup(manifest: DataFrame, copy: DataFrame) -> DataFrame:
    """file, problem: files that a copy lacks, has besides, or holds with other bytes; none for a good backup."""
    other = copy.select("file", F.col("bytes").alias("copied"), F.col("crc32").alias("copied_crc32"))
    problem = (
        F.when(F.col("copied").isNull(), "missing")
        .when(F.col("bytes").isNull(), "unexpected")
        .when((F.col("bytes") != F.col("copied")) | (F.col("crc32") != F.col("copied_crc32")), "differs")
    )
    return manifest.join(other, "file", "full").select("file", problem.alias("problem")).where("problem is not null")


def choose_encoding(measured: DataFrame) -> DataFrame:
    """block, encoding, score: the cheapest measured encoding of each block (block, encoding, bytes, raw_bytes, encode_ns,
    decode_ns), or 'raw' where none beats the raw size. The encodings themselves are Parquet's."""
    score = F.col("bytes") + 0.001 * F.col("decode_ns") + 0.0001 * F.col("encode_ns")
    best = measured.withColumn("score", score).groupBy("block").agg(F.min(F.struct("score", "encoding")).alias("best"), F.max("raw_bytes").alias("raw"))
    wins = F.col("best.score") < F.col("raw")
    return best.select("block", F.when(wins, F.col("best.encoding")).otherwise("raw").alias("encoding"), F.when(wins, F.col("best.score")).otherwise(F.col("raw").cast("double")).alias("score"))


def columnar_export(events: DataFrame) -> DataFrame:
    """The seven integer columns of the Arrow interchange; call toArrow() on it."""
    return events.select("sequence", "shard", "slot", "generation", "schema_id", "valid_ticks", "known_ticks")
