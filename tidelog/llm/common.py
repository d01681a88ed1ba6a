"""Shared folder, durable intermediate tables and small column helpers of the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Whole texts go to Python in batches of this many rows, unless the session asks for less: Spark's usual 10,000 texts at a
#: time are held several times over, outside the heap and in each worker.
BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
#: Rows of packed columns are much larger than texts, so bytes are bounded too.
BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "4m"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent (a local session, as in tests) a temporary folder takes its place; on a cluster its
    absence is an error, since no local folder is visible to every executor.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set(CHECKPOINT_KEY, root)
    _made.append(f"{root.rstrip('/')}/tidelog/{label}-{uuid.uuid4().hex}")
    return _made[-1]


_made: list[str] = []


def release(spark: SparkSession) -> int:
    """Delete the tables and files that this session's operators left in the shared folder, and say how many there were.

    Results are lazy and read them, so call this once the results are written.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        done += bool(path.getFileSystem(conf).delete(path, True))
    return done


def materialize(df: DataFrame, label: str, tidy: bool = True) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors.

    tidy: let Spark delete the shuffle files of the stages that produced the table at once; steps that shuffle little leave
    that to the next one.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    if tidy:
        free_shuffles(spark)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that nothing refers to any more, instead of whenever the driver's
    memory happens to be collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def free(df: DataFrame, name: str) -> str:
    """`name` with as many underscores before it as make it a name that no column of `df` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(col, UPPER, UPPER.lower())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bound_rows(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to Python at a time."""
    if not 0 < int(spark.conf.get(BATCH_KEY)) <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def bound_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to Python at a time, and at most about BATCH_BYTES where the session names no bound."""
    bound_rows(spark)
    if spark.conf.get(BYTES_KEY, None) is None:
        spark.conf.set(BYTES_KEY, BATCH_BYTES)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    here = str(Path(__file__).resolve().parents[2])
    if spark.sparkContext.master.startswith("local["):  # workers must find this package wherever the session was started
        spark.sparkContext.environment.setdefault("PYTHONPATH", here)
    bound_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
