from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
import __spark_entry__ as entry

from .conftest import prose, rows


def stages(spark, docs):
    out = []
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, "").cache()
        out.append(docs)
    return out


def test_stages(spark, docs):
    language, near, passages, mixed, packed = stages(spark, docs)
    for d in (language, near, passages, mixed):
        assert d.columns == docs.columns
    assert {26, 27, 28, 33} & {r["doc_id"] for r in language.collect()} == set() and language.where("lang is null").count() == 0
    assert language.count() == len(rows()) - 5
    assert {20, 21, 22} & {r["doc_id"] for r in near.collect()} == set()
    cut = {r["doc_id"]: r for r in passages.collect()}
    assert cut[25]["text"] == prose(101, 30) and cut[25]["n_chars"] == len(cut[25]["text"]) and cut[0]["text"] == rows()[0][1]
    want = Counter(r["doc_id"] for r in mixed.collect())
    ends = Counter(r["doc_id"] for r in packed.collect() if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == want


def test_a_stage_run_alone_bounds_what_goes_to_python(spark, docs):
    """Stages do not need `run` for it: neither whole texts nor packed columns travel 10,000 rows at a time."""
    from tidelog.llm.common import BATCH_KEY, BATCH_ROWS, BYTES_KEY

    def batches(found):
        for b in found:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    for _, stage in pipeline.STAGES[:3] + pipeline.STAGES[4:]:
        spark.conf.unset(BATCH_KEY)
        spark.conf.unset(BYTES_KEY)
        stage(spark, docs, "")
        for rows_, length in ((3000, 1), (200, 50_000)):
            texts = spark.range(0, rows_, 1, 1).select(F.repeat(F.lit("x"), length).alias("text"))
            got = texts.mapInArrow(batches, "n long, size long").collect()
            assert max(r["n"] for r in got) <= BATCH_ROWS and max(r["size"] for r in got) <= 5 << 20
    spark.conf.set(BATCH_KEY, "7")  # a session that asks for less gets it
    pipeline.STAGES[2][1](spark, docs, "")
    assert spark.conf.get(BATCH_KEY) == "7"
    spark.conf.unset(BATCH_KEY)
    spark.conf.unset(BYTES_KEY)


def test_empty_input(spark, empty):
    assert stages(spark, empty)[-1].count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert set(entry.oracle_sql()) <= set(names)
