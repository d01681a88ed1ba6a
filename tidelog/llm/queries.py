"""The registered query of each corpus operator, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import langid, mixing, substrings, urls
from tidelog.llm.ann import nearest
from tidelog.llm.common import read_table
from tidelog.llm.dac import read_corpus, write_corpus
from tidelog.llm.media import features, read_archives, write_archives
from tidelog.llm.packing import pack
from tidelog.llm.sharding import kd_shards
from tidelog.llm.simhash import CONTRACT, near_duplicates


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rule or host reputation; a page's outcome is bad if its label is toxic or of low quality."""
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    labels = read_table(spark, sf_dir, "labels").where("toxic is not null and quality is not null")
    return urls.judge(read_table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and read back through the archive data source."""
    root = write_archives(read_table(spark, sf_dir, "documents"))
    return features(read_archives(spark, root, rangeBytes=str(16 << 20))).withColumn("doc_id", F.col("doc_id").cast("long"))


def op3_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = near_duplicates(read_table(spark, sf_dir, "documents"), CONTRACT)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op4_stable_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors by inner product of every vector whose id is divisible by 20."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op5_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.learn(docs))
    held_out = F.coalesce(~langid.learnable(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lid_lang").alias("lang_pred"), F.col("_lid_score").alias("score"))


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated towards the target weights of their sources, globally shuffled."""
    out = mixing.replicate(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("_mix_copies").alias("copies"), F.col("_mix_copy").alias("copy"), F.col("_mix_key").alias("shuffle_key"))


def op7_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 13-word windows that start in a document with a smaller id."""
    return substrings.digests(read_table(spark, sf_dir, "documents"))


def op8_dac_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in directly addressable files, read back."""
    return read_corpus(*write_corpus(read_table(spark, sf_dir, "documents")))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    out = kd_shards(read_table(spark, sf_dir, "documents"), 40)
    return out.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_url_reputation": op1_url_reputation,
    "op2_media_columns": op2_media_columns,
    "op3_simhash_trie": op3_simhash_trie,
    "op4_stable_projections": op4_stable_projections,
    "op5_cross_parsing": op5_cross_parsing,
    "op6_poisson_mixing": op6_poisson_mixing,
    "op7_relative_lz": op7_relative_lz,
    "op8_dac_tokens": op8_dac_tokens,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_harmonic_packing": op10_harmonic_packing,
}

ORACLES = {"op1_url_reputation": urls.ORACLE, "op6_poisson_mixing": mixing.ORACLE, "op7_relative_lz": substrings.ORACLE}
