"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each stage's rows to the shared folder and
reads them back for the next, so a lost executor repeats one stage's tasks at most. All stages but the last return the
columns of `documents`. Empty input gives empty output; null and repeated rows are treated as the operators state. A stage
that goes through Python bounds the batches itself, since it may be run without `run`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import langid, mixing, packing, simhash, substrings
from tidelog.llm.common import bound_batches, materialize, read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null or empty text, or no letter in it); fills a null lang with the prediction,
    and replaces a lang that the text clearly contradicts. Ties go to the first language by name; repeated rows stay
    repeated; where no label is known at all, nothing is learned and every document is dropped."""
    bound_batches(spark)
    return langid.decide(docs, langid.learn(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more). SimHash links
    come first, and the shingle sets decide. Texts without words are one group; of repeated rows one stays; rows without
    an id stay unless a row with an id is in their group."""
    bound_batches(spark)
    return simhash.keep_one(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 13 words or more that stand in a document with a smaller id; drops documents left empty (and null
    ones). Repeated rows are no references of each other; rows without an id keep their text."""
    bound_batches(spark)
    out = substrings.remove_duplicates(docs).where(F.length("text") > 0)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents at random towards the square-root weights of their sources, globally shuffled. A null source
    is a source; rows with one id, repeated ones too, get the same number of copies."""
    return mixing.replicate(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens. Null and empty texts are an end token; repeated rows are
    packed as often as they occur."""
    bound_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages parse, hash and tokenize text in ways that SQL has no words for.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
