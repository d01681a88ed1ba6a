import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "ra", "se", "ti") for b in ("r", "st", "nd", "lo", "ving", "ty", "", "x")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows():
    """Nulls in every column, empty and long texts, copies, near copies, shared passages, repeated rows."""
    base = [(i, prose(i, 40 + i), "en" if i % 2 else "de", f"s{i % 3}", None) for i in range(12)]
    shared = prose("shared", 60)
    out = base + [
        (20, base[3][1], "en", "s0", 1), (21, base[3][1], None, None, None),  # exact copies
        (22, prose(4, 44) + " zz", "de", "s1", 3), (23, base[7][1].replace(" ", "\n\t ", 5), "en", "s1", 3),  # near copies
        (24, prose(100, 30) + " " + shared, "en", "s1", 3), (25, shared + " " + prose(101, 30), "de", "s2", 3),  # shared passages
        (26, None, "en", "s1", 0), (27, "", "de", "s1", 0), (28, " \n\t ", None, "s1", 0), (29, "one two", "en", "s0", 7),
        (30, prose("long", 30_000), "en", "s0", 9), (None, base[5][1], "en", "s0", 9), (None, None, None, None, None),
        (31, base[1][1], "en", "s0", 9), (31, base[1][1], "en", "s0", 9), (31, prose(200, 50), "en", "s0", 9),  # repeated rows and ids
        (32, "ÄÖ ß é ́ 12.5, it's <|endoftext|> <|startoftext|>x    ", "de", "s1", 3), (33, "12 34 ²", "en", "s1", 3),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def crowded(docs):
    """Extra columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ("id", "fp", "key", "bucket", "blob", "kind", "text_crc32", "leaf", "shard", "start", "l", "t", "i", "rate", "copies", "node", "root", "class", "index", "n", "size")
    return docs.select("*", *[F.lit(None).cast("string").alias(n) for n in names])
