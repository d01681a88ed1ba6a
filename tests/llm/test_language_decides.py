import random

import corpus_pipeline as pipeline

from .conftest import SCHEMA

WORDS = {"en": ["the", "house", "with", "window", "and", "night", "thing", "would"], "de": ["der", "schön", "nicht", "straße", "und", "zwölf", "ich", "kämpft"]}


def text(lang, seed, lines):
    r = random.Random(f"{lang}{seed}")
    return "\n".join(" ".join(r.choice(WORDS[lang]) for _ in range(8)) for _ in range(lines))


def test_labels_that_the_text_contradicts(spark):
    """pipeline: a text in another language than its label gets its own; short or mixed texts keep their label. Ids 107 to 109 are not learned from."""
    source = [(i, text("en" if i % 2 else "de", i, 12), "en" if i % 2 else "de", "s", 1) for i in range(80)]
    source += [(107, text("en", 107, 12), "de", "s", 1), (108, "the night", "de", "s", 1), (109, text("en", 109, 5) + "\n" + text("de", 109, 6), "de", "s", 1)]
    source += [(103, text("de", 103, 12), None, "s", 1), (105, "12 34", "de", "s", 1)]
    docs = spark.createDataFrame(source, SCHEMA)
    out = pipeline.identify_language(spark, docs, "")
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert all(got[i] == ("en" if i % 2 else "de") for i in range(80))
    assert got[107] == "en" and got[108] == got[109] == "de" and got[103] == "de" and 105 not in got
