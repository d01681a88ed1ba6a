import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import dac, packing
from tidelog.llm.tokens import WordTokenizer, small_batches

from .conftest import rows

TOKENIZER = WordTokenizer()
TEXT = st.text(st.characters(codec="utf-8") | st.sampled_from(list("aeIO '.,<|>\n\t1")), max_size=60)


def reference(text):
    return TOKENIZER._tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT | st.none() | st.sampled_from(["<|endoftext|>", "a<|STARTOFTEXT|> b", "End. Next, it's", "İ K̊ é. "]), max_size=6))
def test_tokens_equal_the_tokenizer(texts):
    ids, at = TOKENIZER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [reference(t) for t in texts]


def test_tokens_of_slices():
    texts = ["Ünder É ß", "ABC é.", None, "Ömer, o", "x" * 50 + " ÄÖ"]
    batch = pa.record_batch({"text": texts})
    for a in range(5):
        ids, at = TOKENIZER.encode(batch.slice(a, 2).column("text"))
        assert [ids[x:y].tolist() for x, y in zip(at, at[1:])] == [reference(t) for t in texts[a : a + 2]]


def test_small_batches():
    batch = pa.record_batch({"text": ["a" * 10, None, "b" * 100, "", "c"]})
    parts = list(small_batches(iter([batch]), "text", 20))
    assert sum(p.num_rows for p in parts) == 5 and len(parts) > 1


@given(st.integers(0, 20_000))
def test_cut(n):
    pieces = packing.cut(n)
    assert sum(x for x, _ in pieces) == n and all(0 < x <= 2048 // k for x, k in pieces)


def check_packing(out, docs, capacity):
    """Every id of every document lies in exactly one piece of the right ids; sequences are gapless and within capacity."""
    texts, covered, by_seq = defaultdict(list), defaultdict(Counter), defaultdict(list)
    for d, t, *_ in docs:
        texts[d].append(reference(t))
    for r in out:
        a, n = r["start"], r["length"]
        assert n > 0 and any(len(x) == r["doc_tokens"] and a + n <= len(x) and zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()) == r["ids_crc32"] for x in texts[r["doc_id"]])
        covered[r["doc_id"], r["doc_tokens"]].update(range(a, a + n))
        by_seq[r["sequence_id"]].append(r)
    want = defaultdict(Counter)
    for d, own in texts.items():
        for x in own:
            want[d, len(x)].update(range(len(x)))
    assert covered == want
    for v in by_seq.values():
        v.sort(key=lambda r: r["offset"])
        ends = [0] + [r["offset"] + r["length"] for r in v]
        assert [r["offset"] for r in v] == ends[:-1] and ends[-1] <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))


@given(st.lists(st.integers(1, 9000), max_size=30), st.sampled_from([64, 256, 2048]))
def test_plans_are_the_cuts(tokens, capacity):
    doc, start, length, kind = packing.Plans(capacity).apply(np.array(tokens, np.int64))
    want, at = [], 0
    for d, n in enumerate(tokens):
        at = 0
        for x, k in packing.cut(n, capacity):
            want.append((d, at, x, k))
            at += x
    assert list(zip(doc.tolist(), start.tolist(), length.tolist(), kind.tolist())) == want


def test_repeated_rows_are_dealt_apart(spark):
    """One id and one text in every row: pieces still spread over buckets and fill sequences."""
    out = packing.pack(spark.createDataFrame([(7, "one two three")] * 5000, "doc_id long, text string")).collect()
    check_packing(out, [(7, "one two three")] * 5000, 2048)
    assert len({r["sequence_id"] for r in out}) <= 5000 * 4 / 2048 * 1.1 + 1


@pytest.mark.parametrize("capacity", [2048, 256])
def test_packing(docs, crowded, capacity):
    check_packing(packing.pack(docs, capacity=capacity).collect(), rows(), capacity)
    assert packing.pack(crowded, capacity=capacity).count() == packing.pack(docs, capacity=capacity).count()


def test_packing_padding(spark):
    many = spark.createDataFrame([(i, "word " * (i % 1500)) for i in range(3000)], "doc_id long, text string")
    out = packing.pack(many)
    used, tokens = out.select("sequence_id").distinct().count(), out.groupBy().sum("length").first()[0]
    assert tokens / (used * 2048) > 0.98


def test_packing_empty(empty):
    assert packing.pack(empty).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
@settings(max_examples=50, deadline=None)
def test_dac_round_trip_and_access(ids):
    data = dac.encode(np.array(ids, np.uint32), [5, None], np.array([0, len(ids) // 2, len(ids)]))
    f = dac.DacFile(lambda at, n: data[at : at + n])
    assert f.decode().tolist() == ids and f.documents()[0] == [5, None]
    for i in range(0, len(ids), 97):
        assert f.access(i) == ids[i]
    with pytest.raises(IndexError):
        f.access(len(ids))


def test_dac_corpus(docs, crowded, empty, monkeypatch):
    order = sorted(rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at, want = 0, []
    for d, t, *_ in order:
        ids = reference(t)
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    got = sorted(map(tuple, dac.read_corpus(*dac.write_corpus(docs)).collect()), key=key)
    assert got == sorted(want, key=key)
    assert dac.read_corpus(*dac.write_corpus(crowded)).count() == len(want)
    assert dac.read_corpus(*dac.write_corpus(empty)).count() == 0
