"""The registered corpus queries and the whole pipeline, run on small tables against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as pipeline
from tidelog.llm import langid, queries
from tidelog.llm.common import read_table
from tidelog.llm.tokens import WordTokenizer

from .test_near_and_substrings import brute_groups
from .test_setjoin import brute_kept
from tidelog.llm import simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables")


@pytest.fixture(scope="module")
def source(spark):
    return read_table(spark, SF, "documents").collect()


def test_op3(spark, source):
    fps = [simhash.fingerprint(r["text"], 3) for r in source]
    want = {(r["doc_id"], f.hex(), g) for r, f, g in zip(source, fps, brute_groups(fps, [r["doc_id"] for r in source], 2))}
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in queries.op3_simhash_trie(spark, SF).collect()} == want


def test_op4_recall(spark):
    rows = read_table(spark, SF, "embeddings").collect()
    ids, X = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    found = defaultdict(list)
    for r in queries.op4_stable_projections(spark, SF).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        scores = X @ X[np.flatnonzero(ids == q)[0]]
        want = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:20]
        hits += len(set(want) & {v for v, _ in got})
    assert hits >= 0.9 * 20 * len(found)


def test_op5(spark, source):
    """Against a parse of every text by substring search, and the labels that were held out."""
    out = {r["doc_id"]: r for r in queries.op5_cross_parsing(spark, SF).collect()}
    samples = langid.learn(read_table(spark, SF, "documents"))
    norms = {k: bytes(langid._symbols(v)) for k, v in samples.items()}

    def phrases(norm, text):
        n = at = 0
        while at < len(text):
            end = at + 1
            while end < len(text) and text[at : end + 1] in norm:
                end += 1
            at, n = end, n + 1
        return n

    right = held = 0
    for r in source:
        got, text = out[r["doc_id"]], (r["text"] or "").encode()
        assert got["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not langid.has_letter(r["text"]):
            assert got["lang_pred"] == "und"
            continue
        if len(text) <= langid.SEGMENT:  # one segment: the parse is the same
            bits = sorted((phrases(norm, bytes(langid._symbols(text))) * np.log2(len(norm)), k) for k, norm in norms.items())
            assert got["lang_pred"] == bits[0][1] or bits[1][0] - bits[0][0] < 3 * np.log2(1 << 14)
        if got["held_out"]:
            held += 1
            right += got["lang_pred"] == r["lang"]
    assert held > 20 and right >= 0.97 * held


def test_op10(spark, source):
    tokenizer, own = WordTokenizer(), defaultdict(list)
    for r in queries.op10_harmonic_packing(spark, SF).collect():
        own[r["doc_id"]].append(r)
    used = Counter()
    for r in source:
        ids = np.array(tokenizer._tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(own[r["doc_id"]], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
            used[p["sequence_id"]] += p["length"]
        assert at == len(ids)
    assert max(used.values()) <= 2048 and sum(used.values()) / (2048 * len(used)) > 0.9


def test_op8_and_op2(spark, source):
    got = {r["doc_id"]: r for r in queries.op8_dac_tokens(spark, SF).collect()}
    tokenizer, at = WordTokenizer(), 0
    for r in sorted(source, key=lambda r: r["doc_id"]):
        ids = np.array(tokenizer._tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        assert (got[r["doc_id"]]["start"], got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    stored = {r["doc_id"]: r for r in queries.op2_media_columns(spark, SF).collect()}
    for r in source:
        data = (r["text"] or "").encode()
        data += b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        own = stored[r["doc_id"]]
        assert (own["payload_bytes"], own["payload_sha256"], own["tail_crc32"]) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))


def test_pipeline(spark, source):
    """Stage by stage, each on what its predecessor kept, and then the whole run."""
    docs, kept = read_table(spark, SF, "documents"), {}
    for number, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        kept[name] = out.collect()
        if number < 4:
            assert out.columns == docs.columns
            docs = out
    language, near, passages, mixed, packed = kept.values()
    assert {r["doc_id"] for r in language} == {r["doc_id"] for r in source if langid.has_letter(r["text"])}
    assert {r["doc_id"] for r in near} == brute_kept([(r["doc_id"], r["text"]) for r in language])
    first, want = {}, {}
    for r in sorted(near, key=lambda r: r["doc_id"]):
        w = r["text"].encode().split()
        gone = {p for k in range(len(w) - 12) if first.setdefault(tuple(w[k : k + 13]), r["doc_id"]) < r["doc_id"] for p in range(k, k + 13)}
        want[r["doc_id"]] = [x for k, x in enumerate(w) if k not in gone]
    assert {r["doc_id"]: r["text"].encode().split() for r in passages} == {k: v for k, v in want.items() if v}
    counts = Counter(r["doc_id"] for r in mixed)
    assert set(counts) <= {r["doc_id"] for r in passages} and max(counts.values()) <= 12
    ends = Counter(r["doc_id"] for r in packed if r["start"] + r["length"] == r["doc_tokens"])
    assert ends == counts
    whole = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in pipeline.run(spark, SF).collect())
    assert whole == Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed)
