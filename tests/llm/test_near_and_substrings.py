import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import simhash, substrings
from tidelog.llm.graph import components

from .conftest import prose, rows


def brute_groups(fps, ids, budget):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (int.from_bytes(fps[i], "big") ^ int.from_bytes(fps[j], "big")).bit_count() <= budget:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_hashes_match_the_definition():
    import xxhash

    text = "The  CAT\tsat\n on Ünder"
    want = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ("the cat sat", "cat sat on", "sat on Ünder".replace("Ü", "Ü"))]
    assert simhash.shingle_hashes(text, 3).tolist() == want
    assert simhash.shingle_hashes("A b", 3).tolist() == [xxhash.xxh64_intdigest(b"a b", 42)]
    assert simhash.fingerprint(None, 3) == simhash.fingerprint(" \n", 3) == bytes(8)


def test_bits_are_a_strict_majority():
    h = simhash.shingle_hashes(prose(1, 700), 3)
    want = sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h))
    assert int.from_bytes(simhash.fingerprint(prose(1, 700), 3), "big") == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**10 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 3))
def test_trie_join_equals_brute_force(low, budget):
    values = np.array(sorted(v << 30 | 7 for v in low), np.uint64)
    node = np.array([[0, len(values)]])
    i, j = simhash.trie_join(values, node, node, np.zeros(1, np.int64), 10, budget)
    root = np.arange(len(values))
    simhash._join_all(root, i, j)
    fps = [int(v).to_bytes(8, "big") for v in values]
    assert root.tolist() == brute_groups(fps, range(len(fps)), budget)
    assert all((int(values[a]) ^ int(values[b])).bit_count() <= budget for a, b in zip(i, j)) and len(i) == len(set(range(len(root)))) - len(set(root.tolist()))


@pytest.mark.parametrize("cap", [2048, 1])
def test_near_duplicates(docs, crowded, cap):
    spec = simhash.Spec(3, 2, simhash.CONTRACT.tables, cap=cap)
    source = rows()
    fps = [simhash.fingerprint(r[1], 3) for r in source]
    want = Counter(zip([r[0] for r in source], fps, brute_groups(fps, [r[0] for r in source], 2)))
    for frame in (docs, crowded):
        got = simhash.near_duplicates(frame, spec).collect()
        assert Counter((r["doc_id"], bytes(r["fp"]), r["component_id"]) for r in got) == want


def ball(radius, count, seed):
    """Distinct values within `radius` bits of zero."""
    r, values = np.random.default_rng(seed), {0}
    while len(values) < count:
        values.add(sum(1 << int(b) for b in r.choice(64, radius, replace=False)))
    return sorted(values)


@pytest.mark.parametrize("cap", [1 << 30, 64, 8, 1])
def test_links_do_not_depend_on_the_cap(spark, cap):
    """Fingerprints around two values, one subtrie holding most: pairs of nodes over the cap are cut by the cluster."""
    values = sorted(set(ball(3, 250, 3)) | {v ^ 0xFFFF for v in ball(2, 100, 4)} | {int(x) for x in np.random.default_rng(5).integers(0, 1 << 63, 100)})
    fps = [v.to_bytes(8, "big") for v in values]
    nodes = spark.createDataFrame([(bytearray(f),) for f in fps], "fp binary")
    edges = simhash.links(nodes, simhash.Spec(3, 2, simhash.CONTRACT.tables, cap=cap))
    assert all((int.from_bytes(r["a"], "big") ^ int.from_bytes(r["b"], "big")).bit_count() <= 2 for r in edges.collect())
    roots = {bytes(x["node"]): bytes(x["root"]) for x in components(edges).collect()}
    assert [fps.index(roots.get(f, f)) for f in fps] == brute_groups(fps, range(len(fps)), 2)


def test_links_need_enough_blocks(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(bytearray(8),)], "fp binary"), simhash.Spec(3, 3, simhash.CONTRACT.tables))


def test_keep_one(docs, empty, crowded):
    kept = simhash.keep_one(docs)
    out = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert kept.columns == docs.columns
    ids = {d for d, _ in out}
    assert 3 in ids and not {20, 21, 22} & ids and 1 in ids and {0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 24, 25, 30} <= ids
    assert max(out.values()) == 1 and (31, prose(1, 41)) not in out and (31, prose(200, 50)) in out
    assert simhash.keep_one(empty).count() == 0
    assert simhash.keep_one(crowded).columns == crowded.columns and simhash.keep_one(crowded).count() == kept.count()


def test_repeated_row_stays_once(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "x y z u v w")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 2]


def test_doubtful_pairs_are_compared_exactly(spark):
    """Edits that leave a similarity just above and just below 0.8."""
    source, want = [], {}
    for i in range(30):
        a = prose(f"j{i}", 300).split()
        b = list(a)
        for k in range(4 + i % 10):
            b[7 + k * 20] = f"new{k}"
        sets = [{tuple(w[x : x + 5]) for x in range(296)} for w in (a, b)]
        similar = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        source += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
        want[2 * i + 1] = similar < 0.8
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(source, "doc_id long, text string")).collect()}
    assert set(range(0, 60, 2)) <= kept and all(i in kept for i, apart in want.items() if apart)
    assert sum(i in kept for i, apart in want.items() if not apart) <= 2 and 5 < sum(want.values()) < 25


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges).collect()}
    assert roots == {i: 0 for i in range(1, 41)} | {101: 100}


def brute_removal(source, window):
    """First ids of windows, then words of each row outside repeated windows."""
    first = {}
    for d, t, *_ in source:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1 if d is not None else 0):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, t, *_ in source:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[k : k + window])] < d:
                gone.update(range(k, k + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((d, len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("held", [1 << 18, 16])
def test_substrings(docs, crowded, empty, held, monkeypatch):
    monkeypatch.setattr(substrings, "HELD", held)
    want = brute_removal(rows(), 13)
    assert sum(k[2] for k in want) > 100
    assert Counter(map(tuple, substrings.digests(docs).collect())) == want
    assert Counter(map(tuple, substrings.digests(crowded).collect())) == want
    assert substrings.digests(empty).count() == 0


def test_windows_that_only_just_repeat(spark):
    """Exactly 13 words, one less, and a window that crosses two earlier documents."""
    a, b = prose("a", 30).split(), prose("b", 30).split()
    texts = [" ".join(a), " ".join(b), " ".join(["x1"] + a[5:18] + ["x2"]), " ".join(["y1"] + a[5:17] + ["y2"]), " ".join(a[10:30] + b[:15]), "q " * 40, "q " * 13, "Q " * 13]
    source = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(source, "doc_id long, text string")
    got = Counter(map(tuple, substrings.digests(df).collect()))
    assert got == brute_removal(source, 13)
    by = {k[0]: k[2] for k in got}
    assert (by[2], by[3], by[4], by[6], by[7]) == (13, 0, 35, 13, 0)


def test_remove_duplicates_keeps_other_columns(crowded):
    out = substrings.remove_duplicates(crowded)
    assert out.columns == crowded.columns and out.count() == crowded.count()
    kept = {r["doc_id"]: r["text"] for r in out.collect()}
    assert kept[20] == "" and kept[0] == rows()[0][1] and kept[26] is None


def test_pieces_become_factors():
    """Pieces that go on from each other are one factor; others begin where their first window does; twice counts once."""
    got = substrings.joined_factors([0, 3, 3, 5, 20, 40], [3, 2, 2, 4, 1, 1], [1, 1, 1, 2, 2, 9], [7, 10, 10, 0, 15, 0])
    assert got == [(0, 17, 1, 7), (5, 16, 2, 0), (20, 13, 2, 15), (40, 13, 9, 0)]
    assert substrings.kept_words(" ".join(map(str, range(60))), got)[1] == [b"33", b"34", b"35", b"36", b"37", b"38", b"39", *[str(k).encode() for k in range(53, 60)]]


def longest_factors(source, window):
    """Greedy parse by brute force: from the first word that starts a repeated window, the longest match in one earlier
    document; then from the first repeated window that is not inside the factor."""
    words = {d: (t or "").split() for d, t in source}
    out = []
    for d, w in words.items():
        s = 0
        while s + window <= len(w):
            best = (0, 0, 0)
            for r, v in words.items():
                if r < d:
                    for p in range(len(v) - window + 1):
                        n = 0
                        while s + n < len(w) and p + n < len(v) and w[s + n] == v[p + n]:
                            n += 1
                        best = max(best, (n, -r, -p))
            if best[0] >= window:
                out.append((d, s, best[0], -best[1], -best[2]))
                s += best[0] - window + 1
            else:
                s += 1
    return sorted(out)


@pytest.mark.parametrize("held", [1 << 18, 16])
def test_factors_are_the_longest_matches(spark, held, monkeypatch):
    """Passages with one source each: the parse equals the greedy one by brute force, boundaries included."""
    monkeypatch.setattr(substrings, "HELD", held)
    p = {k: prose(f"p{k}", 40).split() for k in "abcde"}
    texts = [
        " ".join(p["a"] + ["x0"] + p["b"]), " ".join(p["c"] + p["d"]), prose("own", 60), " ".join(["y"] + p["a"][5:30] + ["z"] + p["c"][10:40] + p["d"][:25]),
        " ".join(p["a"][20:40] + ["x0"] + p["b"][:7]), " ".join(p["e"]), " ".join(p["b"][30:] + p["e"][:13] + p["d"][27:]), None, "",
    ]
    source = list(enumerate(texts))
    df = spark.createDataFrame(source, "doc_id long, text string").repartition(5)
    assert sorted(map(tuple, substrings.parse(df).collect())) == longest_factors(source, 13)


def test_factors_copy_their_reference(docs):
    """Of any documents: a factor's words stand in its reference, which has a smaller id, and factors cover the repeated windows."""
    texts = {}
    for d, t, *_ in rows():
        texts.setdefault(d, []).append((t or "").split())
    found = substrings.parse(docs).collect()
    assert found
    for f in found:
        assert f["ref_id"] < f["doc_id"] and f["length"] >= 13
        mine = [w[f["start"] : f["start"] + f["length"]] for w in texts[f["doc_id"]]]
        theirs = [w[f["ref_start"] : f["ref_start"] + f["length"]] for w in texts[f["ref_id"]]]
        assert any(len(m) == f["length"] and m in theirs for m in mine)


def test_partitions_follow_the_bytes(spark, docs, monkeypatch):
    monkeypatch.setattr(substrings, "PART_BYTES", 20_000)
    assert substrings._parts(docs, "text") > 4
    assert Counter(map(tuple, substrings.digests(docs).collect())) == brute_removal(rows(), 13)


def test_names_of_its_own_in_the_input(docs):
    clash = docs.selectExpr("*", "1 as _sub_id", "'a' as _sub_blob", "2 as _SUB_bucket", "3 as own_5")
    out = substrings.remove_duplicates(clash)
    assert out.columns == clash.columns
    assert out.select(*docs.columns).exceptAll(substrings.remove_duplicates(docs)).count() == 0 and out.where("_sub_id = 1 and _sub_blob = 'a' and own_5 = 3").count() == clash.count()


def test_keep_one_with_names_of_its_own(docs):
    clash = docs.selectExpr("*", "1 as sim_id", "'a' as sim_crc", "2 as sim_of", "3 as _sim_of")
    out = simhash.keep_one(clash)
    assert out.columns == clash.columns and out.count() == simhash.keep_one(docs).count()
