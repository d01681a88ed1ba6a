import numpy as np
import pytest

from tidelog.llm import setjoin, simhash

from .conftest import prose


def words_of(seed, n):
    return [f"{seed}w{k}" for k in range(n)]


def brute_kept(source):
    """Ids that stay: the smallest of each component of the pairs with a similarity of 0.8 or more."""
    sets = []
    for _, t in source:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(source)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 9 * len(x & y) >= 4 * (len(x) + len(y)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(source):
        least[find(i)] = min(least.get(find(i), d), d)
    return set(least.values())


def kept(spark, source):
    return {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(source, "doc_id long, text string")).collect()}


def test_a_repeated_line_does_not_merge_other_texts(spark):
    """pipeline: texts whose only common part is one line, a hundred times."""
    line = " ".join(words_of("line", 9)) + " "
    source = [(i, line * 100 + " ".join(words_of(f"d{i}", 150))) for i in range(6)] + [(i, "again " * 100 + " ".join(words_of(f"d{i}", 400))) for i in range(6, 12)]
    assert kept(spark, source) == set(range(12)) == brute_kept(source)


def test_repeats_and_short_texts(spark):
    """pipeline: a text and itself with its last words ten times more; texts of 8 and 9 words, at 0.8 exactly."""
    source = []
    for i in range(4):
        w = words_of(f"r{i}", 300)
        source += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w + w[-9:] * 10))]
    for i in range(10, 60):
        w = words_of(f"s{i}", 9)
        source += [(2 * i, " ".join(w[:8])), (2 * i + 1, " ".join(w))]
    assert kept(spark, source) == {d for d, _ in source if d % 2 == 0} == brute_kept(source)


def edited(words, r, count):
    out = list(words)
    for k in r.choice(len(out), count, replace=False):
        out[k] = f"e{r.integers(1 << 40)}"
    return " ".join(out)


def family(seed, texts, most):
    r = np.random.default_rng(seed)
    origin = words_of(f"f{seed}", 120)
    return [edited(origin, r, int(r.integers(0, most))) for _ in range(texts)]


def test_families_of_edited_texts(spark):
    """pipeline: similarities around 0.8, where links by way of a third text are rejected and direct ones hold."""
    source = list(enumerate(t for s in range(20) for t in family(s, 6, 6)))
    assert kept(spark, source) == brute_kept(source)


def test_crowded_shingles(spark, monkeypatch):
    """pipeline: families beyond the size to which all pairs are compared at once."""
    monkeypatch.setattr(setjoin, "FEW", 2)
    monkeypatch.setattr(setjoin, "ROUNDS", 1)
    source = list(enumerate(t for s in (1, 2) for t in family(s, 60, 8)))
    assert kept(spark, source) == brute_kept(source)


@pytest.mark.parametrize("n", [4, 9, 45, 500])
def test_every_pair_at_the_threshold_meets(n):
    """pipeline: whatever comes last, sets at 0.8 share a shingle of their prefixes and pass the bitmaps."""
    r = np.random.default_rng(n)
    for _ in range(200):
        both = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        own = n // 4 if n % 4 == 0 else n * 9 // 4 // 9
        cut = int(r.integers(0, own + 1))
        more = r.integers(0, 1 << 63, own, dtype=np.uint64)
        a, b = np.unique(np.append(both, more[:cut])), np.unique(np.append(both, more[cut:]))
        assert 9 * n >= 4 * (len(a) + len(b))
        often = np.sort(r.choice(both, n // 2, replace=False))
        times = r.integers(4, 9, len(often))
        assert np.intersect1d(setjoin.prefix(a, often, times), setjoin.prefix(b, often, times)).size
        assert setjoin.parity_distance(setjoin.parities(a), setjoin.parities(b)) <= own
