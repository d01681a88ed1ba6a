"""Word shingles of whole texts as hashes."""

from __future__ import annotations

from itertools import accumulate

import numpy as np

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the lower-cased (A-Z) text; fewer words: of the whole sequence."""
    import xxhash

    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = list(accumulate(map(len, found), lambda at, n: at + n + 1))
    starts = [0, *[e + 1 for e in ends[:-1]]]
    spans = zip(starts, ends[words - 1 :] or ends[-1:], strict=False)
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype=np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Distinct shingle hashes, ascending."""
    return np.unique(shingle_hashes(text, words))
