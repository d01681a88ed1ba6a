"""Whole texts to token ids with a public tokenizer, one distinct word at a time.

The tokenizer's normaliser and splitter never look across ASCII white space, so a text's ids are the concatenated ids of
its words. Each batch encodes every distinct new word once; words are joined by a special token whose id then marks
their ends. `encode` equals `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BATCH_BYTES = 2 << 20
#: Bytes of words and ids that a process remembers; beyond that, words that the last batch lacks are forgotten.
CACHED_BYTES = 16 << 20
_SEPARATOR = "<|endoftext|>"
_JOINED = 256


def _gather(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs pool[start : start + size], one after another."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class WordTokenizer:
    """path: a tokenizers file; by default the installed public vocabulary."""

    def __init__(self, path: str | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self._tokenizer = Tokenizer.from_file(path)
        self._separator = self._tokenizer.token_to_id(_SEPARATOR)
        self._words = pa.array([], pa.large_string())
        self._ids, self._ends = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, and how many each has. Words that may hold special tokens are encoded one by one."""
        special = pc.match_substring(words, "<|").to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~special)).to_pylist()
        chunks = [_SEPARATOR.join(plain[i : i + _JOINED]) for i in range(0, len(plain), _JOINED)]
        pools, sizes = [], []
        for e in self._tokenizer.encode_batch_fast(chunks, add_special_tokens=False):
            ids = np.array(e.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self._separator), len(ids))
            sizes.append(np.diff(ends, prepend=-1) - 1)
            pools.append(np.delete(ids, ends[:-1]))
        odd = [self._tokenizer.encode(w, add_special_tokens=False).ids for w in words.filter(pa.array(special)).to_pylist()]
        order = np.argsort(np.concatenate([np.flatnonzero(~special), np.flatnonzero(special)]))
        pool = np.concatenate([*pools, *[np.array(x, "<u4") for x in odd], np.zeros(0, "<u4")])
        size = np.concatenate([*sizes, np.array([len(x) for x in odd], np.int64)]).astype(np.int64)
        return (_gather(pool, (np.cumsum(size) - size)[order], size[order]), size[order]) if odd else (pool, size)

    def _lookup(self, words: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, and where in it each of these distinct words begins and how many it has. Words that occur `often`
        are remembered."""
        at = pc.fill_null(pc.index_in(words, value_set=self._words), -1).to_numpy(zero_copy_only=False)
        missing = at < 0
        new_words = words.filter(pa.array(missing))
        new_ids, new_sizes = self._new(new_words)
        pool = np.concatenate([self._ids, new_ids])
        sizes, starts = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        known = np.diff(self._ends, prepend=0)
        sizes[~missing], starts[~missing] = known[at[~missing]], (self._ends - known)[at[~missing]]
        sizes[missing], starts[missing] = new_sizes, len(self._ids) + np.cumsum(new_sizes) - new_sizes
        if self._words.nbytes + self._ids.nbytes + self._ends.nbytes > CACHED_BYTES:
            kept = often
            self._words, self._ids, self._ends = words.filter(pa.array(kept)), _gather(pool, starts[kept], sizes[kept]), np.cumsum(sizes[kept])
        else:
            kept = often & missing
            self._words = pa.concat_arrays([self._words, words.filter(pa.array(kept))])
            self._ids = np.concatenate([self._ids, _gather(pool, starts[kept], sizes[kept])])
            self._ends = np.concatenate([self._ends, (self._ends[-1] if len(self._ends) else 0) + np.cumsum(sizes[kept])])
        return pool, starts, sizes

    @staticmethod
    def _plainer(texts: pa.Array) -> pa.Array:
        """Fewer distinct words, equal ids: A-Z lower-cased, and a space between an ASCII letter and a lone . or , after it.

        The tokenizer lower-cases too, and splits letters from marks. Texts that may hold special tokens stay as they are.
        """
        fewer = pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z])([.,])([ \n])", r"\1 \2\3")
        return pc.if_else(pc.match_substring(texts, "<|"), texts, fewer)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text followed by END_ID, and the offsets of the texts. Null: an empty text."""
        own = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy: ascii_lower garbles slices
        words = pc.ascii_split_whitespace(self._plainer(pc.fill_null(own, "")))
        flat = words.flatten().dictionary_encode()
        which = flat.indices.to_numpy(zero_copy_only=False)
        pool, starts, sizes = self._lookup(flat.dictionary, np.bincount(which, minlength=len(flat.dictionary)) > 1)
        ids = _gather(pool, starts[which], sizes[which])
        ends = np.cumsum(sizes[which])
        by_word = np.concatenate([[0], ends])
        by_text = by_word[words.offsets.to_numpy() - words.offsets[0].as_py()] if len(texts) else np.zeros(1, dtype=np.int64)
        return np.insert(ids, by_text[1:], END_ID), by_text + np.arange(len(by_text))


_RETURNED = False


def return_memory() -> None:
    """Let this worker give large freed blocks back to the system at once. Workers live on from task to task, and what one
    operator's batches took would else stay with them, beside what the next one needs."""
    global _RETURNED
    if not _RETURNED:
        _RETURNED = True
        pa.set_memory_pool(pa.system_memory_pool())
        with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
            ctypes.CDLL("libc.so.6").mallopt(_MMAP_THRESHOLD, 1 << 20)


#: glibc's name for the size from which a block is mapped by itself; setting it also stops glibc from raising it.
_MMAP_THRESHOLD = -3


def small_batches(batches: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of about `limit` bytes of text (one row at least), whatever the size of the batches that Spark sends."""
    return_memory()
    for batch in batches:
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


_TOKENIZERS: dict[str | None, WordTokenizer] = {}


def tokenizer(path: str | None = None) -> WordTokenizer:
    """One tokenizer for each process, so that its cache outlives a task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]
