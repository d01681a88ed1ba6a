"""Language identification by cross-parsing entropy.

A language's model is the suffix automaton of a labelled sample. A text is parsed greedily into the longest phrases that
occur in the sample; with c phrases for n symbols and a sample of N symbols, c * log2(N) / n estimates the bits that a
symbol costs, and the language with the fewest wins. Parsing needs only the automaton's forward moves, so an automaton
becomes a dense table whose failing moves restart at the root and count a phrase, and a whole batch of texts moves
through it together, one numpy step for each symbol position. Texts are parsed whole, in segments of SEGMENT symbols
that each start anew.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import free
from tidelog.llm.tokens import small_batches

#: Bounds of the labelled sample: documents and bytes for each language, and bytes in all.
SAMPLE_DOCS = 64
SAMPLE_BYTES = 16_384
SAMPLE_TOTAL = 1 << 21
#: Languages that are learned, the most frequent ones; each costs its automaton and a pass over every text.
LANGUAGES = 256
PIECE = 256
SEGMENT = 1024
BATCH = 2 << 20
UNDETERMINED = "und"
#: A label is contradicted where its language takes CLEARLY times the bits of the predicted one, over the whole text and in
#: lines that hold AGREEING of the bytes of its distinct lines, LEAST_BYTES at least.
CLEARLY = 1.5
AGREEING = 2 / 3
LEAST_BYTES = 128
_LETTER = re.compile(r"[^\W\d_]")
_FLAG = 1 << 29


def _symbols(data: bytes) -> np.ndarray:
    """Bytes with A-Z lower-cased and all other ASCII but letters as one separator."""
    return np.frombuffer(data.translate(_CLASSES), np.uint8)


_CLASSES = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower())


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Moves of each state of the minimal automaton of all substrings."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and s not in moves[p]:
            moves[p][s] = new
            p = link[p]
        if p != -1:
            q = moves[p][s]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and moves[p].get(s) == q:
                    moves[p][s] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return moves


@dataclass
class Model:
    """The table of one language: entry [state * width + class] is the next state * width, plus _FLAG for each phrase
    that ended. A symbol that the sample lacks is a phrase by itself."""

    table: np.ndarray
    classes: np.ndarray
    bits: float

    @classmethod
    def of(cls, sample: bytes) -> Model:
        symbols = _symbols(sample)
        present = np.unique(symbols)
        width = len(present) + 1
        classes = np.full(256, len(present), np.uint8)  # the last class: never seen, always fails
        classes[present] = np.arange(len(present))
        moves = suffix_automaton(classes[symbols].tolist())
        root = np.full(width, _FLAG, np.int32)
        for s, to in moves[0].items():
            root[s] = to * width + _FLAG
        table = np.tile(root, (len(moves), 1))
        table[1:][:, table[0] == _FLAG] += _FLAG  # the phrase before an unknown symbol, and the symbol
        states = np.repeat(np.arange(len(moves)), [len(m) for m in moves])
        table[states, [s for m in moves for s in m]] = np.array([to for m in moves for to in m.values()], dtype=np.int32) * width
        return cls(table.ravel(), classes, float(np.log2(max(2, len(symbols)))))


def phrases(model: Model, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Phrases of each segment; segments come by falling length."""
    state, count = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
    coded = model.classes[symbols]
    rows = np.zeros((SEGMENT, len(starts)), np.uint8)
    for k, (a, n) in enumerate(zip(starts.tolist(), lengths.tolist(), strict=True)):
        rows[:n, k] = coded[a : a + n]
    active = np.searchsorted(-lengths, -np.arange(SEGMENT), side="left")
    for t in range(int(lengths[0]) if len(lengths) else 0):
        m = active[t]
        moved = model.table.take(state[:m] + rows[t, :m])
        count[:m] += moved >> 29
        np.bitwise_and(moved, _FLAG - 1, out=state[:m])
    return count + (state != 0)


def has_letter(text: str | None) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def rates(models: dict[str, Model], texts: list[str | None]) -> np.ndarray:
    """Bits a symbol of each text (rows) in each language; 0 symbols: 0."""
    data = [(t or "").encode() for t in texts]
    sizes = np.array([len(d) for d in data], np.int64)
    symbols = _symbols(b"".join(data))
    per = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(data)), per)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    starts = np.repeat(np.cumsum(sizes) - sizes, per) + inner * SEGMENT
    lengths = np.minimum(SEGMENT, sizes[owner] - inner * SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    out = np.zeros((len(data), len(models)))
    for j, model in enumerate(models.values()):
        c = np.bincount(owner[order], weights=phrases(model, symbols, starts[order], lengths[order]), minlength=len(data))
        out[:, j] = c * model.bits / np.maximum(1, sizes)
    return out


def learnable(id_col: Column) -> Column:
    """crc32(id as text) mod 3 is not 1; a null id is not learned from."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 != 1


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A bounded sample of labelled text for each language.

    Documents are drawn by a hash of their id, below a threshold that leaves about 2 * SAMPLE_DOCS for each language, and
    give one piece of PIECE characters each, at a hashed place. Only these pieces reach the driver, for LANGUAGES languages at
    most (the most frequent; ties to the first by name). Null ids, texts and labels and empty texts teach nothing; of equal
    ids each row counts; an empty table teaches nothing.
    """
    own = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(F.col("l").isNotNull() & (F.length("t") > 0) & learnable(F.col("i")))
    counts = {r["l"]: r["n"] for r in own.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(LANGUAGES).collect()}
    if not counts:
        return {}
    each = max(1024, min(SAMPLE_BYTES, SAMPLE_TOTAL // len(counts)))
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, 2 * SAMPLE_DOCS / n)) for k, n in counts.items()], "l string, share double")
    order = F.shiftrightunsigned(F.xxhash64("i"), 11) / F.lit(float(1 << 53))
    place = 1 + F.pmod(F.xxhash64(F.lit("piece"), F.col("i")), F.greatest(F.length("t") - PIECE + 1, F.lit(1)))
    drawn = own.join(F.broadcast(shares), "l").where(order < F.col("share")).select("l", order.alias("o"), F.substring("t", place, F.lit(PIECE)).alias("piece"))
    by: dict[str, list[str]] = {}
    for r in sorted(drawn.collect(), key=lambda r: (r["l"], r["o"], r["piece"])):
        by.setdefault(r["l"], []).append(r["piece"])
    return {k: b"\n".join(p.encode() for p in v[:SAMPLE_DOCS])[:each] for k, v in sorted(by.items())}


_MODELS: dict[tuple, dict[str, Model]] = {}


def _models(samples: dict[str, bytes]) -> dict[str, Model]:
    """Built once in each worker process."""
    key = tuple(sorted(samples.items()))
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = {k: Model.of(v) for k, v in sorted(samples.items())}
    return _MODELS[key]


def _predicted(models: dict[str, Model], texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text."""
    names = [*models, UNDETERMINED]
    known = np.array([bool(models) and has_letter(t) for t in texts], bool)
    best, score = np.full(len(texts), len(models)), np.zeros(len(texts))
    if known.any():
        found = rates(models, [t if k else None for t, k in zip(texts, known, strict=True)])
        two = np.sort(found, axis=1)[:, :2]
        sure = two[:, 1] / np.maximum(two.sum(axis=1), 1e-300) if found.shape[1] > 1 else np.ones(len(texts))
        best, score = np.where(known, found.argmin(axis=1), len(models)), np.where(known, sure, 0.0)
    return [names[i] for i in best.tolist()], score


def predict(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """All columns of `docs` and _lid_lang, _lid_score (with more underscores where `docs` has such columns), without a shuffle.

    The score is r2 / (r1 + r2) for the fewest and second-fewest bits a symbol (1 with one language). Null texts and
    texts without a letter are `und` with score 0, as are all when nothing was learned; ties go to the first language by
    name; repeated rows come out as often as they went in; an empty table gives an empty result; other columns are passed
    on unread.
    """
    lang, sure = free(docs, "_lid_lang"), free(docs, "_lid_score")
    schema = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(sure)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(samples)
        for batch in small_batches(batches, text_col, BATCH):
            found, score = _predicted(models, batch.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found), pa.array(score)], [*batch.schema.names, lang, sure])

    return docs.mapInArrow(run, schema)


def _contradicts(models: dict[str, Model], text: str, label: str, other: str) -> bool:
    """Whether a text is clearly in another language than its label. Lines count by themselves, so that one long phrase
    that a sample happens to hold (a common line) does not speak for the rest."""
    names = list(models)
    a, b = names.index(label), names.index(other)
    lines = [text, *{x for x in text.split("\n") if has_letter(x)}]
    found = rates(models, lines)
    clear = found[:, a] >= CLEARLY * found[:, b]
    sizes = np.array([len(x.encode()) for x in lines[1:]], np.int64)
    agreeing = int(sizes[clear[1:]].sum())
    return bool(clear[0]) and agreeing >= max(LEAST_BYTES, AGREEING * int(sizes.sum()))


def decide(docs: DataFrame, samples: dict[str, bytes], text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The columns of `docs`, with the language of each text for its label; texts without a language are dropped: null ones,
    those without a letter, and all when nothing was learned.

    A null label becomes the prediction. A label is kept unless the text clearly contradicts it (see CLEARLY); a label of
    which no sample was learned cannot be judged and is kept, and a text that is itself in its label's sample speaks for it.
    Rows with equal texts and labels fare alike, so repeated rows stay repeated. One pass, by one worker a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = _models(samples)
        for batch in small_batches(batches, text_col, BATCH):
            texts, said = batch.column(text_col).to_pylist(), batch.column(lang_col).to_pylist()
            predicted, _ = _predicted(models, texts)
            for k, (label, other) in enumerate(zip(said, predicted, strict=True)):
                if other != UNDETERMINED and (label is None or label != other and label in models and _contradicts(models, texts[k], label, other)):
                    said[k] = other
            at = batch.schema.get_field_index(lang_col)
            out = batch.set_column(at, batch.schema.field(at), pa.array(said, batch.schema.field(at).type))
            yield out.filter(pa.array([p != UNDETERMINED for p in predicted], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
