"""Quality rules: counted base rules and a calibrated n-gram logistic regression.

A text's features are hashed word 1- and 2-grams and character (byte) 3- and 5-grams.
Each family counts with its share of the text, so the linear score is the mean weight of
the word grams plus that of the character grams: one table look-up per gram and no sparse
vectors.  The model is fitted on a bounded sample of labelled rows and calibrated on a part
of it that the fit has not seen; the thresholds are fixed.

Cases: a null or empty text has no words and fails the base rule; repeated rows and ids
give one result row each; other columns of the input are not read.  Without labelled rows
of both classes the model says 1.0 and only the base rules decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vigilkb.llm.common import blocks, labelled_sample, mix, per_text, run_hashes, runs, small_batches
from vigilkb.llm.linear import minimise, platt, sigmoid

#: Labelled rows that the model is fitted on, and the longest text among them.
SAMPLE_ROWS = 1500
SAMPLE_CHARS = 50_000
#: Fixed thresholds.
LEAST_WORDS, MOST_REPEATED, LEAST_QUALITY = 50, 50, 0.5

_BITS = 17
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_CONTINUED = (np.arange(256) & 0xC0) == 0x80
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, quality double"
)


@dataclass
class Model:
    words: np.ndarray
    chars: np.ndarray
    offset: float
    slope: float
    shift: float


def _slots(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> np.uint64(64 - _BITS)).astype(np.int32)


def _grams(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, at: np.ndarray):
    """For both families: slots of the grams and where each text's begin."""
    n, of = len(hashes), np.repeat(np.arange(len(at) - 1), np.diff(at))
    pair = _slots(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])[of[:-1] == of[1:]] if n > 1 else np.zeros(0, np.int32)
    owner = np.concatenate([of, of[:-1][of[:-1] == of[1:]]]) if n > 1 else of
    yield np.concatenate([_slots(hashes), pair]), owner, len(at) - 1
    wide = data.astype(np.uint32)
    texts = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    slots, owners = [], []
    for n, keys in ((3, (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)), (5, (0x27D4EB2F, 0x165667B1, 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))):
        if len(wide) >= n:
            h = np.full(len(wide) - n + 1, n, np.uint32)
            for i, key in enumerate(keys):
                h += wide[i : len(wide) - n + 1 + i] * np.uint32(key)
                h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            same = texts[: len(h)] == texts[n - 1 :]
            slots.append((h >> np.uint32(32 - _BITS)).astype(np.int32)[same])
            owners.append(texts[: len(h)][same])
    empty = np.zeros(0, np.int32)
    yield np.concatenate([empty, *slots]), np.concatenate([empty, *owners]), len(offsets) - 1


def _read(texts: pa.Array):
    """Blocks with their words: (first row, last row, bytes, offsets, word starts, hashes, word positions of the texts)."""
    for first, last, data, offsets in blocks(texts):
        starts, ends = runs(~_SPACE[data], offsets)
        yield first, last, data, offsets, run_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def fit(rows: list[tuple[str, int]]) -> Model | None:
    labels = np.array([y for _, y in rows])
    learn = np.arange(len(rows)) % 4 != 3
    if len(set(labels[learn].tolist())) < 2:
        return None
    size = 1 << _BITS
    cols, vals, owners = [], [], []
    for first, _, data, offsets, hashes, at in _read(pa.array([t for t, _ in rows], pa.large_string())):
        for family, (slots, owner, n) in enumerate(_grams(data, offsets, hashes, at)):
            count = np.bincount(owner, minlength=n)
            keys, times = np.unique(owner.astype(np.int64) * size + slots, return_counts=True)
            text = keys // size
            cols.append((keys % size + family * size).astype(np.int32))
            vals.append((times / count[text]).astype(np.float32))
            owners.append((text + first).astype(np.int32))
    cols, vals, owners = map(np.concatenate, (cols, vals, owners))
    weight = np.where(learn, 1.0 / learn.sum(), 0.0)

    def margins(w: np.ndarray) -> np.ndarray:
        return np.bincount(owners, vals * w[cols], len(rows)) + w[-1]

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = margins(w)
        g = (sigmoid(z) - labels) * weight
        value = float((weight * (np.logaddexp(0, z) - labels * z)).sum()) + 1e-6 * float(w.dot(w))
        return value, np.append(np.bincount(cols, vals * g[owners], 2 * size), g.sum()) + 2e-6 * w

    w = minimise(loss, np.zeros(2 * size + 1), 40)
    z = margins(w)
    slope, shift = platt(z[~learn], labels[~learn])
    return Model(w[:size].astype(np.float32), w[size:-1].astype(np.float32), float(w[-1]), slope, shift)


def _repeated(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word: is it in a 3-word window that its text has twice or more?"""
    covered = np.zeros(len(hashes), bool)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = np.flatnonzero(of[:-2] == of[2:]) if len(of) > 2 else np.zeros(0, np.int64)
    key = mix(
        hashes[inside] * np.uint64(0x9E3779B97F4A7C15)
        + mix(hashes[inside + 1] + np.uint64(0x632BE59BD9B4E019))
        + mix(hashes[inside + 2] ^ of[inside].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(3)
    )
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    for i in range(3):
        covered[inside[twice] + i] = True
    return covered


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += bool(line.strip())
        else:
            seen.add(line)
    return n


def judge(texts: pa.Array, model: Model | None) -> dict[str, np.ndarray]:
    """The base counts and the verdict of each text."""
    out: dict[str, list[np.ndarray]] = {}
    for _, _, data, offsets, hashes, at in _read(texts):
        n_words = np.diff(at)
        repeated = per_text(_repeated(hashes, at), at)
        z = np.full(len(n_words), model.offset if model else 0.0)
        if model:
            for w, (slots, owner, n) in zip((model.words, model.chars), _grams(data, offsets, hashes, at), strict=True):
                z += np.bincount(owner, w[slots], n) / np.maximum(np.bincount(owner, minlength=n), 1)
        raw = data.tobytes()
        cols = {
            "n_words": n_words,
            "word_chars": per_text(~_SPACE[data] & ~_CONTINUED[data], offsets),
            "n_symbols": per_text(_SYMBOL[data], offsets),
            "n_dup_lines": np.array([_dup_lines(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64),
            "n_repeat_words": repeated,
            "base_failed": (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words),
            "quality": sigmoid(model.slope * z + model.shift) if model else np.ones(len(n_words)),
        }
        cols["kept"] = ~cols["base_failed"] & (cols["quality"] >= LEAST_QUALITY)
        for k, v in cols.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    return fit(labelled_sample(docs, labels, "quality", SAMPLE_ROWS, SAMPLE_CHARS))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of ``SCHEMA`` per document."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cols = judge(batch.column(1), model.value)
                names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(cols[k]) for k in names]], ["doc_id", *names])

    return docs.select("doc_id", "text").mapInArrow(score, SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(at), model.value)["kept"]))

    return docs.mapInArrow(sift, docs.schema)
