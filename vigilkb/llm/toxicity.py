"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares two units (words; runs of single letters count as one word, so a spaced
insult is a unit too) by the letter triples that they share as subsequences.  A triple may
have gaps: it counts ``DECAY`` for every letter skipped, up to ``SPAN`` letters in all, so
inserted characters weaken a match and do not break it.  Case is folded, digits that stand
for letters are read as letters, and punctuation inside a unit is skipped.  The kernel is
divided by a norm that depends on the lengths of the two units.

Training: the sentences of a bounded sample of labelled documents bear their document's
label.  A machine with squared hinge loss is fitted on the units of the sentences, mapped
by Nyström onto the kernel values with ``LANDMARKS`` landmark units.  Then only those sentences
of a toxic document that hold a unit on the toxic side keep their label (its highest one
always does), and the machine is fitted again.

Scoring: the machine is a sum over landmarks of kernel values, and the kernel is a dot
product of triple weights, so the landmarks' triples are added up once into one table.
The value of a unit is then the same sum, taken from the table for all letters of a batch at
once.  A document's response is that of its highest unit, turned into a probability that was
fitted on the sample's documents.

Cases: a null or empty text, or one without units of three letters, gets the lowest response;
units of more than ``LONGEST`` letters are read through overlapping windows; repeated rows
and ids give one result row each; other columns are not read.  Without labelled rows of
both classes every score is the share of toxic labels (0.0 if there are none).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilkb.llm.common import blocks, held_out, labelled_sample, small_batches
from vigilkb.llm.linear import minimise, platt, sigmoid

#: Labelled rows that the machine is fitted on, and the longest text among them.
SAMPLE_ROWS = 3000
SAMPLE_CHARS = 20_000
#: Most distinct units and landmarks of a fit.
UNITS, LANDMARKS = 30_000, 160
DECAY, SPAN, LONGEST = 0.5, 6, 24
ROUNDS = 2
FLOOR = -3.0
#: Units need more codes than this, their start included.
SHORTEST = 3
THRESHOLD = 0.5

SCORES = "doc_id long, held_out boolean, score double, predicted int"

# letters are 1..26, letters of other scripts 27, digits without a reading 28, the start of a unit 29, e and a with
# an accent 30 and 31 (others are read as the plain letter); 0 is skipped, -1 is white space
_CODE = np.zeros(256, np.int8)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = 27
_CODE[0xC3] = 0
for _first, _letters in ((0x80, "aaaaaaaceeeeiiiidnooooo o uuuuyts"), (0xA0, "aaaaaaaceeeeiiiidnooooo o uuuuyty")):
    for _i, _c in enumerate(_letters[:32]):
        _CODE[_first + _i] = {"e": 30, "a": 31, " ": 0}.get(_c, ord(_c) - 96)
_START = 29
_CODE[48:58] = 28
for _digit, _letter in zip("013457", "oieast", strict=True):
    _CODE[ord(_digit)] = ord(_letter) - 96
_CODE[[0x20, *range(0x09, 0x0E)]] = -1
_STEPS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]
_DECAYS = np.array([DECAY ** (b - 2) for _, b in _STEPS], np.float32)
_LONG = np.arange(LONGEST + 1)
_NORM = np.sqrt(np.maximum(1e-9, sum(d * d * np.maximum(_LONG - b, 0) for (_, b), d in zip(_STEPS, _DECAYS, strict=True)))).astype(np.float32)
_TABLE = 32**3
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(letter codes, starts, lengths, text) of the units; long ones as overlapping windows."""
    code = _CODE[data]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    white = code == -1
    gap = np.cumsum(white)
    kept = code > 0
    letters, text, gap = code[kept], text[kept], gap[kept]
    none = np.zeros(0, np.int64)
    if not len(letters):
        return letters, none, none, none
    new = np.ones(len(letters), bool)
    new[1:] = (gap[1:] != gap[:-1]) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(starts, append=len(letters))
    # single letters in a row are one unit
    joins = np.zeros(len(starts), bool)
    joins[1:] = (sizes[1:] == 1) & (sizes[:-1] == 1) & (text[starts][1:] == text[starts][:-1])
    starts = starts[~joins]
    owners = text[starts]
    letters = np.insert(letters, starts, _START)
    starts = starts + np.arange(len(starts))
    sizes = np.diff(starts, append=len(letters))
    long = sizes > LONGEST
    if long.any():
        half = LONGEST // 2
        more, at = [letters], len(letters)
        extra_starts, extra_sizes, extra_text = [], [], []
        for s, n, o in zip(starts[long], sizes[long], owners[long], strict=True):
            for a in range(0, n - half, half):
                piece = letters[s + a : s + min(a + LONGEST, n)]
                more.append(piece)
                extra_starts.append(at)
                extra_sizes.append(len(piece))
                extra_text.append(o)
                at += len(piece)
        owners = np.concatenate([owners[~long], extra_text]).astype(np.int64)
        starts = np.concatenate([starts[~long], extra_starts]).astype(np.int64)
        sizes = np.concatenate([sizes[~long], extra_sizes]).astype(np.int64)
        return np.concatenate(more), starts, sizes, owners
    return letters, starts, sizes, owners


def _triples(letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
    """For each gap pattern: where its triples begin, their slots and their weight."""
    rest = np.full(len(letters), -1, np.int16)  # letters that follow within the unit
    order = np.argsort(starts, kind="stable")
    s, n = starts[order], sizes[order]
    at = np.repeat(s, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rest[at] = np.repeat(s + n, n) - at - 1
    wide = letters.astype(np.int32)
    first, second = wide << 10, wide << 5
    for (a, b), d in zip(_STEPS, _DECAYS, strict=True):
        n = len(wide) - b
        if n > 0:
            yield rest[:n] >= b, first[:n] + second[a : n + a] + wide[b : n + b], d


@dataclass
class Machine:
    table: np.ndarray
    offset: float
    slope: float
    shift: float

    def responses(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The machine's value of each unit."""
        total = np.zeros(len(letters), np.float32)
        for inside, slots, decay in _triples(letters, starts, sizes):
            total[: len(slots)] += self.table[slots] * inside * decay
        running = np.concatenate([[0.0], np.cumsum(total, dtype=np.float64)])
        out = (running[starts + sizes] - running[starts]) / _NORM[np.minimum(sizes, LONGEST)] + self.offset
        return np.where(sizes > SHORTEST, np.maximum(out, FLOOR), FLOOR)

    def highest(self, texts: pa.Array) -> np.ndarray:
        out = []
        for first, last, data, offsets in blocks(texts):
            letters, starts, sizes, owner = units(data, offsets)
            best = np.full(last - first, FLOOR)
            if len(starts):
                np.maximum.at(best, owner, self.responses(letters, starts, sizes))
            out.append(best)
        return np.concatenate(out) if out else np.zeros(0)

    def scores(self, texts: pa.Array) -> np.ndarray:
        return sigmoid(self.slope * self.highest(texts) + self.shift)


def _maps(words: list[bytes]) -> np.ndarray:
    """The kernel's feature vectors, divided by the norms."""
    out = np.zeros((len(words), _TABLE), np.float32)
    for i, w in enumerate(words):
        letters = np.frombuffer(w, np.int8)
        for inside, slots, decay in _triples(letters, np.array([0]), np.array([len(w)])):
            np.add.at(out[i], slots[inside], decay)
        out[i] /= _NORM[len(w)]
    return out


def _kernel(words: list[bytes], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values with the landmarks whose feature vectors are the columns of ``landmarks``."""
    letters = np.frombuffer(b"".join(words), np.int8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    unit = np.repeat(np.arange(len(words)), sizes)
    out = np.zeros((len(words), landmarks.shape[1]), np.float32)
    for inside, slots, decay in _triples(letters, starts, sizes):
        at = np.flatnonzero(inside)
        for a in range(0, len(at), 50_000):
            some = at[a : a + 50_000]
            first, begins = np.unique(unit[some], return_index=True)
            out[first] += decay * np.add.reduceat(landmarks[slots[some]], begins, axis=0)
    return out / _NORM[sizes][:, None]


def fit(rows: list[tuple[str, int]]) -> Machine:
    labels = np.array([y for _, y in rows])
    share = float(labels.mean()) if len(rows) else 0.0
    flat = Machine(np.zeros(_TABLE, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0))
    if share in (0.0, 1.0):
        return flat
    sentences = [(i, x) for i, (text, _) in enumerate(rows) for x in _SENTENCE.split(text) if x]
    owner = np.array([i for i, _ in sentences])
    names: dict[bytes, int] = {}
    of, within = [], []
    for first, _, data, offsets in blocks(pa.array([x for _, x in sentences], pa.large_string())):
        letters, starts, sizes, sentence = units(data, offsets)
        raw, fits = letters.tobytes(), sizes > SHORTEST
        of += [names.setdefault(raw[a : a + n], len(names)) for a, n in zip(starts[fits].tolist(), sizes[fits].tolist(), strict=True)]
        within.append(sentence[fits] + first)
    # one row per sentence and distinct unit
    pair = np.unique(np.concatenate(within) * len(names) + np.array(of)) if names else np.zeros(0, np.int64)
    if not len(pair):
        return flat
    within, of = pair // len(names), pair % len(names)
    often = np.bincount(of, minlength=len(names))
    toxic = np.bincount(of, labels[owner[within]], len(names))
    words = list(names)
    # the units of the fit: the most frequent ones, then by their letters
    chosen = sorted(range(len(words)), key=lambda k: (-often[k], words[k][::-1]))[:UNITS]
    place = np.full(len(names), -1)
    place[chosen] = np.arange(len(chosen))
    known = place[of] >= 0
    within, of = within[known], place[of[known]]
    often, toxic, words = often[chosen], toxic[chosen], [words[k] for k in chosen]
    # landmarks: units most typical of toxic sentences, and a spread of the others
    typical = np.argsort(-(toxic - share * often) / np.sqrt(often), kind="stable")[: LANDMARKS // 2]
    others = np.setdiff1d(np.arange(len(words))[:: max(1, len(words) // (LANDMARKS // 2))], typical)
    marks = _maps([words[k] for k in [*typical, *others]])
    gram = marks @ marks.T
    values, vectors = np.linalg.eigh(gram.astype(np.float64))
    good = values > 1e-5 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])  # the inverse square root, so that z.z' is the kernel
    z = _kernel(words, marks.T.copy()) @ root
    positive = labels[owner] == 1
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(ROUNDS):
        pos = np.bincount(of, positive[within], len(words))
        neg = np.bincount(of, ~positive[within], len(words))
        weight = 1.0 / max(1.0, (pos + neg).sum())

        def loss(p: np.ndarray, pos=pos, neg=neg, weight=weight) -> tuple[float, np.ndarray]:
            f = z @ p[:-1] + p[-1]
            up, down = np.maximum(0, 1 - f), np.maximum(0, 1 + f)
            value = weight * float((pos * up**2 + neg * down**2).sum()) + 1e-6 * float(p.dot(p))
            g = 2 * weight * (neg * down - pos * up)
            return value, np.append(z.T @ g, g.sum()) + 2e-6 * p

        p = minimise(loss, np.zeros(z.shape[1] + 1), 150)
        w, b = p[:-1], float(p[-1])
        f = z @ w + b
        best = np.full(len(owner), FLOOR)
        np.maximum.at(best, within, f[of])
        top = np.full(len(rows), -np.inf)
        np.maximum.at(top, owner, best)
        positive = (labels[owner] == 1) & ((best > 0) | (best >= top[owner]))
    table = ((root @ w) @ marks).astype(np.float32)
    machine = Machine(table, b, 1.0, 0.0)
    machine.slope, machine.shift = platt(machine.highest(pa.array([t for t, _ in rows], pa.large_string())), labels)
    return machine


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(labelled_sample(docs, labels.where(~held_out(F.col("doc_id"))), "toxic", SAMPLE_ROWS, SAMPLE_CHARS))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of ``SCORES`` per document; labels of held-out ids are not learnt from."""
    spark = docs.sparkSession
    small_batches(spark)
    machine = spark.sparkContext.broadcast(train(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = machine.value.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                [x.split()[0] for x in SCORES.split(", ")],
            )

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")).mapInArrow(score, SCORES)
