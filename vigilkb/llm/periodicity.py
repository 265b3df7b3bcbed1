"""Runs of repeated word sequences, by a suffix automaton with link-cut access.

A run is a stretch of consecutive words with smallest period q and length >= ``max(LEAST_WORDS,
LEAST_EXPONENT * q)`` that no neighbouring word extends with that period.

The words of a stretch are appended one by one to a suffix automaton.  Its suffix links form a
tree, kept as link-cut paths: the states of one path have the same last end in the text, which
is the path's colour.  Appending word i accesses the new state, and every suffix of the stretch
so far gets the colour i.  On the way to the root the access meets the segments of other
colours; a segment of colour e whose deepest state has length m says that the m last words
also ended at e, and not later.  With d = i - e <= m that is a square of period d, and the
m + d last words have period d.  They begin where the run does, as no longer suffix has this
last end; d is the smallest period, as a smaller one would be a later end; and the last word of
the run is among the i.  So the longest find of every (start, period) is the run, and each run
is found.

Before that, stretches that no run touches are left out, without loss: in a run every
``GRAM`` words stand again a period away (``LEAST_WORDS >= 2q + GRAM - 1`` for q <= 8, three
periods are beyond it for larger q), so a run lies in a stretch of words covered by such
grams, at least three times as long as the distance to the nearest equal gram.  Grams are
compared by hash, which can only keep more; the automaton works on the words themselves.

Words are runs other than ASCII white space.  A document is one task's work, as its row is.
Cases: a null, empty or blank text has no words and no runs; a null doc_id and repeated rows
are rows like any other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.llm.common import blocks, mix, run_hashes, runs, small_batches

LEAST_WORDS, LEAST_EXPONENT, GRAM = 24, 3, 8

SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_U = np.uint64
_FACTORS = [_U(pow(0xD1342543DE82EF95, j + 1, 2**64)) for j in range(GRAM)]
_FAR = np.int64(1) << 60

#: Which word stands at each place of a text, for a document id and its number of words; None: each its own.
Reshape = Callable[[int, int], np.ndarray | None]


def runs_of(words: list, least: int = LEAST_WORDS, exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start and period."""
    n = len(words)
    # state 1 is the empty suffix, 0 is none
    length, link, then = [0, 0], [0, 0], [None, {}]
    # link-cut paths: left and right subtree, parent (of a path's root: the state above the path), colour at the root
    left, right, up, colour = [0, 0], [0, 0], [0, 0], [0, -1]

    def add(size: int) -> int:
        length.append(size)
        link.append(0)
        left.append(0)
        right.append(0)
        up.append(0)
        colour.append(-1)
        return len(length) - 1

    def splay(x: int) -> None:
        """Make ``x`` the root of its path's tree."""
        while True:
            p = up[x]
            if not p:
                return
            on_left = left[p] == x
            if not on_left and right[p] != x:
                return
            g = up[p]
            if g and (left[g] == p or right[g] == p):
                turn(p if on_left == (left[g] == p) else x)
            turn(x)

    def turn(x: int) -> None:
        p = up[x]
        g = up[p]
        if g and left[g] == p:
            left[g] = x
        elif g and right[g] == p:
            right[g] = x
        else:
            colour[x] = colour[p]
        if left[p] == x:
            inner = left[p] = right[x]
            right[x] = p
        else:
            inner = right[p] = left[x]
            left[x] = p
        if inner:
            up[inner] = p
        up[p], up[x] = x, g

    ends: dict[tuple[int, int], int] = {}
    last = 1
    for i, word in enumerate(words):
        new = add(i + 1)
        then.append({})
        p = last
        while p and word not in then[p]:
            then[p][word] = new
            p = link[p]
        above = 1
        if p:
            q = then[p][word]
            above = q
            if length[q] != length[p] + 1:
                above = add(length[p] + 1)
                then.append(then[q].copy())
                while p and then[p].get(word) == q:
                    then[p][word] = above
                    p = link[p]
                link[above], link[q] = link[q], above
                # the copy goes right above q on q's path
                splay(q)
                inner = left[q]
                left[above], left[q], up[above] = inner, above, q
                if inner:
                    up[inner] = above
        link[new] = last_above = above
        up[new] = last_above
        last = new
        # access: every segment on the way up gives its length and last end, and joins the new path
        below, x = new, above
        while x:
            splay(x)
            cut_off, e = right[x], colour[x]
            if cut_off:
                colour[cut_off] = e
            right[x] = below
            period, size = i - e, length[x]
            if period <= size and size + period >= least and size + period >= exponent * period:
                ends[i + 1 - size - period, period] = i + 1
            below, x = x, up[x]
        colour[below] = i
    return sorted((start, end - start, period) for (start, period), end in ends.items())


def stretches(h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words, given by hash, that a run may lie in; ``at`` are the texts' bounds."""
    n = len(h)
    many = n - GRAM + 1
    if many < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    grams = mix(text[:many].astype(_U))
    for j, factor in enumerate(_FACTORS):
        grams += h[j : j + many] * factor
    whole = np.flatnonzero(text[:many] == text[GRAM - 1 :])
    order = whole[np.argsort(grams[whole], kind="stable")]
    gap = np.where(grams[order[1:]] == grams[order[:-1]], order[1:] - order[:-1], _FAR)
    near = np.full(n, _FAR)
    near[order[:-1]] = gap
    near[order[1:]] = np.minimum(near[order[1:]], gap)
    while True:
        begins = np.flatnonzero(near < _FAR)
        if not len(begins):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, begins, 1)
        np.add.at(covered, begins + GRAM, -1)
        starts, ends = runs(np.cumsum(covered)[:n] > 0, at)
        size = (ends - starts)[np.searchsorted(starts, begins, "right") - 1]
        out = (size < LEAST_WORDS) | (near[begins] * LEAST_EXPONENT > size)
        if not out.any():
            return starts, ends
        near[begins[out]] = _FAR


def _found(raw: bytes, starts: np.ndarray, ends: np.ndarray, first: int, last: int) -> list[tuple[int, int, int]]:
    words = [raw[a:b] for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)]
    return runs_of(words)


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> pa.Array:
    """The texts whose words are given by their bytes' bounds, joined by one space."""
    size = ends - starts + 1
    to = np.concatenate([[0], np.cumsum(size)])
    out = np.full(to[-1], 0x20, np.uint8)
    source = np.arange(to[-1]) - np.repeat(to[:-1] - starts, size)
    word = np.ones(to[-1], bool)
    word[to[1:] - 1] = False
    out[word] = data[source[word]]
    # every text ends with a space that does not belong to it
    bounds, some = to[at], np.diff(at) > 0
    keep = np.ones(to[-1], bool)
    keep[bounds[1:][some] - 1] = False
    offsets = np.concatenate([[0], np.cumsum(np.diff(bounds) - some)])
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep]))


def periodic_runs(docs: DataFrame, reshape: Reshape | None = None) -> DataFrame:
    """``SCHEMA``: the runs of every document by start and period, and its text without their repeated words.

    A word is left out of ``collapsed`` if a run contains it after the run's first period.
    ``reshape`` may put other words of the document at its places first.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in blocks(batch.column(1)):
                ids = batch.column(0).slice(first, last - first)
                starts, ends = runs(~_SPACE[data], offsets)
                at = np.searchsorted(starts, offsets)
                if reshape is not None:
                    order = np.arange(len(starts))
                    for k, doc in enumerate(ids.to_pylist()):
                        n = int(at[k + 1] - at[k])
                        if doc is not None and n and (places := reshape(doc, n)) is not None:
                            order[at[k] : at[k + 1]] = at[k] + places
                    starts, ends = starts[order], ends[order]
                raw = data.tobytes()
                dropped = np.zeros(len(starts) + 1, np.int64)
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(last - first)]
                for a, b in zip(*stretches(run_hashes(data, starts, ends), at), strict=True):
                    k = int(np.searchsorted(at, a, "right")) - 1
                    for start, length, period in _found(raw, starts, ends, a, b):
                        found[k].append((int(a - at[k]) + start, length, period))
                        dropped[a + start + period] += 1
                        dropped[a + start + length] -= 1
                kept = np.cumsum(dropped)[: len(starts)] == 0
                left = np.concatenate([[0], np.cumsum(kept)])[at]
                many = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
                flat = np.array([r for f in found for r in f], np.int64).reshape(-1, 3)
                listed = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(np.diff(at).astype(np.int64)), pa.ListArray.from_arrays(pa.array(many), listed),
                        _joined(data, starts[kept], ends[kept], left).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def strongest(found: Column) -> Column:
    """The run of greatest length over period; of equal ones the first by start, then period.  Null if there is none."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    return F.aggregate(
        found, none,
        lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best),
    )


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of runs, the strongest one and digests of all runs and of the collapsed text."""
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
