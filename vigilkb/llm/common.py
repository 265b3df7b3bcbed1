"""Helpers shared by the operators: tables, Arrow batches, byte-level text kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Rows of a text column that one Arrow batch may hold; texts are long, so far fewer than usual.
BATCH_ROWS = 256
#: Bytes that the vectorised kernels take at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep the Arrow batches of whole texts within a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, most_chars: int) -> list[tuple[str, int]]:
    """At most ``bound`` labelled texts, chosen by the hash of their id, for fitting on the driver.

    Texts of more than ``most_chars`` code points are not learnt from (they are scored like
    any other), so the sample has a size that no corpus exceeds.
    """
    picked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    )
    rows = (
        docs.select("doc_id", "text").where(F.length("text") <= most_chars)
        .join(F.broadcast(picked), "doc_id")
        .select("doc_id", "text", "__label")
        .collect()
    )
    return [(r[1], int(r[2])) for r in sorted(rows, key=lambda r: (r[0], r[1]))]


def as_large(column: pa.Array) -> pa.LargeStringArray:
    column = column.cast(pa.large_string())
    return pa.array([], pa.large_string()) if len(column) == 0 else column


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, UTF-8 bytes, offsets) of consecutive texts; null is empty."""
    texts = as_large(texts.fill_null(""))
    n = len(texts)
    if n == 0:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``inside`` bytes that do not cross a text's end."""
    n = len(inside)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


_RNG = np.random.default_rng(20240229)
BYTE_KEYS = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_STEP = 1 << 16


def _powers(base: int) -> np.ndarray:
    out = np.empty(_STEP, np.uint64)
    value = 1
    for i in range(_STEP):
        out[i] = value
        value = value * base % 2**64
    return out


POWERS = _powers(_BASE)
INVERSES = _powers(pow(_BASE, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte runs, by differences of one running polynomial."""
    out = np.zeros(len(starts), np.uint64)
    if len(starts) == 0:
        return out
    total = np.zeros(len(data) + 1, np.uint64)
    scale = 1  # the power at which a step begins; periodic powers would let runs collide
    for a in range(0, len(data), _STEP):
        piece = BYTE_KEYS[data[a : a + _STEP]] * POWERS[: min(_STEP, len(data) - a)] * np.uint64(scale)
        np.cumsum(piece, out=total[a + 1 : a + 1 + len(piece)])
        total[a + 1 : a + 1 + len(piece)] += total[a]
        scale = scale * pow(_BASE, _STEP, 2**64) % 2**64
    undo = pow(pow(_BASE, -1, 2**64), _STEP, 2**64)
    steps = np.empty(len(data) // _STEP + 1, np.uint64)
    value = 1
    for i in range(len(steps)):
        steps[i] = value
        value = value * undo % 2**64
    out = (total[ends] - total[starts]) * INVERSES[starts % _STEP] * steps[starts // _STEP]
    return mix(out ^ (ends - starts).astype(np.uint64))


def per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive positions ``at``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]
