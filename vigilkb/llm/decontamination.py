"""Benchmark decontamination by size-partitioned MinHash containment search.

The short test items are the indexed side, partitioned by size: class c holds the items of
up to ``8 * 2**c`` word shingles.  Documents are the long side.  Within a document, the
shingles are cut into blocks of a class's size; two neighbouring blocks make a window, so a
contained item lies inside one window and is a known share of it at least.  With ``HASHES``
single-row bands an item of containment 0.8 is missed with a chance below 1e-5.  Block
minima of a class are minima of two blocks of the class below, so all classes together cost
little more than the smallest.  Items of up to ``FEW`` different shingles, and those that
repeat shingles so often that they would fill less of a window, are not left to chance: a
document that contains one has one of any ``n_item - least + 1`` of its shingles, where
``least`` is the number it must share, and these are looked up exactly.  Every candidate is
verified by exact shingle containment in the whole document.

Words are runs of ASCII letters and digits and of non-ASCII characters; ASCII letters are
folded.  A shingle is five words; an item of fewer words is one shingle of all its words.

Items are broadcast in blocks of bounded size (``BLOCK_ITEMS`` and ``BLOCK_CHARS``), one
pass over the documents for each block, so a large benchmark needs more passes and no more
memory.  The documents are never shuffled.

Cases: null or empty documents contain nothing, null or empty items are contained nowhere;
repeated documents and repeated items give a row each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilkb.llm.common import blocks, mix, run_hashes, runs, small_batches

SHINGLE_WORDS = 5
LEAST_CONTAINED = 0.8
HASHES = 64
SMALLEST = 8
FEW = 4
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20

FOUND = "doc_id long, item_id long, n_shared long, n_item long, containment double"

_BYTES = np.arange(256)
_WORD = ((_BYTES >= 48) & (_BYTES < 58)) | ((_BYTES >= 65) & (_BYTES < 91)) | ((_BYTES >= 97) & (_BYTES < 123)) | (_BYTES >= 128)
_FOLD = np.where((_BYTES >= 65) & (_BYTES < 91), _BYTES + 32, _BYTES).astype(np.uint8)
_ORDERS = np.random.default_rng(7).integers(1, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)


def shingles(hashes: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows and where each text's begin."""
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    n = max(0, len(hashes) - size + 1)
    whole = of[:n] == of[size - 1 :] if n else np.zeros(0, bool)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = mix(h + hashes[i : n + i])
    return h[whole], np.concatenate([[0], np.cumsum(np.maximum(np.diff(at) - size + 1, 0))])


def words_of(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, word positions) of each block of texts."""
    for first, _, data, offsets in blocks(texts):
        folded = _FOLD[data]
        starts, ends = runs(_WORD[data], offsets)
        yield first, run_hashes(folded, starts, ends), np.searchsorted(starts, offsets)


class Index:
    """Test items by size class, with the MinHash minima to look for."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids: list[int | None] = [i for i, _ in items]
        self.sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
        self.short: dict[int, dict[int, list[int]]] = {}
        classes: dict[int, list[int]] = {}
        few: list[tuple[int, int]] = []
        size_class = lambda n: max(0, int(np.ceil(np.log2(n / SMALLEST))))
        for first, hashes, at in words_of(pa.array([t for _, t in items], pa.large_string())):
            for i in range(len(at) - 1):
                own = hashes[at[i] : at[i + 1]]
                if 0 < len(own) < SHINGLE_WORDS:
                    key, _ = shingles(own, np.array([0, len(own)]), len(own))
                    self.sets[first + i] = key
                    self.short.setdefault(len(own), {}).setdefault(int(key[0]), []).append(first + i)
                elif len(own):
                    got, _ = shingles(own, np.array([0, len(own)]), SHINGLE_WORDS)
                    self.sets[first + i] = own_set = np.unique(got)
                    n = len(own_set)
                    if n <= FEW or size_class(n) < size_class(len(got)):
                        least = next(k for k in range(n + 1) if k >= LEAST_CONTAINED * n)
                        few += [(int(key), first + i) for key in own_set[: n - least + 1]]
                    else:
                        classes.setdefault(size_class(n), []).append(first + i)
        few.sort()
        self.few = np.array([key for key, _ in few], np.uint64), np.array([item for _, item in few], np.int64)
        self.classes = {c: self._minima(members) for c, members in sorted(classes.items())}

    def _minima(self, members: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each hash function: a bitmap of the high halves, the sorted minima and their items."""
        out = []
        for a in _ORDERS:
            low = np.array([((self.sets[i] >> np.uint64(32)).astype(np.uint32) * a).min() for i in members], np.uint32)
            order = np.argsort(low)
            seen = np.zeros(1 << 16, bool)
            seen[low >> np.uint32(16)] = True
            out.append((seen, low[order], np.array(members)[order]))
        return out

    def candidates(self, got: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) pairs that share a minimum in some window, or a shingle that is looked up."""
        pairs: set[tuple[int, int]] = set()
        if not len(got):
            return pairs
        keys, items = self.few
        if len(keys):
            left, right = np.searchsorted(keys, got, "left"), np.searchsorted(keys, got, "right")
            hit = np.flatnonzero(right > left)
            for k, text in zip(hit, np.searchsorted(at, hit, "right") - 1, strict=True):
                pairs.update((int(text), int(i)) for i in items[left[k] : right[k]])
        if not self.classes:
            return pairs
        short = (got >> np.uint64(32)).astype(np.uint32)
        many = -(-np.diff(at) // SMALLEST)  # blocks of each text
        of = np.repeat(np.arange(len(many)), many)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        begins = at[of] + nth * SMALLEST
        lows = [np.minimum.reduceat(short * a, begins) for a in _ORDERS]
        for c in range(max(self.classes) + 1):
            if c:  # two blocks become one of double size
                heads = np.flatnonzero(nth % 2 == 0)
                lows = [np.minimum.reduceat(low, heads) for low in lows]
                of, nth = of[heads], nth[heads] // 2
            joined = of[1:] == of[:-1]
            for low, (seen, values, items) in zip(lows, self.classes.get(c, []), strict=False):
                window = low.copy()
                window[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                hit = np.flatnonzero(seen[window >> np.uint32(16)])
                left, right = np.searchsorted(values, window[hit], "left"), np.searchsorted(values, window[hit], "right")
                for k in np.flatnonzero(right > left):
                    pairs.update((int(of[hit[k]]), int(i)) for i in items[left[k] : right[k]])
        return pairs

    def search(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(row, item, shingles shared, shingles of the item) of the contained items."""
        out = []
        for first, hashes, at in words_of(texts):
            got, where = shingles(hashes, at, SHINGLE_WORDS)
            for text, item in sorted(self.candidates(got, where)):
                wanted = self.sets[item]
                shared = int(np.isin(wanted, got[where[text] : where[text + 1]]).sum())
                if shared >= LEAST_CONTAINED * len(wanted):
                    out.append((first + text, item, shared, len(wanted)))
            for size, known in self.short.items():
                got, where = shingles(hashes, at, size)
                hit = np.flatnonzero(np.isin(got, np.array(list(known), np.uint64)))
                text = np.searchsorted(where, hit, "right") - 1
                for t, key in sorted({(int(t), int(got[k])) for t, k in zip(text, hit, strict=True)}):
                    out += [(first + t, item, 1, 1) for item in known[key]]
        return out


def _indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded blocks of the items."""
    items = benchmark.select("item_id", "text").where(F.length("text") > 0)
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    many = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for k in range(many):
        block = items.where(F.pmod(F.xxhash64("text", "item_id"), F.lit(many)) == k) if many > 1 else items
        rows = block.collect() if n else []
        yield Index([(r[0], r[1]) for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row of ``FOUND`` per document and item that it contains."""
    spark = docs.sparkSession
    small_batches(spark)
    found = []
    for index in _indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = held.value.search(batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([h[0] for h in hits], pa.int64())),
                        pa.array([held.value.ids[h[1]] for h in hits], pa.int64()),
                        pa.array([h[2] for h in hits], pa.int64()),
                        pa.array([h[3] for h in hits], pa.int64()),
                        pa.array([h[2] / h[3] for h in hits], pa.float64()),
                    ],
                    [x.split()[0] for x in FOUND.split(", ")],
                )

        found.append(docs.select("doc_id", "text").mapInArrow(look, FOUND))
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no test item, with all their columns."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index("text")
    for index in _indexes(benchmark):
        held = spark.sparkContext.broadcast(index)

        def sift(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[h[0] for h in held.value.search(batch.column(at))]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs


ORACLE = """
WITH fold AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM documents
), bench AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w
    FROM benchmark
), ds AS (
    SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM fold
), bs AS (
    SELECT DISTINCT item_id, unnest([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM bench
), size AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM bs JOIN ds USING (s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_item)
"""
