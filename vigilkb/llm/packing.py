"""Best-fit packing of tokenised documents into sequences of a fixed length.

Texts are tokenised in Arrow batches, with a bounded memo of the ids of white-space
separated words (the vocabulary never joins ids across white space).  A document's ids end
with ``END_ID``; only documents longer than a sequence are cut.

The packing is best-fit decreasing on runs of equal sizes.  Pieces are range-sorted by size,
so a piece is known by its size and rank.  Sizes are taken from the largest down; a run fills
the smallest gaps that still hold it, the i-th pieces taking the i-th gap, the shrunken gaps return to
the sorted list, and what finds no gap opens new sequences.  This schedule is made by a loop on
the driver from a histogram of at most ``capacity`` sizes (see the README: it replaces distributed
sweeps over tables of sizes and gaps); the pieces then look up their sequence and offset by size and rank.

Cases: a null or empty text is the one id ``END_ID``; repeated rows and ids are packed once
each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilkb.llm.common import small_batches
from vigilkb.operators.ordering import number_rows
from vigilkb.session import cut

CAPACITY = 2048
END_ID = 0
#: Words whose ids a worker remembers.
MEMO_WORDS = 2_000_000

#: ASCII punctuation but the apostrophe, which can begin a contraction.
_AFTER = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_loaded: dict[str, tuple] = {}


def _learn(words: set[bytes], memo: dict[bytes, bytes], tokenizer) -> None:
    """Remember the ids of new words.  Punctuation after a letter or digit is always a token run of its own."""
    split = {}
    for w in words:
        core = w.rstrip(_AFTER)
        if len(core) < len(w) and core[-1:].isalnum() and b"<|" not in w:
            split[w] = (core, w[len(core) :])
    new = [w for w in {part for pair in split.values() for part in pair} | (words - split.keys()) if w not in memo]
    for w, e in zip(new, tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False), strict=True):
        memo[w] = np.array(e.ids, "<u4").tobytes()
    for w, (core, tail) in split.items():
        memo[w] = memo[core] + memo[tail]


def ids_of(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = (Tokenizer.from_file(path), {})
    tokenizer, memo = _loaded[path]
    end = END_ID.to_bytes(4, "little")
    for text in texts:
        raw = (text or "").encode("utf-8", "replace")
        # the vocabulary folds case, but for the special strings
        words = (raw if b"<|" in raw else raw.lower()).split()
        ids = list(map(memo.get, words))
        if None in ids:
            new = {w for w, i in zip(words, ids, strict=True) if i is None}
            if len(memo) + 2 * len(new) > MEMO_WORDS:
                memo.clear()
                new = set(words)
            _learn(new, memo, tokenizer)
            ids = [memo[w] for w in words]
        ids.append(end)
        yield b"".join(ids)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    small_batches(docs.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[int]] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), ids_of(batch.column(1).to_pylist(), tokenizer), strict=True):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    piece = ids[at : at + 4 * capacity]
                    for col, v in zip(cols, (doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(tokenise, PIECES)


def schedule(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, ranks, first sequence, pieces per sequence, offset) of every bulk move."""
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of sequences (first, how many)
    sizes: list[int] = []  # the gaps that exist, sorted
    moves, opened = [], 0

    def give_back(gap: int, first: int, many: int) -> None:
        if gap and many:
            if not gaps[gap]:
                bisect.insort(sizes, gap)
            gaps[gap].append((first, many))

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            at = bisect.bisect_left(sizes, size)
            if at < len(sizes):
                gap = sizes[at]
                first, many = gaps[gap].pop()
                if not gaps[gap]:
                    sizes.pop(at)
            else:
                gap, first, many = capacity, opened, -(-left // (capacity // size))
                opened += many
            fits = gap // size
            full = min(many, left // fits)
            if full:
                moves.append((size, rank, full * fits, first, fits, capacity - gap))
                rank, left = rank + full * fits, left - full * fits
            rest = min(left, fits - 1) if full < many else 0
            if rest:
                moves.append((size, rank, rest, first + full, rest, capacity - gap))
                rank, left = rank + rest, left - rest
            give_back(gap - fits * size, first, full)
            give_back(gap - rest * size, first + full, int(rest > 0))
            give_back(gap, first + full + int(rest > 0), many - full - int(rest > 0))
    return moves


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """``PIECES`` with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    cutup = cut(pieces(docs, tokenizer, capacity))
    # at most ``capacity`` rows
    counts = {int(r[0]): int(r[1]) for r in cutup.groupBy("length").count().collect()}
    before, total = {}, 0
    for size in sorted(counts):
        before[size], total = total, total + counts[size]
    moves = [(s, before[s] + r, before[s] + r + n, q, per, o) for s, r, n, q, per, o in schedule(counts, capacity)]
    moved = spark.createDataFrame(moves, "length long, first long, last long, sequence long, per long, at long")
    place = F.col("rank") - F.col("first")
    return (
        number_rows(cutup, ["length", "doc_id", "piece"], "rank", start=0)
        .join(F.broadcast(moved), "length")  # sized by the capacity, not by the documents
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("sequence") + F.floor(place / F.col("per"))).cast("long").alias("sequence_id"),
            (F.col("at") + place % F.col("per") * F.col("length")).cast("long").alias("offset"),
        )
    )
