"""Product-quantised vector codes, with the candidates of every grid cell remembered.

Vectors become integers (``floor(SCALE * x)``) and are cut into ``PARTS`` parts.  Every part
position has a codebook of ``ENTRIES`` entries: first those of the smallest vec_ids, then
``ROUNDS`` times the floored means of the parts assigned to each entry.  A part is assigned to
the entry at the least squared Euclidean distance, ties to the lower index.

Assignment by memoised cells: the space of a part is a grid of cells whose side is
``1 / CELLS`` of the codebook's spread.  The first part that falls into a cell makes a worker
compute the least and the greatest distance of every entry to the cell's box.  An entry whose
least distance is beyond another's greatest is dominated everywhere in the box; the others are
kept under the cell's key, and all parts of the cell are compared exactly with those alone.
An entry at the same distance as the winner is never dominated, so ties are decided exactly.
The memory is bounded: beyond ``MOST_CELLS`` cells of a part it starts anew.

Only codebooks pass through the driver: ``ENTRIES`` vectors, whatever the table's size.
Sums are made in tasks and added by Spark, exactly.

Cases: rows whose vector is null or holds null, NaN or infinite components are dropped.  So are
vectors of another dimension than that of the smallest vec_id whose dimension is a positive
multiple of ``PARTS``.  Components beyond what exact 64-bit distances allow (2.6e5 before
scaling at 64 dimensions, less as the root of the dimension) are taken as that bound.  Rows with
a null vec_id are coded but begin no codebook; repeated rows count each; equal vec_ids are ordered by
their vectors.  With fewer rows than ``ENTRIES`` the codebooks are shorter.  A missing label
column is null; an empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilkb.session import cut

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
CELLS, MOST_CELLS = 8, 1 << 15
#: Rows assigned at once: their distances to the candidates are an array of so many rows.
STEP = 2048
#: A label with more than one row in so many is hot; there are at most so many of them.
HOT_SHARE = 1000


def bound_of(dimension: int) -> int:
    """The largest component for which no sum of squared differences leaves 64 bits."""
    return math.isqrt((1 << 60) // dimension)


def integers(vectors: np.ndarray) -> np.ndarray:
    most = bound_of(vectors.shape[1])
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -most, most).astype(np.int64)


class Grid:
    """Nearest entries of one part position."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.side = max(1, -(-int((entries.max(axis=0) - entries.min(axis=0)).max()) // CELLS))
        self.number: dict[bytes, int] = {}
        self.lists = np.zeros((0, 1), np.int64)  # candidates of every cell, ascending, filled up with the last one
        self.many = 0

    def _candidates(self, cells: np.ndarray) -> np.ndarray:
        """A boolean (cell, entry): not dominated anywhere in the cell's box."""
        low = (cells * self.side)[:, None, :] - self.entries[None, :, :]
        high = low + (self.side - 1)
        far = np.maximum(np.abs(low), np.abs(high))
        near = np.where((low <= 0) & (high >= 0), 0, np.minimum(np.abs(low), np.abs(high)))
        return (near * near).sum(axis=2) <= (far * far).sum(axis=2).min(axis=1)[:, None]

    def _remember(self, cells: np.ndarray, keys: list[bytes]) -> None:
        keep = self._candidates(cells)
        width = max(int(keep.sum(axis=1).max()), self.lists.shape[1])
        order = np.argsort(~keep, axis=1, kind="stable")[:, :width]  # those kept first, ascending
        size = keep.sum(axis=1)
        order = np.where(np.arange(width) < size[:, None], order, order[np.arange(len(order)), size - 1][:, None])
        if self.many + len(cells) > len(self.lists) or width > self.lists.shape[1]:
            grown = np.zeros((max(2 * self.many, self.many + len(cells), 64), width), np.int64)
            old = self.lists[: self.many]
            grown[: self.many, : old.shape[1]] = old
            if self.many:
                grown[: self.many, old.shape[1] :] = old[:, -1:]
            self.lists = grown
        self.lists[self.many : self.many + len(cells)] = order
        for k, key in enumerate(keys, self.many):
            self.number[key] = k
        self.many += len(cells)

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of every point, and the squared distance."""
        cells, of = np.unique(np.floor_divide(points, self.side), axis=0, return_inverse=True)
        of = of.reshape(-1)
        cells = np.ascontiguousarray(cells)
        keys = [c.tobytes() for c in cells]
        if self.many + len(cells) > MOST_CELLS:
            self.number.clear()
            self.many = 0
        new = [k for k, key in enumerate(keys) if key not in self.number]
        if new:
            self._remember(cells[new], [keys[k] for k in new])
        places = np.array([self.number[key] for key in keys], np.int64)
        choice = self.lists[places[of]]
        apart = points[:, None, :] - self.entries[choice]
        distance = (apart * apart).sum(axis=2)
        best = distance.argmin(axis=1)  # the first of equal ones, which has the lowest index
        rows = np.arange(len(points))
        return choice[rows, best], distance[rows, best]


_grids: dict[str, list[Grid]] = {}


def grids(codebooks: np.ndarray) -> list[Grid]:
    """The grids of codebooks (part, entry, component); a worker keeps those it used last."""
    name = hashlib.sha256(codebooks.tobytes()).hexdigest()
    if name not in _grids:
        _grids.clear()
        _grids[name] = [Grid(part) for part in codebooks]
    return _grids[name]


def assign(vectors: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, part) indexes of entries, and the squared distances summed over the parts."""
    parts = vectors.reshape(len(vectors), len(codebooks), -1)
    codes = np.empty(parts.shape[:2], np.int64)
    error = np.zeros(len(vectors), np.int64)
    for p, grid in enumerate(grids(codebooks)):
        for a in range(0, len(vectors), STEP):
            codes[a : a + STEP, p], distance = grid.nearest(parts[a : a + STEP, p])
            error[a : a + STEP] += distance
    return codes, error


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, label) of the rows that are coded."""
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    sound = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select("vec_id", "embedding", label.alias("label")).where(F.col("embedding").isNotNull() & F.forall("embedding", sound))
    size = F.size("embedding")
    first = kept.where(F.col("vec_id").isNotNull() & (size > 0) & (size % PARTS == 0)).agg(F.min(F.struct("vec_id", size.alias("size")))).first()[0]
    return kept.where(size == (first["size"] if first else 0)) if first else kept.where("false")


def first_codebooks(kept: DataFrame) -> np.ndarray:
    rows = kept.where("vec_id is not null").orderBy("vec_id", "embedding").limit(ENTRIES).select("embedding").collect()
    vectors = integers(np.array([r[0] for r in rows], np.float64))
    return np.ascontiguousarray(vectors.reshape(len(rows), PARTS, -1).transpose(1, 0, 2))


def next_codebooks(kept: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """Every used entry replaced by the floored mean of the parts assigned to it."""
    n_parts, entries, size = codebooks.shape

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((n_parts, entries), np.int64)
        total = np.zeros((n_parts, entries, size), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _vectors(batch.column(0))
            codes, _ = assign(vectors, codebooks)
            split = vectors.reshape(len(vectors), n_parts, size)
            for p in range(n_parts):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], split[:, p])
        part, entry = np.nonzero(count)
        if len(part):
            flat = total[part, entry].reshape(-1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(part, size)), pa.array(np.repeat(entry, size)), pa.array(np.tile(np.arange(size), len(part))),
                    pa.array(np.repeat(count[part, entry], size)), pa.array(flat),
                ],
                ["part", "entry", "place", "many", "total"],
            )

    sums = kept.select("embedding").mapInArrow(add_up, "part long, entry long, place long, many long, total long")
    exact = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("many", "total")]
    out = codebooks.copy()
    # one row per component of the codebooks
    for r in sums.groupBy("part", "entry", "place").agg(*exact).collect():
        out[r.part, r.entry, r.place] = int(r.total) // int(r.many)
    return out


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, label, code, error of every usable row and the digest of the final codebooks."""
    kept = usable(vectors)
    if kept.isEmpty():
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256"))
    codebooks = first_codebooks(kept)
    for _ in range(ROUNDS):
        codebooks = next_codebooks(kept, codebooks)
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()
    label = kept.schema["label"].dataType

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, error = assign(_vectors(batch.column(2)), codebooks)
                text = [row.tobytes().hex() for row in found.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    coded = kept.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id long, label {label.simpleString()}, code string, error long")
    return coded.withColumn("codebooks_sha256", F.lit(digest))


def with_label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels; nulls are one label.

    Labels with more than a thousandth of all rows, which are at most a thousand, are looked
    up in every task; only rows of other labels are shuffled to their label's sum.
    """
    coded = cut(coded)
    totals = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("many")))
    rows = totals.agg(F.sum("many")).first()[0] or 0
    hot = totals.withColumnRenamed("label", "of").withColumn("hot", F.col("many") * HOT_SHARE > rows)
    often = F.broadcast(hot.where("hot").select("of", "label_error"))
    same = F.col("label").eqNullSafe(F.col("of"))
    first = coded.join(often, same)
    others = coded.join(often, same, "left_anti").join(hot.where("not hot").select("of", "label_error"), same)
    return first.unionByName(others).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _rounds() -> str:
    """The assignments and means of the rounds, one after the other."""
    out = []
    for k in range(ROUNDS + 1):
        out.append(f"""
a{k} AS (
    SELECT vec, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
    FROM (SELECT p.vec, p.part, b.entry,
                 list_sum(list_transform(list_zip(p.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
          FROM parts p JOIN b{k} b ON p.part = b.part)
    GROUP BY vec, part)""")
        if k < ROUNDS:
            out.append(f"""
m{k} AS (
    SELECT part, entry, list(mean ORDER BY place) AS v
    FROM (SELECT a.part, a.entry, u.place, ((sum(u.x) - (sum(u.x) % count(*) + count(*)) % count(*)) // count(*))::BIGINT AS mean
          FROM a{k} a JOIN parts p ON a.vec = p.vec AND a.part = p.part,
               LATERAL (SELECT unnest(p.v) AS x, unnest(range(len(p.v))) AS place) u
          GROUP BY a.part, a.entry, u.place)
    GROUP BY part, entry),
b{k + 1} AS (
    SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)""")
    return ",".join(out)


ORACLE = f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS vec, vec_id, label,
           list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * {SCALE}) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
    SELECT vec, part, v[1 + part * len(v) // {PARTS} : (part + 1) * len(v) // {PARTS}] AS v
    FROM kept, (SELECT unnest(range({PARTS})) AS part)),
b0 AS (SELECT part, vec AS entry, v FROM parts WHERE vec < {ENTRIES}),{_rounds()},
coded AS (
    SELECT vec, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec),
books AS (
    SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT k.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY k.label))::BIGINT AS label_error, codebooks_sha256
FROM kept k JOIN coded c ON k.vec = c.vec, books
"""
