"""Exact as-of k-nearest-neighbour join by inner product.

Vectors are packed into blocks of bounded size, grouped by nearest pivot, birth time and
length of life, and written once to the shared folder, in files of one stretch of time each.
If the queries are the corpus' own rows, one table serves both sides.  A task holds a bounded
part of the queries, and the blocks of the stretches in which these can find something stream
past it: every block reaches a task once, is multiplied with all queries that it is alive for,
and a query's k best leave its task once.  Blocks are not shuffled, however many partners
they have, and no pair of vectors ever leaves the kernel.

What meets:

* A block that holds no vector alive while a query ran is left out.  Lives of similar
  length share a block (an interval [2^l, 2^(l+1)) of lengths in slices of 2^l ticks), so what
  a query meets is a constant times what is alive, not all that ever was.
* Products are formed in single precision.  What lies above a query's k-th best score so far,
  less a bound of the rounding errors, is multiplied again in double precision.
* What is alive at once is divided among pivots if it fills many blocks and a sample shows that
  this leaves many pairs out.  The corpus then streams past twice: every query block first meets
  its own pivot, which yields a lower bound for each query's k-th best score; then the other
  pivots' blocks, unless the ball bound ``q.x <= q.c + |q| r`` shows that they cannot beat it.

Blocks that do not meet provably hold no result, so the join is exact for any data.  A pivot
that attracts a large share of the vectors just has more blocks.  A corpus that was measured
to be small is not written but broadcast to the query blocks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from vigilkb.config import PHYSICAL
from vigilkb.operators.ordering import FOREVER
from vigilkb.session import cut

#: Products formed at once, so that they stay near the processor's cache.
_STEP = 1 << 19
#: Most vectors of a corpus that are multiplied together, and the bytes that wait for it.
_TOGETHER, _WAITING = 1 << 11, 1 << 25
#: Up to this k a query's best are kept as one row of a matrix.
_DENSE = 256
#: Most hits a task holds for larger k.
_MOST = 1 << 20
#: Most stretches of time that blocks of short lives are dealt to, and the fewest rows of one.
_STRETCHES, _STRETCH_ROWS = 16, 1 << 17
#: Most halvings of a slice by which births are told apart.
_HALVINGS = 8


def _vectors(col: pa.Array, dtype) -> np.ndarray:
    """The rows of a list column as a matrix; a missing vector or component is NaN."""
    rows = len(col)
    lengths = np.asarray(col.value_lengths().fill_null(-1))
    dim = int(lengths.max(initial=0))
    if col.null_count == 0:
        if (lengths != dim).any():
            raise ValueError("vectors of one side differ in length")
        flat = col.flatten()
        return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(rows, dim)
    out = np.full((rows, max(dim, 0)), np.nan, dtype)
    there = lengths >= 0
    if (lengths[there] != dim).any():
        raise ValueError("vectors of one side differ in length")
    out[there] = col.drop_null().flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(-1, dim)
    return out


def _nearest_pivot(pivots: np.ndarray):
    half = 0.5 * (pivots**2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            x = _vectors(b.column(b.schema.get_field_index("vec")), np.float64)
            near = (x @ pivots.T - half).argmax(axis=1).astype(np.int32)
            names = b.schema.names
            arrays = [pa.array(near) if n == "pivot" else b.column(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return assign


def _pruned(sample: np.ndarray, pivots: np.ndarray) -> float:
    """Share of the pairs of cells that the ball bound leaves out, if a sampled vector's best partner
    in the sample scores as its k-th best does."""
    near = (sample @ pivots.T - 0.5 * (pivots**2).sum(axis=1)).argmax(axis=1)
    s = sample @ sample.T
    np.fill_diagonal(s, -np.inf)
    best = s.max(axis=1)
    cells = [sample[near == p] for p in range(len(pivots))]
    bars = np.array([best[near == p].min(initial=np.inf) for p in range(len(pivots))])
    share = np.array([len(c) for c in cells]) / len(sample)
    centre = np.array([c.mean(axis=0) if len(c) else np.zeros(sample.shape[1]) for c in cells])
    radius = np.array([np.sqrt(((c - m) ** 2).sum(axis=1).max()) if len(c) else 0.0 for c, m in zip(cells, centre)])
    norm = np.sqrt((centre**2).sum(axis=1))
    bound = centre @ centre.T + np.outer(norm, radius) + np.outer(radius, norm) + np.outer(radius, radius)
    return float((np.outer(share, share) * (bound < bars[:, None])).sum())


def _norm(x: np.ndarray) -> float:
    """Length of the longest vector."""
    return float(np.sqrt(np.nanmax(np.einsum("ij,ij->i", x, x, dtype=np.float64), initial=0.0)))


class _Corpus:
    """One block of the corpus."""

    def __init__(self, ids: np.ndarray, born: np.ndarray, dies: np.ndarray, x: np.ndarray):
        self.ids, self.born, self.dies, self.x = ids, born, dies, x
        self.lo, self.hi = born.min(), dies.max()
        self.quick = x.astype(np.float32, copy=False)
        self.norm = _norm(x)


def _places(mask: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of a mask that is false nearly everywhere: eight of its cells are looked at together."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    some = np.flatnonzero(flat[:whole].view(np.uint64))
    at, place = np.nonzero(flat[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[at] * 8 + place, whole + np.flatnonzero(flat[whole:])])


class _Asks:
    """Queries in the order of their ticks, with the k best that each has found so far."""

    def __init__(self, ids: np.ndarray, ats: np.ndarray, x: np.ndarray, k: int, decimals: int, floor: float | None):
        order = np.argsort(ats, kind="stable")
        self.ids, self.at, self.x = ids[order], ats[order], x[order]
        self.k, self.decimals, self.slack = k, decimals, 10.0**-decimals
        self.quick = self.x.astype(np.float32, copy=False)
        self.norm = _norm(self.x)
        m = len(self.ids)
        self.bar = np.full(m, -np.inf if floor is None else floor)
        self.dense = k <= _DENSE
        if self.dense:
            self.score, self.hit = np.full((m, k), -np.inf), np.full((m, k), np.iinfo(np.int64).max)
        else:
            self.more, self.held = [], 0

    def alive(self, c: _Corpus) -> tuple[int, int]:
        """Places of the queries for which some vector of ``c`` may be alive."""
        return int(np.searchsorted(self.at, c.lo, "right")), int(np.searchsorted(self.at, c.hi, "left"))

    def meet(self, c: _Corpus) -> None:
        first, last = self.alive(c)
        step = max(64, _STEP // len(c.ids))
        for a in range(first, last, step):
            self._part(c, a, min(last, a + step))

    def meet_all(self, corpus: list[_Corpus]) -> None:
        """Blocks that are alive for about the same queries are multiplied together."""
        met = sorted(
            ((int(last - first).bit_length(), first, last, c) for c in corpus for first, last in [self.alive(c)] if first < last),
            key=lambda m: m[:3])
        some, rows, work, lo, hi = [], 0, 0, 0, 0

        def done() -> None:
            if some:
                self.meet(some[0] if len(some) == 1 else _Corpus(*(np.concatenate(x) for x in zip(*((c.ids, c.born, c.dies, c.x) for c in some)))))

        for _, first, last, c in met:
            n, together = len(c.ids), (min(lo, first), max(hi, last))
            if some and (rows + n > _TOGETHER or (together[1] - together[0]) * (rows + n) > 1.25 * (work + (last - first) * n)):
                done()
                some, rows, work = [], 0, 0
            lo, hi = (first, last) if not some else together
            some.append(c)
            rows, work = rows + n, work + (last - first) * n
        done()

    def _part(self, c: _Corpus, a: int, b: int) -> None:
        n, at, bar = len(c.ids), self.at[a:b], self.bar[a:b]
        # beyond this, single precision may overflow
        single = self.norm < 1e15 and c.norm < 1e15
        error = (c.x.shape[1] + 8) * 2.0**-23 * self.norm * c.norm if single else 0.0
        s = self.quick[a:b] @ c.quick.T if single else self.x[a:b].astype(np.float64) @ c.x.T.astype(np.float64)
        least = bar - self.slack - error
        short = np.flatnonzero(np.isneginf(bar))
        if len(short):
            # without k hits there is no bar yet: the k-th best of what is alive here is one
            t = s[short]
            t[(c.born[None, :] >= at[short, None]) | (c.dies[None, :] <= at[short, None]) | np.isnan(t)] = -np.inf
            s[short] = t
            least[short] = -1e38 if single else -1e308
            if n > self.k:
                kth = np.partition(t, n - self.k, axis=1)[:, n - self.k].astype(np.float64)
                least[short] = np.maximum(least[short], kth - 2 * self.slack - 2 * error)
        if single:
            least = (least - np.abs(least) * 2.0**-22).astype(np.float32)
        found = _places(s >= least[:, None])
        if not len(found):
            return
        r, j = np.divmod(found, n)
        lives = (c.born[j] < at[r]) & (c.dies[j] > at[r])
        r, j = r[lives], j[lives]
        if not len(r):
            return
        if not single:
            v = s[r, j]
        elif len(r) * 16 > s.size:
            v = (self.x[a:b].astype(np.float64) @ c.x.T.astype(np.float64))[r, j]
        else:
            v = np.concatenate([
                np.einsum("ij,ij->i", self.x[a + r[i:i + 65536]].astype(np.float64), c.x[j[i:i + 65536]].astype(np.float64))
                for i in range(0, len(r), 65536)])
        v, ids = np.round(v, self.decimals), c.ids[j]
        fair = v >= bar[r]
        if self.dense:
            fair &= (v > self.score[a + r, -1]) | (ids <= self.hit[a + r, -1])
        if fair.any():
            self._add(a + r[fair], ids[fair], v[fair])

    def _add(self, r: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        if not self.dense:
            self.more.append((r, ids, v))
            self.held += len(r)
            if self.held > _MOST:
                self._shrink()
            return
        # of rows in order; each has its k best so far, if only as places
        rows = np.unique(r)
        of = np.concatenate([np.repeat(np.arange(len(rows)), self.k), np.searchsorted(rows, r)])
        ids = np.concatenate([self.hit[rows].ravel(), ids])
        v = np.concatenate([self.score[rows].ravel(), v])
        order = np.lexsort((ids, -v, of))
        of = of[order]
        top = order[np.arange(len(of)) - np.searchsorted(of, of, side="left") < self.k]
        self.score[rows], self.hit[rows] = v[top].reshape(-1, self.k), ids[top].reshape(-1, self.k)
        self.bar[rows] = np.maximum(self.bar[rows], self.score[rows, -1])

    def _shrink(self) -> None:
        r, ids, v = (np.concatenate(x) for x in zip(*self.more))
        order = np.lexsort((ids, -v, r))
        r, ids, v = r[order], ids[order], v[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, side="left")
        full = place == self.k - 1
        self.bar[r[full]] = v[full]
        top = place < self.k
        self.more, self.held = [(r[top], ids[top], v[top])], int(top.sum())

    def leave(self) -> Iterator[pa.RecordBatch]:
        """What was found so far; the bars stand."""
        if self.dense:
            r, place = np.nonzero(self.score > -np.inf)
            ids, v = self.hit[r, place], self.score[r, place]
        elif self.held:
            self._shrink()
            (r, ids, v), self.more, self.held = self.more[0], [], 0
        else:
            return
        for i in range(0, len(r), _MOST // 8):
            part = slice(i, i + _MOST // 8)
            yield pa.RecordBatch.from_arrays(
                [pa.array(self.ids[r[part]]), pa.array(ids[part]), pa.array(v[part] + 0.0)], names=["qid", "cid", "score"])


def _joined(blocks: list[dict], *setup) -> _Asks:
    return _Asks(*(np.concatenate([b[n] for b in blocks]) for n in ("ids", "ats", "x")), *setup)


class _Held:
    """The query blocks of a task: all of a group together, or one by one if pivots tell them apart."""

    def __init__(self, blocks: list[dict], pivots: bool, *setup):
        self.pivots, self.slack = pivots, 2 * 10.0 ** -setup[1]
        self.waiting, self.bytes = {}, 0
        self.groups: dict[str, list[dict]] = {}
        for b in blocks:
            self.groups.setdefault(b["grp"], []).append(b)
        if not pivots:
            self.all = {g: _joined(x, *setup) for g, x in self.groups.items()}
            return
        self.all, self.balls = {}, {}
        for g, x in self.groups.items():
            self.all |= {(g, i): _joined([b], *setup) for i, b in enumerate(x)}
            centre = np.array([b["centre"] for b in x])
            self.balls[g] = {
                "pivot": np.array([b["pivot"] for b in x]), "centre": centre, "norm": np.sqrt((centre**2).sum(axis=1)),
                "radius": np.array([b["radius"] for b in x]), "lo": np.array([b["ats"].min() for b in x]),
                "hi": np.array([b["ats"].max() for b in x]), "bar": np.array([self.all[g, i].bar.min() for i in range(len(x))])}

    def meet(self, c: _Corpus, grp: str, again: bool, pivot: int, centre: np.ndarray | None, radius: float | None) -> Iterator[pa.RecordBatch]:
        if grp not in self.groups:
            return
        if not self.pivots:
            self.waiting.setdefault(grp, []).append(c)
            self.bytes += c.x.nbytes
            if self.bytes > _WAITING:
                yield from self.settle()
            return
        x = self.balls[grp]
        met = (x["hi"] > c.lo) & (x["lo"] < c.hi) & ((x["pivot"] != pivot) if again else (x["pivot"] == pivot))
        if again:
            bound = x["centre"] @ centre + x["norm"] * radius + np.sqrt(centre @ centre) * x["radius"] + x["radius"] * radius
            met &= ~(bound < x["bar"] - self.slack)
        for i in np.flatnonzero(met):
            q = self.all[grp, i]
            q.meet(c)
            x["bar"][i] = q.bar.min()
            yield from self.relieve(q)

    def settle(self) -> Iterator[pa.RecordBatch]:
        """The blocks that wait meet their queries."""
        for grp, corpus in self.waiting.items():
            q = self.all[grp]
            # those of large k leave between the blocks
            for part in [corpus] if q.dense else [[c] for c in corpus]:
                q.meet_all(part)
                yield from self.relieve(q)
        self.waiting, self.bytes = {}, 0

    def relieve(self, q: _Asks) -> Iterator[pa.RecordBatch]:
        # the best of all parts are chosen outside
        if not q.dense and sum(x.held for x in self.all.values()) > _MOST:
            for x in self.all.values():
                yield from x.leave()

    def leave(self) -> Iterator[pa.RecordBatch]:
        yield from self.settle()
        for q in self.all.values():
            yield from q.leave()


def _score(k: int, decimals: int, floor: float | None, held_queries: bool, pivots: bool = False, single: bool = False):
    """Top-k of every query over the corpus blocks of a task.

    ``held_queries``: rows marked ``head`` are the task's query blocks, the others the corpus that
    streams past them; otherwise every query block is followed by all that it meets, and is done
    when the next one begins.
    """
    setup, dtype = (k, decimals, floor), np.float32 if single else np.float64

    def asked(row: dict) -> dict:
        ids, ats = (np.frombuffer(row[x], np.int64) for x in ("q_ids", "q_ats"))
        return {
            "grp": row["grp"], "pivot": row["q_pivot"], "ids": ids, "ats": ats, "x": np.frombuffer(row["q_vecs"], dtype).reshape(len(ids), -1),
            "centre": None if row["q_centre"] is None else np.frombuffer(row["q_centre"], np.float64), "radius": row["q_radius"]}

    def stored(row: dict) -> _Corpus:
        ids, born, dies = (np.frombuffer(row[x], np.int64) for x in ("ids", "borns", "dies"))
        return _Corpus(ids, born, dies, np.frombuffer(row["vecs"], dtype).reshape(len(ids), -1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                yield {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, None
        for row in rows(batches):
            if row["q_block"] != name:
                if held is not None:
                    yield from held.leave()
                name, held = row["q_block"], _Held([asked(row)], False, *setup)
            yield from held.meet(stored(row), row["grp"], False, 0, None, None)
        if held is not None:
            yield from held.leave()

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asks, early, held = [], [], None

        def meet(row: dict) -> Iterator[pa.RecordBatch]:
            centre = None if row["centre"] is None else np.frombuffer(row["centre"], np.float64)
            yield from held.meet(stored(row), row["grp"], row["again"], row["pivot"], centre, row["radius"])

        for row in rows(batches):
            if row["head"]:
                if held is not None:
                    raise RuntimeError("the queries of a task came in two parts")
                asks.append(asked(row))
            elif not asks:
                early.append(row)
            else:
                if held is None:
                    held = _Held(asks, pivots, *setup)
                    for x in early:
                        yield from meet(x)
                yield from meet(row)
        if held is None and asks and early:
            held = _Held(asks, pivots, *setup)
            for x in early:
                yield from meet(x)
        if held is not None:
            yield from held.leave()

    return streamed if held_queries else paired


_PACKED = ("grp string, pivot int, block string, ids binary, borns binary, dies binary, vecs binary, "
           "lo long, hi long, at_hi long, centre binary, radius double")


def _packer(single: bool, balls: bool):
    """Rows, sorted by block, to one row a block; ``balls``: with its centre and radius."""
    dtype = np.float32 if single else np.float64

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _PACKED.split(", ")]
        kinds = [pa.string(), pa.int32(), pa.string(), *[pa.binary()] * 4, *[pa.int64()] * 3, pa.binary(), pa.float64()]
        key, parts = None, []

        def block() -> tuple:
            ids, born, dies = (np.concatenate([p[i] for p in parts]) for i in range(3))
            x = np.concatenate([p[3] for p in parts])
            centre, radius = None, None
            if balls:
                wide = x.astype(np.float64)
                m = wide.mean(axis=0)
                centre, radius = m.tobytes(), float(np.sqrt(((wide - m) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-9
            return (*key, ids.tobytes(), born.tobytes(), dies.tobytes(), x.tobytes(), int(born.min()), int(dies.max()),
                    int(born.max()), centre, radius)

        def out(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names=names)

        for b in batches:
            if b.num_rows == 0:
                continue
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            x = _vectors(col["vec"], dtype)
            ids, born, dies = (col[n].to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for n in ("id", "born", "dies"))
            code = col["block"].dictionary_encode().indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [b.num_rows]])
            done = []
            for i, j in zip(starts[:-1], starts[1:]):
                mine = tuple(col[n][int(i)].as_py() for n in ("grp", "pivot", "block"))
                if mine != key:
                    if key is not None:
                        done.append(block())
                    key, parts = mine, []
                parts.append((ids[i:j].copy(), born[i:j].copy(), dies[i:j].copy(), x[i:j].copy()))
                if len(done) >= 64:
                    yield out(done)
                    done = []
            if done:
                yield out(done)
        if key is not None:
            yield out([block()])

    return pack


def _single(d: DataFrame) -> bool:
    """Singles stay singles on the way: the kernel multiplies again in double precision."""
    return isinstance(d.schema["vec"].dataType.elementType, T.FloatType)


def _pack(side: DataFrame, balls: bool = False) -> DataFrame:
    """One row a block; rows of a block that already lie in one partition of ``dest`` are not moved."""
    placed = side.repartition("grp", "pivot", "block") if "dest" not in side.columns else side
    rows = placed.select("grp", "pivot", "block", "id", "born", "dies", "vec").sortWithinPartitions("grp", "pivot", "block")
    return rows.mapInArrow(_packer(_single(side), balls), _PACKED)


def _grid(total: int, newest: int, cells: int, rows: int) -> tuple[int, int]:
    """Slices of time, and their width."""
    slices = max(1, -(-total // (cells * rows)))
    return slices, max(1, -(-(newest + 1) // slices))


def _placed(side: DataFrame, newest: int, width: int) -> DataFrame:
    """Add the class of a row's length of life and the slice of its birth."""
    lives = F.greatest((F.least("dies", F.lit(newest + 1)) - F.col("born")) / width, F.lit(1.0))
    return side.withColumn("life", F.floor(F.log2(lives)).cast("int")).withColumn(
        "slice", F.floor(F.col("born") / (width * F.pow(F.lit(2.0), F.col("life")))).cast("long")
    )


def _blocked(side: DataFrame, total: int, newest: int, cells: int, rows: int) -> DataFrame:
    """Add a block name: group, pivot, length of life, birth-time slice, and where that is full the
    part of the slice, and a salt where one part is full.

    ``cells`` is the number of groups and pivots at any time, ``newest`` the last tick.
    """
    if total <= rows:
        return side.withColumn("block", F.concat_ws(":", "grp", "pivot"))
    slices, width = _grid(total, newest, cells, rows)
    # a cell has 2^-life of the slices and is halved as often, if not too often, so the number of
    # parts is bounded by what was measured; the vectors are then shuffled once, to their blocks
    parts = lambda h: cells * ((h + 2) * (slices + 1) + slices.bit_length() * 2**h)
    halvings = max([h for h in range(_HALVINGS + 1) if parts(h) <= PHYSICAL.most_cells], default=0)
    key = ["grp", "pivot", "life", "slice"]
    cell = _placed(side, newest, width).withColumn(
        "part", F.floor(F.col("born") / (width * F.pow(F.lit(2.0), F.greatest(F.col("life") - halvings, F.lit(0))))).cast("long"))
    before = W.partitionBy(*key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    full = cell.groupBy(*key, "part").agg(F.count("*").alias("n")).select(
        *key, "part", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(rows)).cast("long").alias("bin"),
        F.ceil(F.col("n") / F.lit(rows)).cast("int").alias("salts"))
    if parts(halvings) <= PHYSICAL.most_cells:
        full = F.broadcast(full)
    return cell.join(full, [*key, "part"]).withColumn(
        "block", F.concat_ws(":", *key, "bin", F.pmod(F.xxhash64("id"), F.col("salts")))
    )


def _stretched(side: DataFrame, total: int, newest: int, cells: int, rows: int) -> DataFrame:
    """Add the stretch of time that a row belongs to, a longer one for longer lives, and the place of its slice in it."""
    if total <= rows:
        return side.withColumns({"stretch": F.struct(F.lit(0).alias("life"), F.lit(0).cast("long").alias("at")), "place": F.lit(0).cast("long")})
    slices, width = _grid(total, newest, cells, rows)
    most = max(1, min(_STRETCHES, total // _STRETCH_ROWS))
    level = max(0, (-(-slices // most) - 1).bit_length())
    d = side if "life" in side.columns else _placed(side, newest, width)
    life = F.greatest("life", F.lit(level))
    at = F.floor(F.col("born") / (width * F.pow(F.lit(2.0), life))).cast("long")
    place = F.floor(F.col("slice") * F.pow(F.lit(2.0), F.col("life") - max(0, level - 6))).cast("long")
    return d.withColumns({"stretch": F.struct(life.alias("life"), at.alias("at")), "place": place})


def _dealt(plain: DataFrame, side: DataFrame, total: int, newest: int, cells: int, rows: int, balls: bool) -> tuple[DataFrame, dict]:
    """Written blocks, and of every stretch its parts: (first birth, last birth, last death, their files).

    ``plain`` are the births and deaths of ``side``.  A stretch has 64 places at most, and places next to each other share a file.
    """
    spark = side.sparkSession
    cores = spark.sparkContext.defaultParallelism
    kept = _stretched(plain, total, newest, cells, rows).groupBy("stretch", "place").agg(
        F.count("*").alias("n"), F.min("born").alias("lo"), F.max("born").alias("at_hi"), F.max("dies").alias("hi")).collect()
    most, files, spans, places = max(rows, min(64 * rows, -(-total // (2 * cores)))), 0, {}, []
    for r in sorted(kept):
        key, n, span = tuple(r["stretch"]), r["n"], (r["lo"], r["at_hi"], r["hi"])
        parts = spans.setdefault(key, [])
        if parts and parts[-1][0] + n <= most:
            held, (lo, at_hi, hi), at = parts[-1]
            parts[-1] = (held + n, (min(lo, span[0]), max(at_hi, span[1]), max(hi, span[2])), at)
        else:
            at = range(files, files - (-n // most))
            files = at.stop
            parts.append((n, span, at))
        places.append((*key, r["place"], at.start, len(at)))
    to = F.broadcast(spark.createDataFrame(places, "life_at int, at long, place long, first int, parts int"))
    members = _stretched(_blocked(side, total, newest, cells, rows), total, newest, cells, rows).withColumns(
        {"life_at": F.col("stretch.life"), "at": F.col("stretch.at")}).join(to, ["life_at", "at", "place"]).withColumn(
        "dest", (F.col("first") + F.pmod(F.xxhash64("block"), F.col("parts"))).cast("int"))
    table = cut(_pack(members.repartitionById(files, F.col("dest")), balls))
    # a task writes what it holds under its own number
    names = {int(re.match(r"part-(\d+)", x).group(1)): x for x in (f.rsplit("/", 1)[-1] for f in table.inputFiles())}
    return table, {key: [(*span, [names[i] for i in at if i in names]) for _, span, at in parts] for key, parts in spans.items()}


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int,
    *,
    decimals: int = 6,
    floor: float | None = None,
    block_rows: int | None = None,
    max_pivots: int | None = None,
) -> DataFrame:
    """The ``k`` best live vectors for every query.

    ``queries``: id, at, vec [, grp]; ``corpus``: id, valid_from, valid_to, vec [, grp].
    With ``grp``, only vectors of the query's own group match.  A vector is live for a
    query iff valid_from < at < valid_to.  Scores are rounded to ``decimals`` and ties
    go to the smaller id.  Result: qid, cid, score, rank.
    """
    rows = block_rows or PHYSICAL.block_rows
    # A constant shared value, not data: ungrouped input is one group.
    q = queries if "grp" in queries.columns else queries.withColumn("grp", F.lit(""))
    c = corpus if "grp" in corpus.columns else corpus.withColumn("grp", F.lit(""))

    def vector(d: DataFrame) -> Column:
        single = all(_single(x) for x in (q, c))
        return F.col("vec") if single else F.col("vec").cast("array<double>").alias("vec")

    mine = ["id", "grp"]
    q, c = (
        q.select(*mine, F.col("at").cast("long").alias("born"), F.lit(0).cast("long").alias("dies"), vector(q)),
        c.select(*mine, F.col("valid_from").cast("long").alias("born"),
                 F.coalesce(F.col("valid_to").cast("long"), F.lit(FOREVER)).alias("dies"), vector(c)),
    )
    single = _single(c)

    def optimized(d: DataFrame):
        return d.drop("dies")._jdf.queryExecution().optimizedPlan()

    # the queries are the corpus' own rows, each asked at its birth
    own = bool(optimized(q).sameResult(optimized(c)))

    plain_q, plain_c = (d.select("born", "dies") for d in (q, c))

    def extent(d: DataFrame, side: int) -> DataFrame:
        lasts = F.col("dies") == FOREVER
        return d.agg(F.lit(side).alias("side"), F.count("*").alias("n"), F.max("born").alias("b"),
                     F.approx_count_distinct("grp").alias("groups"), F.lit(None).cast("int").alias("dim"),
                     F.sum(F.when(~lasts, F.col("dies") - F.col("born")).cast("double")).alias("lived"),
                     F.count_if(lasts).alias("last"), F.sum(F.when(lasts, F.col("born")).cast("double")).alias("since"))

    # vectors are of one length, so one tells how wide they are
    one = c.limit(1).select(F.lit(2), F.lit(0), F.lit(0), F.lit(0), F.size("vec"), F.lit(0.0), F.lit(0), F.lit(0.0))
    asked, size, *width = sorted(extent(q, 0).unionByName(extent(c, 1)).union(one).collect())
    n, newest = size["n"], max(asked["b"] or 0, size["b"] or 0)
    held = n * max(width[0]["dim"] or 0, 0) * 8 if width else 0
    fits = held <= PHYSICAL.corpus_bytes and max_pivots is None
    pivots = 1
    if not fits:
        # what is alive at one moment is what pivots divide
        alive_ticks = (size["lived"] or 0) + size["last"] * (newest + 1) - (size["since"] or 0)
        at_once = n if max_pivots else int(min(n, alive_ticks / (newest + 1)))
        pivots = int(max(1, min(max_pivots or PHYSICAL.max_pivots, at_once // (8 * rows))))
    if pivots > 1:
        # at most max_pivots vectors and a few more to try them on reach the driver
        most = pivots if max_pivots else 8 * PHYSICAL.max_pivots
        picked = c.where("vec IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(most).select("vec").collect()
        picked = np.array([r["vec"] for r in picked], dtype=np.float64)
        if not max_pivots and _pruned(picked, picked[:pivots]) < 0.2:
            pivots = 1
    if pivots > 1:
        assign = _nearest_pivot(picked[:pivots])
        q, c = (
            d.withColumn("pivot", F.lit(0)).mapInArrow(
                assign, d.withColumn("pivot", F.lit(0)).schema
            )
            for d in (q, c)
        )
    else:
        q, c = (d.withColumn("pivot", F.lit(0)) for d in (q, c))

    def blocked(d: DataFrame, extent) -> DataFrame:
        return _blocked(d, extent["n"] or 1, newest, pivots * max(1, extent["groups"]), rows)

    per_query = W.partitionBy("qid").orderBy(F.desc("score"), "cid")

    def best(hits: DataFrame) -> DataFrame:
        return hits.withColumn("rank", F.row_number().over(per_query).cast("long")).where(F.col("rank") <= k)

    result = "qid long, cid long, score double"
    asks = {"ids": "q_ids", "borns": "q_ats", "vecs": "q_vecs", "pivot": "q_pivot", "centre": "q_centre", "radius": "q_radius"}
    if fits:
        # the corpus was measured: it is small enough to meet the query blocks where they are
        qb = _pack(blocked(q, asked)).drop("dies", "hi").withColumnsRenamed({**asks, "block": "q_block", "lo": "q_lo", "at_hi": "q_hi"})
        cb = _pack(blocked(c, size)).drop("pivot", "centre", "radius").withColumnRenamed("grp", "c_grp")
        alive = (F.col("lo") < F.col("q_hi")) & (F.col("hi") > F.col("q_lo"))
        pairs = qb.repartition(F.col("q_block")).join(F.broadcast(cb), F.col("grp") == F.col("c_grp")).where(alive)
        pairs = pairs.select("grp", "q_block", *asks.values(), "ids", "borns", "dies", "vecs")
        return best(pairs.mapInArrow(_score(k, decimals, floor, held_queries=False, single=single), result))

    # Both sides are read by many tasks, so they are written once to the shared folder, in
    # files enough for every core; what a block is made of is dealt to its file at once.
    def dealt(plain: DataFrame, d: DataFrame, extent) -> tuple[DataFrame, dict]:
        return _dealt(plain, d, extent["n"], newest, pivots * max(1, extent["groups"]), rows, pivots > 1)

    if not (n and asked["n"]):
        return queries.sparkSession.createDataFrame([], f"{result}, rank long")
    cb, stored = dealt(plain_c, c, size)
    qb, asking = (cb, stored) if own else dealt(plain_q, q, asked)
    head = queries.sparkSession.range(1).select(F.lit(True).alias("head"))
    hits = None
    for parts in asking.values():
        first, last = min(p[0] for p in parts), max(p[1] for p in parts)
        near = [x for y in stored.values() for born, _, hi, x in y if born < last and hi > first]
        files = [x for p in parts for x in p[3]]
        if not near:
            continue
        in_files = lambda d, names: d.where(F.col("_metadata.file_name").isin(names))
        blocks = in_files(cb, [x for y in near for x in y]).select(
            F.lit(False).alias("head"), F.lit(False).alias("again"), "grp", "pivot", "ids", "borns", "dies", "vecs", "centre", "radius")
        past = head.unionByName(blocks, allowMissingColumns=True)
        if pivots > 1:
            past = past.unionByName(blocks.withColumn("again", F.lit(True)))
        mine = in_files(qb, files).coalesce(len(files)).select(
            F.col("grp").alias("q_grp"), *[F.col(x).alias(y) for x, y in asks.items()],
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("nth"))
        # the head meets all query blocks of a task, what streams past comes with the first of them
        met = past.coalesce(1).hint("shuffle_replicate_nl").join(mine, F.col("head") | (F.col("nth") == 0))
        rows_of = met.select(
            "head", "again", F.when(F.col("head"), F.col("q_grp")).otherwise(F.col("grp")).alias("grp"),
            *[F.when(F.col("head"), F.col(x)).alias(x) for x in asks.values()],
            "pivot", "ids", "borns", "dies", "vecs", "centre", "radius")
        part = rows_of.mapInArrow(_score(k, decimals, floor, held_queries=True, pivots=pivots > 1, single=single), result)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return queries.sparkSession.createDataFrame([], f"{result}, rank long")
    return best(hits)


def as_corpus(chunks: DataFrame) -> DataFrame:
    """Chunk vectors keyed by their arrival number."""
    return chunks.select(F.col("seq").alias("id"), "valid_from", "valid_to", "vec")


def vector_candidates(readers: DataFrame, chunks: DataFrame, k: int, **kw) -> DataFrame:
    """Vector-only discovery: (seq, cand, score, rank); ``readers`` has seq, at, vec.

    The reader's own chunk is not in the index yet, so nothing has to be dropped.
    """
    found = knn_join(readers.select(F.col("seq").alias("id"), "at", "vec"), as_corpus(chunks), k, **kw)
    return found.withColumnsRenamed({"qid": "seq", "cid": "cand"})
