"""Suffix-array dedup of repeated byte strings across documents.

Removed is each byte that a ``WIDTH``-byte string covers which also starts in a document with a
smaller doc_id; strings are judged on the input.

Suffix order by linear grouping construction (``suffix_order``): suffixes are grouped by
their Lyndon prefixes.  Groups are processed in descending order; previous-smaller pointers
tell which earlier suffixes a group extends, and those move to new groups.  A second sweep in
ascending order emits the members of every group in order.  Nothing is renamed or sorted
recursively.

Distribution.  Winnowing picks, in every ``WIDTH``-byte string, the ``GRAM``-byte gram with the
least hash (ties: the last one) as its anchor, so equal strings have equal anchors at equal
places and need only be compared below the same anchor.  The strings of one anchor in a text
are consecutive: its context is a stretch of at most 76 bytes.  Blocks of documents and
hash buckets exchange packed messages twice:

1. a block asks which of its anchors any other document has (four bytes per anchor, one
   byte back);
2. for the shared ones it sends each context once, with its smallest doc_id.  A bucket
   merges equal contexts, suffix-sorts different contexts of an anchor together, and answers
   with the smallest doc_id of the context and, for each of its strings, whether a smaller
   one has it.

A hot anchor is one row per block and context, not per document; an anchor that more than
``HOT_BLOCKS`` blocks have is sent as single strings keyed by their own hashes instead, so no
bucket gets all contexts of a frequent gram.  Texts are read from the packed blocks and are
never grouped by key.

Cases: a null text is empty; a text of fewer than ``WIDTH`` bytes loses nothing; of rows with
equal doc_id none is smaller than the other; a row without doc_id is not compared and keeps
all its bytes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from vigilkb.llm.common import mix, parts, run_hashes, small_batches
from vigilkb.session import cut

WIDTH, GRAM = 50, 24
WINDOW = WIDTH - GRAM + 1
#: Text bytes in a packed block, and anchors in a bucket, on average.
BLOCK_BYTES, BUCKET_ANCHORS = 8 << 20, 1 << 19
HOT_BLOCKS = 4096

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_U = np.uint64
_PLACE = (1 << 21) - 1
_PIECE = 1 << 20


# ------------------------------------------------------------------ suffix order

def suffix_order(text: list[int]) -> list[int]:
    """The starts of all suffixes in ascending order, in linear time."""
    n = len(text)
    if not n:
        return []
    letters = sorted(set(text))
    place = {c: k for k, c in enumerate(letters)}
    group = [place[c] for c in text]
    members: list[list[int]] = [[] for _ in letters]
    for i, g in enumerate(group):
        members[g].append(i)
    size = [len(m) for m in members]
    below = list(range(-1, len(letters) - 1))
    above = [*range(1, len(letters)), -1]
    done = [False] * len(letters)
    smaller = [-1] * n

    def part(old: int, some: list[int]) -> None:
        """``some`` members of a group become a group of their own, right above it."""
        new = len(members)
        up = above[old]
        members.append(some)
        size.append(len(some))
        size[old] -= len(some)
        done.append(False)
        below.append(old)
        above.append(up)
        below[up] = new
        above[old] = new
        for p in some:
            group[p] = new

    now = len(letters) - 1
    while now != -1:
        own = members[now]
        if len(own) != size[now]:
            own = [i for i in own if group[i] == now]
        done[now] = True
        if len(own) == 1:
            p = own[0] - 1
            while p >= 0 and done[group[p]]:
                p = smaller[p]
            smaller[own[0]] = p
            # a group that is extended as a whole stays as it is
            if p >= 0 and size[group[p]] > 1:
                part(group[p], [p])
        else:
            times: dict[int, int] = {}
            for i in own:
                p = i - 1
                while p >= 0 and done[group[p]]:
                    p = smaller[p]
                smaller[i] = p
                if p >= 0:
                    times[p] = times.get(p, 0) + 1
            # those that this group extends most often are the largest of their group
            levels: dict[int, dict[int, list[int]]] = {}
            for p, t in times.items():
                levels.setdefault(t, {}).setdefault(group[p], []).append(p)
            for t in sorted(levels, reverse=True):
                for old, some in levels[t].items():
                    if len(some) != size[old]:
                        part(old, some)
        now = below[now]
    # ascending: where every group begins
    start = [0] * len(members)
    at, low = 0, 0
    while below[low] != -1:
        low = below[low]
    while low != -1:
        start[low] = at
        at += size[low]
        low = above[low]
    order = [-1] * n
    placed = bytearray(n)
    for k in range(-1, n):
        p = (order[k] if k >= 0 else n) - 1
        while p >= 0 and not placed[p]:
            g = group[p]
            order[start[g]] = p
            start[g] += 1
            placed[p] = 1
            p = smaller[p]
    return order


# ------------------------------------------------------------------ anchors

def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start of the first string, number of strings, anchor hash, text, place after the start) of every anchor."""
    found = []
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for a in range(0, max(len(data) - WIDTH + 1, 0), _PIECE):
        piece = data[a : a + _PIECE + WIDTH - 1]
        n = len(piece) - WIDTH + 1
        x = piece.astype(_U)
        x = x[:-1] | (x[1:] << _U(8))
        x = x[:-2] | (x[2:] << _U(16))
        x = x[:-4] | (x[4:] << _U(32))
        gram = mix(x[: -GRAM + 8])
        for i in range(8, GRAM, 8):
            gram = mix(gram * _U(0x9E3779B97F4A7C15) + x[i : len(x) - GRAM + 8 + i])
        m = len(gram)
        key = (gram & ~_U(_PLACE)) | (_U(_PLACE) - np.arange(m, dtype=_U))
        pad = -m % WINDOW
        grid = np.concatenate([key, np.full(pad, ~_U(0))]).reshape(-1, WINDOW)
        ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
        back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        least = np.minimum(back[:n], ahead[WINDOW - 1 : WINDOW - 1 + n])
        place = _PLACE - (least & _U(_PLACE)).astype(np.int64)
        text = owner[a : a + n]
        whole = np.arange(a, a + n) + WIDTH <= offsets[text + 1]
        new = whole.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
        first = np.flatnonzero(new)
        running = np.concatenate([[0], np.cumsum(whole)])
        many = running[np.append(first[1:], n)] - running[first]
        found.append((first + a, many, gram[place[first]], text[first], place[first] - first))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U), none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stretches(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of several stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Block:
    """Documents packed together."""

    def __init__(self, payload: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int.from_bytes(raw[:8], "little")
        head = np.frombuffer(raw, np.int64, 3 * n + 1, 8)
        self.ids, self.named, self.offsets = head[:n], head[n : 2 * n].astype(bool), head[2 * n :]
        self.data = np.frombuffer(raw, np.uint8, -1, 8 * (3 * n + 2))

    @staticmethod
    def pack(rows: list[tuple[int | None, bytes]]) -> bytes:
        ids = np.array([d or 0 for d, _ in rows], np.int64)
        named = np.array([d is not None for d, _ in rows], np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(t) for _, t in rows])]).astype(np.int64)
        head = len(rows).to_bytes(8, "little") + ids.tobytes() + named.tobytes() + offsets.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + b"".join(t for _, t in rows))

    def anchors(self) -> tuple[np.ndarray, ...]:
        """Anchors of the texts, taken in steps that fit the kernels' memory."""
        out, first = [], 0
        n = len(self.ids)
        while first < n:
            last = max(first + 1, int(np.searchsorted(self.offsets, self.offsets[first] + _PIECE, "right")) - 1)
            a = self.offsets[first]
            s, m, g, t, o = anchors(self.data[a : self.offsets[last]], self.offsets[first : last + 1] - a)
            out.append((s + a, m, g, t + first, o))
            first = last
        out = tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else anchors(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        keep = self.named[out[3]] if len(out[3]) else np.zeros(0, bool)
        return tuple(x[keep] for x in out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def row(rows: list) -> pa.RecordBatch:
        payload = Block.pack(rows)
        # named by its content and place: the same again when a task is repeated
        name = hashlib.sha256(payload).hexdigest()[:24]
        size = sum(len(t) for _, t in rows)
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([payload], pa.binary())], ["name", "size", "payload"])

    rows, size = [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            rows.append((doc, (text or "").encode("utf-8", "replace")))
            size += len(rows[-1][1])
            if size >= BLOCK_BYTES:
                yield row(rows)
                rows, size = [], 0
    if rows:
        yield row(rows)


# ------------------------------------------------------------------ messages

def _squeeze(*arrays: np.ndarray) -> bytes:
    head = np.array([a.nbytes for a in arrays], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unsqueeze(blob: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, np.int64, len(kinds)), 8 * len(kinds), []
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _asked(gram: np.ndarray, text_ids: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, sorted short hashes, held by several documents) of a block's anchors."""
    order = np.lexsort((text_ids, gram >> _U(24), gram % _U(buckets)))
    bucket, short, doc = (gram % _U(buckets)).astype(np.int64)[order], (gram >> _U(24))[order], text_ids[order]
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (short[1:] != short[:-1])
    heads = np.flatnonzero(new)
    if not len(heads):
        return
    several = np.maximum.reduceat(doc, heads) != np.minimum.reduceat(doc, heads)
    b, s = bucket[heads], short[heads]
    cuts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for i, j in zip(cuts, np.append(cuts[1:], len(b)), strict=True):
        yield int(b[i]), s[i:j], several[i:j]


_MESSAGE = "name string, bucket int, blob binary"


def _message(rows: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())],
        ["name", "bucket", "blob"],
    )


def _first_requests(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(payload)
                _, _, gram, text, _ = block.anchors()
                # gaps of sorted hashes are small numbers
                yield _message([
                    (name, b, _squeeze(np.diff(short, prepend=_U(0)).astype(np.uint32 if np.diff(short, prepend=_U(0)).max() < 2**32 else _U), several))
                    for b, short, several in _asked(gram, block.ids[text], buckets)
                ])
    return ask


def _first_answers(table: pa.Table) -> pa.Table:
    """Per short hash of each block: 0 no other document has it, 1 some have it, 2 very many blocks have it."""
    asked = []
    for blob in table.column("blob").to_pylist():
        gaps, several = _unsqueeze(blob, np.uint8, bool)
        asked.append((np.cumsum(gaps.view(np.uint32 if len(gaps) == 4 * len(several) else _U).astype(_U)), several))
    sizes = [len(s) for s, _ in asked]
    hashes, several = np.concatenate([s for s, _ in asked]), np.concatenate([m for _, m in asked])
    _, inverse, many = np.unique(hashes, return_inverse=True, return_counts=True)
    twice = np.zeros(len(many), bool)
    twice[inverse[several]] = True
    fate = np.where(many > HOT_BLOCKS, 2, ((many > 1) | twice).astype(np.int64)).astype(np.uint8)[inverse]
    ends = np.cumsum(sizes)
    blobs = [_squeeze(fate[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    return pa.table({"name": table.column("name"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})


def _second_requests(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, payload, answers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                block = Block(payload)
                start, many, gram, text, inside = block.anchors()
                told = {a["bucket"]: a["blob"] for a in answers or []}
                fate = np.zeros(len(gram), np.uint8)
                of = (gram % _U(buckets)).astype(np.int64)
                order = np.argsort(of, kind="stable")
                cuts = np.searchsorted(of[order], np.arange(buckets + 1))
                for b, short, _ in _asked(gram, block.ids[text], buckets):
                    mine = order[cuts[b] : cuts[b + 1]]
                    fate[mine] = _unsqueeze(told[b], np.uint8)[0][np.searchsorted(short, gram[mine] >> _U(24))]
                hot = np.flatnonzero(fate == 2)
                keep = fate == 1
                if len(hot):  # every string of a hot anchor stands for itself
                    single = _stretches(start[hot], many[hot])
                    key = run_hashes(block.data, single, single + WIDTH)
                    start = np.concatenate([start[keep], single])
                    gram, text = np.concatenate([gram[keep], key]), np.concatenate([text[keep], np.repeat(text[hot], many[hot])])
                    many = np.concatenate([many[keep], np.ones(len(single), np.int64)])
                    inside = np.concatenate([inside[keep], np.zeros(len(single), np.int64)])
                else:
                    start, many, gram, text, inside = start[keep], many[keep], gram[keep], text[keep], inside[keep]
                # each context once, with its smallest document
                content = run_hashes(block.data, start, start + many + WIDTH - 1)
                doc = block.ids[text]
                order = np.lexsort((doc, content, gram, gram % _U(buckets)))
                new = np.ones(len(order), bool)
                new[1:] = (gram[order][1:] != gram[order][:-1]) | (content[order][1:] != content[order][:-1])
                entry = np.empty(len(order), np.int64)
                entry[order] = np.cumsum(new) - 1
                heads = order[new]
                of = (gram[heads] % _U(buckets)).astype(np.int64)
                cuts = np.searchsorted(of, np.arange(buckets + 1))
                # what the block must remember goes along, as a message that no bucket answers
                rows = [(name, -1 - int(hashlib.sha256(name.encode()).hexdigest()[:8], 16) % buckets, _squeeze(start, many.astype(np.uint8), text.astype(np.int32), entry.astype(np.int32), np.diff(cuts)))]
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    h = heads[cuts[b] : cuts[b + 1]]
                    size = many[h] + WIDTH - 1
                    rows.append((name, b, _squeeze(gram[h], doc[h], size.astype(np.uint8), inside[h].astype(np.uint8), block.data[_stretches(start[h], size)])))
                yield _message(rows)
    return ask


#: Bytes of contexts that are suffix-sorted together.
SORTED_BYTES = 1 << 16


def _older(data: np.ndarray, at: np.ndarray, size: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For contexts of some anchors: bit i tells that a document before ``least`` has the i-th string."""
    n = size - WIDTH + 1
    text = np.zeros(int(size.sum()) + len(size), np.int64)
    begin = np.cumsum(size + 1) - (size + 1)
    text[_stretches(begin, size)] = data[_stretches(at, size)].astype(np.int64) + 1
    owner = np.repeat(np.arange(len(size)), size + 1)
    nth = np.arange(len(text)) - begin[owner]
    order = np.array(suffix_order(text.tolist()))
    order = order[nth[order] < n[owner[order]]]  # only those that begin a whole string
    strings = text[order[:, None] + np.arange(WIDTH)]
    new = np.concatenate([[True], (strings[1:] != strings[:-1]).any(axis=1)])
    heads = np.flatnonzero(new)
    low = np.minimum.reduceat(least[owner[order]], heads)[np.cumsum(new) - 1]
    bits = np.where(low < least[owner[order]], _U(1) << nth[order].astype(_U), _U(0))
    out = np.zeros(len(size), _U)
    np.bitwise_or.at(out, owner[order], bits)
    return out


def _related(data: np.ndarray, at: np.ndarray, size: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Contexts that agree with another one on the half of a string before the gram, or on the half
    after it.  Two contexts that share a string agree on one of them; the others have none to sort."""
    half, out = (WIDTH - GRAM) // 2, np.zeros(len(at), bool)
    for begin, end in ((inside - half, inside + GRAM), (inside, inside + GRAM + half)):
        whole = np.flatnonzero((begin >= 0) & (end <= size))
        _, inverse, times = np.unique(run_hashes(data, at[whole] + begin[whole], at[whole] + end[whole]), return_inverse=True, return_counts=True)
        out[whole[times[inverse] > 1]] = True
    return out


def _second_answers(table: pa.Table) -> pa.Table:
    """Per context of each block: its smallest document, and the strings that an even smaller one has."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    asked = [_unsqueeze(blob, _U, np.int64, np.uint8, np.uint8, np.uint8) for blob in table.column("blob").to_pylist()]
    counts = [len(g) for g, *_ in asked]
    gram, doc, size, inside, data = (np.concatenate([a[i] for a in asked]) for i in range(5))
    size, inside = size.astype(np.int64), inside.astype(np.int64)
    at = np.cumsum(size) - size
    content = run_hashes(data, at, at + size)
    order = np.lexsort((content, gram))
    new = np.ones(len(order), bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (content[order][1:] != content[order][:-1])
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], heads)
    context = order[heads]
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    anchor = np.concatenate([[True], gram[context][1:] != gram[context][:-1]])
    first = np.flatnonzero(anchor)
    mixed = np.repeat(np.diff(first, append=len(context)) > 1, np.diff(first, append=len(context)))
    older = np.zeros(len(context), _U)
    todo = np.flatnonzero(mixed)
    todo = todo[_related(data, at[context[todo]], size[context[todo]], inside[context[todo]])]
    fill = np.cumsum(size[context[todo]])
    breaks = [0]
    anchor = np.append(True, gram[context[todo]][1:] != gram[context[todo]][:-1]) if len(todo) else anchor[:0]
    for k in np.flatnonzero(anchor).tolist():  # whole anchors, up to a size
        if fill[k - 1] - (fill[breaks[-1] - 1] if breaks[-1] else 0) > SORTED_BYTES and k:
            breaks.append(k)
    for a, b in zip(breaks, [*breaks[1:], len(todo)], strict=True):
        if b > a:
            c = context[todo[a:b]]
            older[todo[a:b]] = _older(data, at[c], size[c], least[todo[a:b]])
    ends = np.cumsum(counts)
    blobs = [_squeeze(least[entry[e - n : e]], older[entry[e - n : e]]) for e, n in zip(ends, counts, strict=True)]
    return pa.table({"name": table.column("name"), "bucket": table.column("bucket"), "blob": pa.array(blobs, pa.binary())})


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload, answers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            block = Block(payload)
            change = np.zeros(len(block.data) + 1, np.int64)
            told = {a["bucket"]: a["blob"] for a in answers or []}
            own = next((b for b in told if b < 0), None)
            if own is not None:
                start, many, text, entry, _ = _unsqueeze(told[own], np.int64, np.uint8, np.int32, np.int32, np.int64)
                got = [_unsqueeze(told[b], np.int64, _U) for b in sorted(b for b in told if b >= 0)]
                if got:
                    least, older = (np.concatenate([g[i] for g in got])[entry] for i in range(2))
                    nth = _stretches(np.zeros(len(many), np.int64), many.astype(np.int64))
                    anchor = np.repeat(np.arange(len(many)), many)
                    gone = (least[anchor] < block.ids[text[anchor]]) | ((older[anchor] >> nth.astype(_U)) & _U(1)).astype(bool)
                    s = (start[anchor] + nth)[gone]
                    np.add.at(change, s, 1)
                    np.add.at(change, s + WIDTH, -1)
            covered = np.cumsum(change)[:-1] > 0
            out = []
            for i, d in enumerate(block.ids.tolist()):
                a, b = block.offsets[i], block.offsets[i + 1]
                c = covered[a:b]
                spans = int(c[:1].sum() + (c[1:] & ~c[:-1]).sum())
                out.append((d if block.named[i] else None, b - a, int(c.sum()), spans, hashlib.sha256(block.data[a:b][~c].tobytes()).hexdigest()))
            names = [x.split()[0] for x in RESULT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if i == 4 else pa.int64()) for i in range(5)], names)


def repeats(docs: DataFrame) -> DataFrame:
    """One row of ``RESULT`` per document."""
    spark = docs.sparkSession
    small_batches(spark)
    packed = cut(docs.select("doc_id", "text").mapInArrow(_blocks, "name string, size long, payload binary").withColumn("name", F.concat_ws("-", "name", F.spark_partition_id(), F.monotonically_increasing_id())))
    total = packed.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    buckets = max(parts(spark), total * 2 // (WINDOW + 1) // BUCKET_ANCHORS)
    small_batches(spark, 4)  # rows are whole blocks from here on
    shared = cut(
        packed.select("name", "payload").mapInArrow(_first_requests(buckets), _MESSAGE)
        .groupBy("bucket").applyInArrow(_first_answers, _MESSAGE)
    )
    answers = cut(
        packed.select("name", "payload").join(shared.groupBy("name").agg(F.collect_list(F.struct("bucket", "blob")).alias("told")), "name", "left")
        .select("name", "payload", "told").mapInArrow(_second_requests(buckets), _MESSAGE)
        .groupBy("bucket").applyInArrow(_second_answers, _MESSAGE)
    )
    return (
        packed.select("name", "payload").join(answers.groupBy("name").agg(F.collect_list(F.struct("bucket", "blob")).alias("told")), "name", "left")
        .select("payload", "told").mapInArrow(_removed, RESULT)
    )
