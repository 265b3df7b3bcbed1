"""Near-duplicate documents by BagMinHash, bands and verified multiset overlap.

A document is the multiset of its five-word shingles (of fewer words: one shingle).  Two
documents are linked if their weighted Jaccard similarity is 0.8 or more; a class is a
connected component of links.

Signature (BagMinHash): the plane of (weight, time) above every shingle holds a Poisson
process of points, each assigned to one of ``SIGNATURE`` components.  Weights are the integer
multiplicities; the weight axis is split into the strips (0,1], (1,2], (2,4], (4,8] ...,
each with a process of its own whose points come in order of time and carry the integer
level they lie at.  A document of multiplicity w sees the points at levels up to w, and a
component keeps the earliest one, so two documents agree in a component with probability
equal to their weighted Jaccard similarity.  Strips whose next point is later than the
latest component are done, so long documents need about one point per shingle.

Search: copies (equal multisets) first collapse into one representative.  Signatures are cut
into ``BANDS`` bands of ``ROWS``; representatives with an equal band share a bucket.  At
similarity 0.8 a pair has no common band with a chance of 5e-8.  No bucket is expanded into
all pairs.  First its most connected member (the one whose buckets are largest: the text that
near copies were made from shares a bucket with all of them) and its smallest one are compared
with the others; in a later round r about 64^r members, spread by hash, with those that are
not in their class yet.  A pair that has several bands in common is left to the smallest of
them, so it is compared once.  A bucket is done when it has one class or all its members were
compared, so buckets of near copies end after the first round, and no pair of different
classes stays uncompared.

Exact test before a comparison: the shingles, each repeat as one of its own, are dealt into
``CELLS`` cells, and of each cell the parity of its count is kept.  A shingle that only one of
two documents has changes one parity, so the number of cells with unequal parities is at most
the size of the symmetric difference, and a pair where it is more than a link allows is none.

Words are runs other than ASCII white space.  Cases: documents without words have a class
each; a null doc_id is not looked at; rows with equal doc_id are one document; other columns
are not read.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.llm.common import blocks, mix, per_text, run_hashes, runs, small_batches
from vigilkb.session import cut

SHINGLE_WORDS, LEAST = 5, 0.8
BANDS, ROWS = 32, 4
SIGNATURE = BANDS * ROWS
CELLS = 1024

_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_U = np.uint64


def shingles(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, shingle hashes, where each text's begin)."""
    for first, last, data, offsets in blocks(texts):
        starts, ends = runs(~_SPACE[data], offsets)
        words, at = run_hashes(data, starts, ends), np.searchsorted(starts, offsets)
        sizes = np.diff(at)
        length = np.minimum(sizes, SHINGLE_WORDS)  # words per shingle of each text
        many = np.where(sizes > 0, sizes - length + 1, 0)
        where = np.concatenate([[0], np.cumsum(many)])
        text = np.repeat(np.arange(len(sizes)), many)
        begin = at[text] + np.arange(where[-1]) - where[text]
        h = length[text].astype(_U)
        for i in range(SHINGLE_WORDS):
            used = length[text] > i
            h = np.where(used, mix(h + words[np.minimum(begin + i, max(len(words) - 1, 0))]), h) if len(words) else h
        yield first, last, h, where


def signatures(h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """The component times of every text; infinite for texts without shingles."""
    n = len(where) - 1
    sig = np.full((n, SIGNATURE), np.inf)
    if not len(h):
        return sig
    owner = np.repeat(np.arange(n), np.diff(where)).astype(_U)
    keys = np.sort((owner << _U(44)) | (h >> _U(20)))
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    weight = np.diff(heads, append=len(keys))
    element, text = keys[heads] & _U((1 << 44) - 1), (keys[heads] >> _U(44)).astype(np.int64)
    strips = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    low = np.where(strip > 0, 1 << np.maximum(strip - 1, 0), 0)
    width = np.maximum(low, 1)
    text, weight = np.repeat(text, strips), np.repeat(weight, strips)
    seed = mix(np.repeat(element, strips) * _U(0x9E3779B97F4A7C15) + strip.astype(_U) * _U(0xD6E8FEB86659FD93))
    time, drawn = np.zeros(len(seed)), 0
    flat = sig.reshape(-1)
    while len(seed):
        points = int(np.clip(100_000 // len(seed), 1, 64))
        nth = (drawn + np.arange(points)).astype(_U)
        r = mix(seed[:, None] + nth[None, :] * _U(0xA0761D6478BD642F))
        gap = -np.log(((r >> _U(11)).astype(np.float64) + 0.5) / 2.0**53) / (SIGNATURE * width)[:, None]
        gap[:, 0] += time  # added strictly one after the other: a point's time has the same bits in every block
        at = np.cumsum(gap, axis=1)
        r = mix(r ^ _U(0xE7037ED1A0B428DB))
        component = (r % _U(SIGNATURE)).astype(np.int64)
        level = low[:, None] + 1 + ((r >> _U(32)).astype(np.float64) / 2.0**32 * width[:, None]).astype(np.int64)
        seen = level <= weight[:, None]
        np.minimum.at(flat, (text[:, None] * SIGNATURE + component)[seen], at[seen])
        drawn += points
        latest = sig.max(axis=1)
        on = at[:, -1] < latest[text]
        seed, time, width, low, text, weight = seed[on], at[on, -1], width[on], low[on], text[on], weight[on]
    return sig


def parities(h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """For each text the parities of its cells, as bits of ``CELLS / 64`` integers."""
    n = len(where) - 1
    text = np.repeat(np.arange(n), np.diff(where))
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    # the second, third ... time that a text has a shingle
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (text[1:] == text[:-1])])[: len(h)]
    place = np.arange(len(h))
    nth = place - np.maximum.accumulate(np.where(again, 0, place))
    h = np.where(again, mix(h + nth.astype(_U) * _U(0x9E3779B97F4A7C15)), h)
    cell = text * CELLS + (h % _U(CELLS)).astype(np.int64)
    odd = (np.bincount(cell, minlength=n * CELLS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(n, CELLS // 64)


def may_link(n: str, odd: str, hn: str, hodd: str) -> Column:
    """Whether sizes and parities allow a link: at similarity s, the symmetric difference is (1 - s) / (1 + s) of both sizes."""
    apart = reduce(operator.add, (F.bit_count(F.get(odd, F.lit(i)).bitwiseXOR(F.get(hodd, F.lit(i)))) for i in range(CELLS // 64)))
    sizes = F.least(n, hn) >= F.lit(LEAST) * F.greatest(n, hn) - 1e-9
    return sizes & (apart * (1 + LEAST) <= (F.col(n) + F.col(hn)) * (1 - LEAST) + 1e-6)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, h, where in shingles(batch.column(1)):
            sizes = np.diff(where)
            digest = [per_text_u(mix(h ^ _U(c)), where) for c in (0x1234567, 0x89ABCDEF)]
            bits = signatures(h, where).view(_U).reshape(-1, BANDS, ROWS)
            keys = np.zeros(bits.shape[:2], _U) + np.arange(BANDS, dtype=_U) * _U(0x9E3779B97F4A7C15)
            for r in range(ROWS):
                keys = mix(keys + bits[:, :, r])
            empty = sizes == 0
            odd = parities(h, where)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(sizes) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1).view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(first, last - first), pa.array(sizes.astype(np.int64)),
                    pa.array(digest[0].view(np.int64), mask=empty), pa.array(digest[1].view(np.int64), mask=empty), lists,
                    pa.FixedSizeListArray.from_arrays(pa.array(odd.reshape(-1)), CELLS // 64).cast(pa.list_(pa.int64())),
                ],
                ["doc_id", "n", "d1", "d2", "bands", "odd"],
            )


def per_text_u(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[where[1:]] - total[where[:-1]]


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, h, where in shingles(batch.column(1)):
            bags = [np.sort(h[a:b]).tobytes() for a, b in zip(where[:-1], where[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(bags, pa.binary())], ["rep", "bag"])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted multisets, with multiplicity."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for left, right in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(left.as_buffer(), _U), np.frombuffer(right.as_buffer(), _U)
            both = overlap(a, b)
            keep.append(both >= LEAST * (len(a) + len(b) - both) - 1e-9)
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(rep, class) of every end of the links (a, b): rounds of large and small stars, until only stars are left."""
    edges = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(0).alias("end")), F.struct(F.col("b").alias("id"), F.lit(1).alias("end")))).alias("e")
    while True:
        # in a star, whatever is the larger end of an edge has no other edge
        seen = edges.select(ends).groupBy("e.id").agg(F.max("e.end").alias("end"), F.count("*").alias("edges"))
        if seen.where("end = 1 AND edges > 1").isEmpty():
            return edges.select(F.col("b").alias("rep"), F.col("a").alias("class"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), "b"), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
        edges = cut(small.select("e.*").where("a < b").distinct())


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, n_shingles): the smallest doc_id of the class is its name."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    sketches = cut(docs.mapInArrow(_sketch, "doc_id long, n long, d1 long, d2 long, bands array<long>, odd array<long>"))
    reps = sketches.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("bands").alias("bands"), F.min("odd").alias("odd"))
    reps = cut(reps)
    each = reps.select("rep", "n", F.explode("bands").alias("band"))
    shared = each.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("members")).where("lo < hi")
    on = cut(each.join(shared.select("band", "members"), "band").select("band", "rep", "n", "members"))
    # the first hubs of a bucket: its most connected member, and its smallest
    degree = on.groupBy("rep").agg(F.sum("members").alias("degree"))
    first = on.join(degree, "rep").groupBy("band").agg(F.max(F.struct("degree", "rep")).alias("top"), F.min("rep").alias("low"))
    on = on.join(first, "band").withColumn("hub", F.col("rep").isin(F.col("top.rep"), F.col("low"))).drop("top", "low")
    near = cut(on.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("band").alias("shared")))
    odds = cut(reps.select("rep", "odd").join(near, F.col("rep") == F.col("doc_id")).drop("doc_id"))
    bags = cut(docs.join(near.select("doc_id"), "doc_id").mapInArrow(_bags, "rep long, bag binary"))
    links, named, rounds, late = None, None, 0, 0
    on = on.withColumn("class", F.col("rep"))
    while left := on.count():
        if rounds:
            step = F.greatest(F.lit(1).cast("long"), F.floor(F.col("members") / F.lit(64**rounds)).cast("long"))
            on = on.withColumn("hub", F.pmod(F.xxhash64("rep", F.lit(rounds)), step) == 0)
        on = cut(on)
        known = on.join(odds, "rep")
        hubs = known.where("hub").select(
            "band", F.col("rep").alias("h"), F.col("n").alias("hn"), F.col("class").alias("hc"), F.col("odd").alias("hodd"),
            F.col("shared").alias("hshared"))
        once = (~F.col("hub") | (F.col("rep") < F.col("h")))
        here = F.array_min(F.array_intersect("shared", "hshared")) == F.col("band")
        pairs = cut(
            known.join(hubs, "band").where((F.col("class") != F.col("hc")) & once & may_link("n", "odd", "hn", "hodd") & here)
            .select(F.least("rep", "h").alias("a"), F.greatest("rep", "h").alias("b"))
        )
        found = cut(
            pairs.join(bags.select(F.col("rep").alias("a"), F.col("bag").alias("abag")), "a")
            .join(bags.select(F.col("rep").alias("b"), F.col("bag").alias("bbag")), "b")
            .select("a", "b", "abag", "bbag").mapInArrow(_verified, "a long, b long")
        )
        # members that were compared with all others of their bucket are done; so are buckets of one class
        on = on.where(~F.col("hub")).drop("hub")
        if fresh := found.count():
            links, late = found if links is None else links.unionByName(found), late + fresh
        # a few links more spare few comparisons: they name classes at the end
        if late * 64 >= left:
            named, late = components(links), 0
            links = named.select(F.col("class").alias("a"), F.col("rep").alias("b"))
            on = on.drop("class").join(named, "rep", "left").withColumn("class", F.coalesce("class", "rep"))
        mixed = on.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi")
        on = cut(on.join(mixed.select("band"), "band", "left_semi"))
        rounds += 1
    if late:
        named = components(links)
    # a copy's class is its representative's; the classes' names are their smallest members
    of = sketches.join(reps.select("d1", "d2", "rep"), ["d1", "d2"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep"), F.col("n").alias("n_shingles"))
    if named is None:
        return of.select("doc_id", F.col("rep").alias("class_id"), "n_shingles")
    return of.join(named, "rep", "left").select("doc_id", F.coalesce("class", "rep").alias("class_id"), "n_shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that name their class, with all their columns; rows without an id stay."""
    others = classes(docs).where("doc_id != class_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(others, docs["doc_id"] == others["__id"], "left_anti")


ORACLE = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
    SELECT doc_id, list_aggregate(w[i : i + {SHINGLE_WORDS - 1}], 'string_agg', ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE_WORDS - 2}, 2))) AS i FROM words WHERE len(w) > 0)
), bags AS MATERIALIZED (
    SELECT doc_id, s, count(*) AS c FROM shingles GROUP BY doc_id, s
), sizes AS (
    SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.c, b.c)) AS common FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common >= {LEAST} * (x.n + y.n - common) - 1e-9
), reach(id, r) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT e.id, l.r FROM reach e JOIN (SELECT a AS k, b AS r FROM links UNION ALL SELECT b, a FROM links) l ON l.k = e.r
)
SELECT id AS doc_id, min(r) AS class_id, any_value(coalesce(n, 0))::BIGINT AS n_shingles FROM reach LEFT JOIN sizes ON doc_id = id GROUP BY id
"""
