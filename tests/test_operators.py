"""Operators against brute force on small random inputs, with the physical knobs turned
so that every execution path is taken."""

import hashlib
import math
import re
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilkb.functions.vectors import embed_texts
from vigilkb.operators import entities as er
from vigilkb.operators import graph as gr
from vigilkb.operators import judging as jd
from vigilkb.operators import knn
from vigilkb.operators import reordering as ro
from vigilkb.operators.facets import facet_weights, metadata_candidates
from vigilkb.operators.knn import _blocked, _pack, knn_join
from vigilkb.operators.ordering import FOREVER, as_of_last, first_k_live, number_rows, running, stab
from vigilkb.operators import pagerank
from vigilkb.operators.pagerank import power_iterate, ranked_walks
from vigilkb.plans import kb as plan
from vigilkb.plans.catalogue import CATALOGUE
from vigilkb.session import cut

LIVES = "id long, valid_from long, valid_to long"


def lives(rng, n, keep=0.5):
    return [(i, i, None if rng.random() < keep else int(i + 1 + rng.integers(0, n))) for i in range(1, n + 1)]


def alive(row, t):
    return row[1] < t and (row[2] is None or row[2] > t)


def test_number_rows(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("a"))
    got = number_rows(df, [F.desc("a")], "n").collect()
    assert sorted(r.n for r in got) == list(range(1, 1001))
    assert [r.a for r in sorted(got, key=lambda r: r.n)] == sorted((r.a for r in got), reverse=True)


@pytest.mark.parametrize("span", [None, 5, 1000])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running(spark, span, exclusive):
    rng = np.random.default_rng(1)
    rows = [("k%d" % rng.integers(0, 3), int(p), int(rng.integers(-9, 9))) for p in rng.permutation(60) - 30]
    df = spark.createDataFrame(rows, "k string, pos long, v long")
    got = {(r.k, r.pos): (r.s, r.m) for r in running(df, ["k"], "pos", {"s": ("sum", "v"), "m": ("max", "v")}, exclusive, span).collect()}
    for k, p, _ in rows:
        seen = [v for kk, pp, v in rows if kk == k and (pp < p or (pp == p and not exclusive))]
        assert got[k, p] == (sum(seen), max(seen) if seen else None)


def test_as_of_last(spark):
    facts = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("b", 2, "z")], "k string, t long, v string")
    readers = spark.createDataFrame([("a", 1), ("a", 4), ("a", 5), ("b", 9), ("c", 9)], "k string, at long")
    got = {(r.k, r["at"]): r.out for r in as_of_last(facts, readers, "k", "t", "v", "at", "out", 3).collect()}
    assert got == {("a", 1): None, ("a", 4): "x", ("a", 5): "y", ("b", 9): "z", ("c", 9): None}


@pytest.mark.parametrize("span", [None, 7])
@pytest.mark.parametrize("small", [1, 1000])
def test_first_k_live_and_stab(spark, span, small):
    rng = np.random.default_rng(2)
    rows = lives(rng, 80, keep=0.1)
    df = spark.createDataFrame(rows, LIVES).withColumn("key", F.lit("hot"))
    led = first_k_live(df, 3, span).select("key", "id", "lead_from", "dies")
    points = spark.range(1, 200).select(F.lit("hot").alias("key"), F.col("id").alias("at"))
    got = defaultdict(set)
    for r in stab(points, cut(led), "key", "at", "lead_from", "dies", small).collect():
        got[r["at"]].add(r.id)
    for t in range(1, 200):
        assert got[t] == set([r[0] for r in rows if alive(r, t)][:3])


@pytest.mark.parametrize("block_rows,pivots", [(1000, None), (16, None), (1000, 1), (8, 4), (5, 7)])
@pytest.mark.parametrize("spread", [1.0, 0.05])
def test_knn_join(spark, block_rows, pivots, spread):
    """Clustered vectors (so that pruning happens) with exact duplicates (so that ties do)."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 6))
    v = centres[rng.integers(0, 4, 90)] + spread * rng.normal(size=(90, 6))
    v[40:50] = v[7]
    v = v.astype(np.float32)
    rows = lives(rng, 90)
    df = spark.createDataFrame([(*r, [float(x) for x in v[i]]) for i, r in enumerate(rows)], LIVES + ", vec array<float>")
    asks = df.select("id", F.col("id").alias("at"), "vec")
    got = {}
    for r in knn_join(asks, df, 4, block_rows=block_rows, max_pivots=pivots).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append(r.cid)
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    for i, r in enumerate(rows):
        best = sorted((-s[i, j], c[0]) for j, c in enumerate(rows) if alive(c, r[0]))[:4]
        assert got.get(r[0], []) == [c for _, c in best]


def test_knn_blocks_meet_without_a_shuffle(spark):
    """Vectors of short lives among some that never end: a query block meets what is alive, and no block is moved to do so."""
    n, rows, short = 1600, 16, 40
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, 3))
    born = [(i, i, None if i % 400 == 0 else i + short, [float(x) for x in v[i]]) for i in range(1, n)]
    df = spark.createDataFrame(born, LIVES + ", vec array<double>")
    found = knn_join(df.select("id", F.col("id").alias("at"), "vec"), df, 3, block_rows=rows, max_pivots=1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "HashJoin" not in plan
    got = defaultdict(list)
    for r in found.orderBy("qid", "rank").collect():
        got[r.qid].append(r.cid)
    s = np.round(v @ v.T, 6)
    for i, *_ in born:
        live = [j for j, b, d, _ in born if b < i and (d is None or d > i)]
        assert got[i] == sorted(live, key=lambda j: (-s[i, j], j))[:3]
    side = df.select("id", F.lit("").alias("grp"), F.lit(0).alias("pivot"), F.col("valid_from").alias("born"),
                     F.coalesce("valid_to", F.lit(FOREVER)).alias("dies"), "vec")
    spans = _pack(_blocked(side, n, n, 1, rows)).select("lo", "hi").collect()
    asked = [(t, t + rows) for t in range(1, n, rows)]
    met = [sum(b.lo < hi and b.hi > lo for b in spans) for lo, hi in asked]
    assert max(met) <= 16  # of about 100 blocks


def test_knn_best_leave_their_task_once(spark, monkeypatch):
    """However many parts a corpus has, no query has more than its k best shuffled."""
    monkeypatch.setattr(knn, "PHYSICAL", replace(knn.PHYSICAL, corpus_bytes=1 << 8))
    n, k, sent, score = 600, 3, spark.sparkContext.accumulator(0), knn._score

    def counted(*args, **kw):
        kernel = score(*args, **kw)

        def counting(batches):
            for b in kernel(batches):
                sent.add(b.num_rows)
                yield b

        return counting

    monkeypatch.setattr(knn, "_score", counted)
    v = np.random.default_rng(6).normal(size=(n, 3))
    df = spark.createDataFrame([(i, i, None, [float(x) for x in v[i]]) for i in range(n)], LIVES + ", vec array<double>")
    found = knn_join(df.select("id", F.col("id").alias("at"), "vec"), df, k, block_rows=16, max_pivots=1).collect()
    assert len(found) == sent.value == sum(min(k, i) for i in range(n))


def shuffles_of(df, column):
    """How many shuffles of a plan move ``column``."""
    jvm = df.sparkSession._jvm
    text = df._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return sum(f"{column}#" in row for row in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", text))


def small_broadcasts(spark, request):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))


def test_knn_moves_vectors_once(spark, monkeypatch, request):
    """Each side's vectors are shuffled once, to their blocks."""
    small_broadcasts(spark, request)
    monkeypatch.setattr(knn, "PHYSICAL", replace(knn.PHYSICAL, corpus_bytes=1 << 8))
    written = []
    monkeypatch.setattr(knn, "cut", lambda d: written.append(d) or cut(d))
    n, k = 600, 3
    v = np.random.default_rng(8).normal(size=(n, 3))
    df = spark.createDataFrame([(i, i, None if i % 7 else i + 90, [float(x) for x in v[i]]) for i in range(n)], LIVES + ", vec array<double>")
    asks = df.select("id", F.col("id").alias("at"), "vec")
    found = knn_join(asks, df, k, block_rows=16, max_pivots=1)
    assert [shuffles_of(d, "vec") for d in written] == [1, 1]
    rows = sorted(tuple(r) for r in found.collect())
    s = np.round(v @ v.T, 6)
    live = lambda i: [j for j in range(i) if j % 7 or j + 90 > i]
    assert [r[:2] for r in sorted(rows, key=lambda r: (r[0], r[3]))] == [
        (i, j) for i in range(n) for j in sorted(live(i), key=lambda j: (-s[i, j], j))[:k]]
    # sizes of too many cells are shuffled instead
    monkeypatch.setattr(knn, "PHYSICAL", replace(knn.PHYSICAL, most_cells=0))
    again = knn_join(asks, df, k, block_rows=16, max_pivots=1)
    assert [shuffles_of(d, "vec") for d in written[2:]] == [2, 2] and sorted(tuple(r) for r in again.collect()) == rows


def test_vectors_join_what_is_stamped(spark, monkeypatch, request):
    """Of a query's tables only ``embeddings`` itself has its vectors shuffled."""
    small_broadcasts(spark, request)
    written = []
    monkeypatch.setattr(plan, "cut", lambda d: written.append(d) or cut(d))
    kb = plan.from_tables(spark, "/root/testdata/sf0.001", ["source_id", "vec"])
    assert len(written) == 1 and shuffles_of(written[0], "vec") <= 1 and shuffles_of(written[0], "embedding") <= 1
    own = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    n, d = own.count(), {r.vec_id: r.embedding for r in own.collect()}
    assert all(r.vec == d[(r.seq - 1) % n] for r in kb.chunks.select("seq", "vec").collect())


ONE_READ = ["graph_edges", "edge_weights", "undirected_projection", "degree", "live_successors"]


@pytest.mark.parametrize("name", ONE_READ)
def test_edges_read_once_are_not_written(spark, monkeypatch, name):
    written = []
    for module in (plan, knn, gr, __import__("vigilkb.plans.catalogue", fromlist=["cut"])):
        monkeypatch.setattr(module, "cut", lambda d: written.append(d) or cut(d))
    CATALOGUE[name](spark, "/root/testdata/sf0.001")
    assert len(written) == 1  # the chunks


def test_graph_seeds_need_no_neighbours(spark, monkeypatch):
    """An anchor has structural neighbours only."""
    sf = "/root/testdata/sf0.001"
    kb = plan.from_tables(spark, sf)
    g = plan.graph_of(kb)
    known = gr.graph_seeds(gr.anchors_for(kb.readers, kb.chunks, g.nodes, kb.span), g.edges, kb.span)
    expected = sorted((r.seq, r.node_id, r.mass) for r in known.withColumn("mass", F.round("mass", 6)).collect())
    monkeypatch.setattr(plan, "vector_candidates", None)
    assert sorted((r.seq, r.node_id, r.mass) for r in CATALOGUE["graph_seeds"](spark, sf).collect()) == expected


def test_knn_serves_its_own_rows_from_one_table(spark, monkeypatch):
    """Queries that are the corpus' rows share its written blocks, and a block reaches a task once, not once per query block."""
    monkeypatch.setattr(knn, "PHYSICAL", replace(knn.PHYSICAL, corpus_bytes=1 << 8))
    monkeypatch.setattr(knn, "_STRETCH_ROWS", 200)
    n, k, written, rows, score = 900, 3, [], spark.sparkContext.accumulator(0), knn._score
    monkeypatch.setattr(knn, "cut", lambda d: written.append(cut(d)) or written[-1])

    def counted(*args, **kw):
        kernel = score(*args, **kw)

        def counting(batches):
            def seen():
                for b in batches:
                    rows.add(b.num_rows)
                    yield b

            return kernel(seen())

        return counting

    monkeypatch.setattr(knn, "_score", counted)
    v = np.random.default_rng(12).normal(size=(n, 4)).astype(np.float32)
    v[100:130] = v[5]  # ties
    dies = [None if i % 50 == 0 else i + 3 + 37 * (i % 5) for i in range(n)]
    df = cut(spark.createDataFrame([(i, i, dies[i], [float(x) for x in v[i]]) for i in range(n)], LIVES + ", vec array<float>"))
    found = knn_join(df.select("id", F.col("valid_from").alias("at"), "vec"), df, k, block_rows=16).collect()
    s = np.round(v.astype(float) @ v.astype(float).T, 6)
    live = lambda i: [j for j in range(i) if dies[j] is None or dies[j] > i]
    assert sorted((r.qid, r["rank"], r.cid) for r in found) == [
        (i, p + 1, j) for i in range(n) for p, j in enumerate(sorted(live(i), key=lambda j: (-s[i, j], j))[:k])]
    assert len(written) == 1
    blocks, tasks = written[0].count(), len(written[0].inputFiles())
    assert tasks > 4 and rows.value <= blocks + tasks * blocks
    pairs = sum(a.lo < b.at_hi and a.hi > b.lo for b in written[0].select("lo", "at_hi").collect() for a in written[0].select("lo", "hi").collect())
    assert rows.value < pairs


@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e20])
def test_knn_singles_lose_nothing(scale):
    """Scores closer than single precision tells apart, and vectors that it cannot hold, are ranked as in double precision."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1, 8)) + 1e-7 * rng.normal(size=(400, 8))
    x, q = (x * scale).astype(np.float64), (rng.normal(size=(70, 8)) * 1e3).astype(np.float64)
    born, ids = np.arange(400) % 7, rng.permutation(400).astype(np.int64)
    asks = knn._Asks(np.arange(70), np.arange(70) % 9, q, 5, 6, None)
    for i in range(0, 400, 50):
        asks.meet(knn._Corpus(ids[i:i + 50], born[i:i + 50], np.full(50, 8), x[i:i + 50]))
    got = defaultdict(list)
    for b in asks.leave():
        for r in b.to_pylist():
            got[r["qid"]].append(r["cid"])
    s = np.round(q @ x.T, 6)
    for i in range(70):
        live = [j for j in range(400) if born[j] < i % 9 < 8]
        best = sorted(live, key=lambda j: (-s[i, j], ids[j]))[:5]
        assert len(got[i]) == len(best)
        # sums of another order may differ in the last digit of a double
        assert np.allclose(s[i, best], sorted(s[i, [j for j in live if ids[j] in got[i]]], reverse=True), rtol=1e-12, atol=1e-6)


def test_cut_leaves_no_shuffles(spark, monkeypatch):
    """What was shuffled to write a table does not stay on the disk beside it."""
    jvm = spark._jvm
    kept = lambda: jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = kept()
    table = cut(spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("x")).count())
    assert kept() <= before and table.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_embedding_counts_once_per_text(spark):
    """Counts by hash bucket, texts of one key together; tokens are counted before the shuffle and the norm is bound once."""
    texts = [(1, "Fee, fee  FEE 50"), (2, ""), (3, None), (4, "a b"), (4, "b c"), (5, "\u212a-\u00e9x 7")]
    df = spark.createDataFrame(texts, "id long, t string")
    found = embed_texts(df, "id", "t")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("aggregate(zip_with") <= 1
    tokens = {1: ["fee"] * 3 + ["50"], 2: [], 3: [], 4: ["a", "b", "b", "c"], 5: ["k", "x", "7"]}
    for r in found.collect():
        raw = np.bincount([int(hashlib.md5(t.encode()).hexdigest()[:4], 16) % 64 for t in tokens[r.id]], minlength=64).astype(float)
        assert r.vec == pytest.approx(list(raw / (np.sqrt((raw**2).sum()) or 1.0)), abs=1e-15)


def test_knn_groups_and_floor(spark):
    v = [(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "a", [0.0, 1.0]), (4, "a", [1.0, 0.1])]
    df = spark.createDataFrame(v, "id long, grp string, vec array<float>")
    asks = df.withColumn("at", F.col("id"))
    have = df.select("id", "grp", "vec", F.col("id").alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    got = {(r.qid, r.cid) for r in knn_join(asks, have, 5, floor=0.5).collect()}
    assert got == {(4, 1)}


@pytest.mark.parametrize("knobs", [dict(rare_posting=0, head_facets=2, span=9, stab_small=1), dict(rare_posting=3, head_facets=1),
                                   dict(rare_posting=10_000), dict(rare_posting=0, head_facets=8)])
def test_metadata_candidates(spark, knobs):
    """One source and one title word hold most chunks; a third of them are exact copies."""
    rng = np.random.default_rng(4)
    rows = lives(rng, 70)
    facets = {}
    for i, _, _ in rows:
        if i % 3 == 0:
            facets[i] = {("source", "s"), ("title", "copy"), ("title", "again"), ("topic", "x")}
        else:
            facets[i] = {("source", "s" if rng.random() < 0.8 else f"s{rng.integers(0, 3)}"), ("topic", f"t{rng.integers(0, 4)}"), ("title", f"w{rng.integers(0, 20)}")}
            if rng.random() < 0.5:
                facets[i].add(("entity", f"e{rng.integers(0, 3)}"))
            if rng.random() < 0.6:
                facets[i].add(("title", "copy"))
    doc = {i: f"d{i % 9}" for i, _, _ in rows}
    stored = spark.createDataFrame([(i, doc[i], a, b, k, v) for i, a, b in rows for k, v in sorted(facets[i])],
                                   "id long, doc_id string, valid_from long, valid_to long, kind string, value string")
    asked = spark.createDataFrame([(i, i, k, v) for i, _, _ in rows for k, v in sorted(facets[i])], "seq long, at long, kind string, value string")
    w = cut(facet_weights(asked, stored, knobs.get("span", 11)))
    got = {}
    for r in metadata_candidates(w, stored, 5, **knobs).orderBy("seq", "rank").collect():
        got.setdefault(r.seq, []).append((r.cand, r.score))
    for i, _, _ in rows:
        live = [r for r in rows if alive(r, i)]
        by_doc = defaultdict(set)
        for c, _, _ in live:
            by_doc[doc[c]] |= {v for k, v in facets[c] if k == "source"}

        def idf(f):
            df = sum(f[1] in s for s in by_doc.values()) if f[0] == "source" else sum(f in facets[c] for c, _, _ in live)
            n = len(by_doc) if f[0] == "source" else len(live)
            return math.log((max(n, 1) + 1) / (df + 1)) + 1

        scored = sorted((-round(sum(idf(f) for f in facets[i] & facets[c]), 6), c) for c, _, _ in live if facets[i] & facets[c])
        assert [c for c, _ in got.get(i, [])] == [c for _, c in scored[:5]]
        assert np.allclose([s for _, s in got.get(i, [])], [-s for s, _ in scored[:5]], atol=2e-6)


def walk_graph(rng, n, hub_share=0.0):
    """Random stamped nodes and edges; with ``hub_share`` most chunks also hang on one hub."""
    nodes = [(f"chunk:{i}", "chunk", str(i), i, None if i % 4 else i + 9, i) for i in range(n)]
    edges = {}
    for a, b in rng.integers(0, n, (3 * n, 2)):
        if a != b:
            edges[int(a), int(b)] = float(rng.random() + 0.1)
    rows = [(f"chunk:{a}", f"chunk:{b}", "contains", w, max(a, b), None if a % 3 else max(a, b) + 6) for (a, b), w in sorted(edges.items())]
    if hub_share:
        nodes.append(("topic:hub", "topic", "hub", 0, None, n))
        rows += [(f"chunk:{i}", "topic:hub", "has_topic", 0.7, i, None) for i in range(n) if rng.random() < hub_share]
    return nodes, rows


NODES = "node_id string, type string, key string, valid_from long, valid_to long, ord long"
EDGES = "src string, dst string, relation string, weight double, valid_from long, valid_to long"
SEEDS = "seq long, at long, node_id string, mass double"


def plain_walks(nodes, steps, seeds, alpha, top_n, skip_seeds=False, iterations=None):
    """Power iteration over each reader's whole graph: {seq: [(cand, score)]} over all candidates, best first."""
    place = {r[0]: r[5] for r in nodes}
    out = {}
    for seq, at in sorted({(q, a) for q, a, *_ in seeds}):
        live = [(place[s], place[d], w) for s, d, w, f, t in steps if f < at and (t is None or t > at)]
        start = np.zeros(len(nodes))
        for q, _, node, mass in seeds:
            if q == seq:
                start[place[node]] += mass
        s, d, w = (np.array([e[i] for e in live], dtype=(int, int, float)[i]) for i in range(3))
        r = power_iterate(len(nodes), s, d, w, start, alpha, iterations or 2000, 0.0 if iterations else 1e-16)
        ok = [r_[5] for r_ in nodes if r_[1] == "chunk" and r[r_[5]] > 0 and (r_[4] is None or r_[4] > at) and not (skip_seeds and start[r_[5]] > 0)]
        out[seq] = [(i, r[i]) for i in sorted(ok, key=lambda i: (-round(float(np.log(r[i])), 9), i))][:top_n]
    return out


def ranked(df):
    out = defaultdict(list)
    for r in df.orderBy("seq", "rank").collect():
        out[r.seq].append((r.cand, r.score, r.slack))
    return out


@pytest.mark.parametrize(("directed", "walk_block", "hub"), [(False, 5, 0.9), (True, 64, 0.9)])
def test_ranked_walks(spark, directed, walk_block, hub):
    rng = np.random.default_rng(5)
    n = 60
    nodes, edges = walk_graph(rng, n, hub)
    # reader 3 is stuck on a lone node, reader 4 has no live step at its tick but a seed, reader 9 begins at a hub
    seeds = [(1, 50, "chunk:2", 1.0), (1, 50, "chunk:5", 0.5), (2, 35, "chunk:1", 2.0), (3, 1, "chunk:0", 1.0), (4, 70, "chunk:59", 1.0)]
    seeds += [(10 + i, int(at), f"chunk:{rng.integers(0, at)}", 1.0) for i, at in enumerate(rng.integers(3, n, 20))]
    if hub:
        seeds += [(9, 58, "topic:hub", 1.0), (9, 58, "chunk:3", 0.1)]
    reverse = {"contains": 0.4, "has_topic": 0.0}
    stepdf = gr.walk_steps(spark.createDataFrame(edges, EDGES), directed, **({"reverse": reverse} if directed else {}))
    steps = [(r.src, r.dst, r.weight, r.valid_from, r.valid_to) for r in stepdf.collect()]
    for kw in ({}, {"skip_seeds": True}, {"iterations": 4}):
        got = ranked(ranked_walks(spark.createDataFrame(seeds, SEEDS), stepdf, spark.createDataFrame(nodes, NODES), alpha=0.8, top_n=5,
                                  symmetric=not directed, walk_block=walk_block, **kw))
        want = plain_walks(nodes, steps, seeds, 0.8, 5, **kw)
        assert {q: [c for c, *_ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items() if v}
        for q, v in got.items():
            for (_, score, slack), (_, true) in zip(v, want[q], strict=True):
                assert score <= true + 1e-12 and true <= score + slack + 1e-12


def test_shared_mass_goes_to_every_earlier_member(spark):
    rng = np.random.default_rng(11)
    nodes, edges = walk_graph(rng, 40)
    members = [("doc:a", f"chunk:{i}", i) for i in range(0, 40, 3)]
    stepdf = gr.walk_steps(spark.createDataFrame(edges, EDGES), False)
    shared = spark.createDataFrame([(1, 30, "doc:a", 3.0), (2, 12, "doc:a", 1.0)], "seq long, at long, owner string, mass double")
    direct = [(1, 30, "chunk:4", 0.5), (3, 20, "chunk:7", 1.0)]
    got = ranked(ranked_walks(spark.createDataFrame(direct, SEEDS), stepdf, spark.createDataFrame(nodes, NODES), alpha=0.8, top_n=4, symmetric=True,
                              shared=shared, members=spark.createDataFrame(members, "owner string, node_id string, valid_from long")))
    seeds = direct + [(q, at, m, mass) for q, at, mass in ((1, 30, 3.0), (2, 12, 1.0)) for _, m, f in members if f < at]
    steps = [(r.src, r.dst, r.weight, r.valid_from, r.valid_to) for r in stepdf.collect()]
    assert {q: [c for c, *_ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in plain_walks(nodes, steps, seeds, 0.8, 4).items()}


def hub_work(spark, n):
    """Nodes expanded, over all blocks, for n readers that each begin at a document of few chunks and at one hub of all chunks."""
    nodes = [(f"chunk:{i}", "chunk", str(i), i, None, i) for i in range(n)]
    nodes += [(f"doc:{k}", "document", str(k), 0, None, n + k) for k in range(n // 8)] + [("topic:hub", "topic", "hub", 0, None, n + n // 8)]
    rows = [(f"doc:{i // 8}", f"chunk:{i}", "contains", 1.5 + i % 8, i, None) for i in range(n)]
    rows += [(f"chunk:{i}", "topic:hub", "has_topic", 0.7, i, None) for i in range(n)]
    seeds = [(i, n, f"doc:{i // 8}", 0.1) for i in range(0, n, 8)] + [(i, n, "topic:hub", 1.0 / n) for i in range(0, n, 8)]
    seen = []
    kept = pagerank.cut

    def watched(df):
        out = kept(df)
        if df.columns == ["block", "ord"]:
            seen.append(out.where("ord >= 0").count())
        return out

    pagerank.cut = watched
    try:
        got = ranked_walks(spark.createDataFrame(seeds, SEEDS), gr.walk_steps(spark.createDataFrame(rows, EDGES), False),
                           spark.createDataFrame(nodes, NODES), alpha=0.85, top_n=5, symmetric=True, walk_block=8)
        assert got.count() == 5 * (n // 8)
    finally:
        pagerank.cut = kept
    return max(seen)


def test_a_hub_of_all_chunks_stays_closed(spark):
    small, large = hub_work(spark, 512), hub_work(spark, 2048)
    assert large < 5 * small  # four times the readers and the hub: in proportion, not the square


def test_walks_send_the_graph_to_each_core_once_however_many_readers(spark):
    rng = np.random.default_rng(7)
    n = 40
    nodes, edges = walk_graph(rng, n)
    stepdf = gr.walk_steps(spark.createDataFrame(edges, EDGES), False)
    seeds = [(i, n - 5 + i % 6, f"chunk:{rng.integers(0, n - 6)}", 1.0) for i in range(200)]
    seen, kept = [], pagerank.cut

    def watched(df):
        out = kept(df)
        if df.columns == ["block", "ord"]:
            seen.append(out.count())
        return out

    pagerank.cut = watched
    try:
        got = ranked(ranked_walks(spark.createDataFrame(seeds, SEEDS), stepdf, spark.createDataFrame(nodes, NODES), alpha=0.8, top_n=5,
                                  symmetric=True, iterations=4, walk_block=2))
    finally:
        pagerank.cut = kept
    assert max(seen) <= len(nodes) * spark.sparkContext.defaultParallelism
    steps = [(r.src, r.dst, r.weight, r.valid_from, r.valid_to) for r in stepdf.collect()]
    want = plain_walks(nodes, steps, seeds, 0.8, 5, iterations=4)
    assert {q: [c for c, *_ in v] for q, v in got.items()} == {q: [c for c, _ in v] for q, v in want.items() if v}


def test_prompts_shuffle_clipped_texts(spark):
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(33, 127, 50_000, dtype=np.uint8)).decode() for _ in range(20)]
    chunks = spark.createDataFrame(list(enumerate(texts)), "seq long, text string")
    found = spark.createDataFrame([(i, j, j + 1) for i in range(5, 20) for j in range(5)], "seq long, cand long, rank long")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = sent()
        got = {r.seq: r.prompt for r in jd.neighbour_prompt(chunks, found, chunks).collect()}
        assert 0 < sent() - before < 1.5 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert set(got) == set(range(5, 20))
    assert got[7] == f"NEW CHUNK (chunk_id=7):\n{texts[7]}\n\nNEIGHBORS:\n" + "\n".join(
        f"  [chunk_id={j}] {texts[j][:300]}" for j in range(5))


def test_components(spark):
    ids = spark.range(30)
    chain = [(i, i + 1) for i in range(0, 12)] + [(20, 25), (25, 22), (22, 20)]
    got = defaultdict(set)
    for r in gr.components(ids, spark.createDataFrame(chain, "a long, b long")).collect():
        got[r.component].add(r.id)
    assert got[0] == set(range(13)) and got[20] == {20, 22, 25} and len(got) == 2 + 14


def test_canonical_fold_equals_sequential(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 8))
    rows = []
    for seq in range(1, 26):
        for pos in range(2):
            sig = int(rng.integers(0, 30))
            rows.append((seq, pos, sig))
    vecs = {s: (lambda x: x / np.linalg.norm(x))(centres[s % 5] + 0.25 * rng.normal(size=8)) for s in range(30)}
    kind = {s: "person" if s % 2 else "org" for s in range(30)}
    df = spark.createDataFrame([(q, p, kind[s], f"{kind[s]}|{s}", f"n{s}", [float(x) for x in vecs[s]]) for q, p, s in rows],
                               "seq long, pos int, type string, sig string, surface string, vec array<double>")
    res, ents = er.canonical_fold(df, 0.9, 0.5)
    got = {(r.seq, r.pos): (r.matched, r.canonical_id, r.band) for r in res.collect()}
    store, count, want = [], defaultdict(int), {}
    for q in range(1, 26):
        pending = []
        for seq, pos, s in [r for r in rows if r[0] == q]:
            near = sorted((-round(float(vecs[s] @ vecs[c]), 6), i) for i, (c, _) in enumerate(store) if kind[c] == kind[s])
            top = -near[0][0] if near else None
            band = "low" if top is None or top < 0.5 else "high" if top >= 0.9 else "gray"
            pending.append((pos, s, store[near[0][1]][1] if band == "high" else None, band))
        minted = {}
        for pos, s, match, band in pending:
            cid = match or minted.get(s)
            if cid is None:
                count[kind[s]] += 1
                cid = minted[s] = f"{kind[s]}-{count[kind[s]]}"
                store.append((s, cid))
            want[q, pos] = (match, cid, band)
    assert got == want
    # the same stream in two parts
    first, known = er.canonical_fold(df.where("seq <= 12"), 0.9, 0.5)
    later, every = er.canonical_fold(df.where("seq > 12"), 0.9, 0.5, known)
    parts = {(r.seq, r.pos): (r.matched, r.canonical_id, r.band) for r in first.unionByName(later).collect()}
    assert parts == want and every.count() == ents.count()


def test_adjudication_guards(spark):
    gray = spark.createDataFrame([("a", "e1", ["e1", "e2"]), ("b", "e1", ["e1"]), ("c", "e9", ["e9"])], "sig string, top string, candidates array<string>")
    verdicts = spark.createDataFrame([("a", "e1", ("merge", "e2", 0.9, "same")), ("b", "e1", ("merge", "zz", 0.9, "?"))],
                                     "sig string, top string, verdict struct<decision string, candidate_id string, confidence double, rationale string>")
    got = {r.sig: (r.verdict.decision, r.verdict.candidate_id) for r in er.adjudicated(gray, verdicts).collect()}
    assert got == {"a": ("merge", "e2"), "b": ("create_new", None), "c": ("create_new", None)}


def test_orders_respect_constraints(spark, story_df):
    constraints = [(r.pred, r.succ) for r in ro.order_constraints(story_df).collect()]
    assert (1, 5) in constraints and (3, 10) in constraints
    orders = set()
    for seed in (42, 43, 44):
        place = {r.seq: r.position for r in ro.random_order(story_df, seed, span=3).collect()}
        assert sorted(place.values()) == list(range(1, 13))
        assert all(place[a] < place[b] for a, b in constraints)
        orders.add(tuple(sorted(place, key=place.get)))
    assert len(orders) == 3


def test_cycle_is_an_error(spark):
    bad = spark.createDataFrame([(1, "insert", "a", ["b"]), (2, "insert", "b", ["a"])], "seq long, op string, doc_id string, implicates array<string>")
    with pytest.raises(RuntimeError):
        ro.random_order(bad, 1, max_rounds=5)


def test_structural_relations_are_not_assertable(spark):
    good = spark.createDataFrame([("supersedes_content",)], "relation string")
    assert gr.assert_edges(good).count() == 1
    with pytest.raises(Exception, match="not assertable"):
        gr.assert_edges(spark.createDataFrame([("contains",)], "relation string")).collect()


def test_bfs_levels(spark):
    """A reader with few direct chunks goes one hop further, through a retired chunk."""
    nodes = spark.createDataFrame(
        [("chunk:1", "chunk", "1", 1, 3, 0), ("date:d", "date", "d", 1, None, 1), ("topic:t", "topic", "t", 1, None, 2),
         ("chunk:2", "chunk", "2", 2, None, 3), ("chunk:4", "chunk", "4", 4, None, 4)],
        "node_id string, type string, key string, valid_from long, valid_to long, ord long")
    edges = spark.createDataFrame(
        [("chunk:1", "date:d", 1, None), ("chunk:1", "topic:t", 1, None), ("chunk:2", "topic:t", 2, None), ("chunk:4", "date:d", 4, None)],
        "src string, dst string, valid_from long, valid_to long")
    anchors = spark.createDataFrame([(9, 9, "date:d")], "seq long, at long, node_id string")
    one = [(r.cand, r.hop) for r in gr.bfs_candidates(anchors, nodes, edges, 1, 5).collect()]
    three = sorted((r.hop, r.cand) for r in gr.bfs_candidates(anchors, nodes, edges, 3, 5).collect())
    assert one == [(4, 1)] and three == [(1, 4), (3, 2)]


def test_forever_is_beyond_any_tick():
    assert FOREVER > 1 << 42
