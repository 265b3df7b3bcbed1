"""Set-based runs against one-event-at-a-time processing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sequential import Base
from vigilkb.operators.evaluation import audit_summary, summarise
from vigilkb.plans.kb import graph_of, graph_only, hybrid
from vigilkb.plans.runs import BASELINES, Setup, candidates_of, detect, prepare, run


@pytest.fixture(scope="module")
def prepared(story_df):
    return prepare(story_df)


@pytest.fixture(scope="module")
def plain(prepared, story_df):
    keys = {
        r.seq: dict(vec=np.array(r.vec), dates=r.dates, topics=r.topics, before=r.matched_ids, after=r.canonical_ids)
        for r in prepared.kb.chunks.collect()
    }
    events = [r.asDict() for r in story_df.orderBy("seq").collect()]
    for e in events:
        e["source_id"] = e["source_id"] or e["doc_id"]
    return keys, events


def test_resolution_reads_before_it_writes(prepared):
    rows = {r.seq: r for r in prepared.kb.chunks.collect()}
    assert rows[1].matched_ids == [] and rows[1].canonical_ids == ["org-1"]
    assert set(rows[3].matched_ids) == {"org-1"}
    assert rows[5].dates == ["04-01"] and rows[5].topics == ["application-fee"]


@pytest.mark.parametrize("baseline", BASELINES)
def test_insert_only_equals_sequential(prepared, plain, baseline):
    keys, events = plain
    expected = {s: f for s, (f, _) in Base(keys, False).run(events, baseline).items() if f}
    got = {}
    for r in candidates_of(prepared.kb, baseline).orderBy("seq", "rank").collect():
        got.setdefault(r.seq, []).append(r.cand)
    assert got == expected


@pytest.mark.parametrize("strategy", [graph_only, hybrid])
def test_block_size_changes_nothing(prepared, strategy):
    g = graph_of(prepared.kb)
    rows = lambda **kw: sorted((r.seq, r.rank, r.cand) for r in strategy(prepared.kb, g, **kw).collect())
    assert rows(walk_block=1) == rows(walk_block=64)


@pytest.mark.parametrize("baseline", BASELINES)
def test_recency_equals_sequential(prepared, plain, baseline):
    keys, events = plain
    setup = Setup(policy="recency")
    calls, chunks = detect(prepared, baseline, setup)
    base = Base(keys, True)
    expected = base.run(events, baseline)
    got = {r.seq: (sorted(r.candidate_docs), r.label) for r in calls.collect()}
    assert got == {s: (sorted({base.doc[c] for c in f}), label) for s, (f, label) in expected.items()}
    assert sorted(r.seq for r in chunks.where("valid_to IS NULL").collect()) == sorted(base.live)


def test_records_and_summary(prepared):
    rec = run(prepared, "vector-only")
    assert rec.count() == 12
    row = {r.seq: r for r in rec.collect()}
    assert row[7].verdict is None and row[7].corpus_size == 4
    s = summarise(rec).first()
    assert s.n_conflict_events == 6 and s.n_clean_events == 6
    assert audit_summary(rec).first().conflicts == 6


def test_own_strategy_and_policy(prepared):
    """A strategy that asks for everything older and a policy that removes the oldest implicated chunk only."""
    def older(kb, graph):
        pair = kb.readers.select("seq", "at").join(kb.chunks.select(F.col("seq").alias("cand"), "valid_from", "valid_to"), F.col("valid_from") < F.col("at"))
        return pair.where("valid_to IS NULL OR valid_to > at").select("seq", "cand", F.lit(1.0).alias("score"), F.col("cand").alias("rank"))

    def oldest(reports):
        return reports.select("report_id", "seq", F.lit("update").alias("action"), F.slice(F.array_sort("implicated_ids"), 1, 1).alias("remove"))

    calls, chunks = detect(prepared, older, Setup(policy=oldest))
    got = {r.seq: r.label for r in calls.collect()}
    assert got[4] == "duplicate" and got[8] == "contradiction"
    live = {r.seq for r in chunks.where("valid_to IS NULL").collect()}
    by_name, _ = detect(prepared, "vector-only", Setup(policy="recency"))
    assert by_name.count() == calls.count() and 1 not in live
    with pytest.raises(Exception, match="commits every chunk"):
        detect(prepared, older, Setup(policy=lambda r: oldest(r).withColumn("action", F.lit("skip"))))[0].collect()
