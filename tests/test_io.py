"""Sources, sinks, replay, streaming and the small value-level operators."""

import json
import os

import pytest
from pyspark.sql import functions as F

from records import as_json_lines
from vigilkb.functions import text as tx
from vigilkb.functions.lexicon import lexicon_mentions
from vigilkb.operators import evaluation as ev
from vigilkb.operators import graph as gr
from vigilkb.operators import judging as jd
from vigilkb.operators.entities import prompt_text, quoted
from vigilkb.operators.replay import log_of, rebuild
from vigilkb.plans.kb import graph_of
from vigilkb.plans.kb import vector_only
from vigilkb.plans.runs import Setup, candidates_of, compare_baselines, detect, prepare, removals_of, retrieve, revalidation
from vigilkb.sources import event_log as el
from vigilkb.sources import gold_events as ge
from vigilkb.sources.snapshots import load_graph, save_graph, snapshot_due, write_run
from vigilkb.streaming.lifecycle import lifecycle_stream
from vigilkb.streaming.monitor import Monitor


@pytest.fixture
def feed(tmp_path, story):
    folder = tmp_path / "feed"
    folder.mkdir()
    lines = as_json_lines(story)
    for i, part in enumerate((lines[:5], lines[5:8], lines[8:])):
        (folder / f"{i}.json").write_text("\n".join(part) + "\n\n")
        # a file stream is read in the order of modification times
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def test_gold_events(spark, feed, tmp_path, story_df):
    got = ge.read_gold(spark, feed)
    assert got.orderBy("seq").collect() == story_df.orderBy("seq").collect()
    ge.write_gold(got, str(tmp_path / "out"))
    assert ge.read_gold(spark, str(tmp_path / "out")).orderBy("seq").collect() == got.orderBy("seq").collect()
    assert ge.read_raw(spark, feed).count() == 12
    assert ge.as_ingest(got).select("metadata.source_id").count() == 12


def test_rewrite_keeps_whole_records_in_order(spark, feed, tmp_path, story_df):
    lines = ['{"seq": %d, "type": "insert", "payload": {"doc_id": "d%d", "version": %d, "odd": {"k": [1, null]}}, "_debug": {"establishes": "x"}, "more": true}' % (i, i, i) for i in range(1, 30)]
    (tmp_path / "in.json").write_text("\n".join(lines))
    raw = ge.read_raw(spark, str(tmp_path / "in.json"))
    order = spark.createDataFrame([(i, 30 - i) for i in range(1, 30)], "seq long, position long")
    ge.rewrite(raw, order, str(tmp_path / "out"))
    parts = sorted(f for f in os.listdir(tmp_path / "out") if f.startswith("part-"))
    got = [json.loads(line) for f in parts for line in (tmp_path / "out" / f).read_text().splitlines()]
    assert got == [{**json.loads(lines[29 - p]), "seq": p} for p in range(1, 30)]


def test_shared_folder_is_asked_for(spark, monkeypatch):
    from types import SimpleNamespace

    from vigilkb import session

    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))


def test_gold_defaults_and_errors(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"seq": 1, "type": "insert", "payload": {"doc_id": "d"}}\n')
    r = ge.read_gold(spark, str(tmp_path / "a.json")).first()
    assert (r.text, r.title, r.is_artifact, r.derived_from, r.expected_label, r.implicates) == ("", "", False, [], "clean", [])
    (tmp_path / "b.json").write_text('{"seq": 1, "type": "upsert", "payload": {"doc_id": "d"}}\n')
    with pytest.raises(Exception, match="unknown event type"):
        ge.read_gold(spark, str(tmp_path / "b.json")).collect()


def test_event_log(spark, tmp_path):
    path = str(tmp_path / "log")
    mk = lambda rows: spark.createDataFrame(rows, "o int, type string, payload string")
    assert el.append(spark, path, mk([(2, "retire", '{"chunk_ids":["b"]}'), (1, "commit", '{"doc_id":"é\\"x"}')]), ["o"]) == 2
    assert el.append(spark, path, mk([(1, "commit", '{"doc_id":"z"}')]), ["o"]) == 3
    log = el.read_log(spark, path)
    rows = log.select("seq", "type", F.variant_get("payload", "$.doc_id", "string").alias("d")).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [(1, "commit", 'é"x'), (2, "retire", None), (3, "commit", "z")]
    assert el.current_seq(log) == 3 and el.current_seq(log.where("seq > 9")) == 0


def test_text_functions(spark):
    rows = [("  A B\tc ", "a b c", "a-b-c"), ("Fee: $50!", "fee: $50!", "fee-50")]
    df = spark.createDataFrame(rows, "s string, e string, t string")
    r = df.select(tx.entity_key(F.col("s")) == F.col("e"), tx.topic_slug(F.col("s")) == F.col("t")).collect()
    assert all(all(x) for x in r)
    dates = [("on 2026-13-99 now", "2026-13-99"), ("March 5, 2026", "03-05"), ("MAY  12", "05-12"), ("Fall Term", "fall-term"), ("  ", None), ("March 123", "march-123")]
    got = spark.createDataFrame(dates, "s string, d string").select(tx.date_key(F.col("s")), "d").collect()
    assert all(a == b for a, b in got)
    t = spark.createDataFrame([("The Dean of Admissions, an É2-b5c dean",)], "s string").select(tx.title_tokens(F.col("s"))).first()[0]
    assert t == ["dean", "admissions", "b5c"]
    assert spark.range(1).select(tx.clip(F.lit("x" * 40), 34)).first()[0] == "x" * 33 + "~"


def test_lexicon(spark):
    df = spark.createDataFrame([("He agreed on the first of March; the CS department moved.",)], "t string")
    got = [(m.type, m.surface) for m in df.select(lexicon_mentions(F.col("t"))).first()[0]]
    assert got == [("person", "Marcus Reed"), ("org", "Computer Science Department"), ("date", "March 1")]


@pytest.fixture(scope="module")
def built(story_df):
    p = prepare(story_df)
    return p, graph_of(p.kb)


def test_rebuild_equals_live(built):
    p, g = built
    similar = gr.freeze_similar(g.found, p.kb.chunks, 5)
    chunks, again, asserted = rebuild(log_of(p.kb.chunks, similar))
    cols = g.edges.columns
    assert sorted(map(str, gr.edges_of(chunks, again, asserted).select(cols).collect())) == sorted(map(str, g.edges.collect()))


def test_graph_snapshot_roundtrip(spark, built, tmp_path):
    _, g = built
    save_graph(g.nodes, g.edges, str(tmp_path / "g"), 50)
    nodes, edges = load_graph(spark, str(tmp_path / "g"), 50)
    assert nodes.count() == g.nodes.count() and edges.count() == g.edges.count()
    assert snapshot_due(49, 50) and not snapshot_due(50, 99) and snapshot_due(99, 150)


def test_revalidation_asks_successors(built):
    p, g = built
    rows = revalidation(p.kb, g.edges, vector_only).collect()
    live = {r.seq: (r.valid_from, r.valid_to) for r in p.kb.chunks.collect()}
    assert rows and all(r.cand != r.seq for r in rows)
    assert all(live[r.seq][0] < r.retired_at and (live[r.seq][1] or 1 << 40) > r.retired_at for r in rows)


def test_retrieval(spark, built):
    p, _ = built
    asks = spark.createDataFrame([(7, "the library operates from nine")], "id long, text string")
    rows = retrieve(p.kb, asks, k=3).orderBy("rank").collect()
    assert len(rows) == 3 and rows[0].doc_id == "hours" and rows[0].seq == 9


def test_write_folds(spark):
    puts = spark.createDataFrame([("n", 1, "a"), ("n", 4, "b")], "node_id string, seq long, env string")
    assert tuple(gr.latest_nodes(puts).first()) == ("n", "b", 1)
    cols = "src string, dst string, relation string, weight double, valid_from long, valid_to long"
    edges = spark.createDataFrame([("a", "b", "similar_to", 0.1, 1, None), ("a", "b", "similar_to", 0.2, 2, None), ("a", "b", "contains", 1.5, 1, None)], cols)
    last = gr.latest_edges(edges)
    assert {(r.relation, r.weight) for r in last.collect()} == {("similar_to", 0.2), ("contains", 1.5)}
    ended = gr.revoke(last, spark.createDataFrame([("a", "b", "similar_to", 9), ("x", "y", "similar_to", 9)], "src string, dst string, relation string, at long"))
    assert {(r.relation, r.valid_to) for r in ended.collect()} == {("similar_to", 9), ("contains", None)}
    with pytest.raises(Exception, match="not assertable"):
        gr.revoke(last, spark.createDataFrame([("a", "b", "contains", 9)], "src string, dst string, relation string, at long")).collect()
    usage = spark.createDataFrame([(3, 1), (4, 2)], "input_tokens long, output_tokens long")
    assert tuple(ev.token_usage(usage).first()) == (7, 3)


def test_adjudicator_prompt(spark):
    df = spark.createDataFrame([("Vance", "person", "leads", [("person-1", "Elena Vance", "person", ["E. Vance", "Vance"], 0.70049)])],
                               "s string, t string, c string, k array<struct<canonical_id string, name string, type string, aliases array<string>, score double>>")
    text = df.select(prompt_text(F.col("s"), F.col("t"), F.col("c"), F.col("k"))).first()[0]
    assert text.splitlines()[-1] == "  [id=person-1] Elena Vance (type=person, aliases=['E. Vance', 'Vance'], score=0.700)"
    names = ["O'Brien", 'the "Elder"', "O'Brien \"the Elder\"", "back\\slash", "two\nlines"]
    said = spark.createDataFrame([(n,) for n in names], "s string").select("s", quoted(F.col("s")).alias("q")).collect()
    assert {r.s: r.q for r in said} == {n: repr(n) for n in names}


def test_judging_and_policies(spark):
    calls = spark.createDataFrame([(1, "clean", []), (2, "duplicate", [1]), (3, "supersedes", [1, 2])], "seq long, label string, implicated_ids array<long>")
    reports = jd.reports_of(calls)
    assert {(r.seq, tuple(r.remove)) for r in jd.decide(reports, "recency").collect()} == {(2, (1,)), (3, (1, 2))}
    assert all(r.action == "insert" and r.remove == [] for r in jd.decide(reports, "insert_only").collect())
    answer = spark.createDataFrame([("report-2", "skip", [])], "report_id string, action string, remove array<long>")
    assert [r.seq for r in jd.pending(reports, jd.decide(reports, "human", answer)).collect()] == [3]
    with pytest.raises(Exception, match="no pending report"):
        jd.decide(reports, "human", spark.createDataFrame([("report-9", "skip", [])], answer.schema)).collect()
    with pytest.raises(Exception, match="unknown label"):
        spark.range(1).select(jd.label_of(F.lit("odd"))).collect()


def test_calls_merge_first_label_records_last(spark):
    calls = spark.createDataFrame([(1, 0, "clean", ["b"], []), (1, 1, "duplicate", ["a"], ["a"]), (1, 2, "supersedes", ["c"], ["c"])],
                                  "seq long, ord int, label string, candidate_docs array<string>, implicated_docs array<string>")
    m = ev.merge_calls(calls).first()
    assert (m.label, m.candidate_docs, m.implicated_docs) == ("duplicate", ["a", "b", "c"], ["a", "c"])
    events = spark.createDataFrame([(0, 1, "d", "insert", "", "duplicate", ["a"]), (1, 2, "d", "delete", "", "clean", [])],
                                   "position long, seq long, doc_id string, event_type string, intent string, expected_label string, implicates array<string>")
    rec = ev.records_of(events, calls, spark.createDataFrame([(1, 4), (2, 3)], "seq long, active_docs long"), run_id="r", baseline="b")
    got = {r.seq: r for r in rec.collect()}
    assert got[1].verdict == "supersedes" and got[1].detected and got[2].verdict is None and got[2].detected is False


def test_shuffled_comparison_and_run_log(spark, story_df, tmp_path):
    rec = compare_baselines(story_df, n_shuffles=2, base_seed=42, baselines=["vector-only"]).cache()
    assert rec.count() == 24 and {r.seed for r in rec.select("seed").distinct().collect()} == {42, 43}
    agg = ev.aggregate(ev.summarise(rec, ["shuffle_idx"]))
    assert {r.metric for r in agg.collect()} == set(ev.METRICS)
    write_run(rec, "x", {"base_seed": 42}, str(tmp_path))
    body = json.loads("\n".join(r.value for r in spark.read.option("wholetext", True).text(f"{tmp_path}/run_x_summary").collect()))
    assert [r["shuffle_idx"] for r in body["per_shuffle"]] == [0, 1] and [r["seed"] for r in body["per_shuffle"]] == [42, 43]
    one = body["per_shuffle"][0]["metrics"]["vector-only"]
    assert one["n_conflict_events"] == 6 and sum(x["total"] for x in one["by_label"].values()) == 6
    assert set(one["by_label"]) == {"contradiction", "duplicate", "supersedes"} and len(one["temporal_detection"]) == 4
    assert all(k.startswith("Q") and "_pos_" in k for k in one["temporal_detection"])
    assert sum(x["n_conflicts"] for x in one["temporal_detection"].values()) == 6
    over = body["aggregate"]["vector-only"]
    assert set(over) == {*ev.METRICS, "by_label"} and set(over["by_label"]["duplicate"]) == {"detect_rate_mean", "detect_rate_std"}
    assert over["detect_rate"]["min"] <= over["detect_rate"]["mean"] <= over["detect_rate"]["max"]
    assert spark.read.json(f"{tmp_path}/run_x").count() == 24


def test_lifecycle_stream(spark, feed, tmp_path):
    out = lifecycle_stream(ge.stream_gold(spark, feed))
    q = (out.writeStream.format("memory").queryName("lives").option("checkpointLocation", str(tmp_path / "c"))
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.seq: (r.retired, r.live) for r in spark.table("lives").collect()}
    assert len(got) == 12 and got[5] == (1, 1) and got[7] == (1, 0) and got[9] == (0, 1)


@pytest.mark.parametrize("baseline", ["metadata-only", "hybrid"])
def test_monitor_equals_batch(spark, feed, tmp_path, story_df, baseline):
    m = Monitor(str(tmp_path / "kb"), baseline)
    q = m.start(ge.stream_gold(spark, feed), str(tmp_path / "c"), once=True)
    q.awaitTermination(900)
    assert q.exception() is None
    got = sorted((r.seq, r.rank, r.cand) for r in m.read(spark, "candidates").collect())
    want = sorted((r.seq, r.rank, r.cand) for r in candidates_of(prepare(story_df).kb, baseline).collect())
    assert m.read(spark, "events").select("batch").distinct().count() == 3
    assert got == want


@pytest.mark.parametrize("baseline", ["vector-only"])
def test_destructive_monitor_equals_batch(spark, feed, tmp_path, story_df, baseline):
    setup = Setup(policy="recency")
    m = Monitor(str(tmp_path / "kb"), baseline, setup)
    q = m.start(ge.stream_gold(spark, feed), str(tmp_path / "c"), once=True)
    q.awaitTermination(900)
    assert q.exception() is None
    calls, _ = detect(prepare(story_df), baseline, setup)
    key = lambda df: sorted((r.seq, r.label, tuple(r.candidate_docs), tuple(r.implicated_ids)) for r in df.collect())
    assert key(m.read(spark, "calls")) == key(calls)
    gone = lambda df: sorted((r.seq, r.tick, r.by) for r in df.collect())
    assert gone(m.read(spark, "removals")) == gone(removals_of(calls)) and gone(removals_of(calls))
