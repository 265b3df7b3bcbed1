"""One registered query per operator, over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilkb.config import DISCOVERY
from vigilkb.functions import text as tx
from vigilkb.functions.lexicon import lexicon_mentions, snap_topic
from vigilkb.functions.vectors import embed_texts
from vigilkb.operators import entities as er
from vigilkb.operators import evaluation as ev
from vigilkb.operators import graph as gr
from vigilkb.operators import judging as jd
from vigilkb.operators import lifecycle as lc
from vigilkb.operators import reordering as ro
from vigilkb.operators.adjudication import adjudicated_fold
from vigilkb.operators.facets import facet_weights, facets_of, metadata_candidates
from vigilkb.operators.knn import knn_join, vector_candidates
from vigilkb.operators.ordering import number_rows, span_for
from vigilkb.operators.replay import log_of, rebuild
from vigilkb.plans import kb as plan
from vigilkb.session import cut
from vigilkb.sources import event_log as el
from vigilkb.sources.tables import change_log, op_of, table

Query = Callable[[SparkSession, str], DataFrame]
CATALOGUE: dict[str, Query] = {}

GRAPH_COLUMNS = ["source_id", "entities", "dates", "topics", "derived_from", "vec"]
FACET_COLUMNS = ["source_id", "entities", "dates", "topics", "title"]
# thresholds at which the random test vectors fall into all three bands
FOLD_HIGH, FOLD_LOW, FOLD_FLOOR = 0.30, 0.22, 0.18


def query(fn: Query) -> Query:
    CATALOGUE[fn.__name__] = fn
    return fn


def r6(c) -> F.Column:
    return F.round(c, 6)


# ----------------------------------------------------------------- log and lifecycle


@query
def event_log_seq(spark, sf):
    e = table(spark, sf, "events").select("ts", "event_id", op_of(F.col("event_type")).alias("op"), "user_id")
    return number_rows(e, ["ts", "event_id"], "seq").select(
        "seq", "event_id", "op", F.concat(F.lit("u"), "user_id").alias("doc_id"))


@query
def log_roundtrip(spark, sf):
    log = change_log(spark, sf).select("seq", F.col("op").alias("type"), F.struct("doc_id").alias("payload"))
    back = el.decode(el.encode(log))
    return back.select("seq", "type", F.variant_get("payload", "$.doc_id", "string").alias("doc_id"))


def _log_span(spark, sf):
    return span_for(table(spark, sf, "events").agg(F.max("event_id") + 1).first()[0])


@query
def doc_lifecycle(spark, sf):
    s = lc.retire_ticks(change_log(spark, sf), _log_span(spark, sf)).where("op <> 'delete'")
    return s.select("seq", "doc_id", "op", F.col("seq").alias("valid_from"), "valid_to",
                    F.col("valid_to").isNull().cast("int").alias("live"))


@query
def state_at_seq(spark, sf):
    s = lc.retire_ticks(change_log(spark, sf), _log_span(spark, sf)).where("op <> 'delete'").withColumn("valid_from", F.col("seq"))
    half = table(spark, sf, "events").count() // 2
    return lc.state_at(s, half).select("seq", "doc_id", "valid_from", "valid_to")


@query
def active_doc_count_timeline(spark, sf):
    log, span = change_log(spark, sf), _log_span(spark, sf)
    s = lc.retire_ticks(log, span).where("op <> 'delete'").withColumn("valid_from", F.col("seq"))
    return lc.active_docs(cut(s), log.select("seq"), span=span).select("seq", F.col("active_docs").cast("long").alias("active_docs"))


@query
def source_id_default(spark, sf):
    d = table(spark, sf, "documents")
    given = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "de", "")
    return d.select("doc_id", lc.source_or_doc(given, F.col("doc_id").cast("string")).alias("source_id"))


# ----------------------------------------------------------------- scalar functions


@query
def normalize_entity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.entity_key(F.col("text"))).alias("key_md5"))


@query
def normalize_topic(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.topic_slug(F.col("text"))).alias("slug_md5"))


@query
def normalize_date(spark, sf):
    e = table(spark, sf, "events")
    surface = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("on "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" at noon")))
        .when(F.col("event_type") == "view", F.concat(F.lit("by "), F.date_format("ts", "MMMM d"), F.lit(", 2024")))
        .when(F.col("event_type") == "signup", F.lit(""))
        .otherwise(F.concat(F.lit("Early  Term "), "user_id"))
    )
    return e.select("event_id", tx.date_key(surface).alias("date_key"))


@query
def title_tokens(spark, sf):
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return p.select("page_id", F.explode(tx.title_tokens(F.col("title"))).alias("token"))


@query
def mention_signature(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.md5(tx.signature(F.col("lang"), F.col("text"))).alias("sig_md5"))


@query
def node_ids(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", tx.node_id("chunk", F.col("doc_id").cast("string")).alias("chunk_node"),
                    tx.node_id("document", F.col("source")).alias("doc_node"), tx.node_id("topic", F.col("lang")).alias("topic_node"))


@query
def lexicon_mentions_q(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(lexicon_mentions(F.col("text"))).alias("pos", "m"))
    return d.select("doc_id", F.col("pos").cast("long").alias("pos"), "m.type", "m.surface", "m.context")


@query
def topic_snap(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", snap_topic(tx.entity_key(F.col("text"))).alias("slug"))
    return d.select("doc_id", F.coalesce("slug", F.lit("-")).alias("slug"))


@query
def edge_tiers(spark, sf):
    g = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    e = gr.edges_of(g.chunks)
    return e.groupBy("relation", "tier").agg(F.count("*").alias("n"), r6(F.sum("weight")).alias("weight"))


# ----------------------------------------------------------------- vectors


@query
def knn_candidates(spark, sf):
    kb = plan.from_tables(spark, sf, ["vec"])
    return plan.vector_only(kb).select("seq", "cand", "score", "rank")


@query
def knn_query_topk(spark, sf):
    """Retrieval: the five best documents for every benchmark text."""
    docs = cut(embed_texts(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id", "text").select("id", "vec"))
    asks = cut(embed_texts(table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), "id", "text").select("id", "vec"))
    corpus = docs.select("id", F.lit(0).alias("valid_from"), F.lit(None).cast("long").alias("valid_to"), "vec")
    found = knn_join(asks.select("id", F.lit(1).alias("at"), "vec"), corpus, DISCOVERY.vector_k)
    return found.select(F.col("qid").alias("item_id"), F.col("cid").alias("doc_id"), "score", "rank")


@query
def similar_to_freeze(spark, sf):
    kb = plan.from_tables(spark, sf, ["vec"])
    frozen = gr.freeze_similar(plan.vector_only(kb, DISCOVERY.freeze_k), kb.chunks, DISCOVERY.freeze_k)
    return frozen.select("seq", "cand", "score", "valid_from", "valid_to")


@query
def neighbour_snippets(spark, sf):
    kb = plan.from_tables(spark, sf, ["vec", "text"])
    prompts = jd.neighbour_prompt(kb.readers, plan.vector_only(kb), kb.chunks)
    return prompts.select("seq", F.md5("prompt").alias("prompt_md5"))


# ----------------------------------------------------------------- metadata


@query
def facets_long(spark, sf):
    kb = plan.from_tables(spark, sf, FACET_COLUMNS)
    return facets_of(kb.chunks, ["seq"])


@query
def facet_idf(spark, sf):
    kb = plan.from_tables(spark, sf, FACET_COLUMNS)
    w = facet_weights(kb.asked_facets(), cut(kb.stored_facets()), kb.span)
    return w.select("seq", "kind", "value", F.col("df").cast("long").alias("df"), F.col("n").cast("long").alias("n"), r6("idf").alias("idf"))


@query
def metadata_candidates_q(spark, sf):
    return plan.metadata_only(plan.from_tables(spark, sf, FACET_COLUMNS))


@query
def facet_shared(spark, sf):
    """Facets each candidate shares with its arrival."""
    kb = plan.from_tables(spark, sf, FACET_COLUMNS)
    asked, stored = cut(kb.asked_facets()), cut(kb.stored_facets())
    best = metadata_candidates(facet_weights(asked, stored, kb.span), stored, span=kb.span)
    mine = best.select("seq", "cand").join(asked.select("seq", "kind", "value"), "seq")
    return (
        mine.join(stored.select(F.col("id").alias("cand"), "kind", "value"), ["cand", "kind", "value"])
        .groupBy("seq", "cand").agg(F.count("*").alias("shared"))
    )


# ----------------------------------------------------------------- entities


def _mentions(spark, sf):
    e = table(spark, sf, "embeddings").where("vec_id IS NOT NULL")
    return e.select(
        (F.col("vec_id") + 1).alias("seq"), F.lit(0).alias("pos"), F.concat(F.lit("t"), "label").alias("type"),
        F.concat(F.lit("name "), "vec_id").alias("sig"), F.concat(F.lit("Name "), "vec_id").alias("surface"),
        F.col("embedding").alias("vec"),
    )


@query
def entity_block_topk(spark, sf):
    m = _mentions(spark, sf)
    asks = m.select(F.col("seq").alias("id"), "type", F.col("seq").alias("at"), "vec")
    have = m.select(F.col("seq").alias("id"), "type", F.col("seq").alias("valid_from"), "vec")
    return er.block(asks, have, floor=0.1).select("id", "ent", "score", "rank")


@query
def three_band(spark, sf):
    m = _mentions(spark, sf)
    asks = m.select(F.col("seq").alias("id"), "type", F.col("seq").alias("at"), "vec")
    have = m.select(F.col("seq").alias("id"), "type", F.col("seq").alias("valid_from"), "vec")
    top = er.block(asks, have, k=1, floor=-2.0).select("id", "score")
    return m.select(F.col("seq").alias("id")).join(top, "id", "left").select(
        "id", "score", er.band(F.col("score"), FOLD_HIGH, FOLD_LOW).alias("band"))


@query
def entity_fold(spark, sf):
    res, _ = er.canonical_fold(_mentions(spark, sf), FOLD_HIGH, FOLD_LOW)
    return res.select("seq", "type", "band", "matched", "canonical_id")


@query
def alias_clusters(spark, sf):
    res, ents = er.canonical_fold(_mentions(spark, sf), FOLD_HIGH, FOLD_LOW)
    return er.alias_clusters(res, ents).select("canonical_id", "name", "type", F.array_join("aliases", "|").alias("aliases"))


@query
def resolution_log(spark, sf):
    res, _ = er.canonical_fold(_mentions(spark, sf), FOLD_HIGH, FOLD_LOW)
    return er.resolution_log(res).groupBy("type", "payload.type", "payload.band").agg(F.count("*").alias("n")).toDF(
        "event", "type", "band", "n")


@query
def node_attributes_at(spark, sf):
    """What each matched mention finds on its entity's node: name, type and the aliases so far."""
    res, ents = er.canonical_fold(_mentions(spark, sf), FOLD_HIGH, FOLD_LOW)
    asks = res.where("matched IS NOT NULL").select(F.col("matched").alias("canonical_id"), F.col("seq").alias("at"))
    return er.attributes_at(asks, res, ents).select(
        F.col("at").alias("seq"), "canonical_id", "name", "type", "first_seq", F.array_join("aliases", "|").alias("aliases"))


def _repeated_mentions(spark, sf):
    """Three mentions per chunk; the last fifth of the vectors are mentioned under the signatures of the first ones."""
    e = table(spark, sf, "embeddings").where("vec_id IS NOT NULL")
    n = e.count() * 4 // 5
    named = e.where(F.col("vec_id") < n).select(F.col("vec_id").alias("s"), F.concat(F.lit("t"), "label").alias("type"), F.col("embedding").alias("vec"))
    said = e.select(F.pmod("vec_id", F.lit(n)).alias("s"), (F.floor(F.col("vec_id") / 3) + 1).alias("seq"), (F.col("vec_id") % 3).cast("int").alias("pos"),
                    F.when(F.col("vec_id") < n, "Name ").otherwise("Alias ").alias("kind"))
    return said.join(named, "s").select("seq", "pos", "type", F.concat(F.lit("name "), "s").alias("sig"), F.concat("kind", "s").alias("surface"), "vec")


def _even_judge(asks):
    """An adjudicator that merges a mention into its best candidate if their numbers add up to an even one."""
    number = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("long")
    same = (number(F.col("sig")) + number(F.col("top"))) % 2 == 0
    verdict = F.struct(
        F.when(same, "merge").otherwise("create_new").alias("decision"), F.when(same, F.col("top")).alias("candidate_id"),
        F.lit(0.5).alias("confidence"), F.lit("even").alias("rationale"))
    return asks.select("sig", "top", verdict.alias("verdict"))


@query
def entity_fold_adjudicated(spark, sf):
    """Every mention with what it became and the record it left in the log (none for a repeat in the minting chunk)."""
    span = span_for(table(spark, sf, "embeddings").count())
    res, _, _ = adjudicated_fold(_repeated_mentions(spark, sf), _even_judge, tau_high=FOLD_HIGH, tau_low=FOLD_LOW, floor=FOLD_FLOOR, span=span)
    log = er.resolution_log(res).select(
        "seq", "pos", F.col("type").alias("event"), "payload.chunk_id", "payload.surface_form", "payload.confidence", "payload.rationale")
    return res.join(log, ["seq", "pos"], "left").select(
        "seq", F.col("pos").cast("long").alias("pos"), "sig", "type", "band", "matched", "canonical_id", "event", "chunk_id", "surface_form", "confidence", "rationale")


# ----------------------------------------------------------------- graph


@query
def graph_nodes(spark, sf):
    kb = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    return gr.nodes_of(kb.chunks).select("node_id", "type", "valid_from", "valid_to", "ord")


def _graph(spark, sf):
    kb = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    return kb, plan.graph_of(kb)


def _similar(kb):
    return gr.freeze_similar(plan.vector_only(kb, DISCOVERY.freeze_k), kb.chunks, DISCOVERY.freeze_k)


def _edges(spark, sf):
    """All edges, for a query that reads them once: neither they nor what they are made of is written."""
    kb = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    return kb, gr.edges_of(kb.chunks, _similar(kb))


def _nodes(kb):
    return cut(gr.nodes_of(kb.chunks))


@query
def graph_edges(spark, sf):
    _, edges = _edges(spark, sf)
    return edges.select("src", "dst", "relation", "tier", r6("weight").alias("weight"), "valid_from", "valid_to")


@query
def edge_weights(spark, sf):
    _, edges = _edges(spark, sf)
    return edges.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("weight"))


@query
def undirected_projection(spark, sf):
    _, edges = _edges(spark, sf)
    p = gr.undirected_projection(edges.where("valid_to IS NULL"))
    return p.select("a", "b", r6("weight").alias("weight"))


@query
def walk_digraph(spark, sf):
    _, edges = _edges(spark, sf)
    reverse = {r: (0.0 if r == "on_date" else w) for r, (_, w) in gr.RELATIONS.items()}
    return gr.walk_digraph(edges.where("valid_to IS NULL"), reverse=reverse).select("src", "dst", r6("weight").alias("weight"))


@query
def degree(spark, sf):
    _, edges = _edges(spark, sf)
    return gr.degree(edges)


@query
def anchors_for(spark, sf):
    kb = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    return gr.anchors_for(kb.readers, kb.chunks, cut(gr.nodes_of(kb.chunks)), kb.span).select("seq", "node_id")


@query
def latest_source_anchor(spark, sf):
    kb = plan.from_tables(spark, sf, ["source_id"])
    return gr.source_anchor(kb.readers, kb.chunks, kb.span).select("seq", "node_id")


@query
def chunk_nodes_for_doc(spark, sf):
    kb = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    e = gr.edges_of(kb.chunks).where("relation = 'contains'")
    return e.select(F.col("src").alias("doc_node"), F.col("dst").alias("chunk_node"))


@query
def retire_revoke(spark, sf):
    _, edges = _edges(spark, sf)
    return gr.revoked_by_retire(edges).select("src", "dst", "relation", F.col("valid_to").alias("revoked_seq"))


@query
def live_successors(spark, sf):
    kb, edges = _edges(spark, sf)
    return gr.live_successors(kb.chunks, edges)


@query
def active_view(spark, sf):
    kb, edges = _edges(spark, sf)
    _, edges = gr.active_view(_nodes(kb), edges)
    return edges.select("src", "dst", "relation")


@query
def graph_state_at(spark, sf):
    kb, edges = _edges(spark, sf)
    half = table(spark, sf, "events").count() // 2
    _, edges = gr.graph_at(_nodes(kb), edges, half)
    return edges.select("src", "dst", "relation")


@query
def graph_snapshot(spark, sf):
    kb, edges = _edges(spark, sf)
    e = gr.edge_counts(edges).select(F.expr(
        "stack(3, 'structural', structural, 0L, 'semantic', semantic_active, semantic_revoked, 'all', "
        "structural + semantic_active, semantic_revoked) AS (type, active, tombstoned)"))
    n = gr.node_counts(gr.nodes_of(kb.chunks))
    return n.select(F.concat(F.lit("node:"), "type").alias("item"), "active", "tombstoned").unionByName(
        e.select(F.concat(F.lit("edge:"), "type").alias("item"), "active", "tombstoned"))


@query
def entity_cluster_sizes(spark, sf):
    kb, g = _graph(spark, sf)
    return gr.entity_clusters(g.nodes, g.edges).select("node_id", "key", "active_chunk_count")


@query
def chunk_components(spark, sf):
    kb, edges = _edges(spark, sf)
    return gr.chunk_components(kb.chunks, edges)


@query
def bfs_khop(spark, sf):
    kb, edges = _edges(spark, sf)
    nodes = _nodes(kb)
    anchors = gr.anchors_for(kb.readers, kb.chunks, nodes, kb.span)
    return gr.bfs_candidates(anchors, nodes, edges, hops=2, top_n=DISCOVERY.graph_top_n, span=kb.span)


@query
def graph_seeds(spark, sf):
    """Anchors only have structural neighbours, so the arrivals' nearest neighbours are not asked for."""
    kb = plan.from_tables(spark, sf, ["source_id", "entities", "dates", "topics", "derived_from"])
    s = gr.graph_seeds(gr.anchors_for(kb.readers, kb.chunks, _nodes(kb), kb.span), gr.edges_of(kb.chunks), kb.span)
    return s.select("seq", "node_id", r6("mass").alias("mass"))


@query
def hybrid_seeds(spark, sf):
    kb, g = _graph(spark, sf)
    s = gr.hybrid_seeds(kb.readers, kb.chunks, g.nodes, g.edges, g.found, DISCOVERY.hybrid_k_vec, DISCOVERY.w_entity, DISCOVERY.w_old, kb.span)
    return s.select("seq", "population", "node_id", "members", r6("mass").alias("mass"))


def _walked(found):
    return found.select("seq", "cand", "rank", F.round("score", 9).alias("score"), F.round("slack", 9).alias("slack"))


@query
def ppr_fixed_iters(spark, sf):
    """Exactly five power iterations, so that scores are exact (``slack`` 0)."""
    return _walked(plan.graph_only(*_graph(spark, sf), iterations=5))


@query
def graph_candidates(spark, sf):
    return _walked(plan.graph_only(*_graph(spark, sf)))


@query
def hybrid_candidates(spark, sf):
    return _walked(plan.hybrid(*_graph(spark, sf)))


@query
def rebuild_from_log(spark, sf):
    kb = plan.from_tables(spark, sf, GRAPH_COLUMNS)
    log = cut(log_of(kb.chunks, _similar(kb)))
    chunks, again, asserted = rebuild(log)
    edges = gr.edges_of(cut(chunks), again, asserted)
    return edges.select("src", "dst", "relation", "tier", r6("weight").alias("weight"), "valid_from", "valid_to")


# ----------------------------------------------------------------- judging and evaluation


def gold_of(spark, sf):
    """Labelled arrivals: quality/toxicity marks stand for the gold label, and the first
    document of the same entity plus the declared sources are what a conflict implicates."""
    a = plan.keyed(plan.arrivals(spark, sf, False)).select("seq", "text_id", "op", "doc_id", "entity", "derived_from")
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("text_id"), "quality", "toxic")
    first = a.groupBy("entity").agg(F.min_by("doc_id", "seq").alias("first_doc"))
    label = (
        F.when(F.col("toxic") == 1, "contradiction").when(F.col("quality") == 0, "duplicate")
        .when(F.size("derived_from") > 0, "supersedes").otherwise("clean")
    )
    g = a.join(marks, "text_id", "left").join(first, "entity").withColumn("expected_label", label)
    none = F.array().cast("array<string>")
    return g.select(
        "seq", (F.col("seq") - 1).alias("position"), "op", F.col("op").alias("event_type"), "doc_id", F.lit("").alias("intent"),
        "expected_label",
        F.when(F.col("expected_label") == "clean", none).otherwise(
            F.array_distinct(F.concat("derived_from", F.array("first_doc")))).alias("implicates"),
    )


def _calls(spark, sf, k=DISCOVERY.vector_k):
    kb = plan.from_tables(spark, sf, ["vec"])
    gold = cut(gold_of(spark, sf))
    calls = jd.oracle_judge(plan.vector_only(kb, k), kb.chunks, gold.where("op <> 'delete'"))
    return kb, gold, calls


def _records(spark, sf):
    kb, gold, calls = _calls(spark, sf)
    corpus = lc.active_docs(kb.chunks, gold.select("seq"), span=kb.span)
    return ev.records_of(gold, calls.withColumn("ord", F.lit(0)), corpus, run_id="r", baseline="vector-only", shuffle_idx=0)


def _sweep(spark, sf, ks=(1, 3, 5)):
    """Records of one run per number of neighbours; a smaller k is a prefix of a larger."""
    kb, gold = plan.from_tables(spark, sf, ["vec"]), cut(gold_of(spark, sf))
    found = cut(plan.vector_only(kb, max(ks)))
    corpus = cut(lc.active_docs(kb.chunks, gold.select("seq"), span=kb.span))
    out = None
    for i, k in enumerate(ks):
        calls = jd.oracle_judge(found.where(F.col("rank") <= k), kb.chunks, gold.where("op <> 'delete'"))
        rec = ev.records_of(gold, calls.withColumn("ord", F.lit(0)), corpus, run_id="r", baseline="vector-only", shuffle_idx=i)
        out = rec if out is None else out.unionByName(rec)
    return out


@query
def oracle_judge(spark, sf):
    _, _, calls = _calls(spark, sf)
    return calls.select("seq", "doc_id", "label", F.array_join("candidate_docs", "|").alias("candidate_docs"),
                        F.array_join("implicated_docs", "|").alias("implicated_docs"), "proposed_action")


@query
def recency_decisions(spark, sf):
    _, _, calls = _calls(spark, sf)
    d = jd.decide(jd.reports_of(calls), "recency")
    return d.select("report_id", "seq", "action", F.explode("remove").alias("removed"))


@query
def insert_only_decisions(spark, sf):
    _, _, calls = _calls(spark, sf)
    d = jd.decide(jd.reports_of(calls), "insert_only")
    return d.select("report_id", "seq", "action", F.size("remove").cast("long").alias("removed"))


@query
def human_pending(spark, sf):
    """Reports still parked once the reviewers have answered every contradiction."""
    _, _, calls = _calls(spark, sf)
    reports = cut(jd.reports_of(calls))
    answers = reports.where("label = 'contradiction'").select("report_id", F.lit("skip").alias("action"), F.col("implicated_ids").alias("remove"))
    decided = jd.decide(reports, "human", answers)
    return jd.pending(reports, decided).select("report_id", "seq", "label")


@query
def judge_call_merge(spark, sf):
    """Each event judged twice, with one and with five neighbours."""
    kb, gold = plan.from_tables(spark, sf, ["vec"]), cut(gold_of(spark, sf))
    found = cut(plan.vector_only(kb, 5))
    a, b = (
        jd.oracle_judge(found.where(F.col("rank") <= k), kb.chunks, gold.where("op <> 'delete'")) for k in (1, 5)
    )
    m = ev.merge_calls(a.withColumn("ord", F.lit(0)).unionByName(b.withColumn("ord", F.lit(1))))
    return m.select("seq", "label", F.array_join("candidate_docs", "|").alias("candidate_docs"),
                    F.array_join("implicated_docs", "|").alias("implicated_docs"))


@query
def eval_records(spark, sf):
    r = _records(spark, sf)
    return r.select(
        "baseline", "position", "seq", "doc_id", "event_type", "expected_label", F.array_join("implicates", "|").alias("implicates"),
        F.col("n_candidates").cast("long").alias("n_candidates"), F.array_join("candidate_docs", "|").alias("candidate_docs"),
        "verdict", F.array_join("implicated_found", "|").alias("implicated_found"),
        F.col("detected").cast("int").alias("detected"), F.col("corpus_size").cast("long").alias("corpus_size"))


@query
def summary_by_baseline(spark, sf):
    return ev.summarise(_records(spark, sf))


@query
def summary_by_label(spark, sf):
    return ev.summarise_labels(_records(spark, sf))


@query
def temporal_quartiles(spark, sf):
    return ev.temporal_quartiles(cut(_records(spark, sf)))


@query
def audit_marks(spark, sf):
    return ev.audit(_records(spark, sf)).select("seq", "implicates", "candidates", "verdict", "mark")


@query
def audit_summary(spark, sf):
    return ev.audit_summary(_records(spark, sf))


@query
def aggregate_shuffles(spark, sf):
    """Mean and spread over three runs that differ in the number of neighbours."""
    return ev.aggregate(ev.summarise(_sweep(spark, sf), ["shuffle_idx"]))


@query
def aggregate_label_rates(spark, sf):
    return ev.aggregate_labels(ev.summarise_labels(_sweep(spark, sf), ["shuffle_idx"]))


@query
def order_dag_edges(spark, sf):
    return ro.order_constraints(cut(gold_of(spark, sf)), _log_span(spark, sf))


@query
def dag_in_degree(spark, sf):
    g = cut(gold_of(spark, sf))
    return ro.in_degree(g, ro.order_constraints(g, _log_span(spark, sf)))


@query
def conflict_positions(spark, sf):
    return ro.conflict_positions(gold_of(spark, sf))


@query
def label_histogram(spark, sf):
    return ro.label_histogram(gold_of(spark, sf))


@query
def shuffle_valid(spark, sf):
    """A constraint-respecting order of the whole log, seed 42."""
    return ro.random_order(cut(gold_of(spark, sf)), 42, span=_log_span(spark, sf)).select("seq", "position")


CATALOGUE["lexicon_mentions"] = CATALOGUE.pop("lexicon_mentions_q")
CATALOGUE["metadata_candidates"] = CATALOGUE.pop("metadata_candidates_q")
