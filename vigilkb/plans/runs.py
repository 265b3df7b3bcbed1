"""End-to-end runs: labelled events in, evaluation records out.

Time is a doubled event clock.  Event s detects at tick 2s; an update or delete retires
its document at 2s, before detection; a replacement decided at s retires at 2s + 1, after
it.  Under the non-destructive policy everything is known up front and a run is one pass.
Under the recency policy what is live depends on earlier verdicts.  There the run is
repeated with the removals its own verdicts imply until they repeat themselves: the
verdict at s depends only on removals before s, so the fixed point is exactly the outcome
of processing one event at a time, and every round settles at least one more event.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from vigilkb.config import DISCOVERY
from vigilkb.functions.lexicon import lexicon_mentions
from vigilkb.functions.text import node_id
from vigilkb.functions.vectors import embed_texts
from vigilkb.operators import evaluation as ev
from vigilkb.operators import lifecycle as lc
from vigilkb.operators.adjudication import Adjudicator, adjudicated_fold
from vigilkb.operators.entities import canonical_fold, route
from vigilkb.operators.graph import live_successors
from vigilkb.operators.judging import Policy, decide, oracle_judge, reports_of
from vigilkb.operators.knn import as_corpus, knn_join, vector_candidates
from vigilkb.operators.ordering import FOREVER, number_rows, span_for
from vigilkb.operators.reordering import shuffles
from vigilkb.plans.kb import KB, Graph, graph_of, graph_only, hybrid, metadata_only, vector_only
from vigilkb.session import cut

BASELINES = ["vector-only", "metadata-only", "graph-only", "hybrid"]

Judge = Callable[[DataFrame, DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Setup:
    """Extension points of a run.

    ``extract``: text column -> ARRAY<STRUCT<type, surface, context>>; ``embed``: (df,
    key, text) -> df with ``vec``; ``policy``: a name or a function of the reports (see ``decide``); ``judge``: (candidates, chunks, gold) -> calls;
    ``adjudicator``: asks -> verdicts (see ``operators.adjudication``), without one gray mentions mint;
    ``vocabulary``: topic slug -> patterns, without one the built-in one.
    """

    extract: Callable = lexicon_mentions
    embed: Callable = embed_texts
    judge: Judge = oracle_judge
    adjudicator: Adjudicator | None = None
    vocabulary: dict[str, list[str]] | None = None
    controlled_topics: bool = True
    policy: str | Policy = "insert_only"
    tau_high: float = DISCOVERY.tau_high
    tau_low: float = DISCOVERY.tau_low


@dataclass
class Prepared:
    events: DataFrame
    kb: KB
    entities: DataFrame
    resolution: DataFrame


def enrich(events: DataFrame, setup: Setup, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors, keys and resolved entities per non-delete event.

    Returns (rows, resolution, entities); rows has matched (entities known before the
    event's own commit) and canonical (after it).
    """
    base = events.where("op <> 'delete'").withColumn(
        "source_id", lc.source_or_doc(F.col("source_id"), F.col("doc_id")))
    # extraction runs once per event; everything after reads its result
    found = cut(base.select("seq", F.posexplode(setup.extract(F.col("text"))).alias("pos", "m")).select("seq", "pos", "m.*"))
    keys, named = route(found, setup.vocabulary, setup.controlled_topics)
    if setup.adjudicator is None:
        resolution, entities = canonical_fold(cut(named), setup.tau_high, setup.tau_low, known)
    else:
        resolution, entities, _ = adjudicated_fold(named, setup.adjudicator, tau_high=setup.tau_high, tau_low=setup.tau_low, known=known)

    def ids(column: str, out: str) -> DataFrame:
        first = resolution.where(F.col(column).isNotNull()).groupBy("seq", column).agg(F.min("pos").alias("pos"))
        return first.groupBy("seq").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("pos", column))), lambda x: x[column]).alias(out))

    none = F.array().cast("array<string>")
    rows = (
        setup.embed(base, "seq", "text").join(keys, "seq", "left")
        .join(ids("matched", "matched_ids"), "seq", "left").join(ids("canonical_id", "canonical_ids"), "seq", "left")
    )
    for c in ("dates", "topics", "matched_ids", "canonical_ids"):
        rows = rows.withColumn(c, F.coalesce(c, none))
    return cut(rows), resolution, entities


def assemble(events: DataFrame, rows: DataFrame) -> KB:
    """Readers and chunks on the doubled clock."""
    span = span_for(2 * (events.agg(F.max("seq")).first()[0] or 0) + 2)
    ends = lc.retire_ticks(events.select("seq", "op", "doc_id"), span).where("op <> 'delete'").select("seq", "valid_to")
    stamped = cut(rows.join(ends, "seq").withColumns(
        {"valid_from": F.col("seq") * 2, "valid_to": F.col("valid_to") * 2}))
    return KB(
        readers=stamped.withColumns({"at": F.col("seq") * 2, "entities": F.col("matched_ids")}),
        chunks=stamped.withColumn("entities", F.col("canonical_ids")),
        span=span,
    )


def prepare(events: DataFrame, setup: Setup = Setup()) -> Prepared:
    events = cut(events)
    rows, resolution, entities = enrich(events, setup)
    return Prepared(events, assemble(events, rows), entities, resolution)


def _graph(kb: KB, destructive: bool, asserted: DataFrame | None, decisions: DataFrame | None) -> Graph:
    found = cut(vector_candidates(kb.readers, kb.chunks, DISCOVERY.freeze_k))
    frozen = None
    if destructive:
        # at commit the replaced chunks are gone and the chunk itself is in the index
        late = kb.readers.withColumn("at", F.col("at") + 1)
        around = cut(vector_candidates(late, kb.chunks, DISCOVERY.freeze_k + 1))
        near = around.where("cand <> seq")
        missed = F.when(F.col("own").isNull(), F.col("rank")).when(F.col("rank") > F.col("own"), F.col("rank") - 1)
        own = around.where("cand = seq").select("seq", F.col("rank").alias("own"))
        frozen = near.join(own, "seq", "left").withColumn("rank", F.coalesce(missed, F.col("rank"))).drop("own")
    return graph_of(kb, asserted=asserted, decisions=decisions, found=found, frozen=frozen)


#: A discovery strategy: (the knowledge base with the readers that ask, its graph when called for) -> (seq, cand, score, rank).
Strategy = Callable[[KB, Callable[[], Graph]], DataFrame]

STRATEGIES: dict[str, Strategy] = {
    "vector-only": lambda kb, graph: vector_only(kb),
    "metadata-only": lambda kb, graph: metadata_only(kb),
    "graph-only": lambda kb, graph: graph_only(kb, graph()),
    "hybrid": lambda kb, graph: hybrid(kb, graph()),
}


def candidates_of(kb: KB, baseline: str | Strategy, *, destructive: bool = False, asserted: DataFrame | None = None,
                  decisions: DataFrame | None = None, since: int = 0) -> DataFrame:
    """(seq, cand, score, rank) of one discovery strategy, by name or the strategy itself, for the readers from ``since`` on."""
    asked = kb if since == 0 else replace(kb, readers=cut(kb.readers.where(F.col("seq") >= since)))
    strategy = STRATEGIES[baseline] if isinstance(baseline, str) else baseline
    # the graph holds the neighbours that every earlier commit froze
    return strategy(asked, lambda: _graph(kb, destructive, asserted, decisions))


def _mark(removed: DataFrame) -> tuple:
    r = removed.agg(F.count("*").alias("n"), F.sum(F.xxhash64("seq", "gone").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def detect(p: Prepared, baseline: str, setup: Setup = Setup(), *, since: int = 0,
           earlier: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(calls, chunks as finally stamped).

    ``since`` asks only for the events from there on; ``earlier`` (seq, tick, by) are the removals
    that the calls before them made.
    """
    gold = p.events.where((F.col("op") != "delete") & (F.col("seq") >= since)).select("seq", "doc_id", "expected_label", "implicates")
    if setup.policy == "insert_only":
        return cut(setup.judge(candidates_of(p.kb, baseline, since=since), p.kb.chunks, gold)), p.kb.chunks
    if setup.policy == "human":
        raise ValueError("a run does not wait for people; see decide() for the human queue")
    base, before, removals = p.kb, None, earlier
    # every round settles one more event at least
    for _ in range(p.events.where(F.col("seq") >= since).count() + 2):
        kb, asserted, decisions = _after(base, removals)
        calls = cut(setup.judge(candidates_of(kb, baseline, destructive=True, asserted=asserted, decisions=decisions, since=since), kb.chunks, gold))
        made = removals_of(calls, setup.policy)
        removals = cut(made if earlier is None else earlier.unionByName(made))
        after = _mark(removals.groupBy("seq").agg(F.min("tick").alias("gone")))
        if after == before:
            return calls, kb.chunks
        before = after
    raise RuntimeError("removals did not settle")


def removals_of(calls: DataFrame, policy: str | Policy = "recency") -> DataFrame:
    """(seq, tick, by): the chunks that the policy removes for flagged calls, just after them."""
    made = decide(reports_of(calls), policy)
    return made.select(F.explode("remove").alias("seq"), (F.col("seq") * 2 + 1).alias("tick"), F.col("seq").alias("by"))


def _after(base: KB, removals: DataFrame | None) -> tuple[KB, DataFrame | None, DataFrame | None]:
    """The tables with ``removals`` stamped into them, the edges they assert and the decisions behind them."""
    if removals is None:
        return base, None, None
    first = removals.groupBy("seq").agg(F.min("tick").alias("gone"))
    chunks = cut(base.chunks.join(first, "seq", "left").withColumn("valid_to", F.least("valid_to", "gone")).drop("gone"))
    ends = chunks.select(F.col("seq").alias("by"), F.col("valid_to").alias("n_to"))
    asserted = cut(removals.join(ends, "by").select(
        node_id("chunk", F.col("by").cast("string")).alias("src"), node_id("chunk", F.col("seq").cast("string")).alias("dst"),
        F.lit("supersedes_content").alias("relation"), F.lit(1.0).alias("confidence"),
        F.col("tick").alias("valid_from"), F.col("n_to").alias("valid_to")))
    decisions = removals.select(F.concat(F.lit("report-"), F.col("by").cast("string")).alias("report_id"), F.col("tick").alias("valid_from")).distinct()
    return replace(base, chunks=chunks), asserted, decisions


def run(p: Prepared, baseline: str, setup: Setup = Setup(), *, run_id: str = "run", shuffle_idx: int = -1,
        seed: int | None = None) -> DataFrame:
    """Evaluation records of one strategy over one event order."""
    calls, chunks = detect(p, baseline, setup)
    readers = p.events.select("seq", F.col("seq").alias("position"))
    # the corpus after event s is what is live just before tick 2s + 2
    corpus = lc.active_docs(chunks, readers.select("seq", (F.col("seq") * 2 + 1).alias("tick")), at="tick", span=p.kb.span)
    events = p.events.withColumns({"position": F.col("seq") - 1, "event_type": F.col("op")})
    return ev.records_of(events, calls.withColumn("ord", F.lit(0)), corpus, run_id=run_id, baseline=baseline,
                         shuffle_idx=shuffle_idx, seed=seed)


def compare_baselines(events: DataFrame, setup: Setup = Setup(), *, n_shuffles: int = 0, base_seed: int = 42,
                      baselines: list[str] | None = None, run_id: str = "run") -> DataFrame:
    """Records of all strategies over the given order, or over ``n_shuffles`` random ones."""
    orders = [(None, events)] if n_shuffles == 0 else shuffles(events, n_shuffles, base_seed)
    out = None
    for i, (seed, order) in enumerate(orders):
        p = prepare(order, setup)
        for b in baselines or BASELINES:
            rec = cut(run(p, b, setup, run_id=run_id, shuffle_idx=i if seed is not None else -1, seed=seed))
            out = rec if out is None else out.unionByName(rec)
    return out


def retrieve(kb: KB, asks: DataFrame, setup: Setup = Setup(), k: int = DISCOVERY.vector_k) -> DataFrame:
    """The ``k`` best chunks live now for each text of ``asks`` (id, text), best first:
    (id, rank, score, seq, doc_id, text)."""
    now = setup.embed(asks, "id", "text").select("id", F.lit(FOREVER - 1).alias("at"), "vec")
    found = knn_join(cut(now), as_corpus(kb.chunks), k)
    stored = kb.chunks.select("seq", "doc_id", "text")
    return found.join(stored, found.cid == stored.seq).select(F.col("qid").alias("id"), "rank", "score", "seq", "doc_id", "text")


def revalidation(kb: KB, edges: DataFrame, strategy: Callable[[KB], DataFrame]) -> DataFrame:
    """Candidates for every live successor of a retirement, asked again right after it:
    (retired_at, seq, cand, score, rank).  A chunk is no candidate of itself."""
    hit = live_successors(kb.chunks, edges)
    asks = cut(number_rows(hit.withColumnRenamed("seq", "chunk"), ["retired_at", "chunk"], "seq"))
    attributes = kb.readers.drop("at").withColumnRenamed("seq", "chunk")
    readers = asks.join(attributes, "chunk").withColumn("at", F.col("retired_at") + 1)
    found = strategy(replace(kb, readers=cut(readers)))
    return found.join(asks, "seq").where("cand <> chunk").select("retired_at", F.col("chunk").alias("seq"), "cand", "score", "rank")
