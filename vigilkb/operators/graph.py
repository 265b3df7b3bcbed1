"""The dependency graph as validity-stamped node and edge tables.

Nothing is mutated: a node or edge is a row with ``valid_from`` and ``valid_to``, and
every view (active, as-of, walk graph) is a predicate over those stamps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilkb.config import PHYSICAL
from vigilkb.functions.text import node_id
from vigilkb.operators.ordering import (
    as_of_last,
    as_of_total,
    born_pos,
    first_k_live,
    live_at,
    number_rows,
    stab,
)
from vigilkb.session import cut

# Relation -> (tier, walk weight).  similar_to is scaled by its confidence.
RELATIONS = {
    "contains": ("structural", 1.5),
    "mentions": ("structural", 0.5),
    "on_date": ("structural", 0.4),
    "has_topic": ("structural", 0.7),
    "derived_from": ("structural", 2.5),
    "version_of": ("structural", 3.0),
    "supersedes": ("structural", 3.0),
    "similar_to": ("semantic", 1.0),
    "contradicts": ("semantic", 2.0),
    "duplicates": ("semantic", 2.0),
    "supersedes_content": ("semantic", 3.0),
}
UNKNOWN_WEIGHT = 1.0


def _looked_up(relation: Column, table: dict[str, object], default: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(known[relation], default)


def weight_of(relation: Column, table: dict[str, float] | None = None) -> Column:
    table = {r: w for r, (_, w) in RELATIONS.items()} if table is None else table
    return _looked_up(relation, table, F.lit(UNKNOWN_WEIGHT))


def tier_of(relation: Column) -> Column:
    return _looked_up(
        relation,
        {r: t for r, (t, _) in RELATIONS.items()},
        F.raise_error(F.concat(F.lit("unknown relation "), relation)).cast("string"),
    )


def _chunk_node(seq: Column) -> Column:
    return node_id("chunk", seq.cast("string"))


def freeze_similar(found: DataFrame, chunks: DataFrame, keep: int) -> DataFrame:
    """Nearest neighbours at commit time -> (seq, cand, score, valid_from, valid_to).

    Only positive scores are frozen; the pair ends when either chunk is retired.
    """
    ends = chunks.select("seq", "valid_from", "valid_to")
    return (
        found.where((F.col("score") > 0) & (F.col("rank") <= keep))
        .join(ends, "seq")
        .join(ends.select(F.col("seq").alias("cand"), F.col("valid_to").alias("c_to")), "cand")
        .select("seq", "cand", "score", "valid_from", F.least("valid_to", "c_to").alias("valid_to"))
    )


def edges_of(
    chunks: DataFrame, similar: DataFrame | None = None, asserted: DataFrame | None = None
) -> DataFrame:
    """All edges: src, dst, relation, tier, weight, confidence, valid_from, valid_to.

    ``chunks``: seq, doc_id, dates, topics, entities, derived_from, valid_from.
    """
    me = _chunk_node(F.col("seq"))
    born = F.col("valid_from")

    def structural(src: Column, dst: Column, relation: str, rows: DataFrame = chunks) -> DataFrame:
        return rows.select(
            src.alias("src"), dst.alias("dst"), F.lit(relation).alias("relation"),
            F.lit(None).cast("double").alias("confidence"), born.alias("valid_from"),
            F.lit(None).cast("long").alias("valid_to"),
        )

    def anchored(kind: str, column: str, relation: str) -> DataFrame:
        rows = chunks.select("seq", "valid_from", F.explode(F.array_distinct(column)).alias("key"))
        return structural(me, node_id(kind, F.col("key")), relation, rows)

    first_seen = chunks.groupBy("doc_id").agg(F.min("valid_from").alias("doc_from"))
    sourced = (
        chunks.select("seq", "valid_from", F.explode(F.array_distinct("derived_from")).alias("key"))
        .where("key <> ''")
        .join(first_seen.withColumnRenamed("doc_id", "key"), "key")
        # a source that only arrives later never gets its edge
        .where("doc_from <= valid_from")
    )
    parts = [
        structural(node_id("document", F.col("doc_id")), me, "contains"),
        anchored("date", "dates", "on_date"),
        anchored("topic", "topics", "has_topic"),
        anchored("entity", "entities", "mentions"),
        structural(me, node_id("document", F.col("key")), "derived_from", sourced),
    ]
    if similar is not None:
        pair = F.array(F.struct(F.col("seq").alias("a"), F.col("cand").alias("b")),
                       F.struct(F.col("cand").alias("a"), F.col("seq").alias("b")))
        parts.append(
            similar.withColumn("p", F.explode(pair)).select(
                _chunk_node(F.col("p.a")).alias("src"), _chunk_node(F.col("p.b")).alias("dst"),
                F.lit("similar_to").alias("relation"), F.col("score").alias("confidence"),
                "valid_from", "valid_to",
            )
        )
    if asserted is not None:
        parts.append(asserted.select(*parts[0].columns))
    edges = parts[0]
    for p in parts[1:]:
        edges = edges.unionByName(p)
    return edges.withColumns(
        {
            "tier": tier_of(F.col("relation")),
            "weight": weight_of(F.col("relation")) * F.coalesce("confidence", F.lit(1.0)),
        }
    )


def assert_edges(edges: DataFrame) -> DataFrame:
    """Guard for judge-asserted edges: a structural relation is an error."""
    ok = F.when(tier_of(F.col("relation")) == "semantic", F.col("relation")).otherwise(
        F.raise_error(F.concat("relation", F.lit(" is structural, not assertable"))).cast("string")
    )
    return edges.withColumn("relation", ok)


def nodes_of(chunks: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """All nodes: node_id, type, key, valid_from, valid_to, ord.

    ``ord`` is the creation order, which breaks ties between equal walk scores: by tick,
    and inside one commit chunk, document, dates, topics, entities.
    """
    def rows(kind: str, key: Column, stage: int, place: Column, frm: DataFrame, ends: bool = False) -> DataFrame:
        return frm.select(
            node_id(kind, key).alias("node_id"), F.lit(kind).alias("type"), key.alias("key"),
            F.struct("valid_from", F.lit(stage).alias("stage"), place.cast("int").alias("place")).alias("made"),
            (F.col("valid_to") if ends else F.lit(None)).cast("long").alias("valid_to"),
        )

    def anchors(kind: str, column: str, stage: int) -> DataFrame:
        ex = chunks.select("valid_from", F.posexplode(F.array_distinct(column)).alias("place", "key"))
        return rows(kind, F.col("key"), stage, F.col("place"), ex)

    zero = F.lit(0)
    every = (
        rows("chunk", F.col("seq").cast("string"), 0, zero, chunks, ends=True)
        .unionByName(rows("document", F.col("doc_id"), 1, zero, chunks))
        .unionByName(anchors("date", "dates", 2))
        .unionByName(anchors("topic", "topics", 3))
        .unionByName(anchors("entity", "entities", 4))
    )
    if decisions is not None:
        every = every.unionByName(rows("decision", F.col("report_id"), 5, zero, decisions))
    first = every.groupBy("node_id").agg(
        F.first("type").alias("type"), F.first("key").alias("key"),
        F.min("made").alias("made"), F.max("valid_to").alias("valid_to"),
    )
    made = first.select("node_id", "type", "key", "made.*", "valid_to")
    return number_rows(made, ["valid_from", "stage", "place", "node_id"], "ord", start=0).drop("stage", "place")


# ----------------------------------------------------------------- writes as folds


def latest_nodes(puts: DataFrame) -> DataFrame:
    """Node writes (node_id, seq, env) folded: the last envelope wins, the first write
    keeps its place in the order."""
    return puts.groupBy("node_id").agg(F.max_by("env", "seq").alias("env"), F.min("seq").alias("first_seq"))


def latest_edges(puts: DataFrame) -> DataFrame:
    """Edge writes folded: (src, dst, relation) is unique and the last write wins."""
    keys = ["src", "dst", "relation"]
    rest = [c for c in puts.columns if c not in keys]
    return puts.groupBy(*keys).agg(F.max_by(F.struct(*rest), "valid_from").alias("e")).select(*keys, "e.*")


def revoke(edges: DataFrame, revocations: DataFrame) -> DataFrame:
    """Apply single-edge revocations (src, dst, relation, at).  Revoking a structural edge
    is an error, a missing edge is ignored, and an earlier end stands."""
    once = assert_edges(revocations).groupBy("src", "dst", "relation").agg(F.min("at").alias("__at"))
    return edges.join(once, ["src", "dst", "relation"], "left").withColumn(
        "valid_to", F.least("valid_to", "__at")).drop("__at").select(*edges.columns)


# ----------------------------------------------------------------- views


def active_view(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes that are not retired and the unrevoked edges between them."""
    live = nodes.where("valid_to IS NULL")
    ids = live.select("node_id")
    kept = (
        edges.where("valid_to IS NULL")
        .join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    )
    return live, kept


def graph_at(nodes: DataFrame, edges: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """The active graph after event ``seq``."""
    stamp = f"valid_from <= {seq} AND (valid_to IS NULL OR valid_to > {seq})"
    live = nodes.where(stamp)
    ids = live.select("node_id")
    kept = (
        edges.where(stamp)
        .join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    )
    return live, kept


def revoked_by_retire(edges: DataFrame) -> DataFrame:
    return edges.where("tier = 'semantic' AND valid_to IS NOT NULL")


def live_successors(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """(retired_at, seq): chunks still live after a retirement that sat on the other end
    of an edge it revoked."""
    ended = revoked_by_retire(edges)
    ends = ended.select("valid_to", F.explode(F.array("src", "dst")).alias("node_id"))
    live = chunks.select(
        F.concat(F.lit("chunk:"), F.col("seq").cast("string")).alias("node_id"), "seq",
        F.col("valid_to").alias("c_to"),
    )
    return (
        ends.join(live, "node_id")
        .where("c_to IS NULL OR c_to > valid_to")
        .select(F.col("valid_to").alias("retired_at"), "seq")
        .distinct()
    )


def undirected_projection(edges: DataFrame) -> DataFrame:
    """Parallel relations, and both stored directions, add up on one undirected edge."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum("weight").alias("weight")
    )


def walk_steps(
    edges: DataFrame,
    directed: bool,
    forward: dict[str, float] | None = None,
    reverse: dict[str, float] | None = None,
) -> DataFrame:
    """Stamped transitions (src, dst, weight) of the walk graph.

    Undirected: every stored edge counts both ways.  Directed: ``similar_to`` is stored
    both ways already and keeps its stored weight; any other relation gets its forward
    and its typed reverse weight, and weights that are not positive drop out.
    """
    def step(src: str, dst: str, weight: Column) -> Column:
        return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), weight.alias("weight"))

    if not directed:
        both = F.array(step("src", "dst", F.col("weight")), step("dst", "src", F.col("weight")))
    else:
        rel = F.col("relation")
        both = F.when(rel == "similar_to", F.array(step("src", "dst", F.col("weight")))).otherwise(
            F.array(step("src", "dst", weight_of(rel, forward)), step("dst", "src", weight_of(rel, reverse)))
        )
    return (
        edges.select("valid_from", "valid_to", F.explode(both).alias("s"))
        .select("s.*", "valid_from", "valid_to")
        .where("weight > 0")
    )


def walk_digraph(edges: DataFrame, **weights) -> DataFrame:
    return walk_steps(edges, True, **weights).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def degree(edges: DataFrame) -> DataFrame:
    """Incident edges of every kind, revoked ones included."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(
        F.count("*").alias("degree")
    )


# ----------------------------------------------------------------- anchors of an arrival


def source_anchor(readers: DataFrame, chunks: DataFrame, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """The document that most recently committed the reader's source (last writer)."""
    found = as_of_last(
        chunks.select("source_id", "valid_from", "doc_id"),
        readers.select("source_id", "seq", "at"),
        "source_id", "valid_from", "doc_id", "at", "doc", span,
    )
    return found.where("doc IS NOT NULL").select("seq", "at", node_id("document", F.col("doc")).alias("node_id"))


def _key_nodes(readers: DataFrame, kind: str, column: str) -> DataFrame:
    return readers.select("seq", "at", F.explode(F.array_distinct(column)).alias("key")).select(
        "seq", "at", node_id(kind, F.col("key")).alias("node_id")
    )


def anchors_for(
    readers: DataFrame, chunks: DataFrame, nodes: DataFrame, span: int | None = PHYSICAL.fold_span
) -> DataFrame:
    """Existing anchor nodes of each reader: (seq, at, node_id)."""
    wanted = (
        _key_nodes(readers, "date", "dates")
        .unionByName(_key_nodes(readers, "topic", "topics"))
        .unionByName(_key_nodes(readers, "entity", "entities"))
    )
    made = nodes.where("type IN ('date', 'topic', 'entity')").select("node_id", "valid_from")
    present = wanted.join(made, "node_id").where("valid_from < at").select("seq", "at", "node_id")
    return present.unionByName(source_anchor(readers, chunks, span))


def neighbour_steps(edges: DataFrame) -> DataFrame:
    """Step at which a node gains each distinct structural neighbour (they never end)."""
    pair = F.array(F.struct(F.col("src").alias("n"), F.col("dst").alias("o")),
                   F.struct(F.col("dst").alias("n"), F.col("src").alias("o")))
    first = (
        edges.where("tier = 'structural'")
        .select(F.explode(pair).alias("p"), "valid_from")
        .groupBy("p.n", "p.o")
        .agg(F.min("valid_from").alias("valid_from"))
    )
    return first.groupBy(F.col("n").alias("node_id"), born_pos("valid_from").alias("pos")).agg(
        F.count("*").alias("delta")
    )


def graph_seeds(anchors: DataFrame, edges: DataFrame, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """Graph-only teleport mass: 1 / (1 + distinct neighbours as of the reader).

    Seeds are anchors, and an anchor only has structural neighbours.
    """
    known = as_of_total(neighbour_steps(edges), anchors, ["node_id"], "at", "deg", span=span)
    return known.select("seq", "at", "node_id", (F.lit(1.0) / (1 + F.col("deg"))).alias("mass"))


def hybrid_seeds(
    readers: DataFrame,
    chunks: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    found: DataFrame,
    k_vec: int,
    w_entity: float,
    w_old: float,
    span: int | None = PHYSICAL.fold_span,
) -> DataFrame:
    """The three seed populations: (seq, at, population, node_id, members, mass).

    The prior versions of the reader's document carry ``w_old`` each; they are kept as one
    row per reader (document node, number of members), because listing them would repeat
    a busy document's whole history for each of its events.
    """
    vector = (
        found.where((F.col("rank") <= k_vec) & (F.col("score") > 0))
        .join(readers.select("seq", "at"), "seq")
        .select("seq", "at", F.lit("vector").alias("population"), _chunk_node(F.col("cand")).alias("node_id"),
                F.lit(1).cast("long").alias("members"), (F.col("score") * F.col("score")).alias("mass"))
    )
    made = nodes.where("type = 'entity'").select("node_id", "valid_from")
    entity = (
        _key_nodes(readers, "entity", "entities").join(made, "node_id")
        .where("valid_from < at").select("seq", "at", "node_id")
    )
    steps = (
        edges.where("relation = 'mentions'")
        .groupBy(F.col("dst").alias("node_id"), born_pos("valid_from").alias("pos"))
        .agg(F.count("*").alias("delta"))
    )
    entity = as_of_total(steps, entity, ["node_id"], "at", "deg", span=span).select(
        "seq", "at", F.lit("entity").alias("population"), "node_id", F.lit(1).cast("long").alias("members"),
        (F.lit(float(w_entity)) / (1 + F.col("deg"))).alias("mass"),
    )
    writes = chunks.select("doc_id", born_pos("valid_from").alias("pos"), F.lit(1).cast("long").alias("delta"))
    prior = as_of_total(writes, readers.select("doc_id", "seq", "at"), ["doc_id"], "at", "n", span=span).where("n > 0").select(
        "seq", "at", F.lit("prior").alias("population"), node_id("document", F.col("doc_id")).alias("node_id"),
        F.col("n").alias("members"), (F.col("n") * F.lit(float(w_old))).alias("mass"),
    )
    return vector.unionByName(entity).unionByName(prior)


def direct_mass(seeds: DataFrame) -> DataFrame:
    """Mass of the seeds that name their node."""
    return seeds.where("population <> 'prior'").groupBy("seq", "at", "node_id").agg(F.sum("mass").alias("mass"))


def shared_mass(seeds: DataFrame) -> DataFrame:
    """Mass each earlier chunk of a document gets: (seq, at, owner, mass)."""
    return seeds.where("population = 'prior'").select(
        "seq", "at", F.col("node_id").alias("owner"), (F.col("mass") / F.col("members")).alias("mass"))


def members_of(chunks: DataFrame) -> DataFrame:
    """Which chunks a document contains: (owner, node_id, valid_from)."""
    return chunks.select(node_id("document", F.col("doc_id")).alias("owner"), _chunk_node(F.col("seq")).alias("node_id"), "valid_from")


# ----------------------------------------------------------------- snapshot


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(
        F.count_if(F.col("valid_to").isNull()).alias("active"),
        F.count_if(F.col("valid_to").isNotNull()).alias("tombstoned"),
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    semantic = F.col("tier") == "semantic"
    return edges.agg(
        F.count_if(~semantic).alias("structural"),
        F.count_if(semantic & F.col("valid_to").isNull()).alias("semantic_active"),
        F.count_if(semantic & F.col("valid_to").isNotNull()).alias("semantic_revoked"),
    )


def entity_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Live chunks that mention each entity."""
    live = nodes.where("type = 'chunk' AND valid_to IS NULL").select(F.col("node_id").alias("src"), F.lit(1).alias("one"))
    mentions = edges.where("relation = 'mentions'").select("src", "dst")
    counted = mentions.join(live, "src", "left").groupBy(F.col("dst").alias("node_id")).agg(
        F.count("one").alias("active_chunk_count")
    )
    return nodes.where("type = 'entity'").select("node_id", "key").join(counted, "node_id")


def components(vertices: DataFrame, pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components (id, component = smallest id), by alternating large-star and
    small-star contraction.  Each round is a minimum per vertex and one join, so a hub's
    neighbours are never gathered, and rounds grow with the logarithm of the graph."""
    e = cut(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("u <> v").distinct()
    )

    def lowest(x: DataFrame) -> DataFrame:
        return x.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def mark(x: DataFrame):
        r = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    before = mark(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(lowest(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct()
        )
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = lowest(down)
        small = (
            down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        e = cut(small)
        after = mark(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    roots = e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))
    return vertices.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def chunk_components(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Sizes of the components of live chunks over unrevoked chunk-to-chunk edges."""
    live = chunks.where("valid_to IS NULL").select(F.col("seq").alias("id"))
    links = edges.where("tier = 'semantic' AND valid_to IS NULL").select(
        F.expr("CAST(substring(src, 7) AS BIGINT)").alias("a"), F.expr("CAST(substring(dst, 7) AS BIGINT)").alias("b")
    )
    links = links.join(live.withColumnRenamed("id", "a"), "a", "left_semi").join(
        live.withColumnRenamed("id", "b"), "b", "left_semi"
    )
    return components(live, links).groupBy("component").agg(F.count("*").alias("size"))




# ----------------------------------------------------------------- breadth-first ablation


def bfs_candidates(anchors: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int, top_n: int,
                   span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """Live chunks within ``hops`` of the anchors: (seq, cand, hop, rank).

    Levels are visited in order and a reader stops after the level that brings it to
    ``top_n``; inside a level older nodes come first.  A frontier anchor may touch a large
    share of all chunks, so its answers come from the list of its oldest live chunks;
    2 * top_n of them suffice because an unfinished reader has seen fewer than top_n.
    Only unfinished readers expand their frontier in full.
    """
    pair = F.array(F.struct(F.col("src").alias("n"), F.col("dst").alias("o")),
                   F.struct(F.col("dst").alias("n"), F.col("src").alias("o")))
    links = cut(
        edges.select(F.explode(pair).alias("p"), "valid_from", "valid_to").groupBy("p.n", "p.o", "valid_to")
        .agg(F.min("valid_from").alias("valid_from"))
    )
    is_chunk = lambda c: F.col(c).startswith("chunk:")
    ends = nodes.where("type = 'chunk'").select(
        F.col("node_id").alias("o"), F.col("key").cast("long").alias("id"), F.col("valid_to").alias("c_to"), "ord")
    of_anchor = links.where(~is_chunk("n")).drop("valid_to").join(ends, "o")
    leaders = cut(first_k_live(
        of_anchor.select(F.col("n").alias("key"), "id", "valid_from", F.col("c_to").alias("valid_to")), 2 * top_n, span))
    frontier = cut(anchors.select("seq", "at", "node_id").distinct())
    seen, found, order = frontier, None, nodes.where("type = 'chunk'").select(F.col("key").cast("long").alias("cand"), "ord")
    for hop in range(1, hops + 1):
        listed = stab(
            frontier.where(~is_chunk("node_id")).select("seq", "at", F.col("node_id").alias("key")),
            leaders.select("key", "id", "lead_from", "dies"), "key", "at", "lead_from", "dies",
        ).select("seq", F.col("id").alias("cand"))
        near = (
            frontier.where(is_chunk("node_id")).join(links, F.col("node_id") == F.col("n"))
            .where(live_at(F.col("at"), F.col("valid_from"), F.col("valid_to")))
            .join(ends, "o").where("c_to IS NULL OR c_to > at").select("seq", F.col("id").alias("cand"))
        )
        new = listed.unionByName(near).distinct().withColumn("hop", F.lit(hop).cast("long"))
        if found is not None:
            new = new.join(found.select("seq", "cand"), ["seq", "cand"], "left_anti")
        known = seen.where(is_chunk("node_id")).select("seq", F.expr("CAST(substring(node_id, 7) AS BIGINT)").alias("cand"))
        new = new.join(known, ["seq", "cand"], "left_anti")
        found = cut(new if found is None else found.unionByName(new))
        if hop == hops:
            break
        full = found.groupBy("seq").agg(F.count("*").alias("n")).where(F.col("n") >= top_n).select("seq")
        nxt = (
            frontier.join(full, "seq", "left_anti").join(links, F.col("node_id") == F.col("n"))
            .where(live_at(F.col("at"), F.col("valid_from"), F.col("valid_to")))
            .select("seq", "at", F.col("o").alias("node_id")).distinct()
            .join(seen.select("seq", "node_id"), ["seq", "node_id"], "left_anti").select("seq", "at", "node_id")
        )
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        seen = cut(seen.unionByName(frontier))
    ranked = W.partitionBy("seq").orderBy("hop", "ord")
    return (
        found.join(order, "cand").withColumn("rank", F.row_number().over(ranked).cast("long"))
        .where(F.col("rank") <= top_n).select("seq", "cand", "hop", "rank")
    )
