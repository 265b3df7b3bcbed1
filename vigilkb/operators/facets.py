"""Metadata-only discovery: as-of IDF over facets and exact top-n by summed IDF.

The candidates of an arrival are the live chunks that share a facet with it, ranked by
the summed IDF of the shared facets (ties: the older chunk).  Joining postings to
postings would emit every pair below a frequent facet, so the work is split by what a
pair shares, and every part is exact:

* Chunks with identical facet sets form one *profile*.  They score alike, so only the n
  oldest live members of a profile can ever be answers (``first_k_live``).
* Pairs of profiles that share a *rare* facet come from a posting join.  Its postings
  are short by definition.
* Pairs that share only *hot* facets share some subset X of them.  The n oldest live
  chunks that contain X score at least idf(X), so a chunk that is not among them is
  beaten n times over by the time its true shared set is looked up.  Each profile
  therefore publishes the subsets of its hot facets and each arrival looks its own
  subsets up; no pair is formed.
* A profile with more hot facets than ``head_facets`` publishes subsets of the most
  frequent ones (its head).  Pairs that share one of its other hot facets (its tail)
  come from a posting join on the tail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilkb.config import DISCOVERY, PHYSICAL
from vigilkb.functions.text import title_tokens
from vigilkb.operators.ordering import (
    as_of_total,
    first_k_live,
    lifetime_deltas,
    presence_deltas,
    stab,
)
from vigilkb.session import cut


def facets_of(df: DataFrame, id_cols: list[str]) -> DataFrame:
    """Distinct (kind, value) rows from entities, dates, topics, source_id and title."""

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(
            F.filter(values, lambda v: v.isNotNull() & (v != "")),
            lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")),
        )

    every = F.concat(
        tagged("entity", F.array_distinct("entities")),
        tagged("date", F.array_distinct("dates")),
        tagged("topic", F.array_distinct("topics")),
        tagged("source", F.array(F.col("source_id"))),
        tagged("title", title_tokens(F.coalesce("title", F.lit("")))),
    )
    return df.select(*id_cols, F.explode(every).alias("f")).select(*id_cols, "f.kind", "f.value")


def facet_weights(
    asked: DataFrame, stored: DataFrame, span: int | None = PHYSICAL.fold_span
) -> DataFrame:
    """Document frequency, population and smoothed IDF of each asked facet, as of its
    reader.

    ``asked``: seq, at, kind, value; ``stored``: id, doc_id, valid_from, valid_to, kind,
    value.  Sources are counted in live documents, everything else in live chunks.
    """
    keys = ["kind", "value"]
    by_chunk = lifetime_deltas(stored.where("kind <> 'source'"), keys)
    by_doc = presence_deltas(stored.where("kind = 'source'"), ["kind", "value", "doc_id"], span).drop("doc_id")
    # read three times below
    chunks = cut(stored.select("id", "doc_id", "valid_from", "valid_to").distinct())
    all_chunks = lifetime_deltas(chunks, []).select(
        F.lit("#chunks").alias("kind"), F.lit("").alias("value"), "pos", "delta"
    )
    all_docs = presence_deltas(chunks, ["doc_id"], span).select(
        F.lit("#docs").alias("kind"), F.lit("").alias("value"), "pos", "delta"
    )
    # a tick is one event, so equal steps are rare and adding them up first would only move all rows once more
    deltas = by_chunk.unionByName(by_doc).unionByName(all_chunks).unionByName(all_docs)
    populations = asked.select("seq", "at").distinct().select(
        "seq",
        "at",
        F.explode(F.array(F.lit("#chunks"), F.lit("#docs"))).alias("kind"),
        F.lit("").alias("value"),
    )
    counted = cut(
        as_of_total(deltas, asked.select(*populations.columns).unionByName(populations), keys, "at", "df", span=span)
    )
    size = (
        counted.where("kind IN ('#chunks', '#docs')")
        .groupBy("seq")
        .agg(
            F.max(F.when(F.col("kind") == "#chunks", F.col("df"))).alias("n_chunks"),
            F.max(F.when(F.col("kind") == "#docs", F.col("df"))).alias("n_docs"),
        )
    )
    n = F.greatest(F.when(F.col("kind") == "source", F.col("n_docs")).otherwise(F.col("n_chunks")), F.lit(1))
    return (
        counted.where("kind NOT IN ('#chunks', '#docs')")
        .join(size, "seq")
        .select("seq", "at", "kind", "value", "df", n.alias("n"))
        .withColumn("idf", F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)
    )


def _subsets(items: Column) -> Column:
    """All non-empty subsets of a short sorted array."""
    top = F.pow(F.lit(2), F.size(items)).cast("int") - 1
    return F.when(
        F.size(items) > 0,
        F.transform(
            F.sequence(F.lit(1), top),
            lambda m: F.filter(items, lambda x, i: F.getbit(m, i) == 1),
        ),
    ).otherwise(F.array().cast("array<array<string>>"))


def _total(weights: Column, shared: Column) -> Column:
    return F.aggregate(shared, F.lit(0.0), lambda s, f: s + F.coalesce(weights[f], F.lit(0.0)))


def _split(profiles: DataFrame, sizes: DataFrame, heads: int) -> DataFrame:
    """Per profile: its rare facets, its hot head and its hot tail (sorted arrays)."""
    hot = F.col("n_profiles") > F.col("limit")
    ranked = (
        profiles.select("profile", F.explode("fs").alias("f"))
        .join(sizes, "f")
        .groupBy("profile")
        .agg(
            F.sort_array(F.collect_list(F.when(~hot, F.col("f")))).alias("rare"),
            F.sort_array(
                F.collect_list(F.when(hot, F.struct(F.col("n_profiles").alias("n"), "f"))), asc=False
            ).alias("hot"),
        )
    )
    return profiles.join(ranked, "profile").select(
        "profile",
        "fs",
        "rare",
        F.sort_array(F.slice("hot.f", 1, heads)).alias("head"),
        F.sort_array(F.filter("hot.f", lambda x, i: i >= heads)).alias("tail"),
    )


def _posted(left: DataFrame, lcol: Column, right: DataFrame, rcol: Column) -> DataFrame:
    """Profile pairs below a common facet, kept at the first facet they have in common."""
    a = left.select(F.col("profile").alias("p"), F.col("fs").alias("p_fs"), lcol.alias("l"), F.explode(lcol).alias("f"))
    b = right.select(F.col("profile").alias("q"), F.col("fs").alias("q_fs"), rcol.alias("r"), F.explode(rcol).alias("f"))
    return (
        a.join(b, "f")
        .where(F.col("f") == F.array_min(F.array_intersect("l", "r")))
        .select("p", "q", F.array_intersect("p_fs", "q_fs").alias("shared"))
    )


def metadata_candidates(
    weights: DataFrame,
    stored: DataFrame,
    top_n: int = DISCOVERY.metadata_top_n,
    *,
    rare_posting: int | None = None,
    head_facets: int | None = None,
    span: int | None = PHYSICAL.fold_span,
    stab_small: int | None = None,
) -> DataFrame:
    """Exact top-n candidates: (seq, cand, score, rank).

    ``weights`` is the result of :func:`facet_weights`; ``stored`` its second input.
    """
    limit = PHYSICAL.rare_posting if rare_posting is None else rare_posting
    heads = PHYSICAL.head_facets if head_facets is None else head_facets
    name = F.concat_ws(":", "kind", "value")
    profile = F.sha2(F.concat_ws("\u0001", "fs"), 256)
    readers = cut(
        weights.groupBy("seq", "at")
        .agg(F.sort_array(F.collect_list(F.struct(name.alias("f"), F.col("idf").alias("w")))).alias("fw"))
        .select("seq", "at", F.col("fw.f").alias("fs"), F.map_from_entries("fw").alias("w"))
        .withColumn("profile", profile)
    )
    members = (
        stored.groupBy("id", "valid_from", "valid_to")
        .agg(F.sort_array(F.collect_set(name)).alias("fs"))
        .withColumn("profile", profile)
    )
    members = cut(members)
    kept = members.groupBy("profile").agg(F.first("fs").alias("fs"))
    # posting lengths in profiles, not chunks: a group of copies counts once
    sizes = (
        kept.select(F.explode("fs").alias("f")).groupBy("f").agg(F.count("*").alias("n_profiles"))
        .withColumn("limit", F.lit(limit))
    )
    theirs = cut(_split(kept, sizes, heads))
    ours = cut(_split(readers.groupBy("profile").agg(F.first("fs").alias("fs")), sizes, heads))
    leaders = cut(
        first_k_live(members.select(F.col("profile").alias("key"), "id", "valid_from", "valid_to"), top_n, span)
    )

    pairs = (
        _posted(ours, F.col("rare"), theirs, F.col("rare"))
        .unionByName(_posted(ours, F.col("tail"), theirs, F.concat("head", "tail")))
        .unionByName(_posted(ours, F.col("head"), theirs, F.col("tail")))
    )
    by_profile = (
        readers.select("seq", "at", "w", F.col("profile").alias("p"))
        .join(pairs, "p")
        .select("seq", "at", F.col("q").alias("key"), _total(F.col("w"), F.col("shared")).alias("score"))
    )
    ends = ["key", "id", "lead_from", "dies"]
    from_pairs = stab(by_profile, leaders.select(*ends), "key", "at", "lead_from", "dies", stab_small)

    published = (
        leaders.select(F.col("key").alias("profile"), "id", "valid_from", F.col("dies").alias("valid_to"))
        .join(theirs.where(F.size("head") > 0).select("profile", "head"), "profile")
        .select(F.explode(_subsets(F.col("head"))).alias("x"), "id", "valid_from", "valid_to")
        .withColumn("key", F.concat_ws("\u0001", "x"))
    )
    holders = first_k_live(published.drop("x"), top_n, span)
    looked_up = (
        readers.join(ours.where(F.size("head") > 0).select("profile", "head"), "profile")
        .select("seq", "at", "w", F.explode(_subsets(F.col("head"))).alias("x"))
        .select("seq", "at", F.concat_ws("\u0001", "x").alias("key"), _total(F.col("w"), F.col("x")).alias("score"))
    )
    from_subsets = stab(looked_up, holders.select(*ends), "key", "at", "lead_from", "dies", stab_small)

    best = (
        from_pairs.select("seq", "id", "score")
        .unionByName(from_subsets.select("seq", "id", "score"))
        .groupBy("seq", F.col("id").alias("cand"))
        .agg(F.round(F.max("score"), 6).alias("score"))
    )
    order = W.partitionBy("seq").orderBy(F.desc("score"), "cand")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_n)
