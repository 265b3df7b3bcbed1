"""Ordering constraints of a change log and random orders that respect them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.config import PHYSICAL
from vigilkb.operators.ordering import number_rows, running
from vigilkb.session import cut


def previous_event(events: DataFrame, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """Adds ``prev``: the document's previous event, if any."""
    return running(events, ["doc_id"], "seq", {"prev": ("max", "seq")}, exclusive=True, span=span)


def order_constraints(events: DataFrame, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """(pred, succ) rows, repeats kept: an update follows its document's previous event,
    and a conflict follows the first event of every document it implicates."""
    updates = previous_event(events.select("seq", "op", "doc_id"), span).where("op = 'update' AND prev IS NOT NULL")
    first = events.groupBy("doc_id").agg(F.min("seq").alias("pred"))
    implied = (
        events.select("seq", F.explode("implicates").alias("doc_id")).join(first, "doc_id")
        .where("pred <> seq").select("pred", F.col("seq").alias("succ"))
    )
    return updates.select(F.col("prev").alias("pred"), F.col("seq").alias("succ")).unionByName(implied)


def in_degree(events: DataFrame, constraints: DataFrame) -> DataFrame:
    counted = constraints.groupBy(F.col("succ").alias("seq")).agg(F.count("*").alias("n"))
    return events.select("seq").join(counted, "seq", "left").select("seq", F.coalesce("n", F.lit(0)).alias("in_degree"))


def _priority(seed: int) -> Column:
    """48 random bits per (seed, event), spread so that +1 steps never cross a gap often."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seq").cast("string"))), 1, 12), 16, 10).cast("long")


def random_order(
    events: DataFrame, seed: int, max_rounds: int | None = None, span: int | None = PHYSICAL.fold_span
) -> DataFrame:
    """A random order that respects all constraints: adds ``position`` (from 1).

    Every event draws a random priority; an event that must wait is lifted just above
    the latest of its predecessors, until nothing moves.  Any valid order can come out.
    Runs of updates of one document are lifted by a running maximum in one go, so rounds
    follow the nesting of implications, not the length of a document's history.
    """
    base = previous_event(events.select("seq", "op", "doc_id"), span).withColumn(
        "opens", F.when((F.col("op") == "update") & F.col("prev").isNotNull(), 0).otherwise(1).cast("long")
    ).withColumn("one", F.lit(1).cast("long"))
    chained = running(base, ["doc_id"], "seq", {"chain": ("sum", "opens"), "idx": ("sum", "one")}, span=span)
    keyed = cut(chained.select("seq", "doc_id", "chain", "idx", _priority(seed).alias("key")))
    first = events.groupBy("doc_id").agg(F.min("seq").alias("pred"))
    implied = cut(
        events.select("seq", F.explode("implicates").alias("d")).join(first, F.col("d") == first.doc_id)
        .where("pred <> seq").select("pred", F.col("seq").alias("succ")).distinct()
    )
    # no chain of constraints is longer than the log, so going on for longer means a circle
    for _ in range(max_rounds or keyed.count() + 1):
        lifted = (
            implied.join(keyed.select(F.col("seq").alias("pred"), F.col("key").alias("pk")), "pred")
            .groupBy(F.col("succ").alias("seq")).agg((F.max("pk") + 1).alias("least"))
        )
        raised = keyed.join(lifted, "seq", "left").withColumn("want", F.greatest("key", "least"))
        flat = raised.withColumn("flat", F.col("want") - F.col("idx"))
        ran = running(flat, ["doc_id", "chain"], "seq", {"top": ("max", "flat")}, span=span)
        nxt = cut(ran.select("seq", "doc_id", "chain", "idx", (F.col("top") + F.col("idx")).alias("new"), "key"))
        moved = not nxt.where("new <> key").isEmpty()
        keyed = nxt.select("seq", "doc_id", "chain", "idx", F.col("new").alias("key"))
        if not moved:
            break
    else:
        raise RuntimeError("the constraints contain a cycle")
    placed = cut(number_rows(keyed.select("seq", "key"), ["key", "seq"], "position"))
    return events.drop("position").join(placed.select("seq", "position"), "seq")


def shuffles(
    events: DataFrame, n: int, base_seed: int, span: int | None = PHYSICAL.fold_span
) -> list[tuple[int, DataFrame]]:
    """``n`` variants with seeds base_seed, base_seed + 1, ... and seq renumbered from 1."""
    return [
        (base_seed + k, random_order(events, base_seed + k, span=span).drop("seq").withColumnRenamed("position", "seq"))
        for k in range(n)
    ]


def label_histogram(events: DataFrame) -> DataFrame:
    return events.groupBy("expected_label").agg(F.count("*").alias("n"))


def conflict_positions(events: DataFrame) -> DataFrame:
    """First, last and upper-median position (from 0) of the conflict events."""
    ranked = cut(number_rows(events.where("expected_label <> 'clean'").select("seq"), ["seq"], "n", start=0))
    middle = ranked.count() // 2
    return ranked.agg(
        (F.min("seq") - 1).alias("first"), (F.max("seq") - 1).alias("last"),
        (F.max(F.when(F.col("n") == middle, F.col("seq"))) - 1).alias("median"),
    )
