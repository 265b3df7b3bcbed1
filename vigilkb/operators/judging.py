"""Judging candidates and turning reports into decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.config import DISCOVERY

#: A resolution policy: reports -> decisions (report_id, seq, action, remove).
Policy = Callable[[DataFrame], DataFrame]

# Verdict labels.
LABELS = ["clean", "duplicate", "contradiction", "supersedes", "needs_human"]


def label_of(name: Column) -> Column:
    """Known labels pass, anything else is an error."""
    return F.when(name.isin(LABELS), name).otherwise(
        F.raise_error(F.concat(F.lit("unknown label "), name)).cast("string")
    )


def neighbour_prompt(readers: DataFrame, candidates: DataFrame, chunks: DataFrame,
                     width: int = DISCOVERY.snippet_chars) -> DataFrame:
    """(seq, prompt): the new chunk and one clipped line per candidate, best first.

    Only arrivals with candidates appear: the others are clean without asking.
    """
    line = F.concat(F.lit("  [chunk_id="), F.col("cand").cast("string"), F.lit("] "), F.col("clip"))
    # texts are clipped before they are shuffled
    clips = chunks.select(F.col("seq").alias("cand"), F.substring("text", 1, width).alias("clip"))
    shown = (
        candidates.join(clips, "cand")
        .groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))).alias("l"))
    )
    return readers.select("seq", "text").join(shown, "seq").select(
        "seq",
        F.concat(
            F.lit("NEW CHUNK (chunk_id="), F.col("seq").cast("string"), F.lit("):\n"), "text",
            F.lit("\n\nNEIGHBORS:\n"), F.array_join("l.line", "\n"),
        ).alias("prompt"),
    )


def oracle_judge(candidates: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """One judge call per reader: the gold label iff an implicated document surfaced.

    ``gold``: seq, doc_id, expected_label, implicates.  Result: seq, doc_id, label,
    candidate_docs, implicated_docs, implicated_ids, proposed_action.
    """
    docs = chunks.select(F.col("seq").alias("cand"), F.col("doc_id").alias("cand_doc"))
    listed = (
        candidates.select("seq", "cand").join(docs, "cand").groupBy("seq")
        .agg(F.collect_list(F.struct("cand", "cand_doc")).alias("c"))
    )
    flagged = F.col("expected_label") != "clean"
    hit = F.when(
        flagged, F.filter("c", lambda x: F.array_contains("implicates", x["cand_doc"]))
    ).otherwise(F.slice("c", 1, 0))
    return (
        gold.join(listed, "seq", "left")
        .withColumn("c", F.coalesce("c", F.array().cast(listed.schema["c"].dataType)))
        .withColumn("hit", hit)
        .select(
            "seq",
            "doc_id",
            F.when(F.size("hit") > 0, F.col("expected_label")).otherwise("clean").alias("label"),
            F.array_sort(F.array_distinct("c.cand_doc")).alias("candidate_docs"),
            F.array_sort(F.array_distinct("hit.cand_doc")).alias("implicated_docs"),
            F.array_sort("hit.cand").alias("implicated_ids"),
            F.when(F.size("hit") > 0, "replace_old").otherwise("insert").alias("proposed_action"),
        )
    )


def reports_of(calls: DataFrame) -> DataFrame:
    """Flagged calls only; a report is named after its arrival."""
    return calls.where("label <> 'clean'").withColumn("report_id", F.concat(F.lit("report-"), F.col("seq").cast("string")))


def decide(reports: DataFrame, policy: str | Policy, decided: DataFrame | None = None) -> DataFrame:
    """Decisions (report_id, seq, action, remove).

    recency: the newest chunk replaces everything implicated, whatever the label.
    insert_only: commit, remove nothing.
    human: only what ``decided`` (report_id, action, remove) answers; see ``pending``.
    A function of the reports decides by itself; it commits every chunk (insert or update).
    """
    if callable(policy):
        commits = F.col("action").isin("insert", "update")
        refused = F.raise_error(F.concat(F.lit("a policy of a run commits every chunk, not "), "action"))
        # what is removed depends on the check, so that it is made wherever the decision is used
        return policy(reports).select("report_id", "seq", "action", F.when(commits, F.col("remove")).otherwise(refused.cast("array<bigint>")).alias("remove"))
    if policy == "recency":
        return reports.select("report_id", "seq", F.lit("update").alias("action"), F.col("implicated_ids").alias("remove"))
    if policy == "insert_only":
        return reports.select("report_id", "seq", F.lit("insert").alias("action"), F.array().cast("array<long>").alias("remove"))
    if policy == "human":
        if decided is None:
            raise ValueError("the human policy needs the decisions made so far")
        known = decided.join(reports.select("report_id", "seq"), "report_id", "left")
        checked = F.when(F.col("seq").isNotNull(), F.col("report_id")).otherwise(
            F.raise_error(F.concat(F.lit("no pending report "), "report_id")).cast("string")
        )
        return known.select(checked.alias("report_id"), "seq", "action", "remove")
    raise ValueError(f"unknown policy {policy}")


def pending(reports: DataFrame, decided: DataFrame) -> DataFrame:
    return reports.join(decided.select("report_id"), "report_id", "left_anti")
