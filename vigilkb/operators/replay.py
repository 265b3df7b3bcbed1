"""Commit / retire / resolution log <-> stamped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_COMMIT = (
    "STRUCT<doc_id STRING, source_id STRING, seq BIGINT, similar_to ARRAY<STRUCT<cand BIGINT, score DOUBLE>>, "
    "entities ARRAY<STRING>, dates ARRAY<STRING>, topics ARRAY<STRING>, derived_from ARRAY<STRING>>"
)


def log_of(chunks: DataFrame, similar: DataFrame, resolutions: DataFrame | None = None) -> DataFrame:
    """The log a run leaves: (tick, stage, type, payload JSON).  At one tick a document's
    retirement precedes the commit."""
    near = similar.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("cand", "score"))).alias("similar_to"))
    commits = chunks.join(near, "seq", "left").select(
        F.col("valid_from").alias("tick"), F.lit(1).alias("stage"), F.lit("commit").alias("type"),
        F.to_json(F.struct("doc_id", "source_id", "seq", "similar_to", "entities", "dates", "topics", "derived_from")).alias("payload"),
    )
    retires = (
        chunks.where("valid_to IS NOT NULL").select(
            F.col("valid_to").alias("tick"), F.lit(0).alias("stage"), F.lit("retire").alias("type"),
            # one record per chunk: a document's history is never gathered into one payload
            F.to_json(F.struct(F.array("seq").alias("chunk_ids"))).alias("payload"),
        )
    )
    out = commits.unionByName(retires)
    if resolutions is not None:
        out = out.unionByName(resolutions.select("tick", F.lit(2).alias("stage"), F.lit("resolution").alias("type"), "payload"))
    return out


def rebuild(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, similar, asserted) from a log of (tick, type, payload JSON).

    The graph follows from these by the same set-based construction as a live run.
    """
    commits = log.where("type = 'commit'").select("tick", F.from_json("payload", _COMMIT).alias("c"))
    retired = (
        log.where("type = 'retire'")
        .select("tick", F.explode(F.from_json("payload", "STRUCT<chunk_ids ARRAY<BIGINT>>")["chunk_ids"]).alias("seq"))
        # retiring twice changes nothing
        .groupBy("seq").agg(F.min("tick").alias("valid_to"))
    )
    chunks = commits.select("c.*", F.col("tick").alias("valid_from")).join(retired, "seq", "left")
    ends = retired.select(F.col("seq").alias("cand"), F.col("valid_to").alias("c_to"))
    similar = (
        chunks.select("seq", "valid_from", "valid_to", F.explode("similar_to").alias("s"))
        .select("seq", "s.cand", "s.score", "valid_from", "valid_to").join(ends, "cand", "left")
        .select("seq", "cand", "score", "valid_from", F.least("valid_to", "c_to").alias("valid_to"))
    )
    made = log.where("type = 'resolution'").select(
        "tick", F.from_json("payload", "STRUCT<report_id STRING, action STRING, new_chunk_id BIGINT, remove ARRAY<BIGINT>>").alias("r")
    ).where("r.action = 'update'")
    ids = chunks.select(F.col("seq").alias("new_chunk_id"), F.col("valid_to").alias("n_to"))
    asserted = (
        made.select("tick", "r.new_chunk_id", F.explode("r.remove").alias("old")).join(ids, "new_chunk_id")
        .join(chunks.select(F.col("seq").alias("old")), "old", "left_semi")
        .select(
            F.concat(F.lit("chunk:"), F.col("new_chunk_id").cast("string")).alias("src"),
            F.concat(F.lit("chunk:"), F.col("old").cast("string")).alias("dst"),
            F.lit("supersedes_content").alias("relation"), F.lit(1.0).alias("confidence"),
            F.col("tick").alias("valid_from"), F.col("n_to").alias("valid_to"),
        )
    )
    return chunks.drop("similar_to"), similar, asserted
