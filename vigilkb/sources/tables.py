"""The shared test tables as a stream of change events.

An arrival is one row of ``events`` paired with the text of ``documents`` and the vector of
``embeddings``; ``pages`` supplies titles.  Every event takes part: its place is counted
around the (dense) ids of the shorter tables.  The event's user is the document being
written, purchase/error events are updates/deletes, and the label, language and day act
as entity, topic and date anchors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op_of(event_type) -> F.Column:
    return (
        F.when(event_type == "purchase", "update")
        .when(event_type == "error", "delete")
        .otherwise("insert")
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as (seq, op, doc_id).  event_id is dense and time-ordered."""
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        op_of(F.col("event_type")).alias("op"),
        F.concat(F.lit("u"), F.col("user_id")).alias("doc_id"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def arrivals(spark: SparkSession, sf_dir: str, titles: bool = True) -> DataFrame:
    """One row per event, with the ``vec_id`` that its vector has in ``vectors``."""
    around = lambda name: F.col("event_id") % F.lit(table(spark, sf_dir, name).count())
    events = table(spark, sf_dir, "events").select(
        around("embeddings").alias("vec_id"),
        around("documents").alias("text_id"),
        around("pages").alias("page_id"),
        (F.col("event_id") + 1).alias("seq"),
        op_of(F.col("event_type")).alias("op"),
        F.concat(F.lit("u"), F.col("user_id")).alias("doc_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.col("event_type") == "signup").alias("is_artifact"),
        F.when(
            F.col("event_type") == "signup",
            F.array(F.concat(F.lit("u"), F.get_json_object("props", "$.k"))),
        )
        .otherwise(F.array().cast("array<string>"))
        .alias("derived_from"),
    )
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("text_id"), "text", F.col("source").alias("source_id"), F.col("lang").alias("topic")
    )
    labels = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("label-"), F.col("label")).alias("entity"))
    paired = events.join(labels, "vec_id").join(docs, "text_id")
    if not titles:
        return paired.drop("page_id")
    pages = table(spark, sf_dir, "pages").select(
        "page_id",
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
    )
    return paired.join(pages, "page_id", "left").withColumn("title", F.coalesce("title", F.lit(""))).drop("page_id")
