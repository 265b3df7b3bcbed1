"""Labelled change events as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilkb.operators.judging import label_of

SCHEMA = (
    "seq BIGINT, type STRING, "
    "payload STRUCT<doc_id STRING, version BIGINT, title STRING, source_id STRING, text STRING, "
    "is_artifact BOOLEAN, derived_from ARRAY<STRING>>, "
    "_debug STRUCT<intent STRING, expected_label STRING, implicates ARRAY<STRING>, establishes STRING, "
    "proposed_action STRING, note STRING>"
)
OPS = ["insert", "update", "delete"]


def shaped(raw: DataFrame) -> DataFrame:
    """Flat rows with the defaults filled in; an unknown type or label is an error."""
    none = F.array().cast("array<string>")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    op = F.when(F.col("type").isin(OPS), F.col("type")).otherwise(
        F.raise_error(F.concat(F.lit("unknown event type "), "type")).cast("string")
    )
    return raw.where("seq IS NOT NULL").select(
        "seq", op.alias("op"), F.col("payload.doc_id").alias("doc_id"), text("payload.text").alias("text"),
        F.col("payload.source_id").alias("source_id"), text("payload.title").alias("title"),
        F.coalesce("payload.is_artifact", F.lit(False)).alias("is_artifact"),
        F.coalesce("payload.derived_from", none).alias("derived_from"),
        label_of(F.coalesce("_debug.expected_label", F.lit("clean"))).alias("expected_label"),
        F.coalesce("_debug.implicates", none).alias("implicates"),
        text("_debug.intent").alias("intent"), text("_debug.note").alias("note"),
    )


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return shaped(spark.read.schema(SCHEMA).json(path))


def stream_gold(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return shaped(
        spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)
    )


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Whole records as VARIANT, so unknown keys survive a rewrite."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.parse_json("value").alias("record"))


def write_gold(events: DataFrame, path: str) -> None:
    """Write flat events in the labelled layout; see :func:`rewrite` for orders of existing records."""
    events.select(
        "seq", F.col("op").alias("type"),
        F.struct("doc_id", "title", "source_id", "text", "is_artifact", "derived_from").alias("payload"),
        F.struct("intent", "expected_label", "implicates", "note").alias("_debug"),
    ).write.mode("overwrite").json(path)


def rewrite(raw: DataFrame, order: DataFrame, path: str) -> None:
    """Write the records of :func:`read_raw` in a new order (seq, position): whole, with unknown
    keys, numbered by position and sorted by it across the files."""
    key = F.variant_get("record", "$.seq", "bigint")
    fields = F.map_filter(F.col("record").cast("map<string,variant>"), lambda k, _: k != "seq")
    number = F.create_map(F.lit("seq"), F.parse_json(F.col("position").cast("string")))
    placed = raw.withColumn("seq", key).join(order.select("seq", "position"), "seq")
    (
        placed.select("position", F.to_json(F.map_concat(number, fields)).alias("value"))
        .repartitionByRange("position").sortWithinPartitions("position").select("value")
        .write.mode("overwrite").text(path)
    )


def as_ingest(events: DataFrame) -> DataFrame:
    """The engine-facing event: labels stripped, attributes under ``metadata``."""
    return events.select(
        "seq", F.col("op").alias("event_type"), "doc_id", "text",
        F.struct("source_id", "title", "is_artifact", "derived_from").alias("metadata"),
    )
