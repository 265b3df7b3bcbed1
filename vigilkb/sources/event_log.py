"""Append-only event log: an envelope (seq, type, payload) per line of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from vigilkb.operators.ordering import number_rows
from vigilkb.session import cut


def encode(log: DataFrame) -> DataFrame:
    """One JSON text per record; ``payload`` is a JSON text or a struct."""
    payload = log.schema["payload"].dataType
    body = F.col("payload") if isinstance(payload, T.StringType) else F.to_json("payload")
    return log.select(F.concat(
        F.lit('{"seq": '), F.col("seq").cast("string"), F.lit(', "type": '), F.to_json(F.array("type")).substr(F.lit(2), F.length("type") + 2),
        F.lit(', "payload": '), F.coalesce(body, F.lit("{}")), F.lit("}"),
    ).alias("value"))


def decode(lines: DataFrame) -> DataFrame:
    """Envelope rows with the payload as VARIANT; blank lines are skipped."""
    v = F.parse_json("value")
    return lines.where(F.trim("value") != "").select(
        F.variant_get(v, "$.seq", "bigint").alias("seq"), F.variant_get(v, "$.type", "string").alias("type"),
        F.variant_get(v, "$.payload", "variant").alias("payload"),
    )


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return decode(spark.read.text(path))


def current_seq(log: DataFrame) -> int:
    """Last number used, 0 for an empty log."""
    return log.agg(F.max("seq")).first()[0] or 0


def append(spark: SparkSession, path: str, entries: DataFrame, order: list[str]) -> int:
    """Number ``entries`` (type, payload and the order columns) after the last record and
    append them; returns the new last number.

    One writer per log: the numbering reads the log's end before it writes.
    """
    try:
        last = current_seq(read_log(spark, path))
    except Exception as e:  # a log that does not exist yet is empty
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    numbered = number_rows(entries, order, "__seq", start=last + 1).withColumn("seq", F.col("__seq"))
    numbered = cut(numbered.select("seq", "type", "payload"))
    encode(numbered).write.mode("append").text(path)
    return max(last, current_seq(numbered))
