"""Change events to validity-stamped chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.config import PHYSICAL
from vigilkb.operators.ordering import as_of_total, presence_deltas, running


def source_or_doc(source_id: Column, doc_id: Column) -> Column:
    """A missing or empty source falls back to the document's own id."""
    return F.coalesce(F.nullif(source_id, F.lit("")), doc_id)


def retire_ticks(log: DataFrame, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """Adds ``valid_to``: the next update/delete of the same document, if any.

    Read backwards in time that is a running minimum, so a document that owns a large
    share of the log is still folded bucket by bucket.
    """
    marked = log.withColumn("__back", -F.col("seq")).withColumn(
        "__cut", F.when(F.col("op").isin("update", "delete"), F.col("seq"))
    )
    return running(
        marked, ["doc_id"], "__back", {"valid_to": ("min", "__cut")}, exclusive=True, span=span
    ).drop("__back", "__cut")


def chunks_of(arrivals: DataFrame, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """One chunk per insert/update, live on (valid_from, valid_to)."""
    # only the narrow keys go through the fold; texts and vectors stay where they are
    ends = retire_ticks(arrivals.select("seq", "op", "doc_id"), span).where("op <> 'delete'")
    stamped = arrivals.where("op <> 'delete'").join(ends.select("seq", "valid_to"), "seq")
    return stamped.withColumns(
        {
            "valid_from": F.col("seq"),
            "chunk_id": F.concat_ws("#", "doc_id", F.col("seq").cast("string")),
        }
    )


def state_at(stamped: DataFrame, seq: int | Column, born="valid_from", dies="valid_to") -> DataFrame:
    """Time travel, the state after event ``seq``: born at or before it and not yet
    retired by it."""
    at = F.lit(seq) if isinstance(seq, int) else seq
    return stamped.where((F.col(born) <= at) & (F.col(dies).isNull() | (F.col(dies) > at)))


def active_docs(
    chunks: DataFrame, readers: DataFrame, at: str = "seq", span: int | None = PHYSICAL.fold_span
) -> DataFrame:
    """Number of documents that hold a live chunk once each reader is processed."""
    steps = presence_deltas(chunks.select("doc_id", "valid_from", "valid_to"), ["doc_id"], span)
    return as_of_total(steps.select("pos", "delta"), readers, [], at, "active_docs", after=True, span=span)
