"""Continuous detection: micro-batches of change events against everything before them.

Detection is an as-of join, so a micro-batch asks exactly the questions that processing
its events one at a time would ask: readers come from the batch, the stamped tables hold
the history and the batch itself.  Extraction, embedding and resolution run once per
event; their results, the nearest neighbours and the new entities are kept as tables
partitioned by batch.  A batch that is retried overwrites its own partitions.

Under a destructive policy the removals of earlier batches are a table that the next batch reads;
inside a batch they are settled as in a whole run, which leaves the same calls and removals.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from vigilkb.config import DISCOVERY
from vigilkb.operators.knn import vector_candidates
from vigilkb.plans.kb import graph_of, graph_only, hybrid, metadata_only
from vigilkb.plans.runs import Prepared, Setup, assemble, detect, enrich, removals_of
from vigilkb.session import cut


class Monitor:
    """One strategy over one knowledge base kept under ``home`` (a shared folder)."""

    def __init__(self, home: str, baseline: str = "hybrid", setup: Setup = Setup()) -> None:
        if setup.policy == "human":
            raise ValueError("the stream does not wait for people")
        self.home, self.baseline, self.setup = home, baseline, setup

    def _put(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.home}/{table}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def _upto(self, spark: SparkSession, table: str, batch: int, schema) -> DataFrame:
        """Partitions before this batch; none at the start."""
        if batch == 0:
            return spark.createDataFrame([], schema)
        full = T.StructType([f for f in schema.fields if f.name != "batch"] + [T.StructField("batch", T.LongType())])
        every = spark.read.schema(full).parquet(f"{self.home}/{table}")
        return every.where(F.col("batch") < batch).drop("batch")

    def process(self, arrived: DataFrame, batch: int) -> None:
        spark = arrived.sparkSession
        new = self._put(arrived, "events", batch)
        past = self._upto(spark, "events", batch, new.schema)
        edge = new.agg(F.min("seq")).first()[0]
        if edge is None:
            return
        if batch and (past.agg(F.max("seq")).first()[0] or 0) >= edge:
            raise ValueError("events must arrive in the order of their seq")
        known = None
        if batch:
            first = spark.read.parquet(f"{self.home}/entities").schema
            known = cut(self._upto(spark, "entities", batch, first))
        rows, _, entities = enrich(new, self.setup, known)
        fresh = entities if known is None else entities.join(known.select("canonical_id"), "canonical_id", "left_anti")
        self._put(fresh.select(*entities.columns), "entities", batch)
        rows = self._put(rows, "rows", batch)
        every_row = self._upto(spark, "rows", batch, rows.schema).unionByName(rows)
        every_event = past.unionByName(new)
        kb = assemble(every_event, every_row)
        if self.setup.policy != "insert_only":
            # what earlier batches removed is final; only this batch's verdicts are still open
            first = T.StructType([T.StructField(c, T.LongType()) for c in ("seq", "tick", "by")])
            earlier = cut(self._upto(spark, "removals", batch, first))
            calls, _ = detect(Prepared(every_event, kb, entities, entities), self.baseline, self.setup, since=edge, earlier=earlier)
            calls = self._put(calls, "calls", batch)
            self._put(removals_of(calls, self.setup.policy), "removals", batch)
            return
        asked = replace(kb, readers=cut(kb.readers.where(F.col("seq") >= edge)))
        found = vector_candidates(asked.readers, kb.chunks, max(DISCOVERY.vector_k, DISCOVERY.freeze_k))
        found = self._put(found, "found", batch)
        if self.baseline == "vector-only":
            cands = found.where(F.col("rank") <= DISCOVERY.vector_k)
        elif self.baseline == "metadata-only":
            cands = metadata_only(asked)
        else:
            history = self._upto(spark, "found", batch, found.schema).unionByName(found)
            g = graph_of(kb, found=cut(history))
            cands = graph_only(asked, g) if self.baseline == "graph-only" else hybrid(asked, g)
        cands = self._put(cands, "candidates", batch)
        gold = new.where("op <> 'delete'").select("seq", "doc_id", "expected_label", "implicates")
        self._put(self.setup.judge(cands, kb.chunks, gold), "calls", batch)

    def start(self, events: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
        """Follow a stream of labelled events (see ``sources.gold_events.stream_gold``)."""
        writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.process)
        return (writer.trigger(availableNow=True) if once else writer).start()

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.parquet(f"{self.home}/{table}")
