"""Graph snapshots and run logs on shared storage."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilkb.config import DISCOVERY
from vigilkb.operators.evaluation import nested_aggregate, nested_summary


def save_graph(nodes: DataFrame, edges: DataFrame, path: str, seq: int) -> None:
    """Nodes and edges at version ``seq``; anchors are derivable and are not stored."""
    nodes.write.mode("overwrite").parquet(f"{path}/version={seq}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/version={seq}/edges")


def load_graph(spark: SparkSession, path: str, seq: int) -> tuple[DataFrame, DataFrame]:
    base = f"{path}/version={seq}"
    return spark.read.parquet(f"{base}/nodes"), spark.read.parquet(f"{base}/edges")


def snapshot_due(before: int, after: int, every: int = DISCOVERY.checkpoint_every) -> bool:
    """Whether a multiple of ``every`` lies in (before, after]."""
    return after // every > before // every


def write_run(records: DataFrame, run_id: str, meta: dict, path: str) -> None:
    """Raw records as JSON lines plus one summary document: per run and baseline the metrics, their
    breakdown by label and by position, and their spread over the runs."""
    records.write.mode("overwrite").json(f"{path}/run_{run_id}")
    # one row per run, and one per baseline
    runs = nested_summary(records, ["shuffle_idx", "seed"]).orderBy("shuffle_idx").collect()
    spread = nested_aggregate(records, ["shuffle_idx", "seed"]).orderBy("baseline").collect()
    body = {
        "meta": meta,
        "per_shuffle": [r.asDict(recursive=True) for r in runs],
        "aggregate": {r["baseline"]: {**_plain(r["metrics"]), "by_label": _plain(r["by_label"] or {})} for r in spread},
    }
    text = json.dumps(body, ensure_ascii=False, indent=2)
    records.sparkSession.createDataFrame([(text,)], "value string").write.mode("overwrite").text(
        f"{path}/run_{run_id}_summary"
    )


def _plain(rows: dict) -> dict:
    return {name: row.asDict() for name, row in rows.items()}
