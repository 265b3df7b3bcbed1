"""Command line: compare the discovery strategies on a labelled event log."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from vigilkb.operators.entities import alias_clusters
from vigilkb.operators.evaluation import aggregate, aggregate_labels, audit, audit_summary, summarise, summarise_labels, temporal_quartiles
from vigilkb.operators.reordering import conflict_positions, label_histogram, random_order
from vigilkb.plans.runs import BASELINES, Setup, compare_baselines, enrich
from vigilkb.session import clean_up, cut
from vigilkb.sources.gold_events import read_gold, read_raw, rewrite
from vigilkb.sources.snapshots import write_run


def main() -> None:
    ap = argparse.ArgumentParser(prog="vigilkb", description=__doc__)
    ap.add_argument("--input", required=True, help="labelled events, JSON lines")
    ap.add_argument("--shuffles", type=int, default=5, help="0 keeps the given order")
    ap.add_argument("--seed", type=int, default=42)
    ap.add_argument("--log-dir", help="where to write the records and the summary")
    ap.add_argument("--resolve", action="store_true", help="let the newest chunk replace what it implicates")
    ap.add_argument("--no-audit", action="store_true")
    ap.add_argument("--aliases", action="store_true", help="show the canonical entities and the surfaces they went by, in the given order of events")
    ap.add_argument("--baselines", nargs="*", default=BASELINES)
    ap.add_argument("--write-orders", help="only write the shuffled event logs to this folder, with their label statistics")
    ap.add_argument("--print-rows", type=int, default=1000,
                    help="most rows printed of one table; what is left out is counted, and --log-dir gets all of it")
    args = ap.parse_args()
    spark = SparkSession.builder.appName("vigilkb").getOrCreate()

    def show(df: DataFrame, *order: str) -> None:
        df = cut(df)
        df.orderBy(*order).show(args.print_rows, False)
        if (left := df.count() - args.print_rows) > 0:
            print(f"{left} more rows are not printed")

    events = cut(read_gold(spark, args.input))
    if args.write_orders:
        raw = cut(read_raw(spark, args.input))
        for seed in range(args.seed, args.seed + args.shuffles):
            order = cut(random_order(events, seed))
            rewrite(raw, order, f"{args.write_orders}/seed={seed}")
            renumbered = order.drop("seq").withColumnRenamed("position", "seq")
            show(label_histogram(renumbered), "expected_label")
            show(conflict_positions(renumbered), "first")
        clean_up(spark)
        return
    setup = Setup(policy="recency" if args.resolve else "insert_only")
    run_id = datetime.now().strftime("%Y%m%d_%H%M%S")
    records = cut(compare_baselines(events, setup, n_shuffles=args.shuffles, base_seed=args.seed,
                                    baselines=args.baselines, run_id=run_id))
    if not args.no_audit:
        show(audit(records), "seq", "baseline")
        audit_summary(records).show(truncate=False)
    show(summarise(records, ["shuffle_idx"]), "shuffle_idx", "baseline")
    show(summarise_labels(records), "baseline", "expected_label")
    show(temporal_quartiles(records), "baseline", "quartile")
    show(aggregate(summarise(records, ["shuffle_idx"])), "metric", "baseline")
    show(aggregate_labels(summarise_labels(records, ["shuffle_idx"])), "baseline", "expected_label")
    if args.aliases:
        _, resolution, entities = enrich(events, setup)
        show(alias_clusters(resolution, entities), "canonical_id")
    if args.log_dir:
        audit(records).write.mode("overwrite").json(f"{args.log_dir}/{run_id}_audit")
        meta = {"run_id": run_id, "input": args.input, "shuffles": args.shuffles, "base_seed": args.seed, "policy": setup.policy}
        write_run(records, run_id, meta, args.log_dir)
    clean_up(spark)


if __name__ == "__main__":
    main()
