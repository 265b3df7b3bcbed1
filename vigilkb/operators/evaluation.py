"""Evaluation records and the metrics derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.functions.text import listing

METRICS = ["detect_rate", "affected_recall", "fp_pressure_mean"]


def merge_calls(calls: DataFrame) -> DataFrame:
    """Several judge calls of one event as one: documents are united and the first
    non-clean label wins.  ``calls`` has seq, ord, label, candidate_docs, implicated_docs."""
    flagged = F.col("label") != "clean"
    return calls.groupBy("seq").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("candidate_docs")))).alias("candidate_docs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("implicated_docs")))).alias("implicated_docs"),
        F.coalesce(F.min_by(F.when(flagged, F.col("label")), F.when(flagged, F.col("ord"))), F.lit("clean")).alias("label"),
    )


def records_of(events: DataFrame, calls: DataFrame, corpus: DataFrame, *, run_id: str, baseline: str,
               shuffle_idx: int = -1, seed: int | None = None) -> DataFrame:
    """One record per event.

    ``events``: position, seq, doc_id, event_type, intent, expected_label, implicates;
    ``calls``: one or more per non-delete seq (ord, label, candidate_docs,
    implicated_docs); ``corpus``: seq, active_docs.  Here the last non-clean label is the
    verdict, and an event without a call has none.
    """
    flagged = F.col("label") != "clean"
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    per_event = calls.groupBy("seq").agg(
        united("candidate_docs").alias("candidate_docs"),
        united("implicated_docs").alias("implicated_found"),
        F.coalesce(F.max_by(F.when(flagged, F.col("label")), F.when(flagged, F.col("ord"))), F.lit("clean")).alias("verdict"),
    )
    none = F.array().cast("array<string>")
    out = events.join(per_event, "seq", "left").join(corpus.select("seq", "active_docs"), "seq", "left")
    found = F.coalesce("implicated_found", none)
    cands = F.coalesce("candidate_docs", none)
    return out.select(
        F.lit(run_id).alias("run_id"), F.lit(shuffle_idx).alias("shuffle_idx"),
        F.lit(seed).cast("long").alias("seed"), F.lit(baseline).alias("baseline"),
        "position", "seq", "doc_id", "event_type", "intent", "expected_label", "implicates",
        F.size(cands).alias("n_candidates"), cands.alias("candidate_docs"), "verdict",
        found.alias("implicated_found"), F.size(found).alias("n_implicated_found"),
        F.coalesce((F.col("verdict") != "clean") & F.arrays_overlap("implicates", found), F.lit(False)).alias("detected"),
        F.col("active_docs").alias("corpus_size"),
    )


def token_usage(calls: DataFrame) -> DataFrame:
    """Totals for a judge or extractor that reports its input and output tokens."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return calls.agg(total("input_tokens"), total("output_tokens"))


def _rate(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.round(n / d, 4)).otherwise(0.0)


def summarise(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Headline metrics per baseline (and per extra ``by`` column)."""
    keys = [*(by or []), "baseline"]
    conflict = F.col("expected_label") != "clean"
    agg = records.groupBy(*keys).agg(
        F.count_if(conflict).alias("n_conflict_events"),
        F.count_if(~conflict).alias("n_clean_events"),
        F.count_if(conflict & F.col("detected")).alias("detected_count"),
        # implicated documents are matched against the gold list, not taken on trust
        F.sum(F.when(conflict, F.size(F.array_intersect("implicated_found", "implicates"))).otherwise(0)).alias("found"),
        F.sum(F.when(conflict, F.size("implicates")).otherwise(0)).alias("wanted"),
        F.sum(F.when(~conflict, F.col("n_candidates")).otherwise(0)).alias("fp_pressure_total"),
    )
    return agg.select(
        *keys, "n_conflict_events", "n_clean_events", "detected_count",
        _rate(F.col("detected_count"), F.col("n_conflict_events")).alias("detect_rate"),
        _rate(F.col("found"), F.col("wanted")).alias("affected_recall"),
        _rate(F.col("fp_pressure_total"), F.col("n_clean_events")).alias("fp_pressure_mean"),
        "fp_pressure_total",
    )


def summarise_labels(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    keys = [*(by or []), "baseline", "expected_label"]
    return (
        records.where("expected_label <> 'clean'").groupBy(*keys)
        .agg(F.count("*").alias("total"), F.count_if("detected").alias("detected"))
        .withColumn("rate", _rate(F.col("detected"), F.col("total")))
    )


def temporal_quartiles(records: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Detection by arrival position: four ranges up to the last conflict's position."""
    keys = [*(by or []), "baseline"]
    conflicts = records.where("expected_label <> 'clean'")
    last = conflicts.groupBy(*keys).agg(F.max("position").alias("last"))
    size = F.greatest(F.floor(F.col("last") / 4), F.lit(1)).cast("long")
    ranges = last.withColumn("size", size).withColumn("q", F.explode(F.sequence(F.lit(1), F.lit(4)))).select(
        *keys, F.col("q").cast("long").alias("quartile"), "size",
        ((F.col("q") - 1) * F.col("size")).alias("lo"),
        F.when(F.col("q") < 4, F.col("q") * F.col("size")).otherwise(F.col("last") + 1).alias("hi"),
    )
    counted = (
        conflicts.join(ranges.select(*keys, "size").distinct(), keys)
        .withColumn("quartile", F.least(F.floor(F.col("position") / F.col("size")), F.lit(3)).cast("long") + 1)
        .groupBy(*keys, "quartile")
        .agg(F.count("*").alias("n_conflicts"), F.count_if("detected").alias("detected"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ranges.join(counted, [*keys, "quartile"], "left").select(
        *keys, "quartile", "lo", "hi", zero("n_conflicts").alias("n_conflicts"), zero("detected").alias("detected"),
        _rate(zero("detected"), zero("n_conflicts")).alias("rate"),
    )


def _spread(value: Column) -> list[Column]:
    return [
        F.round(F.avg(value), 4).alias("mean"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 4).alias("std"),
        F.round(F.min(value), 4).alias("min"), F.round(F.max(value), 4).alias("max"),
    ]


def aggregate(summaries: DataFrame) -> DataFrame:
    """Mean, sample deviation (0 for one run), min and max of each metric over runs."""
    long = summaries.select(
        "baseline", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in METRICS])).alias("x")
    )
    return long.groupBy("baseline", F.col("x.metric").alias("metric")).agg(*_spread(F.col("x.v")))


def aggregate_labels(by_label: DataFrame) -> DataFrame:
    return by_label.groupBy("baseline", "expected_label").agg(*_spread(F.col("rate"))[:2])


def nested_summary(records: DataFrame, by: list[str]) -> DataFrame:
    """One row per run (``by``): metrics as MAP<baseline, STRUCT<..., by_label, temporal_detection>>."""
    keys = [*by, "baseline"]
    flat = summarise(records, by)
    entry = lambda name, cols: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("key"), F.struct(*cols).alias("value")))))
    labels = summarise_labels(records, by).groupBy(*keys).agg(entry(F.col("expected_label"), ["total", "detected", "rate"]).alias("by_label"))
    quarter = F.concat(F.lit("Q"), "quartile", F.lit("_pos_"), "lo", F.lit("-"), "hi")
    temporal = temporal_quartiles(records, by).groupBy(*keys).agg(entry(quarter, ["n_conflicts", "detected", "rate"]).alias("temporal_detection"))
    joined = flat
    for part, name in ((labels, "by_label"), (temporal, "temporal_detection")):
        renamed = part.select(*[F.col(k).alias(f"__{k}") for k in keys], name)
        joined = joined.join(renamed, [joined[k].eqNullSafe(renamed[f"__{k}"]) for k in keys], "left").drop(*[f"__{k}" for k in keys])
        empty = F.create_map().cast(part.schema[name].dataType)
        joined = joined.withColumn(name, F.coalesce(name, empty))
    values = [c for c in joined.columns if c not in keys]
    # entries with maps in them have no order
    each = F.struct(F.col("baseline").alias("key"), F.struct(*values).alias("value"))
    return joined.groupBy(*by).agg(F.map_from_entries(F.collect_list(each)).alias("metrics"))


def nested_aggregate(records: DataFrame, by: list[str]) -> DataFrame:
    """(baseline, metrics, by_label) over runs: MAP<metric, STRUCT<mean, std, min, max>> and the labels' detection rates."""
    entry = lambda name, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("key"), value.alias("value")))))
    scalar = aggregate(summarise(records, by)).groupBy("baseline").agg(entry(F.col("metric"), F.struct("mean", "std", "min", "max")).alias("metrics"))
    rates = F.struct(F.col("mean").alias("detect_rate_mean"), F.col("std").alias("detect_rate_std"))
    labels = aggregate_labels(summarise_labels(records, by)).groupBy("baseline").agg(entry(F.col("expected_label"), rates).alias("by_label"))
    return scalar.join(labels, "baseline", "left")


def audit(records: DataFrame) -> DataFrame:
    """Display rows: OK when a conflict was detected through an implicated document, or a
    clean event stayed clean."""
    conflict = F.col("expected_label") != "clean"
    flagged = F.coalesce(F.col("verdict") != "clean", F.lit(False))
    right = F.when(conflict, flagged & F.arrays_overlap("implicates", "implicated_found")).otherwise(~flagged)
    return records.select(
        "baseline", "seq", "doc_id", "expected_label",
        listing(F.col("implicates"), 50).alias("implicates"), listing(F.col("candidate_docs")).alias("candidates"),
        F.coalesce("verdict", F.lit("(no judge call)")).alias("verdict"),
        F.when(F.col("verdict").isNull(), "-").when(right, "OK").otherwise("MISS").alias("mark"),
    )


def audit_summary(records: DataFrame) -> DataFrame:
    """Audit totals: recall counts implicated documents among the surfaced candidates."""
    conflicts = records.where("expected_label <> 'clean'")
    found = F.size(F.array_intersect("candidate_docs", "implicates"))
    agg = conflicts.groupBy("baseline").agg(
        F.count_if((F.col("verdict") != "clean") & (found > 0)).alias("detected"), F.count("*").alias("conflicts"),
        F.sum(found).alias("found"), F.sum(F.size("implicates")).alias("wanted"),
    )
    return agg.select(
        "baseline", "detected", "conflicts", _rate(F.col("detected"), F.col("conflicts")).alias("detect_rate"),
        _rate(F.col("found"), F.col("wanted")).alias("affected_recall"),
    )
