"""Order-dependent primitives that never put a whole group into one task.

A window over ``partitionBy(key)`` sorts every row of a key in a single task.  The
folds here cut each key into clock buckets first: bucket totals are partially
aggregated, folded over the (few) buckets, and joined back to a window that only
spans one bucket.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from vigilkb.config import PHYSICAL
from vigilkb.session import cut

FOREVER = 1 << 60
_BUCKET = "__bucket"


def number_rows(df: DataFrame, keys: list[Column | str], out: str, start: int = 1) -> DataFrame:
    """Consecutive BIGINT numbers in the global order of ``keys``.

    Range partitioning sorts across tasks; the row's place inside its partition plus
    the sizes of the partitions before it is its number.  The sorted rows are
    materialised once so that both passes read the same placement.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(
        df.repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__mid", 33))
    )
    # one row per partition: bounded by the partition count, not by the data
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    place = F.col("__mid") - F.shiftleft(F.col("__part"), 33)
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(out, (F.col("__off") + place + F.lit(start)).cast("long"))
        .drop("__mid", "__part", "__off")
    )


_FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def _merge(fold: str, carried: Column, inner: Column) -> Column:
    if fold == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(inner, F.lit(0))
    return F.greatest(carried, inner) if fold == "max" else F.least(carried, inner)


def running(
    df: DataFrame,
    by: list[str],
    pos: str,
    folds: dict[str, tuple[str, str]],
    exclusive: bool = False,
    span: int | None = PHYSICAL.fold_span,
) -> DataFrame:
    """Running ``sum``/``max``/``min`` per ``by`` in order of the integer ``pos``.

    ``folds`` maps an output column to (fold, input column).  Rows with equal ``pos``
    see each other unless ``exclusive``.  ``span`` is the width of a bucket; None says
    that the caller has measured the whole clock to fit into one.
    """
    end = -1 if exclusive else W.currentRow
    if span is None:
        frame = W.partitionBy(*(by or [F.lit(0)])).orderBy(pos).rangeBetween(W.unboundedPreceding, end)
        folded = {out: _FOLDS[fn](value).over(frame) for out, (fn, value) in folds.items()}
        return df.withColumns(
            {out: F.coalesce(c, F.lit(0)) if folds[out][0] == "sum" else c for out, c in folded.items()}
        )
    d = df.withColumn(_BUCKET, F.floor(F.col(pos) / F.lit(span)).cast("long"))
    totals = d.groupBy(*by, _BUCKET).agg(
        *[_FOLDS[fn](value).alias(f"__t_{out}") for out, (fn, value) in folds.items()]
    )
    lead = by or [F.lit(0)]
    earlier = W.partitionBy(*lead).orderBy(_BUCKET).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *by,
        _BUCKET,
        *[_FOLDS[fn](f"__t_{out}").over(earlier).alias(f"__c_{out}") for out, (fn, _) in folds.items()],
    )
    frame = (
        W.partitionBy(*by, _BUCKET)
        .orderBy(pos)
        .rangeBetween(W.unboundedPreceding, end)
    )
    inner = d.withColumns(
        {f"__i_{out}": _FOLDS[fn](value).over(frame) for out, (fn, value) in folds.items()}
    )
    joined = inner.join(carried, [*by, _BUCKET])
    return joined.withColumns(
        {
            out: _merge(fn, F.col(f"__c_{out}"), F.col(f"__i_{out}"))
            for out, (fn, _) in folds.items()
        }
    ).drop(_BUCKET, *[f"__{p}_{o}" for o in folds for p in "ci"])


# ----------------------------------------------------------------- as-of positions
#
# A row born at tick b is visible to a reader at t iff b < t; one that dies at d is
# gone for a reader at t iff d <= t.  On a four-fold clock births sit at 4b+1, deaths
# at 4d-1, a reader just before t at 4t and one just after t at 4t+2, so "fold
# everything up to the reader" is exact.


def born_pos(tick: str) -> Column:
    return F.col(tick) * 4 + 1


def dead_pos(tick: str) -> Column:
    return F.col(tick) * 4 - 1


def reader_pos(tick: str, after: bool = False) -> Column:
    return F.col(tick) * 4 + (2 if after else 0)


def live_at(at: Column, born: Column, dies: Column) -> Column:
    """Half-open visibility; a null ``dies`` never ends."""
    return (born < at) & (dies.isNull() | (dies > at))


def span_for(last_tick: int | None, width: int | None = None) -> int | None:
    """Bucket width for a clock that ends at ``last_tick``: None if one bucket holds it."""
    width = width or PHYSICAL.fold_span
    return None if (last_tick or 0) * 4 + 3 < width else width


def lifetime_deltas(df: DataFrame, keys: list[str]) -> DataFrame:
    """+1 / -1 steps (``pos``, ``delta``) of rows stamped valid_from / valid_to."""
    return df.select(
        *keys,
        F.explode(
            F.filter(
                F.array(
                    F.struct(born_pos("valid_from").alias("pos"), F.lit(1).cast("long").alias("delta")),
                    F.struct(dead_pos("valid_to").alias("pos"), F.lit(-1).cast("long").alias("delta")),
                ),
                lambda s: s["pos"].isNotNull(),
            )
        ).alias("s"),
    ).select(*keys, "s.pos", "s.delta")


def presence_deltas(df: DataFrame, keys: list[str], span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """Steps at which a key gains its first or loses its last live row: the count of
    distinct live keys is the running sum of these."""
    steps = lifetime_deltas(df, keys).groupBy(*keys, "pos").agg(F.sum("delta").alias("step"))
    counted = running(steps, keys, "pos", {"now": ("sum", "step")}, span=span)
    was = F.col("now") - F.col("step")
    return counted.select(
        *keys,
        "pos",
        F.when((was == 0) & (F.col("now") > 0), 1)
        .when((was > 0) & (F.col("now") == 0), -1)
        .otherwise(0)
        .cast("long")
        .alias("delta"),
    ).where("delta <> 0")


# ----------------------------------------------------------------- first k live


def _carry(k: int):
    """Per key, the k largest end ticks of all buckets before each bucket."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, heap = None, []
        for pdf in batches:
            held = []
            for this, tops in zip(pdf["key"], pdf["tops"]):
                if this != key:
                    key, heap = this, []
                held.append(list(heap))
                heap = heapq.nlargest(k, heap + [int(v) for v in tops])
            yield pd.DataFrame({"key": pdf["key"], "bucket": pdf["bucket"], "held": held})

    return scan


def _lead(k: int):
    """Emit the rows that are, for some while, among the k oldest live ones."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, heap = None, []
        for pdf in batches:
            keep, since = [], []
            for i, (key, bucket, born, dies, held) in enumerate(
                zip(pdf["key"], pdf["bucket"], pdf["valid_from"], pdf["dies"], pdf["held"])
            ):
                if (key, bucket) != group:
                    group = (key, bucket)
                    heap = [int(v) for v in held] if held is not None else []
                    heapq.heapify(heap)
                # the row that ends at tick d is already gone for a reader at d
                start = max(born, heap[0] - 1) if len(heap) == k else born
                if start + 1 < dies:
                    keep.append(i)
                    since.append(start)
                (heapq.heappush if len(heap) < k else heapq.heappushpop)(heap, dies)
            out = pdf.iloc[keep][["key", "id", "valid_from", "dies"]].copy()
            out["lead_from"] = since
            yield out

    return scan


def first_k_live(rows: DataFrame, k: int, span: int | None = PHYSICAL.fold_span) -> DataFrame:
    """When is a row one of the ``k`` oldest live rows of its key?

    ``rows``: key STRING, id BIGINT, valid_from, valid_to.  A row is among the k oldest
    live ones from the moment the k-th last-ending older row has ended.  The k largest
    end ticks are a mergeable summary, so keys are scanned bucket by bucket and a hot
    key is spread over many tasks.  Result: key, id, valid_from, dies, lead_from.
    """
    bucket = F.lit(0) if span is None else F.floor(F.col("valid_from") / span)
    d = rows.select(
        "key",
        "id",
        "valid_from",
        F.coalesce("valid_to", F.lit(FOREVER)).alias("dies"),
        bucket.cast("long").alias("bucket"),
    )
    result = "key string, id long, valid_from long, dies long, lead_from long"
    if span is None:
        return (
            d.withColumn("held", F.lit(None).cast("array<long>"))
            .repartition("key").sortWithinPartitions("key", "valid_from").mapInPandas(_lead(k), result)
        )
    tops = d.groupBy("key", "bucket").agg(
        F.slice(F.sort_array(F.collect_list("dies"), asc=False), 1, k).alias("tops")
    )
    held = (
        tops.repartition("key")
        .sortWithinPartitions("key", "bucket")
        .mapInPandas(_carry(k), "key string, bucket long, held array<long>")
    )
    return (
        d.join(held, ["key", "bucket"])
        .repartition("key", "bucket")
        .sortWithinPartitions("key", "bucket", "valid_from")
        .mapInPandas(_lead(k), result)
    )


# ----------------------------------------------------------------- interval stabbing

_LEVELS = 42  # clock ticks below 2**42


def _cover(lo: str, hi: str) -> str:
    """Dyadic nodes (level, index) that tile the closed tick range [lo, hi]."""
    return f"""
    flatten(transform(sequence(0, {_LEVELS}), lv -> filter(array(
        CASE WHEN shiftright({lo} + shiftleft(1L, lv) - 1, lv) < shiftright({hi} + 1, lv)
              AND shiftright({lo} + shiftleft(1L, lv) - 1, lv) % 2 = 1
             THEN concat_ws(':', lv, shiftright({lo} + shiftleft(1L, lv) - 1, lv)) END,
        CASE WHEN shiftright({lo} + shiftleft(1L, lv) - 1, lv) < shiftright({hi} + 1, lv)
              AND shiftright({hi} + 1, lv) % 2 = 1
             THEN concat_ws(':', lv, shiftright({hi} + 1, lv) - 1) END
    ), n -> n IS NOT NULL)))"""


def stab(
    points: DataFrame,
    spans: DataFrame,
    key: str,
    at: str,
    lo: str,
    hi: str,
    small: int | None = None,
) -> DataFrame:
    """``points`` joined to the ``spans`` of the same key with lo < at < hi.

    Keys with few spans join directly; a key with many would pair every point with
    every span before the filter, so those go through dyadic nodes: a span is tiled by
    at most two nodes per level and a point lies under one node per level.
    """
    small = PHYSICAL.stab_small if small is None else small
    sized = spans.groupBy(key).agg((F.count("*") > small).alias("__big"))
    s = spans.join(sized, key)
    p = points.join(sized, key)
    direct = (
        p.where("NOT __big").drop("__big")
        .join(s.where("NOT __big").drop("__big"), key)
        .where((F.col(lo) < F.col(at)) & (F.col(at) < F.col(hi)))
    )
    ceiling = (1 << _LEVELS) - 1
    tiled = (
        s.where("__big").drop("__big")
        .withColumn("__lo", F.col(lo) + 1)
        .withColumn("__hi", F.least(F.col(hi) - 1, F.lit(ceiling)))
        .withColumn("__node", F.explode(F.expr(_cover("__lo", "__hi"))))
        .drop("__lo", "__hi")
    )
    probes = (
        p.where("__big").drop("__big")
        .withColumn(
            "__node",
            F.explode(
                F.expr(f"transform(sequence(0, {_LEVELS}), lv -> concat_ws(':', lv, shiftright({at}, lv)))")
            ),
        )
    )
    indexed = probes.join(tiled, [key, "__node"]).drop("__node")
    return direct.unionByName(indexed)


def as_of_last(
    facts: DataFrame, readers: DataFrame, key: str, tick: str, value: str, at: str, out: str,
    span: int | None = PHYSICAL.fold_span,
) -> DataFrame:
    """Last ``value`` written for ``key`` strictly before each reader (left join)."""
    carried = [c for c in readers.columns if c != key]
    written = facts.select(
        key,
        born_pos(tick).alias("pos"),
        F.struct(F.col(tick).alias("t"), F.col(value).alias("v")).alias("w"),
        F.lit(None).cast(readers.select(F.struct(*carried)).schema[0].dataType).alias("r"),
    )
    asked = readers.select(
        key,
        reader_pos(at).alias("pos"),
        F.lit(None).cast(written.schema["w"].dataType).alias("w"),
        F.struct(*carried).alias("r"),
    )
    folded = running(written.unionByName(asked), [key], "pos", {"last": ("max", "w")}, span=span)
    return folded.where("r IS NOT NULL").select(key, "r.*", F.col("last.v").alias(out))


def as_of_total(
    deltas: DataFrame,
    readers: DataFrame,
    keys: list[str],
    at: str,
    out: str,
    after: bool = False,
    span: int | None = PHYSICAL.fold_span,
) -> DataFrame:
    """Sum of ``delta`` up to each reader; ``deltas`` has keys, pos, delta."""
    carried = [c for c in readers.columns if c not in keys]
    kind = T.StructType([readers.schema[c] for c in carried])
    steps = deltas.select(*keys, "pos", "delta", F.lit(None).cast(kind).alias("r"))
    asked = readers.select(
        *keys,
        reader_pos(at, after).alias("pos"),
        F.lit(0).cast("long").alias("delta"),
        F.struct(*carried).alias("r"),
    )
    folded = running(steps.unionByName(asked), keys, "pos", {out: ("sum", "delta")}, span=span)
    return folded.where("r IS NOT NULL").select(*keys, "r.*", out)
