"""Vector expressions and the offline text embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, v: s + v,
    )


def unit(v: Column) -> Column:
    """L2-normalised copy; a zero vector stays zero."""
    # one-element array: the norm is bound once, not summed up again for every component
    return F.transform(
        F.array(F.sqrt(dot(v, v))),
        lambda norm: F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))),
    )[0]


class _Slots(dict):
    """Bucket of each token met so far."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) >= 1 << 20:
            self.clear()
        self[token] = slot = int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % self.dim
        return slot


def _counted(dim: int):
    """(key, lower-cased text) -> (key, number of tokens in each bucket)."""
    tokens = re.compile("[a-z0-9]+")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = _Slots(dim)
        for b in batches:
            n = np.zeros((b.num_rows, dim), np.int64)
            for i, text in enumerate(b.column(1)):
                found = tokens.findall(text.as_py() or "")
                if found:
                    n[i] = np.bincount([slots[t] for t in found], minlength=dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * dim, pa.int32()), pa.array(n.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[b.schema.names[0], "n"])

    return count


def embed_texts(df: DataFrame, key: str, text: str, dim: int = 64, out: str = "vec") -> DataFrame:
    """Deterministic offline embedding: token counts hashed into ``dim`` buckets.

    Stands in for a hosted embedding model.  Every text is counted where it is read, and
    only the counts are shuffled; texts of one key count together.
    """
    texts = df.select(key, F.lower(F.col(text)).alias("text"))
    shape = T.StructType([texts.schema[key], T.StructField("n", T.ArrayType(T.LongType()))])
    counts = texts.mapInArrow(_counted(dim), shape).groupBy(key).agg(F.collect_list("n").alias("all"))
    total = F.aggregate(
        F.slice("all", 2, F.size("all")), F.col("all")[0], lambda s, n: F.zip_with(s, n, lambda x, y: x + y)
    )
    sums = counts.select(key, F.transform(total, lambda x: x.cast("double")).alias("__n"))
    filled = df.join(sums, key, "left").withColumn("__raw", F.coalesce("__n", F.array_repeat(F.lit(0.0), dim)))
    return filled.withColumn(out, unit(F.col("__raw"))).drop("__n", "__raw")
