"""Secret scans with corpus-wide ownership frequency.

Spans of three base kinds are found by pattern.  A fourth kind, ``key``, is any other long
token that looks random.  Whether such a token is a live-looking credential or a widely
copied example shows in the corpus: the hash of every candidate is counted by distinct
repositories (source and language) and distinct owners (source).  A candidate of at most
``MOST_OWNERS`` owners is ``live``, any other one is ``copied``.  The base spans are always
reported, with their verdicts; a ``key`` is reported where it is live.

Only candidates travel: texts are read once, each leaves one narrow row, and the counts
are partially aggregated before they are shuffled.

Cases: a null or empty text has no spans; a null source or language is an owner or
repository of its own; repeated rows and ids give one result row each and count once per
owner; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vigilkb.llm.common import small_batches
from vigilkb.session import cut

# The base kinds, in the order in which spans with equal starts are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGNED, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "key")

#: A token that may be a key, the bits per character it needs, and the owners that a live one may have.
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
LEAST_BITS = 3.2
MOST_OWNERS = 2

_FOUND = "array<struct<kind:int,start:int,end:int,digest:binary>>"
_SCAN = f"doc_id long, uid string, n_assign long, n_access long, n_hex long, base_sha256 string, found {_FOUND}"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("digest", pa.binary())]))


def _random_looking(token: str) -> bool:
    if not any(c.isdigit() for c in token) or token.isdigit() or not any(c.isupper() or c.islower() for c in token):
        return False
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) >= LEAST_BITS


def spans_of(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, secret) of every candidate; the first three kinds are the base."""
    out = [(0, m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    out += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((s, e) for _, s, e, _ in out)
    i = 0
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][1] <= m.start():
            i += 1
        if (i == len(base) or base[i][0] >= m.end()) and _random_looking(m[0]):
            out.append((3, m.start(), m.end(), m[0]))
    return sorted((s, k, e, secret) for k, s, e, secret in out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: dict[str, list] = {k.split()[0]: [] for k in _SCAN.split(", ")[1:-1]} | {"found": []}
        for text in batch.column(1).to_pylist():
            found = [(s, k, e, secret) for s, k, e, secret in spans_of(text or "")]
            kinds = Counter(k for _, k, _, _ in found)
            base = listed([(s, k, e) for s, k, e, _ in found if k < 3])
            cols["uid"].append(uuid.uuid4().hex if found else None)
            for k in range(3):
                cols[f"n_{KINDS[k]}"].append(kinds[k])
            cols["base_sha256"].append(hashlib.sha256(base.encode()).hexdigest())
            cols["found"].append([
                {"kind": k, "start": s, "end": e, "digest": hashlib.sha256(secret.encode("utf-8", "replace")).digest()[:16]}
                for s, k, e, secret in found
            ])
        kinds = {"uid": pa.string(), "base_sha256": pa.string(), "found": _ARROW}
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array(v, kinds.get(k, pa.int64())) for k, v in cols.items()], *batch.columns[2:]],
            ["doc_id", *cols, *batch.schema.names[2:]],
        )


def secrets(docs: DataFrame) -> DataFrame:
    """Per document: base counts and digest, all reported spans, and how many are live or copied."""
    small_batches(docs.sparkSession)
    scanned = cut(docs.select("doc_id", "text", "source", "lang").mapInArrow(_scan, f"{_SCAN}, source string, lang string"))
    each = scanned.where(F.size("found") > 0).select(
        "uid", F.coalesce("source", F.lit("")).alias("owner"),
        F.concat_ws("\x00", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("repo"),
        F.inline("found"),
    )
    # one row per candidate, repository and owner before the counts, so copies do not travel
    owned = each.groupBy("digest", "owner", "repo").agg(F.lit(1).alias("one"))
    known = owned.groupBy("digest").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"))
    judged = (
        each.join(known, "digest")
        .withColumn("live", (F.col("owners") <= MOST_OWNERS) & (F.col("repos") <= 2 * MOST_OWNERS))
        .groupBy("uid")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live", "owners", "repos"))).alias("all"))
    )
    shown = F.filter("all", lambda x: (x["kind"] < 3) | x["live"])
    name = F.array(*[F.lit(k) for k in KINDS])
    text = F.transform(shown, lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"]))
    verdicts = judged.select(
        "uid", F.array_join(text, ",").alias("spans"),
        F.size(F.filter(shown, lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter(shown, lambda x: ~x["live"])).cast("long").alias("n_copied"),
    )
    return scanned.join(verdicts, "uid", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0).cast("long")).alias("n_live"), F.coalesce("n_copied", F.lit(0).cast("long")).alias("n_copied"),
    )
