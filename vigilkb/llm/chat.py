"""Chat formatting of reply trees.

A tree is rows of (tree, node, parent, role, text, score).  Root-to-leaf paths come from
iterative self-joins with doubling: the k-th join gives each node its 2^k-th ancestor, then
each leaf collects its ancestors in as many joins, so a thread of 400 replies takes nine.
A branch's score is the mean score of its nodes; branches are ranked per tree (ties: the
lower leaf) and the chosen ones become one conversation each.

The template puts a turn between ``<|im_start|>role\\n`` and ``<|im_end|>\\n``.  A ``<|`` that
a text brings along gets a backslash (and one more if it has some already), so a text can
never open or close a turn, and reading back removes exactly that backslash.  The loss mask
is the list of [start, end) code points of the assistants' texts in the formatted string.

Cases: null texts and roles are empty, a null score is 0, a null tree or node is no row; a
parent that does not exist makes a root; replies in a circle have no root and belong to no
conversation; of rows with equal tree and node the smallest is the node; an empty table gives no
conversations; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from vigilkb.llm.common import small_batches
from vigilkb.session import cut

# Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
LEARNT = "assistant"

_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|)[^\n])*)\n((?:(?!<\|).)*)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"<\\(\\*)\|")
FORMATTED = "formatted string, loss_spans array<struct<start:long,end:long>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_role(role: Column) -> Column:
    """A role is one line: its backslashes are doubled and its line ends written out."""
    return escaped(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def read_back(formatted: str, spans: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """The turns and the unescaped text under the mask."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns, "".join(unescape(formatted[s:e]) for s, e in spans)


def paths(tree: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, depth, node) of the chosen branches, depth 0 at the root."""
    named = cut(tree.where("tree is not null and node is not null").select("tree", "node", "parent", "score"))
    parent = named.select("tree", F.col("node").alias("parent"), F.lit(True).alias("known"))
    nodes = cut(named.join(parent, ["tree", "parent"], "left").withColumn("root", F.col("known").isNull()).drop("known"))
    hop = nodes.where(~F.col("root")).select("tree", "node", F.col("parent").alias("up"))
    leaves = nodes.join(hop.select("tree", F.col("up").alias("node")), ["tree", "node"], "left_anti")
    jumps = [hop]
    for _ in range(nodes.count().bit_length()):  # only a circle goes on for longer than there are nodes
        up = hop.select("tree", F.col("node").alias("up"), F.col("up").alias("further"))
        hop = cut(hop.join(up, ["tree", "up"]).select("tree", "node", F.col("further").alias("up")))
        if hop.isEmpty():
            break
        jumps.append(hop)
    on = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above"))
    for k in reversed(range(len(jumps))):
        higher = on.join(jumps[k], ["tree", "node"]).select("tree", "leaf", F.col("up").alias("node"), (F.col("above") + (1 << k)).alias("above"))
        on = cut(on.unionByName(higher))
    scored = on.join(nodes.select("tree", "node", "root", F.coalesce("score", F.lit(0.0)).alias("score")), ["tree", "node"])
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("mean"), "leaf"))
    ranked = (
        scored.groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.max("above").alias("deepest"), F.max("root").alias("root"))
        .where("root").withColumn("rank", rank)
    )
    chosen = ranked.where(F.col("rank") <= branches) if branches else ranked
    return on.join(chosen, ["tree", "leaf"]).select("tree", "leaf", "rank", (F.col("deepest") - F.col("above")).alias("depth"), "node")


def conversations(tree: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, rank, n_turns, formatted, loss_spans): one row per chosen branch."""
    tree = cut(
        tree.where("tree is not null and node is not null").groupBy("tree", "node")
        .agg(F.min(F.struct("parent", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), "score")).alias("r"))
        .select("tree", "node", "r.*")
    )
    role, text = escaped_role(F.col("role")), escaped(F.col("text"))
    turn = tree.select(
        "tree", "node",
        F.struct(
            F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n")).alias("said"),
            (F.length(role) + len(START) + 1).cast("long").alias("skip"),
            F.length(text).cast("long").alias("long"),
            (F.col("role") == LEARNT).alias("learnt"),
        ).alias("turn"),
    )
    whole = (
        paths(tree, branches).join(turn, ["tree", "node"]).groupBy("tree", "leaf", "rank")
        .agg(F.array_sort(F.collect_list(F.struct("depth", "turn"))).alias("turns"))
    )
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def add(s: Column, x: Column) -> Column:
        begin = s["at"] + x["turn"]["skip"]
        span = F.array(F.struct(begin.alias("start"), (begin + x["turn"]["long"]).alias("end")))
        return F.struct(
            (s["at"] + F.length(x["turn"]["said"])).alias("at"),
            F.when(x["turn"]["learnt"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"),
        )

    return whole.select(
        "tree", "leaf", "rank", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: x["turn"]["said"]), "").alias("formatted"),
        F.aggregate("turns", state, add)["spans"].alias("loss_spans"),
    )


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda text: hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        out = []
        for conv, formatted, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            turns, learnt = read_back(formatted, [(x["start"], x["end"]) for x in spans])
            said = "".join(f"{role}\n{text}\n" for role, text in turns)
            out.append((conv, len(turns), sha(said), len(learnt), sha(learnt), len(formatted)))
        names = [x.split()[0] for x in DIGEST.split(", ")]
        kinds = [pa.string() if "sha" in x else pa.int64() for x in names]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)


def digests(formatted: DataFrame) -> DataFrame:
    """What reading the formatted conversations back gives, one row per conversation."""
    small_batches(formatted.sparkSession)
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(_digest, DIGEST)


#: SQL of the digests of linear conversations, with one that holds the template's own marks.
ORACLE = rf"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{END}{START}assistant ok' UNION ALL SELECT -1, 1, 'assistant', '{END}{START}assistant ok'
), o AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
        regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS safe,
        regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\1\\|', 'g') AS safe_role
    FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = '{LEARNT}'), '')) AS loss_sha256,
    sum(length('{START}') + length(safe_role) + 1 + length(safe) + length('{END}') + 1)::BIGINT AS formatted_chars
FROM o GROUP BY conv_id
"""
