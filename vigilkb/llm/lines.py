"""Line dedup within one edit, by a deletion-neighbourhood join of DataFrame operations.

A line goes if an earlier line (by doc_id, then place in the text) is equal to it or one edit
away: one character replaced, inserted or left out.  Lines of fewer than ``LEAST_CHARS`` code
points are not judged.

Equal lines are found by their hashes.  For the others, all variants with one character left
out are the classical neighbourhood, one row per character.  Here it is opened step by step:
first each line leaves out one half, then - only lines that share such a variant with another
text - a sixteenth of that half, and so on down to single characters.  Two lines one edit
apart share a variant at every step, so nothing is lost, and almost all lines end at the
first step with four rows.  (A pair whose lengths differ leaves out one character more on
the longer side, hence the variants of a line as the shorter and as the longer one.)

At the last step a variant without character i groups texts that differ in i only, and a
line's variants meet the line that they equal.  In both the earliest member decides for all,
so groups are folded by their minimum, hot ones before they are shuffled, and never paired up.
The edit distance to that earliest line is verified.

Cases: a null text has no lines and stays null; empty and short lines stay; equal rows are
one document, different texts of one doc_id are documents in the order of their hashes; a document without doc_id is not compared and stays as it is; other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilkb.llm.common import parts
from vigilkb.session import cut

LEAST_CHARS = 20
FANOUT = 16


def _mark(text: Column) -> Column:
    """31 bits of the text's hash: which of the texts of a doc_id a place is in."""
    return F.xxhash64(text).bitwiseAND(F.lit(0x7FFFFFFF))


def _same(a: Column, b: Column) -> Column:
    """Equality that is no key of a join, so that texts stay partitioned by doc_id alone."""
    return a.bitwiseXOR(b) == 0


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, pos, line); the upper half of ``pos`` is the text's mark, the lower one the line's number."""
    return (
        docs.select("doc_id", F.shiftleft(_mark(F.col("text")), 32).alias("mark"), F.posexplode(F.split("text", "\n")).alias("nth", "line"))
        .where(F.length("line") >= least)
        .select("doc_id", (F.col("mark") + F.col("nth")).alias("pos"), "line")
    )


def _number(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _identity() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")]


def _variant(start: Column, size: Column, more: Column) -> Column:
    """Hash of the line without ``size + more`` characters after ``start``; ``more`` is 1 on the longer side."""
    return F.xxhash64(
        F.length("line") - more, start, size,
        F.substring("line", F.lit(1), start), F.substring("line", start + size + more + 1, F.length("line")),
    )


def _halves() -> Column:
    """(start, size, more) of the halves, as the shorter or equal line and as the longer one."""
    out = []
    for more in (0, 1):
        n = F.length("line") - more
        half = F.floor(n / 2).cast("int")
        out += [
            F.struct(F.lit(0).alias("start"), half.alias("size"), F.lit(more).alias("more")),
            F.struct(half.alias("start"), (n - half).alias("size"), F.lit(more).alias("more")),
        ]
    return F.array(*out)


def _shared(df: DataFrame) -> DataFrame:
    """The variants that more than one text has."""
    return df.groupBy("variant").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo != hi").select("variant")


def _near(docs: DataFrame, by_id: DataFrame, firsts: DataFrame, least: int) -> DataFrame:
    """(h1, h2) of the texts that have an earlier text one edit away."""
    halves = _lines(docs, least).select(*_identity(), F.explode(_halves()).alias("v"), "line")
    halves = halves.select("h1", "h2", "v.*", _variant(F.col("v.start"), F.col("v.size"), F.col("v.more")).alias("variant"))
    some = halves.join(_shared(halves), "variant", "left_semi").select("h1", "h2", "start", "size", "more").distinct()
    # the texts of the survivors, read at their first place
    places = some.join(firsts, ["h1", "h2"]).select("h1", "h2", "first", F.struct("start", "size", "more").alias("v"))
    at = places.groupBy(F.col("first.doc_id").alias("doc_id"), F.shiftright("first.pos", 32).alias("mark")).agg(
        F.collect_list(F.struct("h1", "h2", "first", "v")).alias("asked"))
    rows = cut(
        by_id.join(at, (by_id["doc_id"] == at["doc_id"]) & _same(_mark(by_id["text"]), at["mark"]))
        .select(F.split("text", "\n").alias("lines"), F.explode("asked").alias("a"))
        .select("a.h1", "a.h2", "a.first", "a.v.*", F.get("lines", _number(F.col("a.first.pos"))).alias("line"))
        .where(F.xxhash64("line") == F.col("h1"))
    )
    while not rows.where(F.col("size") > FANOUT).isEmpty():
        part = F.greatest(F.ceil(F.col("size") / FANOUT).cast("int"), F.lit(1))
        starts = F.sequence(F.col("start"), F.col("start") + F.greatest(F.col("size") - 1, F.lit(0)), part)
        pieces = F.transform(
            starts, lambda s: F.struct(s.alias("start"), F.least(part, F.col("start") + F.col("size") - s).alias("size"), F.col("more").alias("more"))
        )
        opened = rows.select("h1", "h2", "first", "line", F.explode(pieces).alias("v")).select("h1", "h2", "first", "line", "v.*")
        opened = opened.withColumn("variant", _variant(F.col("start"), F.col("size"), F.col("more")))
        rows = cut(opened.join(_shared(opened), "variant", "left_semi").drop("variant").distinct())
    # single characters: a replaced one (role 0), the shorter (1) and the longer (2) of a pair of lengths
    places = F.sequence(F.col("start"), F.col("start") + F.col("size") - 1 + F.col("more"))
    without = lambda i: F.concat(F.substring("line", F.lit(1), i), F.substring("line", i + 2, F.length("line")))
    replaced = F.transform(places, lambda i: F.struct(F.lit(0).alias("role"), F.xxhash64(i, without(i)).alias("variant")))
    shorter = F.array(F.struct(F.lit(1).alias("role"), F.xxhash64(F.lit(-1), "line").alias("variant")))
    longer = F.transform(places, lambda i: F.struct(F.lit(2).alias("role"), F.xxhash64(F.lit(-1), without(i)).alias("variant")))
    keys = rows.where("size > 0").select(
        "h1", "h2", "first", "line", F.explode(F.when(F.col("more") == 0, F.concat(replaced, shorter)).otherwise(longer)).alias("k")
    )
    keys = cut(keys.select("h1", "h2", "first", "line", "k.*").distinct())
    earliest = keys.groupBy("variant", "role").agg(F.min(F.struct("first", "line")).alias("e")).select(
        "variant", F.element_at(F.create_map(F.lit(0), F.lit(0), F.lit(1), F.lit(2), F.lit(2), F.lit(1)), F.col("role")).alias("role"), "e"
    )
    return (
        keys.join(earliest, ["variant", "role"])
        .where((F.col("e.first") < F.col("first")) & F.levenshtein("line", F.col("e.line"), 1).isin(0, 1))
        .select("h1", "h2").distinct()
    )


def _judged(docs: DataFrame, least: int) -> tuple[DataFrame, Column]:
    """``docs`` with the numbers of the lines that go (null: none), and the column that has them."""
    known = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    by_id = known.repartition(parts(docs.sparkSession), "doc_id")  # one shuffle of the texts, read by both joins
    places = _lines(known, least).select("doc_id", "pos", *_identity())
    firsts = cut(places.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first")))
    near = cut(_near(known, by_id, firsts, least)).withColumn("near", F.lit(True))
    fate = cut(firsts.join(near, ["h1", "h2"], "left"))
    lost, doc, mark = _free(docs, "lost"), _free(docs, "lost_doc"), _free(docs, "lost_mark")
    gone = cut(
        places.join(fate, ["h1", "h2"]).where(F.col("near").isNotNull() | (F.struct("doc_id", "pos") != F.col("first")))
        .groupBy(F.col("doc_id").alias(doc), F.shiftright("pos", 32).alias(mark)).agg(F.collect_set(_number(F.col("pos"))).alias(lost))
    )
    # one row per document with a repeated line: no size bounds it, so it is never broadcast
    same = (docs["doc_id"] == gone[doc]) & _same(_mark(docs["text"]), gone[mark])
    return docs.join(gone.hint("merge"), same, "left"), F.col(lost)


def _kept(lost: Column) -> Column:
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    kept = F.transform(F.filter(lines, lambda s: ~F.array_contains(lost, s["i"])), lambda s: s["x"])
    return F.when(lost.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with the lines of ``text`` that stay; documents that lose every line go."""
    judged, lost = _judged(docs, least)
    emptied = lost.isNotNull() & (F.size(lost) == F.size(F.split("text", "\n")))
    return judged.where(~emptied).select(*[(_kept(lost) if c == "text" else judged[c]).alias(c) for c in docs.columns])


def report(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every document; an emptied one has an empty text."""
    judged, lost = _judged(docs.select("doc_id", "text"), least)
    return judged.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.when(lost.isNull(), 0).otherwise(F.size(lost)).cast("long").alias("n_removed"),
        _kept(lost).alias("text"),
    )


ORACLE = f"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), d AS (
    SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS ord FROM l WHERE length(line) >= {LEAST_CHARS} GROUP BY line
), k AS (
    SELECT line, ord, n AS m, 0 AS more FROM d UNION ALL SELECT line, ord, n - 1, 1 FROM d
), h AS (
    SELECT *, 'p' AS side, left(line, m // 2) AS half FROM k
    UNION ALL SELECT *, 's', right(line, m - m // 2) FROM k
), c AS (
    SELECT DISTINCT a.line AS x, b.line AS y, a.ord AS xo, b.ord AS yo, b.more AS more
    FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.more = 0 AND a.line <> b.line
), e AS (
    SELECT *, list_sum([CASE WHEN substr(x, i, 1) <> substr(y, i, 1) THEN 1 ELSE 0 END FOR i IN range(1, length(x) + 1)]) AS off,
        len([i FOR i IN range(0, length(y)) IF left(y, i) || substr(y, i + 2) = x]) AS cuts
    FROM c
), near AS (
    SELECT CASE WHEN xo > yo THEN x ELSE y END AS line FROM e WHERE CASE WHEN more = 0 THEN off <= 1 ELSE cuts > 0 END
), gone AS (
    SELECT doc_id, pos FROM l JOIN d USING (line) WHERE doc_id * 1000000 + pos <> ord OR line IN (SELECT line FROM near)
), g AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT docs.doc_id AS doc_id, len(string_split(text, chr(10))) AS n_lines, coalesce(n_removed, 0) AS n_removed,
    coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM l WHERE l.doc_id = docs.doc_id AND NOT EXISTS (
        SELECT 1 FROM gone WHERE gone.doc_id = l.doc_id AND gone.pos = l.pos)), '') AS text
FROM documents docs LEFT JOIN g USING (doc_id)
"""
