"""The adjudicated fold against one mention after another in plain Python."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilkb.operators import adjudication as ad
from vigilkb.operators import entities as er
from vigilkb.plans.runs import Setup, enrich

MENTIONS = "seq long, pos int, type string, sig string, surface string, vec array<double>, context string"
HIGH, LOW, FLOOR, K = 0.9, 0.55, 0.3, 3


def shown(candidates):
    return ";".join(f"{c['canonical_id']}/{c['name']}/{','.join(c['aliases'])}" for c in candidates)


def judge(asks):
    """Decides by a checksum of all that it is shown: the first or last candidate, none, or one that is not there."""
    asked.extend((r.sig, r.top, r.prompt) for r in asks.collect())
    text = F.concat("sig", F.lit("?"), F.array_join(F.transform(
        "candidates", lambda c: F.concat(c["canonical_id"], F.lit("/"), c["name"], F.lit("/"), F.array_join(c["aliases"], ","))), ";"))
    h = F.crc32(text.cast("binary")) % 4
    named = F.when(h == 0, F.element_at("candidates", 1)["canonical_id"]).when(h == 1, F.element_at("candidates", -1)["canonical_id"]).when(h == 3, F.lit("nobody"))
    verdict = F.struct(
        F.when(h == 2, "create_new").otherwise("merge").alias("decision"), named.alias("candidate_id"), F.lit(0.75).alias("confidence"), F.lit("why").alias("rationale"))
    return asks.select("sig", "top", verdict.alias("verdict"))


asked = []


class Plain:
    def __init__(self):
        self.store, self.count, self.verdicts, self.calls = [], defaultdict(int), {}, []

    def decide(self, sig, surface, near):
        key = (sig, near[0][1]["sig"])
        if key not in self.verdicts:
            self.calls.append(key)
            cands = [{"canonical_id": e["sig"], "name": e["name"], "aliases": sorted(e["aliases"])} for _, e in near]
            h = zlib.crc32(f"{sig}?{shown(cands)}".encode()) % 4
            self.verdicts[key] = {0: near[0][1]["sig"], 1: near[-1][1]["sig"]}.get(h)
        return self.verdicts[key]

    def run(self, rows, vecs):
        out = {}
        for seq in sorted({r[0] for r in rows}):
            pending = []
            for _, pos, kind, sig, surface, _, _ in sorted(r for r in rows if r[0] == seq):
                scored = [(round(float(vecs[sig] @ vecs[e["sig"]]), 6), e) for e in self.store if e["type"] == kind]
                near = sorted((x for x in scored if x[0] >= FLOOR), key=lambda x: -x[0])[:K]
                top = near[0][0] if near else 0.0
                band = "low" if not near or top < LOW else "high" if top >= HIGH else "gray"
                match = near[0][1]["sig"] if band == "high" else self.decide(sig, surface, near) if band == "gray" else None
                pending.append((pos, kind, sig, surface, match, band))
            minted, by = {}, {e["sig"]: e for e in self.store}
            for pos, kind, sig, surface, match, band in pending:
                if match is not None:
                    by[match]["aliases"].add(surface)
                    entity = by[match]
                elif sig in minted:
                    entity = minted[sig]
                else:
                    self.count[kind] += 1
                    entity = minted[sig] = {"id": f"{kind}-{self.count[kind]}", "sig": sig, "name": surface, "type": kind, "aliases": {surface}}
                    self.store.append(entity)
                out[seq, pos] = (by[match]["id"] if match is not None else None, entity["id"], band)
        return out


def made(seed, n, spread, signatures=24):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, 6))
    unit = lambda x: x / np.linalg.norm(x)
    kind = {s: "person" if s % 2 else "org" for s in range(signatures)}
    vecs = {f"{kind[s]}|{s}": unit(centres[s % 3] + spread * rng.normal(size=6)) for s in range(signatures)}
    rows = []
    for seq in range(1, n + 1):
        for pos in range(int(rng.integers(0, 4))):
            s = int(rng.integers(0, signatures))
            sig = f"{kind[s]}|{s}"
            rows.append((seq, pos, kind[s], sig, f"Name {s}" + " Jr" * int(rng.integers(0, 2)), [float(x) for x in vecs[sig]], "ctx"))
    return rows, vecs


@pytest.mark.parametrize(("seed", "spread", "span"), [(1, 0.6, None), (2, 0.8, 16)])
def test_fold_equals_sequential(spark, seed, spread, span):
    rows, vecs = made(seed, 20, spread, 16)
    df = spark.createDataFrame(rows, MENTIONS)
    plain = Plain()
    want = plain.run(rows, vecs)
    asked.clear()
    kw = dict(tau_high=HIGH, tau_low=LOW, k=K, floor=FLOOR, span=span)
    res, ents, said = ad.adjudicated_fold(df, judge, **kw)
    got = {(r.seq, r.pos): (r.matched, r.canonical_id, r.band) for r in res.collect()}
    assert got == want
    assert {r.canonical_id: (r.sig, r.name) for r in ents.collect()} == {e["id"]: (e["sig"], e["name"]) for e in plain.store}
    # every question once, and no question that one mention after another would not have asked
    assert sorted((s, t) for s, t, _ in asked) == sorted(plain.calls) and len(asked) > 2
    assert {(r.sig, r.top): r.verdict.candidate_id for r in said.collect()} == plain.verdicts
    assert any("aliases=['Name" in p for _, _, p in asked)
    aliases = {r.canonical_id: set(r.aliases) for r in er.alias_clusters(res, ents).collect()}
    assert aliases == {e["id"]: e["aliases"] for e in plain.store}
    log = er.resolution_log(res).collect()
    merges = [r for r in log if r.type == "entity_merge"]
    assert all((r.payload.confidence, r.payload.rationale) == ((0.75, "why") if r.payload.band == "gray" else (1.0, "auto-merge (high)")) for r in merges)
    assert any(r.payload.band == "gray" for r in merges) and all(r.payload.confidence is None for r in log if r.type == "entity_create")


def test_fold_continues_an_earlier_one(spark):
    rows, vecs = made(5, 14, 0.7, 12)
    df = spark.createDataFrame(rows, MENTIONS)
    want = Plain().run(rows, vecs)
    asked.clear()
    kw = dict(tau_high=HIGH, tau_low=LOW, k=K, floor=FLOOR, span=None)
    first, known, said = ad.adjudicated_fold(df.where("seq <= 6"), judge, **kw)
    names = er.alias_clusters(first, known).join(known.select("canonical_id", "sig"), "canonical_id").select("sig", F.explode("aliases").alias("alias"))
    later, every, _ = ad.adjudicated_fold(df.where("seq > 6"), judge, known=known, known_as=names, verdicts=said, **kw)
    got = {(r.seq, r.pos): (r.matched, r.canonical_id, r.band) for r in first.unionByName(later).collect()}
    assert got == want and every.count() == len({c for _, c, _ in want.values()})
    assert len({(s, t) for s, t, _ in asked}) == len(asked)


def test_no_mentions(spark):
    res, ents, said = ad.adjudicated_fold(spark.createDataFrame([], MENTIONS), judge)
    assert res.count() == ents.count() == said.count() == 0


def test_a_run_with_an_adjudicator(spark, story_df):
    """Low thresholds put the names of the story into the gray band; the adjudicator takes all for the first one."""
    shown = []

    def same(asks):
        shown.extend(r.prompt for r in asks.collect())
        return asks.select("sig", "top", F.struct(F.lit("merge").alias("decision"), F.col("top").alias("candidate_id"), F.lit(1.0).alias("confidence"), F.lit("").alias("rationale")).alias("verdict"))

    rows, resolution, entities = enrich(story_df, Setup(adjudicator=same, tau_high=0.999, tau_low=-1.0))
    assert shown and all(p.startswith("MENTION: ") for p in shown)
    assert {r.band for r in resolution.where("seq > 1").collect()} <= {"gray", "high", "low"}
    assert entities.count() < enrich(story_df, Setup(tau_high=0.999, tau_low=-1.0))[2].count()
