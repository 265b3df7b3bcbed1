"""One-event-at-a-time restatement of a run, in plain Python, to compare with."""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np

WEIGHT = dict(contains=1.5, mentions=0.5, on_date=0.4, has_topic=0.7, derived_from=2.5, similar_to=1.0, supersedes_content=3.0)
STOP = set("the a an of for to and in on at by with is are as or".split())


def walk(n, edges, start, alpha):
    w = np.zeros((n, n))
    for a, b, x in edges:
        w[a, b] += x
    out = w.sum(axis=1)
    step = w / np.where(out == 0, 1, out)[:, None]
    p = np.zeros(n)
    for i, m in start.items():
        p[i] += m
    p /= p.sum()
    r = p.copy()
    for _ in range(100):
        nxt = (1 - alpha) * p + alpha * (step.T @ r) + alpha * r[out == 0].sum() * p
        moved, r = np.abs(nxt - r).sum(), nxt
        if moved < 1e-9:
            break
    return r


class Base:
    """State of one knowledge base; ``keys`` holds, per seq, the vector, the dates and
    topics, and the entities known before and after the event's own commit."""

    def __init__(self, keys, recency):
        self.keys, self.recency = keys, recency
        self.live, self.doc, self.facets = [], {}, {}
        self.order, self.edges, self.source, self.gone = {}, [], {}, set()

    def knn(self, vec, k):
        best = sorted(((-round(float(np.dot(vec, self.keys[c]["vec"])), 6), c) for c in self.live))
        return [(c, -s) for s, c in best[:k]]

    def facets_of(self, e, entities):
        k = self.keys[e["seq"]]
        toks = {t for t in re.findall("[a-z0-9]+", e["title"].lower()) if len(t) > 2 and t not in STOP}
        return ({("entity", x) for x in entities} | {("date", x) for x in k["dates"]} | {("topic", x) for x in k["topics"]}
                | {("source", e["source_id"])} | {("title", t) for t in toks})

    def metadata(self, e):
        mine = self.facets_of(e, self.keys[e["seq"]]["before"])
        docs = defaultdict(set)
        for c in self.live:
            docs[self.doc[c]] |= {v for kind, v in self.facets[c] if kind == "source"}

        def idf(f):
            if f[0] == "source":
                df, n = sum(f[1] in s for s in docs.values()), len(docs)
            else:
                df, n = sum(f in self.facets[c] for c in self.live), len(self.live)
            return math.log((max(n, 1) + 1) / (df + 1)) + 1

        scored = [(-round(sum(idf(f) for f in mine & self.facets[c]), 6), c) for c in self.live if mine & self.facets[c]]
        return [c for _, c in sorted(scored)[:5]]

    def _rank(self, r, skip=()):
        hit = [(-round(math.log(r[i]), 9), i, int(name[6:])) for name, i in self.order.items()
               if name.startswith("chunk:") and int(name[6:]) in self.live and r[i] > 0 and i not in skip]
        return [c for _, _, c in sorted(hit)[:5]]

    def graph(self, e):
        k = self.keys[e["seq"]]
        seeds = [self.source.get(e["source_id"])] + [f"date:{x}" for x in k["dates"]] + [f"topic:{x}" for x in k["topics"]] + [f"ent:{x}" for x in k["before"]]
        seeds = [self.order[s] for s in dict.fromkeys(seeds) if s in self.order]
        if not seeds:
            return []
        flat, near = [], defaultdict(set)
        for s, d, rel, w, on in self.edges:
            if on:
                a, b = self.order[s], self.order[d]
                flat += [(a, b, w), (b, a, w)]
                near[a].add(b)
                near[b].add(a)
        r = walk(len(self.order), flat, {s: 1 / (1 + len(near[s])) for s in seeds}, 0.85)
        return self._rank(r, set(seeds))

    def hybrid(self, e):
        start = defaultdict(float)
        for c, s in self.knn(self.keys[e["seq"]]["vec"], 5):
            if s > 0:
                start[self.order[f"chunk:{c}"]] += s * s
        for x in self.keys[e["seq"]]["before"]:
            if f"ent:{x}" in self.order:
                start[self.order[f"ent:{x}"]] += 1 / (1 + sum((s == f"ent:{x}") + (d == f"ent:{x}") for s, d, *_ in self.edges))
        for c, d in self.doc.items():
            if d == e["doc_id"]:
                start[self.order[f"chunk:{c}"]] += 3.0
        if not start:
            return []
        flat = []
        for s, d, rel, w, on in self.edges:
            if on:
                flat.append((self.order[s], self.order[d], w))
                if rel != "similar_to":
                    flat.append((self.order[d], self.order[s], w))
        return self._rank(walk(len(self.order), flat, start, 0.8))

    def retire(self, chunks):
        for c in chunks:
            if c in self.live:
                self.live.remove(c)
                me = f"chunk:{c}"
                self.edges = [(s, d, rel, w, on and not (rel in ("similar_to", "supersedes_content") and me in (s, d)))
                              for s, d, rel, w, on in self.edges]

    def commit(self, e):
        seq, k = e["seq"], self.keys[e["seq"]]
        me, doc = f"chunk:{seq}", f"doc:{e['doc_id']}"
        near = [(c, s) for c, s in self.knn(k["vec"], 5) if s > 0]
        self.live.append(seq)
        self.doc[seq] = e["doc_id"]
        self.facets[seq] = self.facets_of(e, k["after"])
        for n in [me, doc] + [f"date:{x}" for x in k["dates"]] + [f"topic:{x}" for x in k["topics"]] + [f"ent:{x}" for x in k["after"]]:
            self.order.setdefault(n, len(self.order))
        self.source[e["source_id"]] = doc

        def add(s, d, rel, scale=1.0):
            self.edges.append((s, d, rel, WEIGHT[rel] * scale, True))

        add(doc, me, "contains")
        for kind, rel, values in (("date", "on_date", k["dates"]), ("topic", "has_topic", k["topics"]), ("ent", "mentions", k["after"])):
            for v in values:
                add(me, f"{kind}:{v}", rel)
        for d in dict.fromkeys(e["derived_from"]):
            if f"doc:{d}" in self.order:
                add(me, f"doc:{d}", "derived_from")
        for c, s in near:
            add(me, f"chunk:{c}", "similar_to", s)
            add(f"chunk:{c}", me, "similar_to", s)

    def run(self, events, strategy):
        """{seq: (candidates, label)}"""
        out = {}
        for e in events:
            if e["op"] in ("update", "delete"):
                self.retire([c for c in list(self.live) if self.doc[c] == e["doc_id"]])
            if e["op"] == "delete":
                continue
            found = {"vector-only": lambda: [c for c, _ in self.knn(self.keys[e["seq"]]["vec"], 5)],
                     "metadata-only": lambda: self.metadata(e), "graph-only": lambda: self.graph(e),
                     "hybrid": lambda: self.hybrid(e)}[strategy]()
            hit = [c for c in found if self.doc[c] in e["implicates"]] if e["expected_label"] != "clean" else []
            out[e["seq"]] = (found, e["expected_label"] if hit else "clean")
            if self.recency:
                self.retire(hit)
            self.commit(e)
            if self.recency and hit:
                for c in hit:
                    self.edges.append((f"chunk:{e['seq']}", f"chunk:{c}", "supersedes_content", 3.0, True))
        return out
