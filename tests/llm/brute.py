"""Plain restatements of the operators' results, one document at a time."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

#: Null, empty, blank and long texts, ties, repeats, and a column whose name an operator might use itself.
ODD = [
    (1, None, "en", "a", "x"), (2, "", "en", "a", "x"), (3, " \n\t ", None, None, "x"),
    (4, "one two three", "en", "b", None), (5, "one two three", "en", "b", "y"),
    (6, "word " * 30_000, "en", "a", "x"), (7, "ab" * 60_000, "en", "a", "x"),
    (8, "été à l'œuvre — 漢字 🙂 token = \"24be64439e3e49cf46b2d7c90f3602a3\" fin", "fr", "a", "x"),
    (8, "été à l'œuvre — 漢字 🙂 token = \"24be64439e3e49cf46b2d7c90f3602a3\" fin", "fr", "a", "x"),
    (None, "a text without an id that is long enough to be looked at by most of the operators here", "en", None, "x"),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, score string"

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def quality_counts(text):
    words = SPACE.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(SPACE.search(line))
        seen.add(line)
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def base_spans(text):
    text = text or ""
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    listed = [f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(out)]
    kinds = Counter(k for _, k, _ in out)
    return kinds[0], kinds[1], kinds[2], hashlib.sha256(",".join(listed).encode()).hexdigest(), listed


def bag(text):
    words = SPACE.findall(text or "")
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if k else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def near_classes(docs):
    """doc_id -> smallest doc_id of its component of links at 0.8, by comparing all pairs that share a shingle."""
    bags = {d: bag(t) for d, t in docs}
    parent = {d: d for d in bags}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = {}
    for d, b in bags.items():
        for g in b:
            holders.setdefault(g, []).append(d)
    pairs = {(min(x, y), max(x, y)) for h in holders.values() for x in h for y in h if x != y}
    for x, y in pairs:
        if jaccard(bags[x], bags[y]) >= 0.8:
            a, b = find(x), find(y)
            parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in bags}


def chat_digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    learnt = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt)


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def kept_lines(docs, least):
    """[(doc_id, kept lines)] in order: a line of ``least`` code points goes if an earlier one is within one edit."""
    out, earlier = [], []
    for d, text in sorted(docs):
        keep = []
        for line in (text or "").split("\n"):
            if len(line) < least or not any(within_one_edit(x, line) for x in earlier):
                keep.append(line)
            if len(line) >= least:
                earlier.append(line)
        out.append((d, keep))
    return out


def repeated_bytes(docs, width=50):
    """[(doc_id, bytes, covered flags)] by looking up every window in the documents with a smaller id."""
    first = {}
    rows = [(d, (t or "").encode()) for d, t in docs]
    for d, b in rows:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\x01" * width
        out.append((d, b, bytes(gone)))
    return out
