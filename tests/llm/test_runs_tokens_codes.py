"""Periodic runs, token counts and vector codes, against plain restatements."""

import hashlib
import math
import random
import zlib

import brute
import numpy as np
import pytest
from brute import ODD
from tokenizers import Tokenizer

from vigilkb.llm import grid_codes, periodicity, queries, token_counts

VOCABULARY = queries.tokenizer_path()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ------------------------------------------------------------------ periodic runs

def plain_runs(words, least=24, exponent=3):
    """Every maximal repetition, period by period."""
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(least, exponent * q) and not any(q % d == 0 and part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, len(part), q))
            i = j + 1
    return sorted(out)


def repetitive(rng, size):
    k, words = rng.choice([1, 2, 3, 5, 40]), []
    while len(words) < size:
        unit = [f"w{rng.randrange(k)}" for _ in range(rng.randint(1, 12))]
        words += (unit * rng.randint(1, 9))[: rng.randint(1, 90)]
    return words


def test_runs_of_words():
    rng = random.Random(1)
    for _ in range(500):
        words = repetitive(rng, rng.randint(0, 150))
        for least, exponent in ((24, 3), (2, 2), (5, 3)):
            assert periodicity.runs_of(words, least, exponent) == plain_runs(words, least, exponent)


def test_each_word_costs_about_the_same():
    """The work of the automaton and the paths is counted in calls, not in seconds."""
    import sys

    def calls(words):
        seen = 0

        def count(_, event, __):
            nonlocal seen
            seen += event == "call"

        sys.setprofile(count)
        try:
            periodicity.runs_of(words)
        finally:
            sys.setprofile(None)
        return seen / len(words)

    rng = random.Random(3)
    unit = [rng.randrange(500) for _ in range(60)]
    for many in (lambda n: [0] * n, lambda n: (unit * (n // 60 + 1))[:n], lambda n: [rng.randrange(2) for _ in range(n)]):
        assert calls(many(16_000)) < 2 * calls(many(2_000)) + 5


def restated_runs(doc, text):
    words = brute.SPACE.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc, len(found), *best, 1000 * best[1] // best[2] if found else None,
        digest("".join(f"{s},{size},{q}\n" for s, size, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_runs_of_made_documents(spark):
    rng = random.Random(7)
    docs = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(repetitive(rng, rng.randint(0, 200)))) for i in range(300)]
    docs += [(900, "été 漢字 " * 20 + "fin"), (901, "a " * 3000 + "b " * 30 + "a\x1cb " * 40), (902, "x y " * 12), (903, "x y " * 11 + "x")]
    got = periodicity.digests(periodicity.periodic_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), queries.planted_places))
    assert rows(got) == sorted((restated_runs(*d) for d in docs), key=str)


def test_runs_of_the_table(spark, sf_dir, documents):
    # long texts take the period by period restatement too long
    short = {d: t for d, t in documents if len(t or "") < 4000}
    got = {r[0]: tuple(r) for r in queries.op11_runs(spark, sf_dir).collect()}
    assert len(got) == len(documents) and sum(r[1] > 0 for r in got.values()) > 50
    assert [got[d] for d in short] == [restated_runs(d, t) for d, t in short.items()]


def test_runs_of_odd_rows(spark, odd, no_docs):
    got = rows(periodicity.digests(periodicity.periodic_runs(odd)))
    want = []
    for doc, text, *_ in ODD:
        words = brute.SPACE.findall(text or "")
        found = [(0, len(words), 1)] if len(words) == 30_000 else []
        kept = words[:1] if found else words
        want.append((
            doc, len(found), *(found[0] if found else (None,) * 3), 30_000_000 if found else None,
            hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in found).encode()).hexdigest(),
            hashlib.sha256(" ".join(kept).encode()).hexdigest(),
        ))
    assert got == sorted(want, key=str)
    assert periodicity.periodic_runs(no_docs).count() == 0


def test_equal_exponents_take_the_first_run(spark):
    text = " ".join(["a b"] * 12 + ["-"] + ["c d"] * 12 + ["-"] + ["e"] * 12)
    got = periodicity.digests(periodicity.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (got.n_runs, got.start, got.length, got.period, got.exponent_milli) == (2, 0, 24, 2, 12_000)


# ------------------------------------------------------------------ token counts

def library(texts):
    tokenizer = Tokenizer.from_file(VOCABULARY)
    tokenizer.no_truncation()
    return [len(e.ids) for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_whole_tokens_are_proved():
    counter = token_counts.Counter(VOCABULARY)
    alphabet = {s: s for s in counter.whole if s.isascii()}
    assert len(counter.whole) > 30_000 and "'" in alphabet
    assert library(alphabet) == [1] * len(alphabet)


def test_token_counts_of_hard_texts(spark):
    rng = random.Random(2)
    parts = list("abcXYZ'sst 0129!?.<|>endoftext\t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x00\x7f\x85 　́éİΣẞ漢字🙂½٣²ßı")
    parts += ["가", "ﬁ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'re", "'LL", "'d ", " the "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(5000)]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY, limit=20)
    want = [(i, len(t.encode()), n, n > 20) for i, (t, n) in enumerate(zip(texts, library(texts), strict=True))]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want


def test_token_counts_of_the_table(spark, sf_dir, documents):
    want = sorted(((d, len((t or "").encode()), n, n > 2048) for (d, t), n in zip(documents, library(t for _, t in documents), strict=True)), key=str)
    assert rows(queries.op12_tokens(spark, sf_dir)) == want


def test_token_counts_with_a_small_memo(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_WORDS", 3)
    counter = token_counts.Counter(VOCABULARY)
    texts = ["one unlikelyword two2 three'll four", "five one unlikelyword un-likely", ""] * 3
    assert [counter.text(t.encode()) for t in texts] == library(texts)


def test_token_counts_of_odd_rows(spark, odd, no_docs):
    want = sorted(((r[0], len((r[1] or "").encode()), n, n > 2048) for r, n in zip(ODD, library(r[1] for r in ODD), strict=True)), key=str)
    assert rows(token_counts.token_counts(odd, VOCABULARY)) == want
    assert token_counts.token_counts(no_docs, VOCABULARY).count() == 0


def test_vocabularies_with_white_space_in_tokens_are_refused():
    with pytest.raises(ValueError, match="white space"):
        token_counts.Counter(queries.tokenizer_path("byte_bpe_50k.json"))


# ------------------------------------------------------------------ vector codes

def restated_codes(data):
    """(vec_id, code, error, label_error, digest) with plain integers."""
    kept = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[1]))
    size = len(kept[0][1]) // 16
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, v, _ in kept[:64]] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for step in range(3):
        codes = [[min((apart(part(v, p), e), k) for k, e in enumerate(books[p])) for p in range(16)] for _, v, _ in kept]
        if step < 2:
            for p in range(16):
                for k in range(len(books[p])):
                    mine = [part(v, p) for (_, v, _), c in zip(kept, codes, strict=True) if c[p][1] == k]
                    if mine:
                        books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(d for d, _ in c) for c in codes]
    total = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        total[lab] = total.get(lab, 0) + e
    return [(i, "".join(f"{k:02x}" for _, k in c), e, total[lab], digest) for (i, _, lab), c, e in zip(kept, codes, errors, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize(("dimension", "spread"), [(16, 1.0), (64, 0.125), (48, 0.004)])
def test_codes_of_made_vectors(spark, dimension, spread):
    rng = np.random.default_rng(dimension)
    data = [(int(i), [float(np.float32(x)) for x in rng.normal(0, spread, dimension)], int(rng.integers(0, 4))) for i in rng.permutation(300)]
    data += [(i, v, None) for i, v, _ in data[:40]]  # the same vectors again, under another label
    data += [(1000, None, 1), (1001, [None] * dimension, 1), (1002, [math.nan] * dimension, 1), (1003, [math.inf] + [0.0] * (dimension - 1), 1)]
    got = grid_codes.with_label_errors(grid_codes.codes(spark.createDataFrame(data, VECTORS).repartition(5)))
    assert rows(got) == sorted(restated_codes(data), key=str)


def test_candidates_of_a_cell_hold_every_nearest_entry():
    rng = np.random.default_rng(4)
    entries = rng.integers(-60, 60, (64, 4))
    points = np.concatenate([rng.integers(-200, 200, (3000, 4)), rng.integers(-8, 8, (2000, 4)), entries, entries[:3] + 10**6])
    distance = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    grid = grid_codes.Grid(entries)
    for many in (1 << 15, 100):  # the second forgets its cells again and again
        grid_codes.MOST_CELLS, before = many, grid_codes.MOST_CELLS
        try:
            for a in range(0, len(points), 50):
                best, apart = grid.nearest(points[a : a + 50])
                assert (best == distance[a : a + 50].argmin(axis=1)).all() and (apart == distance[a : a + 50].min(axis=1)).all()
        finally:
            grid_codes.MOST_CELLS = before
    grid = grid_codes.Grid(entries)
    grid.nearest(points)
    assert grid.lists.shape[1] < 64  # the boxes do exclude entries


def test_codes_of_odd_rows(spark):
    wide = "vec_id long, embedding array<double>, label string, many long, part int, of string"
    zero, far = [0.0] * 32, [1e30] + [-1e30] + [0.5] * 30
    data = [
        (1, zero, "a", 1, 1, "x"), (1, zero, "a", 1, 1, "x"), (None, far, None, 1, 1, "x"), (2, far, None, 1, 1, "x"),
        (0, [1.0] * 7, "a", 1, 1, "x"), (-1, [], "a", 1, 1, "x"), (3, [1.0] * 16, "a", 1, 1, "x"), (4, None, "a", 1, 1, "x"),
    ]
    got = rows(grid_codes.with_label_errors(grid_codes.codes(spark.createDataFrame(data, wide))))
    assert [r[:4] for r in got] == [(1, "00" * 16, 0, 0)] * 2 + [(2, got[2][1], 0, 0), (None, got[3][1], 0, 0)]
    assert got[2][1] == got[3][1] == "02" + "02" * 15
    none = grid_codes.with_label_errors(grid_codes.codes(spark.createDataFrame(data[:0], wide)))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_rare_and_hot_labels(spark):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(0, 1, 16)], None if i % 3 == 0 else i if i % 3 == 1 else 7) for i in range(3300)]
    got = grid_codes.with_label_errors(grid_codes.codes(spark.createDataFrame(data, VECTORS))).collect()
    assert len(got) == 3300
    total = {}
    for r in got:
        total[data[r.vec_id][2]] = total.get(data[r.vec_id][2], 0) + r.error
    assert all(r.label_error == total[data[r.vec_id][2]] for r in got)
