"""Operators that compare documents with each other, and the pipeline, against plain restatements."""

import hashlib
import random
import re
from collections import Counter

import brute
import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import ODD, ODD_SCHEMA
from pyspark.sql import functions as F

from vigilkb.llm import lines, neardup, packing, quality, queries, suffixes, surrogates
from vigilkb.llm.common import table


def made(seed, n, vocabulary=40):
    """Random texts with copies, near copies, shared lines and passages."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9))).strip() or "x" for _ in range(vocabulary)]
    sentence = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [sentence(12) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.25:
            text = rng.choice(docs)[1]
        elif docs and kind < 0.5:
            text = list(rng.choice(docs)[1])
            for _ in range(rng.randint(1, 3)):
                if text:
                    text[rng.randrange(len(text))] = rng.choice("abcxyz \n")
            text = "".join(text)
        else:
            text = "\n".join(rng.choice(shared) if rng.random() < 0.3 else sentence(rng.randint(0, 25)) for _ in range(rng.randint(1, 6)))
        docs.append((i, text))
    rng.shuffle(docs)
    return docs


# ------------------------------------------------------------------ suffix arrays

def test_suffix_order():
    rng = random.Random(5)
    for _ in range(500):
        text = [rng.randint(0, rng.choice([1, 2, 6])) for _ in range(rng.randint(0, 60))]
        assert suffixes.suffix_order(text) == sorted(range(len(text)), key=lambda i: text[i:])


def repeated(docs):
    return sorted((
        (d, len(b), sum(g), len(re.findall(b"\x01+", g)), hashlib.sha256(bytes(x for x, y in zip(b, g) if not y)).hexdigest())
        for d, b, g in brute.repeated_bytes(docs)
    ), key=str)


@pytest.mark.parametrize("hot", [suffixes.HOT_BLOCKS, 1])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(suffixes, "HOT_BLOCKS", hot)
    docs = [*made(2, 250), (900, "ab" * 3000), (901, "x" + "ab" * 2000), (902, "z" * 120), (903, "z" * 90 + "y")]
    got = suffixes.repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == repeated(docs)


def test_repeated_bytes_of_the_table(spark, sf_dir, documents):
    assert sorted(map(tuple, queries.op3_suffixes(spark, sf_dir).collect()), key=str) == repeated(documents)


def test_repeated_bytes_of_odd_rows(spark, odd, no_docs):
    got = sorted(map(tuple, suffixes.repeats(odd).collect()), key=str)
    named = [(d, t) for d, t, *_ in ODD if d is not None]
    alone = [(d, t) for d, t, *_ in ODD if d is None]
    whole = [(d, len(t.encode()), 0, 0, hashlib.sha256(t.encode()).hexdigest()) for d, t in alone]
    assert got == sorted(repeated(named) + whole, key=str)
    assert suffixes.repeats(no_docs).count() == 0


def test_anchors_cut_very_long_texts(monkeypatch):
    data = np.frombuffer(random.Random(1).randbytes(20_000), np.uint8) % 4
    whole = suffixes.anchors(data, np.array([0, len(data)]))
    monkeypatch.setattr(suffixes, "_PIECE", 3000)
    pieces = suffixes.anchors(data, np.array([0, len(data)]))
    spread = lambda a: {(s + i, g) for s, n, g, _, _ in zip(*(x.tolist() for x in a)) for i in range(n)}
    assert spread(whole) == spread(pieces) and whole[1].sum() == len(data) - 49


# ------------------------------------------------------------------ line dedup

def test_lines_match_brute_force(spark):
    docs = made(3, 120)
    got = {r.doc_id: r.text for r in lines.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {d: "\n".join(kept) for d, kept in brute.kept_lines(docs, lines.LEAST_CHARS)}


def test_every_single_edit_is_found(spark):
    base = "the quick brown fox jumps over the lazy dog 🙂 and on"
    edits = [base[:i] + base[i + 1 :] for i in range(len(base))] + [base[:i] + "q" + base[i:] for i in range(len(base) + 1)]
    edits += [base[:i] + "#" + base[i + 1 :] for i in range(len(base))]
    far = [base[:i] + "~~" + base[i + 2 :] for i in range(0, len(base) - 2, 7)]
    docs = [(0, base)] + [(i + 1, e) for i, e in enumerate(edits)] + [(1000 + i, e) for i, e in enumerate(far)]
    got = {r.doc_id: r.text for r in lines.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i + 1] == "" for i in range(len(edits))) and all(got[1000 + i] == e for i, e in enumerate(far))
    long = "abcdefghij" * 500
    docs = [(1, long), (2, long[:2345] + long[2346:]), (3, long[:99] + "zz" + long[101:])]
    assert [r.text == "" for r in lines.report(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id").collect()] == [False, True, False]


def test_lines_match_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(con.execute(f"SELECT doc_id, n_lines, n_removed, text FROM ({lines.ORACLE})").fetchall())
    assert sorted(map(tuple, queries.op4_lines(spark, sf_dir).collect())) == want


def test_lines_of_odd_rows(spark, odd, no_docs):
    clash = odd.withColumn("n_lines", F.lit("mine")).withColumn("first", F.lit(1))
    got = lines.dedup_lines(clash)
    assert got.columns == clash.columns and got.count() == len(ODD) and got.where("n_lines != 'mine'").count() == 0
    assert lines.report(odd).where("text is null").count() == 1
    assert lines.report(no_docs).count() == 0


def test_lines_run_without_python(spark, sf_dir):
    plan = queries.op4_lines(spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_different_texts_of_one_id_and_clashing_names(spark):
    first, other = "abcdefghij klmnopqrst uvwxyz", "0123456789 9876543210 zzzzzz"
    near, nearer = first[:-1] + "Q", first[:-2] + "RQ"
    docs = [(0, first), (1, other), (1, near), (2, nearer), (3, other), (3, other)]
    clash = "doc_id long, text string, __gone int, lost int, lost_doc int, lost_mark int, mark int, pos int, line int, first int"
    got = lines.dedup_lines(spark.createDataFrame([(*d, *range(8)) for d in docs], clash))
    assert sorted(map(tuple, got.collect())) == [(0, first, *range(8)), (1, other, *range(8))]
    # two texts of one id, several lines each: what one loses, the other keeps
    a, b = "\n".join([first, "only in the first text", "a line of the first text"]), "\n".join(["only in the second text", first, "a line of the second one"])
    got = lines.report(spark.createDataFrame([(7, a), (7, b)], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in got) == [0, 1] and "only in" in got[0].text and "only in" in got[1].text
    assert sum(first in r.text for r in got) == 1


# ------------------------------------------------------------------ near duplicates

@pytest.mark.parametrize("seed", [11, 12])
def test_near_classes(spark, seed):
    docs = made(seed, 220)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = brute.near_classes(docs)
    assert got == {d: (c if brute.bag(dict(docs)[d]) else d) for d, c in want.items()}


def test_near_classes_of_the_table(spark, sf_dir, documents):
    got = {r.doc_id: r.class_id for r in queries.op9_neardup(spark, sf_dir).collect()}
    assert got == brute.near_classes(documents)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    pairs = []
    for overlap in (0.3, 0.6, 0.9):
        a = [w for w in words[:200] for _ in range(rng.integers(1, 9))]
        b = [w for w in a if rng.random() < overlap] + [w for w in words[200:] for _ in range(int((1 - overlap) * 8))]
        pairs.append((a, b))
    # one-word shingles keep the multiplicities
    old, neardup.SHINGLE_WORDS = neardup.SHINGLE_WORDS, 1
    try:
        for a, b in pairs:
            seen = []
            for salt in range(12):
                texts = pa.array([" ".join(f"{salt}{w}" for w in x) for x in (a, b)])
                (_, _, h, where), = neardup.shingles(texts)
                s = neardup.signatures(h, where)
                seen.append((s[0] == s[1]).mean())
            from collections import Counter

            truth = brute.jaccard(Counter(a), Counter(b))
            assert abs(np.mean(seen) - truth) < 4 * np.sqrt(truth * (1 - truth) / (12 * neardup.SIGNATURE)), truth
    finally:
        neardup.SHINGLE_WORDS = old


def test_bands_do_not_depend_on_the_block():
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(n)) for n in (1, 34, 64, 124, 254) * 20]

    def bands(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
        return [keys for b in neardup._sketch([batch]) for keys in b.column(4).to_pylist()]

    assert bands(texts) == [keys for t in texts for keys in bands([t])]


def test_bands_miss_few_links():
    assert (1 - neardup.LEAST**neardup.ROWS) ** neardup.BANDS < 1e-7


def test_no_link_is_excluded_before_the_comparison(spark):
    rng = random.Random(9)
    pairs = []
    for n in [1, 2, 9, 18, 90, 400, 3000] * 12:
        a = [rng.randrange(n) for _ in range(n)]
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 8))):
            b[rng.randrange(n)] = n + rng.randrange(n)
        pairs.append((a, b + [0] * rng.choice([0, 0, n // 9])))
    rows, truth = [], []
    for a, b in pairs:
        x, y = (neardup.mix(np.array(v, np.uint64)) for v in (a, b))
        both = neardup.overlap(x, y)
        truth.append(both >= 0.8 * (len(a) + len(b) - both) - 1e-9)
        p, q = (neardup.parities(v, np.array([0, len(v)]))[0].tolist() for v in (x, y))
        rows.append((len(rows), len(a), p, len(b), q))
    df = spark.createDataFrame(rows, "i long, n long, odd array<long>, hn long, hodd array<long>")
    may = {r.i for r in df.where(neardup.may_link("n", "odd", "hn", "hodd")).collect()}
    assert {i for i, t in enumerate(truth) if t} <= may and len(may) < len(pairs)


def test_parities_tell_repeats_apart(spark):
    """Shingles that one of two documents has twice, and the other not at all, count as two; equal ones in any order as none."""
    base = list(range(100))
    twice = [base + 2 * list(range(200, 210)), base + 2 * list(range(300, 310)), (base + 2 * list(range(200, 210)))[::-1]]
    a, b, c = (neardup.parities(neardup.mix(np.array(v, np.uint64)), np.array([0, len(v)]))[0].tolist() for v in twice)
    df = spark.createDataFrame([(0, 120, a, 120, b), (1, 120, a, 120, c)], "i long, n long, odd array<long>, hn long, hodd array<long>")
    assert [r.i for r in df.where(neardup.may_link("n", "odd", "hn", "hodd")).collect()] == [1] and a == c


def test_near_pairs_are_compared_once(spark, monkeypatch):
    """Near copies of a text, most of them below 0.8 to each other, share many bands; no pair is compared twice."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    base, docs = [word() for _ in range(150)], []
    for i in range(120):
        text = list(base)
        for j in rng.choice(150, rng.integers(1, 6), replace=False):
            text[j] = word()
        docs.append((i, " ".join(text)))
    seen, cut = [], neardup.cut

    def told(df):
        out = cut(df)
        if "hshared" in df._jdf.queryExecution().analyzed().toString() and df.columns == ["a", "b"]:
            seen.extend(map(tuple, out.collect()))
        return out

    monkeypatch.setattr(neardup, "cut", told)
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert seen and len(seen) == len(set(seen))
    bags = [Counter(tuple(t.split()[i : i + 5]) for i in range(146)) for _, t in docs]
    want = list(range(len(docs)))
    for i, x in enumerate(bags):
        for j in range(i):
            both = (x & bags[j]).total()
            if both >= 0.8 * (292 - both) - 1e-9 and want[i] != want[j]:
                want = [min(want[i], want[j]) if c in (want[i], want[j]) else c for c in want]
    assert got == dict(enumerate(want))


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 302), (300, 302)]
    got = {r.rep: r["class"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + i: 100 for i in range(1, 50)}, 301: 300, 302: 300}


def test_near_odd_rows(spark, odd, no_docs):
    got = {r.doc_id: r.class_id for r in neardup.classes(odd).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert neardup.classes(no_docs).count() == 0
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1


# ------------------------------------------------------------------ surrogates

KEY = "a key"
PEOPLE = [
    (1, "Write to anna.kern@mail.example.com or call +1 (988) 555-2485 today. Mrs. Anna Kern said so; Kern was sure."),
    (2, "Card 4785 3805 9239 1141 and 4785380592391141, ssn 123-45-6789, host 10.20.30.40. Herr Kern kam."),
    (3, "ANNA.KERN@MAIL.EXAMPLE.COM +19885552485 DE89370400440532013000 und Госпожа Иванова Петрова."),
    (4, "nothing here: 12.5% of 2024-01-01, v1.2.3, 555-24"),
]


def test_surrogates(spark):
    got = {r.doc_id: r.text for r in surrogates.replace_entities(spark.createDataFrame(PEOPLE, "doc_id long, text string"), KEY).collect()}
    assert got[4] == PEOPLE[3][1]
    for real in ("anna", "Kern", "555-2485", "4785 3805", "4785380592391141", "123-45-6789", "10.20.30.40", "370400440532013000", "Иванова"):
        assert not any(real in t for t in got.values()), real
    mail = re.search(r"[a-z.]+@[a-z.]+\.com", got[1])[0]
    assert mail.upper() in got[3]  # one address, two formats
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1])[0]
    assert re.sub(r"\D", "", phone) in got[3]
    spaced, plain = re.search(r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", got[2]).groups()
    digits = [int(c) for c in plain]
    assert spaced.replace(" ", "") == plain and plain[0] == "4"
    assert (sum(digits[1::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[::2])) % 10 == 0
    given, family = re.search(r"Mrs\. (\w+) (\w+) said so; \2 was sure", got[1]).groups()
    assert given.endswith("lia") and f"Herr {family} kam" in got[2]
    assert re.search(r"Госпожа [а-яА-Я]+лия [а-яА-Я]+\.", got[3]) and re.search(r"DE\d{20}", got[3])
    again = {r.doc_id: r.text for r in surrogates.replace_entities(spark.createDataFrame(PEOPLE, "doc_id long, text string"), KEY).collect()}
    other = {r.doc_id: r.text for r in surrogates.replace_entities(spark.createDataFrame(PEOPLE, "doc_id long, text string"), "another").collect()}
    assert again == got and other[1] != got[1]


def test_given_names_are_replaced_alone(spark):
    docs = [
        (1, "Mrs Anna Kern came. Anna said that Kern and Annabel know Anna."), (2, "Anna is not addressed here."),
        (3, "Mr Paul Anna-Kern and Mrs Anna Paul: Paul, Anna, Anna-Kern."),
    ]
    got = {r.doc_id: r.text for r in surrogates.replace_entities(spark.createDataFrame(docs, "doc_id long, text string"), KEY).collect()}
    given, family = re.match(r"Mrs (\w+) (\w+) came", got[1]).groups()
    assert got[1] == f"Mrs {given} {family} came. {given} said that {family} and Annabel know {given}." and "Anna" not in (given, family)
    assert got[2] == docs[1][1]
    paul, double, anna, second = re.match(r"Mr (\w+) (\w+) and Mrs (\w+) (\w+):", got[3]).groups()
    assert anna == given and got[3].endswith(f": {second}, {anna}, {double}.")


def test_surrogates_stay_distinct(spark):
    names = [(i, f"family_n_latin", f"name{i}") for i in range(3000)]
    numbers = [(i, "ip", f"{i % 250}.{i // 250}.1.1") for i in range(3000)]
    entities = spark.createDataFrame([r[1:] for r in names + numbers], "kind string, value string")
    drawn = surrogates.assign(entities, KEY).collect()
    for kind in ("family_n_latin", "ip"):
        got = [(r.value, r.drawn) for r in drawn if r.kind == kind]
        assert len({d for _, d in got}) == len(got) == 3000
        assert not {d.lower() for _, d in got} & {v for v, _ in got}


def test_surrogates_of_the_table(spark, sf_dir, documents):
    forms = r"[a-z]+\.\d\d@mail\d\.example\.com|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\+1 \(\d{3}\) 555-\d{4}|(?<!\w)\d{16}(?!\w)"
    got = {r.doc_id: (r.text, r.n_entities) for r in queries.op8_surrogates(spark, sf_dir).collect()}
    assert len(got) == len(documents)
    for d, t in documents:
        before = re.findall(forms, t)
        text, n = got[d]
        assert n == len(before) and (n or text == t)
        assert not any(x in text for x in before)
        # what stands between the entities stays
        at = 0
        for between in re.split(forms, t):
            at = text.index(between, at) + len(between)


def test_surrogates_odd_rows(spark, odd, no_docs):
    clash = odd.withColumn("n_entities", F.lit("mine")).withColumn("kind", F.lit("clash"))
    got = surrogates.replace_entities(clash, KEY)
    assert got.count() == len(ODD) and got.where("n_entities != 0").count() == 0
    assert surrogates.replace_entities(no_docs, KEY).count() == 0
    plan = got._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ pipeline

def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs)
        if k < 4:
            assert docs.columns == columns, name
    good, lined, single, clean, packed = ({r[0]: r for r in df.collect()} for df in seen)
    verdicts = {r.doc_id: r.kept for r in quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).collect()}
    assert set(good) == {d for d, k in verdicts.items() if k}
    kept = {d: ls for d, ls in brute.kept_lines([(d, r.text) for d, r in good.items()], lines.LEAST_CHARS)}
    assert {d: r.text for d, r in lined.items()} == {d: "\n".join(ls) for d, ls in kept.items() if ls}
    assert all(r.n_chars == len(r.text) for r in lined.values())
    classes = brute.near_classes([(d, r.text) for d, r in lined.items()])
    assert set(single) == {d for d in lined if classes[d] == d or not brute.bag(lined[d].text)}
    bench = [set(zip(*(w[i:] for i in range(5)))) for w in (re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) for r in table(spark, sf_dir, "benchmark").collect())]
    dirty = set()
    for d, r in single.items():
        w = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text))
        own = set(zip(*(w[i:] for i in range(5))))
        if any(len(b & own) >= 0.8 * len(b) for b in bench if b):
            dirty.add(d)
    assert set(clean) == set(single) - dirty
    assert set(packed) == set(clean)


def test_pipeline_run_is_its_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    assert got.columns[:5] == [x.split()[0] for x in packing.PIECES.split(", ")] and got.count() > 0
