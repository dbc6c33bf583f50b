import hashlib
import random
import re

import numpy as np
import pytest
from corpus_words import WORDS, prose

from tidebar.llm import embeddings, minhash, repeats
from tidebar.llm.common import components

DOCS = "doc_id long, text string"


def brute_components(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(x) for x in range(n)]


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def edited(rng, text, k):
    w = text.split()
    for _ in range(k):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + str(rng.randrange(99))
    return " ".join(w)


def near_corpus(seed, bases=6, copies=25):
    rng = random.Random(seed)
    texts = []
    for _ in range(bases):
        base = prose(rng, rng.choice([4, 30, 80, 150]))
        texts += [base, base] + [edited(rng, base, rng.randrange(0, 7)) for _ in range(copies)]
    texts += [prose(rng, 40) for _ in range(40)] + ["", "Hello World", "hello world"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_minhash_against_all_pairs(spark, seed):
    texts = near_corpus(seed)
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = brute_components(len(texts), linked)
    out = {r["doc_id"]: r for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)).collect()}
    assert [out[i]["component_id"] for i in range(len(texts))] == want
    assert [out[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert all(out[i]["kept"] == (want[i] == i) for i in out)


def test_minhash_group_that_spans_many_components(spark):
    """One base with copies around the threshold: buckets mix linked and unlinked documents."""
    rng = random.Random(9)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randrange(2, 12)) for _ in range(150)]
    sets = [shingle_set(t) for t in texts]
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = brute_components(len(texts), linked)
    assert 1 < len(set(want)) < 150
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert [out[i] for i in range(len(texts))] == want


def test_minhash_odd_cases(spark, odd_docs, no_docs, clashing):
    out = minhash.near_duplicates(clashing(odd_docs)).collect()
    by = {(r["doc_id"], r["n_shingles"]): r for r in out}
    assert len(out) == odd_docs.count()
    assert by[1, 0]["kept"] and by[2, 0]["kept"] and by[3, 0]["kept"]
    assert {r["component_id"] for r in out if r["doc_id"] in (5, 6, 7, 9)} == {5}
    assert all(r["component_id"] is None and not r["kept"] for r in out if r["doc_id"] is None)
    assert minhash.near_duplicates(no_docs).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.one_of_each(clashing(odd_docs)).collect()) == [0, 0, 1, 2, 3, 4, 8, 8, 9, 10, 11]  # (9, 9) is one document, and first in its group


def test_minhash_ids_that_repeat(spark):
    rng = random.Random(3)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(3, a), (7, a), (7, b), (9, b + " more"), (11, prose(rng, 50)), (12, None), (12, prose(rng, 40))]
    out = minhash.near_duplicates(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(3, 3, True), (7, 3, False), (9, 3, False), (11, 11, True), (12, 12, True)}


def test_one_of_each_keeps_different_texts_of_one_id(spark):
    rng = random.Random(4)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (1, a), (2, a), (3, c), (4, c + " more"), (None, c), (None, c)]
    out = [tuple(r) for r in minhash.one_of_each(spark.createDataFrame(rows, DOCS).repartition(3)).collect()]
    assert sorted(out, key=str) == sorted([(1, a), (1, b), (3, c), (None, c), (None, c)], key=str)


def test_components_of_chains_and_stars(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(1, 200)] + [(2002, 2001), (2003, 2002), (5, 5)]
    rng.shuffle(edges)
    out = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    assert all(out[i] == 0 for i in range(1, 301)) and all(out[1000 + k] == 1000 for k in range(1, 200)) and out[2003] == out[2002] == 2001
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(texts, length):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for k in range(len(raw) - length + 1):
            seen[raw[k : k + length]] = seen.get(raw[k : k + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=bool)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = True
        gone[-1] = False
        runs = int(np.sum(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=False) if not g)).hexdigest()))
    return out


def test_repeats_over_many_ranges(spark):
    """Hot contexts and anchors lie across the ends of many small ranges."""
    rng = random.Random(8)
    line, passage = prose(rng, 7), prose(rng, 60)
    texts = [prose(rng, 8) + line + prose(rng, 8) for _ in range(120)] + [prose(rng, 3) + passage + prose(rng, 3) for _ in range(60)] + [prose(rng, 40)] * 50 + [passage + prose(rng, 5) + passage]
    texts += [t[:-1] + "#" for t in texts[:60]]
    rng.shuffle(texts)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_digest(spark.createDataFrame(list(enumerate(texts)), DOCS), 100).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, 100)


def repeat_corpus(seed):
    rng = random.Random(seed)
    shared = [prose(rng, 40) for _ in range(4)]
    texts = []
    for _ in range(40):
        parts = [prose(rng, rng.randrange(3, 30))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, len(s) // 2)
            parts += [s[a : a + rng.randrange(30, len(s))], prose(rng, rng.randrange(0, 20))]
        texts.append("".join(parts))
    texts += [texts[3], "ab" * 300, "abc" * 150 + "x" + "abc" * 150, "a" * 90, None, "", "é" * 120 + prose(rng, 20), "é" * 120, shared[0] + shared[0]]
    return texts


@pytest.mark.parametrize(("seed", "length", "max_group"), [(1, 60, 10**6), (2, 48, 10**6), (3, 60, 3), (4, 200, 10**6), (5, 120, 2)])
def test_repeats_against_all_windows(spark, seed, length, max_group, monkeypatch):
    texts = repeat_corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    monkeypatch.setattr(repeats.repeated_spans, "__defaults__", (length, max_group))
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.repeat_digest(df, length).collect()}
    assert [out[i] for i in range(len(texts))] == brute_repeats(texts, length)


def test_repeats_odd_cases(spark, odd_docs, no_docs, clashing):
    out = repeats.repeat_digest(clashing(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    gone = {r["doc_id"]: r["n_removed"] for r in out if r["doc_id"]}
    assert gone[5] == gone[6] > 200 and gone[1] == gone[2] == 0 and gone[11] == 1000 and gone[10] == 600 and gone[4] == 0
    assert repeats.repeat_digest(no_docs).count() == 0
    clean = repeats.without_repeats(clashing(odd_docs))
    assert clean.count() == odd_docs.count() and clean.columns == clashing(odd_docs).columns
    left = {r["doc_id"]: r["text"] for r in clean.collect() if r["doc_id"]}
    assert left[5] == "" and left[1] is None and left[8]


def vectors(seed, labels=3, n=400, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(labels):
        centres = rng.normal(size=(20, d))
        v = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, d)) * rng.choice([0.02, 0.1, 1.0], (n, 1))
        rows += [(label, x) for x in v]
    rows += [(0, rows[0][1])] * 3 + [(1, rows[0][1]), (0, 2 * rows[0][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_vectors_against_all_pairs(spark, seed, monkeypatch):
    rows = vectors(seed)
    data = [(i, x.tolist(), label) for i, (label, x) in enumerate(rows)]
    x = np.array([r[1] for r in rows])
    u = x / np.sqrt((x * x).sum(1))[:, None]
    cos = u @ u.T
    label = np.array([r[0] for r in rows])
    link = (cos >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(rows), dtype=bool)
    want = brute_components(len(rows), list(zip(*np.nonzero(link), strict=True)))
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    monkeypatch.setattr(embeddings, "SPREAD", 3)
    out = {r["vec_id"]: r for r in embeddings.near_vectors(df, block=64).collect()}
    assert [out[i]["n_links"] for i in range(len(rows))] == link.sum(1).tolist()
    assert [out[i]["component_id"] for i in range(len(rows))] == want


def test_vectors_odd_cases(spark):
    nan = float("nan")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [nan, 1.0], 0), (6, [1.0, 0.0], None), (7, [1.0, 0.0], 0), (8, [3.0, 0.0], 0), (9, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (10, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = [tuple(r) for r in embeddings.near_vectors(df).collect()]
    assert len(out) == len(rows)
    assert (8, 2, 7, False) in out and out.count((7, 2, 7, True)) == 2 and (None, 0, None, False) in out
    assert all((i, 0, i, True) in out for i in (1, 2, 3, 4, 5, 6, 9, 10))
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    named = spark.createDataFrame([(1, [1.0, 0.0], "x"), (2, [2.0, 0.0], "x"), (3, [1.0, 0.0], "y")], "vec_id long, embedding array<double>, label string")
    clash = named.withColumns({c: named["label"] for c in ("v", "d", "rep", "n", "fine", "k1", "block")})
    assert sorted(tuple(r) for r in embeddings.near_vectors(clash).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    width, need = embeddings.calibration(0.98)
    assert 0 < need <= embeddings.PROJECTIONS and width > 0
