import hashlib
import random

import numpy as np
import pytest
from corpus_words import WORDS, prose

from tidebar.llm import factors

DOCS = "doc_id long, text string"


def brute(rows, window):
    """(n_words, n_removed, digest) of texts in order of (doc_id, place)."""
    texts = [(t or "").encode().split() for _, t in rows]
    seen, out = set(), []
    for w in texts:
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            x = tuple(w[s : s + window])
            if x in seen:
                gone[s : s + window] = [True] * window
            seen.add(x)
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed):
    """Passages of all lengths between other words, few words, runs of one word, nested and overlapping copies."""
    rng = random.Random(seed)
    passages = [prose(rng, n).split() for n in (8, 12, 19, 20, 21, 25, 40, 80)]
    line = prose(rng, 14).split()
    texts = []
    for k in range(120):
        words = []
        for _ in range(rng.randrange(1, 5)):
            words += prose(rng, rng.randrange(0, 25)).split()
            p = rng.choice(passages)
            cut = rng.randrange(0, 6)
            words += rng.choice([p, p[cut:], p[: len(p) - cut], line, ["la"] * rng.randrange(0, 50), [rng.choice("ab") for _ in range(40)]])
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    texts += [None, "", " \n", texts[3], texts[5] + " x"]
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "max_block"), [(1, 4096), (2, 6), (3, 2)])
def test_against_all_windows(spark, seed, max_block):
    rows = corpus(seed)
    want = brute(rows, 20)
    out = {r["doc_id"]: r for r in factors.copy_digest(spark.createDataFrame(rows, DOCS).repartition(5), 20, max_block).collect()}
    got = [(out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) for i, _ in rows]
    assert got == want
    assert sum(w[1] for w in want) > 500


def test_one_line_between_different_neighbours(spark):
    """A line in every document, in one block or in many: same rows."""
    rng = random.Random(4)
    line = prose(rng, 30)
    tags = [f"{rng.choice(WORDS)}{k}" for k in range(700)]
    rows = [(k, f"{prose(rng, 3)} {tags[k]} {line[: 20 + k % 60]} {tags[-k]} {line} {prose(rng, 9)}") for k in range(300)]
    want = brute(rows, 20)
    for max_block in (4096, 16):
        out = {r["doc_id"]: r for r in factors.copy_digest(spark.createDataFrame(rows, DOCS), 20, max_block).collect()}
        assert [(out[i]["n_words"], out[i]["n_removed"], out[i]["kept_sha256"]) for i, _ in rows] == want


def test_parse_finds_every_matched_window():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n, columns, window = rng.integers(2, 9), 14, 5
        words = rng.integers(1, 3, (n, columns))
        words[rng.random((n, columns)) < 0.05] = 0
        lengths = factors.matching_statistics(np.zeros(n, np.int64), words, np.ones((n, columns - window + 1), bool))
        r, s, e = factors.parsed(lengths, np.zeros(n, np.int64), np.full(n, columns - window), window)
        got = {(a, k) for a, b, c in zip(r, s, e, strict=True) for k in range(b, c - window + 1)}
        want = {(a, k) for a in range(n) for k in range(columns - window + 1) if words[a, k : k + window].all() and any((words[b, k : k + window] == words[a, k : k + window]).all() for b in range(a))}
        assert got == want


def test_odd_cases(spark, odd_docs, no_docs, clashing):
    """Equal rows are documents: one stays. A null id stands where its text's hash would."""
    out = factors.copy_digest(clashing(odd_docs)).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append((r["n_words"], r["n_removed"]))
    assert by[1] == by[2] == by[3] == [(0, 0)]
    assert by[8] == [(3, 0), (3, 0)]
    assert by[4][0][1] == 0 and by[4][0][0] >= 30_000
    texts = {r["doc_id"]: r["text"] for r in odd_docs.filter("doc_id in (5, 6, 9)").collect()}
    n = len(texts[5].split())
    assert by[6] == [(n, n)]
    assert sorted(by[9]) == [(n + 1, n), (n + 1, n + 1)]
    assert factors.copy_digest(no_docs).count() == 0
    cut = factors.without_copies(clashing(odd_docs))
    assert cut.columns == clashing(odd_docs).columns
    assert sorted(r["text"] for r in cut.filter("doc_id = 9").collect()) == ["", "x"]
    assert [r["text"] for r in cut.filter("doc_id = 1").collect()] == [None]
    twice = spark.createDataFrame([(k, texts[5]) for k in (1, 1, 1, 2)], DOCS)
    assert sorted((r["doc_id"], r["n_removed"]) for r in factors.copy_digest(twice).collect()) == [(1, 0), (1, n), (1, n), (2, n)]
