import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from corpus_words import WORDS, prose

from tidebar.llm import ranking

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    held = [(i, terms(t)) for i, t in docs]
    held = [(i, Counter(w), len(w)) for i, w in held if w]
    total, length = len(held), sum(n for *_, n in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in held:
            m = 25 + (75 * n * total) // length
            s = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10], 1)]
    return out


def rows(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_against_scoring_everything(spark, seed):
    rng = random.Random(seed)
    few = [rng.choice(WORDS) for _ in range(12)]
    docs = [(k, " ".join(rng.choice(few if rng.random() < 0.6 else WORDS) for _ in range(rng.randrange(1, 90)))) for k in range(900)]
    docs += [(1000 + k, docs[7][1]) for k in range(40)] + [(5000, "Ça VA: naïve-Été 42\x007"), (5001, None), (5002, "...")]
    items = [(k, prose(rng, rng.randrange(1, 40))) for k in range(60)] + [(90, docs[7][1] + " " + docs[7][1]), (91, "ça va naïve été Été 7"), (92, None), (93, "zzzz"), (94, "")]
    out = ranking.ranked(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS))
    want = sorted(brute(docs, items))
    assert rows(out) == want
    assert [r for r in want if r[0] == 90][9][2] == 1008


def test_groups_and_passes_change_nothing(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(k, prose(rng, rng.randrange(5, 60))) for k in range(300)]
    items = [(k, prose(rng, 12)) for k in range(40)]
    for name, value in (("GROUP", 7), ("TREE", 50), ("LEAF", 3), ("ITEMS", 15)):
        monkeypatch.setattr(ranking, name, value)
    assert rows(ranking.ranked(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == sorted(brute(docs, items))


def test_bounds_hold_and_prune():
    """No document of a subtree scores above its bound, and one rare passage does not need all documents."""
    rng = random.Random(4)
    docs = [prose(rng, 40) for _ in range(3000)]
    docs[1234] += " quark gluon lepton quark gluon"
    vocabulary = sorted({w for t in docs for w in terms(t)})
    df = Counter(w for t in docs for w in set(terms(t)))
    rank = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (-df[w], w)))}
    counts = [Counter(terms(t)) for t in docs]
    ends = np.cumsum([len(c) for c in counts])
    tree = ranking.Tree(ends, np.array([rank[w] for c in counts for w in c]), np.array([k for c in counts for k in c.values()]), np.array([25 + 75 * sum(c.values()) // 40 for c in counts]), len(rank))
    weights = np.zeros((len(rank), 2))
    for w in ("quark", "gluon", "lepton"):
        weights[rank[w], 0] = 7000
    weights[[rank[w] for w in terms(docs[5])], 1] = 900
    items = np.arange(2)
    for i, j in [(0, 3000), *tree.children(0, 3000)[:20]]:
        held, most = tree.bounds(i, j)
        assert (tree.scores(i, j, weights, items) <= most @ weights[held]).all()
    tops = ranking.Tops(1)
    assert ranking.search(tree, weights[:, :1], tops, list(range(3000))) < 100
    assert tops.kept[0][0][2] == 1234 and len(tops.kept[0]) == 1


def test_odd_cases(spark, odd_docs, no_docs, clashing):
    """Rows stand for themselves; a null doc_id comes last among equals; a null item_id is an item."""
    texts = [r["text"] for r in odd_docs.filter("doc_id = 5").collect()]
    items = spark.createDataFrame([(1, texts[0]), (1, texts[0]), (None, texts[0]), (2, "")], ITEMS)
    out = rows(ranking.ranked(clashing(odd_docs), clashing(items)).filter("item_id = 1").withColumn("doc_id", __import__("pyspark").sql.functions.coalesce("doc_id", __import__("pyspark").sql.functions.lit(-1))))
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = [(i, k, -1 if d is None else d, s) for i, k, d, s in brute(docs, [(1, texts[0]), (1, texts[0])])]
    assert out == sorted(want)
    assert ranking.ranked(odd_docs, items).filter("item_id is null").count() == len(want) // 2
    assert ranking.ranked(no_docs, items).count() == 0
    assert ranking.ranked(odd_docs, items.filter("item_id = 9")).count() == 0
