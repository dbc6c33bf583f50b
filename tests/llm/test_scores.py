import math
import random

import numpy as np
from corpus_words import prose

from tidebar.llm import calibration, decontam, licenses, quality, toxicity

DOCS = "doc_id long, text string"


def accuracy(df, labels, column):
    joined = df.join(labels.select("doc_id", column), "doc_id").filter("held_out").collect()
    return sum(r["predicted"] == r[column] for r in joined) / len(joined)


def tables(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")]


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    out = quality.score_quality(docs, labels)
    assert out.count() == docs.count()
    assert accuracy(out, labels, "quality") > 0.97
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_toxicity_on_held_out_rows(spark):
    docs, labels = tables(spark)
    out = toxicity.score_toxicity(docs, labels)
    assert out.count() == docs.count()
    assert accuracy(out, labels, "toxic") > 0.94
    assert out.filter("score < 0 or score > 1 or score is null").count() == 0


def test_held_out_labels_are_not_learned_from(spark):
    """Turning the held-out labels over changes nothing."""
    from pyspark.sql import functions as F

    docs, labels = tables(spark)
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {tuple(r) for r in toxicity.score_toxicity(docs, labels).select("doc_id", "score").collect()}
    assert a == {tuple(r) for r in toxicity.score_toxicity(docs, turned).select("doc_id", "score").collect()}


def test_scores_odd_cases(spark, odd_docs, no_docs, clashing):
    _, labels = tables(spark)
    none = labels.limit(0)
    for score in (quality.score_quality, toxicity.score_toxicity):
        assert {r["score"] for r in score(clashing(odd_docs), none).collect()} == {0.5}
        assert score(clashing(odd_docs), labels).count() == odd_docs.count()
        assert score(no_docs, labels).count() == 0


def test_without_usable_labels_quality_is_one_half_and_keeps_all(spark, odd_docs):
    from pyspark.sql import functions as F

    docs = odd_docs.unionByName(spark.createDataFrame([(i, f"a clean text of number {i}", "en", None, None) for i in range(100, 200)], odd_docs.schema))
    held, calibrates = F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    y = docs.filter("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    cases = {
        "no labels": y.limit(0),
        "null labels": y.withColumn("quality", F.lit(None).cast("int")),
        "labels of other documents": y.withColumn("doc_id", F.col("doc_id") + 100_000),
        "held-out labels": y.filter(held),
        "labels that only calibrate": y.filter(~held & calibrates),
    }
    assert cases["held-out labels"].count() and cases["labels that only calibrate"].count()
    for name, labels in cases.items():
        assert {(r["score"], r["predicted"]) for r in quality.score_quality(docs, labels).collect()} == {(0.5, 1)}, name
        assert quality.good_documents(docs, labels).count() == docs.count(), name


def test_folding_and_matching():
    m = toxicity.Matcher([("idiot", True, 5.0), ("vequ", False, 4.0)], exceptions=("idiot board",))
    for text in ("you IDIOT!", "1d10t", "іdіоt", "ｉｄｉｏｔ", "id!ot", "x idi0t."):
        assert len(m.hits(text)[0]) == 1, text
    for text in ("idiots", "xidiot", "the idiot board", "", None):
        assert not m.hits(text)[0], text
    assert len(m.hits("vequment le veqution et lavequ")[0]) == 2
    assert m.density("idiot " + "fine " * 30) > m.density("idiot " + "fine " * 300) > 0


def test_random_features_approximate_the_kernel():
    m = quality.Model(np.zeros(3), np.ones(3), features=20_000)
    x = np.random.default_rng(0).normal(size=(20, 3))
    z = m.lift(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 3))
    assert np.abs(z @ z.T - kernel).max() < 0.05


def test_normal_equations_equal_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, len(quality.STATISTICS)))
    y = (x[:, 0] > 0).astype(int)
    df = spark.createDataFrame([(i, a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "doc_id long, x array<double>, y int").repartition(5)
    from pyspark.sql import functions as F

    model = quality.fit(df)
    rows = df.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) != 0).collect()
    a, b = np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows])
    z = model.lift(a)
    want = np.linalg.solve(z.T @ z + quality.RIDGE * len(a) / z.shape[1] * np.eye(z.shape[1]), z.T @ b)
    assert np.allclose(model.weights, want, atol=1e-6)


def test_isotonic_is_monotone(spark):
    rng = random.Random(2)
    rows = [(s := rng.random(), int(rng.random() < s)) for _ in range(3000)]
    knots = calibration.isotonic(spark.createDataFrame(rows, "s double, y int"), "s", "y", 0.0, 1.0)
    grid = np.linspace(-0.5, 1.5, 500)
    p = calibration.calibrated(grid, knots, 0.0, 1.0)
    assert (np.diff(p) >= -1e-12).all() and p.min() >= 0 and p.max() <= 1 and np.abs(p[(grid > 0.1) & (grid < 0.9)] - grid[(grid > 0.1) & (grid < 0.9)]).max() < 0.15


def brute_leaks(docs, items):
    index = decontam.Index(items)
    found = {}
    for doc, text in docs:
        words = decontam.words_of(text)
        for p in range(max(1, math.ceil(len(words) / index.stride))):
            window = words[p * index.stride : (p + 2) * index.stride]
            grams = decontam._trigrams(window)
            for k, impact in enumerate(index.impacts):
                score = sum(impact.get(w, 0.0) for w in set(window))
                q, a = (len(g & grams) / len(g) if g else 1.0 for g in index.grams[k])
                if score >= decontam.THRESHOLD - 1e-12 and q >= decontam.OVERLAP and a >= decontam.OVERLAP:
                    found[doc, index.ids[k]] = max(score, found.get((doc, index.ids[k]), 0.0))
    return found


def test_leaks_against_scoring_everything(spark, no_docs, clashing):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([3, 8, 20, 40, 90])) + f" rare{i} odd{i}") for i in range(60)] + [(99, ""), (98, None)]
    docs = []
    for i in range(120):
        parts = [prose(rng, rng.randrange(0, 200))]
        if i % 3 == 0:
            w = rng.choice(items[:60])[1].split()
            cut = w[: int(len(w) * rng.choice([1.0, 1.0, 0.8, 0.5]))]
            parts.append(" ".join(x.upper() if rng.random() < 0.3 else x for x in cut) + rng.choice([".", ",", ""]))
        docs.append((i, " ".join([*parts, prose(rng, rng.randrange(0, 100))])))
    docs += [(200, None), (201, ""), (202, "  ")]
    want = brute_leaks(docs, items)
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontam.contamination(clashing(d).repartition(3), b).collect()}
    assert got.keys() == want.keys() and len(want) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert decontam.contamination(no_docs, b).count() == 0 and decontam.contamination(d, b.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontam.without_leaks(d, b).collect()} == {i for i, _ in docs} - {k[0] for k in want}


def test_exact_copies_of_short_items_are_found(spark):
    """Against a search for the item's words in a row, which knows nothing of the index."""
    rng = random.Random(5)
    items = [(10 * n + k, " ".join(f"w{n}x{k}x{j}" for j in range(n))) for n in range(1, 13) for k in range(3)]
    docs = [(i, f"{prose(rng, rng.choice([0, 2, 70, 150]))} {t} {prose(rng, rng.choice([0, 1, 90]))}") for i, t in items]
    docs += [(1000 + i, " ".join(w + " pause between words" for w in t.split())) for i, t in items if len(t.split()) in (2, 6)]
    want = {(d, i) for d, text in docs for i, t in items if f" {t.lower()} " in " " + " ".join(decontam.words_of(text)) + " "}
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination(d, b).collect()}
    assert got == want and len(want) == len(items)
    assert {r["doc_id"] for r in decontam.without_leaks(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_index_blocks_find_the_same(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, prose(rng, 12) + f" rare{i}") for i in range(30)]
    docs = [(i, prose(rng, 30) + " " + items[i][1]) for i in range(30)]
    monkeypatch.setattr(decontam, "INDEX_ITEMS", 7)
    got = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, i) for i in range(30)} <= {(r["doc_id"], r["item_id"]) for r in got}


def test_index_blocks_change_no_result(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, prose(rng, rng.choice([6, 12, 40, 90])) + f" rare{i}") for i in range(12)] + [(None, "an item that has no name of its own")]
    docs = [(i, prose(rng, 30) + " " + " ".join(t.split()[: rng.choice([100, 100, 32])])) for i, (_, t) in enumerate(items)] + [(99, prose(rng, 50))]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted((r["doc_id"], r["item_id"], round(r["score"], 9), r["first_word"]) for r in decontam.contamination(d, b).collect())
    kept = lambda: {r["doc_id"] for r in decontam.without_leaks(d, b).collect()}
    want, left = rows(), kept()
    assert 99 in left and 12 not in left and len(want) > 8
    monkeypatch.setattr(decontam, "INDEX_ITEMS", 5)
    assert rows() == want and kept() == left


def test_licenses(spark, no_docs):
    files = [
        (1, "Released under the MIT License.", "r/a/LICENSE"),
        (2, "some words here\nThis work is licensed under the GNU General Public License, version 3.\nand a long text that goes on and on without an end of it all", "r/a/x"),
        (3, "nothing of the kind", "r/a/b/y"),
        (4, None, "r/a/b/c/z"),
        (5, "nothing", "q/y"),
        (6, "This work is licensed under a Creative Commons Attribution 4.0 International License.", "r/a/b/LICENSE"),
        (7, "", None),
        (8, "my rights to sing are permitted", "q/z"),
        (3, "nothing of the kind", "r/a/b/y"),
    ]
    out = licenses.scan(spark.createDataFrame(files, "doc_id long, text string, path string").repartition(3)).collect()
    got = {r["doc_id"]: (r["licence"], r["basis"], r["inherited_from"]) for r in out}
    assert len(out) == len(files)
    assert got[1] == ("MIT", "statement", None) and got[2] == ("GPL-3.0", "statement", None)
    assert got[3] == ("CC-BY-4.0", "inherited", "r/a/b") and got[4] == ("CC-BY-4.0", "inherited", "r/a/b")
    assert got[5] == got[7] == got[8] == (None, "none", None) and got[6][0] == "CC-BY-4.0"
    from pyspark.sql import functions as F

    assert licenses.scan(no_docs.withColumn("path", F.lit("x"))).count() == 0


def test_whole_licence_files_and_the_root_folder(spark):
    rng = random.Random(6)
    texts = dict(licenses.full_texts())
    files = [(i, texts[n].replace("<year> <copyright holders>", "2020 A. Body"), f"p/{n}/LICENSE") for i, n in enumerate(texts)]
    files += [(100 + i, "print(1)", f"p/{n}/src/main.py") for i, n in enumerate(texts)]
    files += [(200, texts["MIT"], "LICENSE"), (201, "print(2)", "q/r/s.py"), (202, "print(3)", "setup.py"), (203, "no path", None)]
    files += [(300 + i, prose(rng, 200), f"prose/{i}") for i in range(30)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(files, "doc_id long, text string, path string").repartition(3)).collect()}
    for i, n in enumerate(texts):
        assert (got[i]["licence"], got[i]["basis"], got[i]["is_licence_file"]) == (n, "statement", True), n
        assert (got[100 + i]["licence"], got[100 + i]["inherited_from"]) == (n, f"p/{n}"), n
    assert got[200]["is_licence_file"] and got[203]["licence"] is None
    assert all((got[i]["licence"], got[i]["basis"], got[i]["inherited_from"]) == ("MIT", "inherited", "") for i in (201, 202, *range(300, 330)))


def test_repeated_rows_are_no_licence_files(spark):
    """A text just under half of whose words state a licence is no licence file, however often its row repeats; with the line twice in it, it is."""
    text = "Released under the MIT License.\nalpha beta gamma delta epsilon zeta eta theta."
    twice = text + "\nReleased under the MIT License."
    kind = "doc_id long, text string, path string"
    for copies in (1, 2, 7):
        files = [(1, text, "p/a")] * copies + [(2, "nothing here", "p/b"), (3, twice, "q/a"), (4, "nothing here", "q/b")]
        out = licenses.scan(spark.createDataFrame(files, kind).repartition(3)).collect()
        assert len(out) == copies + 3
        got = {r["doc_id"]: (r["own_licence"], r["is_licence_file"], r["licence"], r["basis"]) for r in out}
        assert got == {1: ("MIT", False, "MIT", "statement"), 2: (None, False, None, "none"), 3: ("MIT", True, "MIT", "statement"), 4: (None, False, "MIT", "inherited")}


def test_templates_need_no_fixed_words(spark):
    files = spark.createDataFrame([(1, "Available under CC BY-SA 4.0", "a/x"), (2, "zork glub frob", "b/x"), (3, "plain prose of some kind", "c/x")], "doc_id long, text string, path string")
    assert {r["doc_id"]: r["licence"] for r in licenses.scan(files).collect()} == {1: "CC-BY-SA-4.0", 2: None, 3: None}
    assert {r["doc_id"]: r["licence"] for r in licenses.scan(files, [("Zork", "Zork glub frob.")]).collect()} == {1: None, 2: "Zork", 3: None}


def brute_cosine(texts, wording, line):
    parts = [licenses._terms(p) for t in texts for p in licenses._SENTENCE.split(t)]
    idf = lambda t: math.log(1 + len(parts) / (1 + sum(t in p for p in parts)))
    a, b = ({t: x.count(t) * idf(t) for t in x} for x in (licenses._terms(line), licenses._terms(wording)))
    return sum(w * b.get(t, 0.0) for t, w in a.items()) / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))


def test_all_statements_count_in_the_cosine(spark):
    line = "This is the work that is licensed under the MIT License."
    texts = [line, *(f"this is the road under the hill of work number {i}\nand the {i}" for i in range(40))]
    out = licenses.scan(spark.createDataFrame([(i, t, f"d{i}/x") for i, t in enumerate(texts)], "doc_id long, text string, path string")).filter("doc_id = 0").first()
    want = max(brute_cosine(texts, t, line) for _, t in licenses.TEMPLATES)
    assert want > 0.5 and abs(out["cosine"] - want) < 1e-8
