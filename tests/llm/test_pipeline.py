import os

import corpus_pipeline as cp
import pytest

from tidebar.llm import decontam, minhash, quality, repeats


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        path = str(tmp_path_factory.mktemp("p") / str(k))
        stage(spark, out[-1], d).write.parquet(path)
        out.append(spark.read.parquet(path))
    return d, out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").distinct().collect()}


def test_stages_keep_the_columns(staged):
    _, out = staged
    assert all(df.columns == out[0].columns for df in out[1:-1]) and len(cp.STAGES) == 5


def test_quality_stage(spark, staged):
    d, out = staged
    labels = spark.read.parquet(f"{d}/labels.parquet")
    bad = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    assert len(ids(out[1]) & good) >= 0.95 * len(good & ids(out[0])) and len(ids(out[1]) & bad) <= 0.2 * max(1, len(bad & ids(out[0])))


def test_dedup_stage(staged):
    _, out = staged
    kept = {r["doc_id"] for r in minhash.near_duplicates(out[1]).filter("kept").collect()}
    assert ids(out[2]) == kept and out[2].count() == len(kept)


def test_repeat_stage(staged):
    _, out = staged
    digest = {r["doc_id"]: r for r in repeats.repeat_digest(out[2]).collect()}
    texts = {r["doc_id"]: r["text"] for r in out[3].collect()}
    assert texts.keys() == digest.keys()
    for i, t in texts.items():
        assert len((t or "").encode()) <= digest[i]["n_bytes"] - digest[i]["n_removed"]


def test_decontamination_stage(spark, staged):
    d, out = staged
    leaks = ids(decontam.contamination(out[3], spark.read.parquet(f"{d}/benchmark.parquet")))
    assert ids(out[4]) == ids(out[3]) - leaks


def test_packing_stage_and_run(spark, staged):
    d, out = staged
    assert ids(out[5]) == ids(out[4])
    total = lambda df: df.agg({"length": "sum"}).first()[0]
    assert total(cp.run(spark, d)) == total(out[5])


def test_packed_pieces_are_the_documents_ids(staged):
    """Every piece is cut from its document's ids as the tokenizer gives them, and every id is in one piece."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    from tidebar.llm import packing

    _, out = staged
    t = Tokenizer.from_file(packing.default_tokenizer())
    left = {}
    for r in out[4].collect():
        left[r["doc_id"]] = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
    places = {}
    total = 0
    for r in out[5].collect():
        ids = left[r["doc_id"]]
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total += r["length"]
    assert total == sum(map(len, left.values()))
    for pieces in places.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY


def test_run_leaves_one_table(spark):
    import os

    from tidebar.sources.scratch import shared_dir

    d = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(d))
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and len(set(os.listdir(d)) - before) == 1


def test_empty_and_odd_documents(spark, no_docs, odd_docs):
    d = "/root/testdata/sf0.001"
    for docs in (no_docs, odd_docs):
        for _, stage in cp.STAGES:
            docs = stage(spark, docs, d)
            docs = spark.createDataFrame(docs.collect(), docs.schema)


def test_run_against_the_same_in_one_process(spark, tmp_path):
    """Copies, near copies, a passage of several documents and leaks: what run() packs is what plain Python leaves, id by id."""
    import random
    import zlib
    from collections import Counter

    import numpy as np
    from corpus_words import prose
    from test_dedup import brute_components, edited, shingle_set
    from tokenizers import Tokenizer

    from tidebar.llm import packing

    rng = random.Random(21)
    texts = [prose(rng, rng.randrange(50, 130)) for _ in range(40)]
    texts += [texts[3], texts[3], edited(rng, texts[5], 1), edited(rng, texts[6], 2), edited(rng, texts[7], 40)]
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage} é{prose(rng, 30)}" for _ in range(4)]
    items = [prose(rng, 25) for _ in range(4)]
    texts += [f"{prose(rng, 30)} {item} {prose(rng, 30)}" for item in items[:3]] + ["", None, "short"]
    docs = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))  # so that every document is good enough
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    sets = [shingle_set(t) for t in texts]
    component = brute_components(len(texts), [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])])
    left = {k: (texts[k] or "").encode() for k in range(len(texts)) if component[k] == k}
    assert len(left) < len(texts) - 2
    before = len(left)
    windows = Counter(raw[s : s + 200] for raw in left.values() for s in range(len(raw) - 199))
    assert any(n > 1 for n in windows.values())
    for k, raw in left.items():
        gone = np.zeros(len(raw), dtype=bool)
        for s in range(len(raw) - 199):
            if windows[raw[s : s + 200]] > 1:
                gone[s : s + 200] = True
        left[k] = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")
    left = {k: t for k, t in left.items() if not any(item in t for item in items)}
    assert len(left) == before - 3

    t = Tokenizer.from_file(packing.default_tokenizer())
    want = {k: np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4") for k, text in left.items()}
    got: dict = {}
    for r in cp.run(spark, str(tmp_path)).collect():
        assert r["ids_crc32"] == zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == {k: len(ids) for k, ids in want.items()}


def test_entry_has_all_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert os.path.exists(cp.__file__) and quality.MAX_LABELLED
