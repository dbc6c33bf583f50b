import itertools
import json
import random
import zlib

import numpy as np
import pytest
from corpus_words import prose

from tidebar.llm import chat, packing, sharding
from tidebar.llm.common import number_sorted, number_within

DOCS = "doc_id long, text string"


def test_fill_against_all_subsets():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted({rng.randrange(1, 40) for _ in range(5)}, reverse=True)
        items = [(x, rng.randrange(1, 4)) for x in lengths]
        room = rng.randrange(0, 120)
        best = max(s for c in itertools.product(*[range(n + 1) for _, n in items]) if (s := sum(k * x for k, (x, _) in zip(c, items, strict=True))) <= room)
        used = packing.fill(items, room)
        assert sum(x * n for x, n in used) == best and all(n <= dict(items)[x] for x, n in used)


def test_plan_uses_up_the_histogram():
    rng = random.Random(2)
    histogram = {rng.randrange(1, 257): rng.randrange(1, 50) for _ in range(100)} | {256: 7}
    left = dict.fromkeys(histogram, 0)
    for times, need in packing.plan(histogram, 256):
        assert sum(x * n for x, n in need) <= 256
        for x, n in need:
            left[x] += n * times
    assert left == histogram


def test_packing_round_trip(spark, odd_docs, no_docs, clashing):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([0, 1, 5, 300, 5000])) for _ in range(60)] + [None, "", "Ünïcode, it's 12ab ..", "<|endoftext|> x", "a\x85b\tc", "İstanbul"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(4)
    out = packing.pack(df).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        mine = out[out.doc_id == i].sort_values("start")
        assert mine.doc_tokens.unique().tolist() == [len(ids)] and mine.length.sum() == len(ids)
        for r in mine.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    sizes = out.groupby("sequence_id").length.sum()
    assert sizes.max() <= 4096 and sorted(sizes.index) == list(range(len(sizes)))
    by = out.sort_values(["sequence_id", "offset"])
    assert ((by.offset + by.length).groupby(by.sequence_id).shift(1).fillna(0) == by.offset).all()
    assert packing.pack(clashing(odd_docs)).select("doc_id").distinct().count() == odd_docs.select("doc_id").distinct().count()
    assert packing.pack(no_docs).count() == 0


def test_word_cache_on_odd_strings(monkeypatch):
    """Words put together against the tokenizer on whole texts, with a cache that overflows."""
    from tokenizers import Tokenizer

    t, cache = Tokenizer.from_file(packing.default_tokenizer()), packing.WordCache(packing.default_tokenizer())
    monkeypatch.setattr(packing, "CACHE_WORDS", 3000)
    rng = random.Random(11)
    pool = [*"abcXYZéÉßİıΣσς'’.,-<>|#&_ \n\t\x85\u00a0\u0338\u0301\u0307\u200b中文字12½²ⅫǅŉﬁΑ=", "'s", "'ll", "<|endoftext|>", "<|ENDOFTEXT|>", "word", "the", *prose(rng, 50).split()]
    for _ in range(60):
        texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 30))) for _ in range(100)]
        ids, bounds = cache.encode(texts)
        want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(bounds.tolist())] == want
    assert len(cache.codes) < 6000


def test_packing_leaves_little_padding(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = packing.pack(docs).groupBy("sequence_id").sum("length").toPandas()["sum(length)"]
    assert (4096 - sizes).sum() < 4096 * 1.5


def test_shards(spark, odd_docs, no_docs, clashing):
    rng = random.Random(5)
    texts = [prose(rng, int(rng.expovariate(1 / 40))) for _ in range(3000)]
    texts += [texts[7]] * 40 + [None] * 3 + ["hot " * 50] * 1500
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(5)
    out = sharding.shard(df, 8).toPandas()
    assert sorted(out.doc_id) == list(range(len(texts)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.min() < 1.05
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    want = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in enumerate(texts)}
    assert all(want[r.doc_id] == (r.size, r.text_crc32) for r in out.rename(columns={"size": "bytes"}).assign(size=out["size"]).itertuples())
    small = out[out.doc_id.isin([7, *range(3000, 3040)])]
    assert small.shard.nunique() == 1  # a light group of copies stays together
    odd = sharding.shard(clashing(odd_docs))
    assert odd.count() == odd_docs.count() and odd.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert sharding.shard(no_docs).count() == 0


def test_numbers_within_are_gapless(spark):
    rows = [(rng := i % 3, i, i % 5) for i in range(1000)] + [(None, 1, 1), (None, 1, 1)]
    rows += [(1, 5, 0)] * 300
    df = spark.createDataFrame([(*r, u) for u, r in enumerate(rows)], "k int, i int, z int, u int")
    out = number_within(df, ["k"], "u", ["i"], "n").toPandas()
    for _, part in out.groupby("k", dropna=False):
        assert sorted(part.n) == list(range(len(part)))
    assert rng == 0 and list(out.columns) == ["k", "i", "z", "n"]


def test_numbers_follow_the_order(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(50), "x") for k in [None, 1, 2] for _ in range(400)] + [(1, 7, "y")] * 300
    rng.shuffle(rows)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "30")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = number_sorted(spark.createDataFrame(rows, "k int, i int, z string").repartition(5), ["k"], ["i"], "n").toPandas()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(out) == len(rows)
    for _, part in out.groupby("k", dropna=False):
        by = part.sort_values("n")
        assert by.n.tolist() == list(range(len(part))) and by.i.is_monotonic_increasing


MESSAGES = "conv_id long, turn long, role string, text string, own_id string, follows_id string, tool string, arguments string, extra int"
SCHEMAS = {"add": {"required": ["x"], "properties": {"x": "integer", "y": "number", "s": "string"}}}


def test_tool_links(spark):
    rows = [
        (1, 0, "user", "hi", None, None, None, None),
        (1, 1, "tool", "3", None, "c1", None, None),  # result before its call
        (1, 2, "assistant", "", "c1", None, "add", '{"y": 2, "x": 1}'),
        (1, 3, "assistant", "", "c2", "c1", "add", '{"x": "no"}'),
        (1, 4, "tool", None, None, "c9", None, None),  # no such call
        (1, 5, "assistant", "", "c1", None, "mul", "{}"),  # id used before
        (2, 0, "assistant", "", "p", "q", "add", '{"x": true}'),  # a cycle of two
        (2, 1, "assistant", "", "q", "p", "add", "[1]"),
        (2, 2, "assistant", "", None, None, "add", "{"),
        (None, 0, "user", "x", "a", "a", None, None),
        (3, 0, "user", "same", None, None, None, None),
        (3, 0, "user", "same", None, None, None, None),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], MESSAGES).repartition(4)
    out = chat.format_chats(df, SCHEMAS).toPandas()
    one = out[out.conv_id == 1].sort_values("position")
    assert one.turn.tolist() == [0, 2, 1, 3, 4, 5]
    assert one.status.tolist() == ["root", "root", "linked", "linked", "orphan", "repeated id"]
    errors = dict(zip(one.turn, one.arguments_error, strict=True))
    assert errors[2] is None and errors[3] == "x is no integer" and errors[5] == "unknown tool"
    two = out[out.conv_id == 2].sort_values("position")
    assert two.status.tolist() == ["cycle", "cycle", "root"] and two.arguments_error.tolist() == ["x is no integer", "no object", "no JSON"]
    assert json.loads(one.json.iloc[1]) == {"content": "", "role": "assistant", "tool_call": {"arguments": {"x": 1, "y": 2}, "id": "c1", "name": "add"}}
    assert one.json.iloc[1] == '{"content":"","role":"assistant","tool_call":{"arguments":{"x":1,"y":2},"id":"c1","name":"add"}}'
    assert len(out) == len(rows) and sorted(out[out.conv_id == 3].position) == [0, 1]
    assert chat.format_chats(df.limit(0), SCHEMAS).count() == 0


def test_odd_arguments_are_written_as_they_stand(spark):
    deep = "[" * 100_000
    args = ["no json", '{"x": "\\ud800"}', "[1]", None, "", '{"x": NaN}', deep, "y" * 200_000]
    rows = [(1, k, "assistant", "t", None, None, tool, a, 0) for k, (tool, a) in enumerate((tool, a) for tool in ("nobody", "add") for a in args)]
    clash = spark.createDataFrame(rows, MESSAGES).withColumnsRenamed({"extra": "key"})
    out = {r["turn"]: r for r in chat.format_chats(clash, SCHEMAS).collect()}
    assert len(out) == len(rows)
    for k, a in enumerate(args):
        for turn in (k, k + len(args)):
            got = json.loads(out[turn]["json"])["tool_call"]["arguments"]
            assert got == (json.loads(a) if k == 1 else a or None)
        assert out[k]["arguments_error"] == "unknown tool"
    assert [out[k + len(args)]["arguments_error"] for k in range(len(args))] == ["no JSON", "x is no integer", "no object", "no JSON", "no JSON", "no JSON", "no JSON", "no JSON"]


def test_values_for_executors_need_no_package():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from tidebar.llm import decontam, licenses

    for value in (decontam.Index([(1, "some words of an item")]), licenses.Bound(["a b"], {"a": 1.0, "b": 2.0}, 1.0, 0.5)):
        done = subprocess.run([sys.executable, "-c", "import pickle, sys; print(type(pickle.loads(sys.stdin.buffer.read())).__name__)"], input=cloudpickle.dumps(value), cwd="/", env={}, capture_output=True)
        assert done.stdout.decode().strip() == type(value).__name__, done.stderr


@pytest.mark.parametrize("n", [1, 40, 300])
def test_long_reversed_chain(spark, n):
    """Every message follows the one after it: the order turns round."""
    rows = [(1, t, "tool", "", f"m{t}", f"m{t + 1}" if t + 1 < n else None, None, None, 0) for t in range(n)]
    out = chat.format_chats(spark.createDataFrame(rows, MESSAGES), {}).toPandas().sort_values("position")
    assert out.turn.tolist() == list(range(n - 1, -1, -1))


def test_deep_chain_keeps_parents_first(spark):
    rng = random.Random(6)
    rows = [(1, t, "tool", "", f"m{t}", f"m{rng.randrange(200)}" if rng.random() < 0.8 else None, None, None, 0) for t in range(200)]
    out = chat.format_chats(spark.createDataFrame(rows, MESSAGES), {}).toPandas()
    place, status = dict(zip(out.turn, out.position, strict=True)), dict(zip(out.turn, out.status, strict=True))
    for r in rows:
        if r[5] and status[r[1]] == "linked":
            assert place[int(r[5][1:])] < place[r[1]]


def test_queries_side_by_side_keep_their_tables(spark):
    """Two threads of one session: neither drops what the other has made, and the session's setting is as before."""
    import os
    from concurrent.futures import ThreadPoolExecutor
    from threading import Barrier

    from tidebar.llm import scratch

    both = Barrier(2, timeout=60)
    before = spark.conf.get(scratch._CLEAN, None)

    def query(k):
        def make():
            first = scratch.settle(spark.range(k, k + 10))
            both.wait()
            second = scratch.settle(first.filter("id % 2 = 0"))
            both.wait()
            return second

        out = scratch.tidied(spark, make)
        both.wait()
        return sorted(r["id"] for r in out.collect()), out.inputFiles()

    with ThreadPoolExecutor(2) as pool:
        (a, of_a), (b, of_b) = pool.map(query, (0, 100))
    assert a == [0, 2, 4, 6, 8] and b == [100, 102, 104, 106, 108]
    assert os.path.dirname(of_a[0]) != os.path.dirname(of_b[0])
    assert spark.conf.get(scratch._CLEAN, None) == before
