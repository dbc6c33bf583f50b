"""Whole operators against restatements that share none of their joins, indexes or trees."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from corpus_words import WORDS, prose
from pyspark.sql import functions as F

from tidebar.llm import chat, decontam, licenses, quality, sharding, toxicity

DOCS = "doc_id long, text string"


# ---- licences: every statement against every template, every path against every folder
def brute_scan(files, templates, full):
    statements = {k: [licenses._terms(p) for p in licenses._SENTENCE.split(text or "")] for k, (_, text, _) in enumerate(files)}
    total = sum(map(len, statements.values()))
    df = Counter(t for parts in statements.values() for p in parts for t in set(p))
    idf = lambda t: math.log(1 + total / (1 + df[t]))

    def cosine(a, b):
        a, b = ({t: n * idf(t) for t, n in Counter(x).items()} for x in (a, b))
        dot = sum(w * b.get(t, 0.0) for t, w in a.items())
        return dot / math.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values())) if dot else 0.0

    own = {}
    for k, parts in statements.items():
        every = [t for p in parts for t in p]
        best, inside = None, 0
        for whole, terms, wordings, least, first in [(False, p, templates, licenses.SIMILARITY, 0) for p in parts] + [(True, every, full, licenses.WHOLE_SIMILARITY, len(templates))]:
            scored = [(round(cosine(terms, licenses._terms(w)), 9), -(first + i), n) for i, (n, w) in enumerate(wordings)]
            c, _, name = max(scored, default=(0.0, 0, ""))
            if c >= least:
                best, inside = max(best or (False, 0.0, ""), (whole, c, name)), inside + len(terms)
        own[k] = (*best, 2 * inside >= len(every)) if best else None
    folder = lambda path: "/".join(path.split("/")[:-1])
    folders = {}
    for k, found in own.items():
        if found and found[3] and files[k][2] is not None:
            at = folder(files[k][2])
            folders[at] = max(folders.get(at, (0.0, "")), (found[1], found[2]))
    out = []
    for k, (doc, _, path) in enumerate(files):
        if own[k]:
            out.append((doc, own[k][2], "statement", None))
            continue
        steps = [] if path is None else path.split("/")[:-1]
        near = [a for a in ("/".join(steps[:n]) for n in range(len(steps), -1, -1)) if a in folders] if path is not None else []
        out.append((doc, folders[near[0]][1], "inherited", near[0]) if near else (doc, None, "none", None))
    return out


def test_license_scan_against_everything(spark):
    rng = random.Random(4)
    full = licenses.full_texts()
    templates = [*licenses.TEMPLATES, ("Twin-A", "Granted under the twin terms of nobody."), ("Twin-B", "Granted under the twin terms of nobody.")]
    files = []
    for i in range(160):
        path = "/".join(rng.choice("abc") for _ in range(rng.randrange(0, 4))) + f"/f{i}"
        kind = rng.random()
        line = rng.choice(templates)[1]
        if kind < 0.15:
            text = line
        elif kind < 0.3:
            text = prose(rng, 30) + "\n" + line + " " + prose(rng, 20)
        elif kind < 0.35:
            text = rng.choice(full)[1]
        elif kind < 0.4:
            text = " ".join(w for w in line.split() if rng.random() < 0.7)
        else:
            text = rng.choice([None, "", " \n ", prose(rng, 40), "the license of the road is the permission to use it. Rights are reserved."])
        files.append((rng.choice([i, i, None]), text, path.lstrip("/") if rng.random() < 0.95 else None))
    files += [(900, "Released under the MIT License.", "two/A"), (901, "Licensed under the Apache License, Version 2.0.", "two/B"), (902, "x", "two/c/d"), (903, prose(rng, 40_000), "two/long"), files[0]]
    df = spark.createDataFrame(files, "doc_id long, text string, path string").withColumns({c: F.lit("z") for c in ("term", "h", "licence", "folder", "k1", "whole", "depth")}).repartition(4)
    got = [(r["doc_id"], r["licence"], r["basis"], r["inherited_from"]) for r in licenses.scan(df, templates).collect()]
    assert sorted(got, key=str) == sorted(brute_scan(files, templates, full), key=str)
    assert {"statement", "inherited", "none"} == {g[2] for g in got} and "Twin-B" not in {g[1] for g in got}


# ---- toxicity: every entry looked for at every place
def test_matcher_against_a_plain_search():
    rng = random.Random(5)
    pool = ["bad", "badly", "ugh", "u", "gh", "fish", "bad fish", " ", " ", ".", "-", "0", "х", "é", "B4D", "clown"]
    entries = [("bad", True, 3.0), ("ugh", False, 2.0), ("u", True, 1.0), ("ad fi", False, 9.0)]
    exceptions = ("bad fish", "clown ugh")
    m = toxicity.Matcher(entries, exceptions)
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randrange(0, 12)))
        folded = toxicity.fold(text)

        def at(phrase, whole, folded=folded):
            for s in range(len(folded) - len(phrase) + 1):
                e = s + len(phrase)
                if folded[s:e] == phrase and not (s and folded[s - 1].isalnum()) and not (whole and e < len(folded) and folded[e].isalnum()):
                    yield s, e

        harmless = [x for p in exceptions for x in at(toxicity.fold(p), True)]
        want = [(s, e, w) for p, whole, w in entries for s, e in at(p, whole) if not any(a <= s and e <= b for a, b in harmless)]
        assert sorted(m.hits(text)[0]) == sorted(want), text


def test_exceptions_are_learned(spark):
    rng = random.Random(6)
    rows = [(f"{prose(rng, 20)} what a rotter {prose(rng, 20)}", 1) for _ in range(60)] + [(f"{prose(rng, 20)} the Rotter valley {prose(rng, 20)}", 0) for _ in range(15)] + [(prose(rng, 40), 0) for _ in range(400)]
    train = spark.createDataFrame(rows, "text string, y int")
    lexicon = toxicity.learn(train)
    assert "rotter" in {e[0] for e in lexicon}
    exceptions = toxicity.learn_exceptions(train, lexicon)
    assert toxicity.fold("rotter valley") in exceptions and toxicity.fold("a rotter") not in exceptions
    m = toxicity.Matcher(lexicon, exceptions)
    assert m.density("oh, that rotter!") > 0 == m.density("walk in rotter valley")
    assert toxicity.learn_exceptions(train, []) == ()


# ---- quality: the whole fit and calibration in one process
def pooled(raw, y):
    blocks = []
    for s, t in sorted(zip(raw, y, strict=True)):
        blocks.append([t, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            t2, n2, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + t2, blocks[-1][1] + n2, blocks[-1][2], hi]
    x = [v for b in blocks for v in (b[2], b[3])]
    return x, np.maximum.accumulate([(b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (0, 1)])


def test_quality_from_end_to_end(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = {r["doc_id"]: r["score"] for r in quality.score_quality(docs, labels).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.filter("quality is not null").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["doc_id"] in texts}
    fifth = {r["doc_id"] for r in docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0).select("doc_id").collect()}
    fit, rest = [i for i in y if i not in fifth], [i for i in y if i in fifth]
    x = {i: np.array(quality.statistics(t)) for i, t in texts.items()}
    a = np.array([x[i] for i in fit])
    scale = a.std(0)
    model = quality.Model(a.mean(0), np.where(scale > 1e-9, scale, 1.0))
    z = model.lift(a)
    model.weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(fit) / z.shape[1] * np.eye(z.shape[1]), z.T @ np.array([y[i] for i in fit]))
    knots = pooled(model.raw(np.array([x[i] for i in rest])).tolist(), [y[i] for i in rest])
    ids = list(texts)
    raw = model.raw(np.array([x[i] for i in ids]))
    want = 0.999 * np.interp(raw, *knots) + 0.001 * np.clip((raw - quality.LOW) / (quality.HIGH - quality.LOW), 0, 1)
    assert np.quantile(np.abs(want - np.array([out[i] for i in ids])), 0.99) < 0.02  # binned calibration moves few scores, and little
    assert np.mean((want >= 0.5) == (np.array([out[i] for i in ids]) >= 0.5)) > 0.99


# ---- shards: every cut by sorting everything
def brute_leaves(points, shards):
    groups = [points]
    for _ in range(int(math.log2(shards))):
        cut = []
        for g in groups:
            dim = max(sharding.DIMENSIONS, key=lambda d, g=g: max(p[d] for p in g) - min(p[d] for p in g))
            key = lambda p, dim=dim: (math.floor(p[dim] * (2**sharding.DIM_BITS - 1)), p["h"] % 2**sharding.HASH_BITS, p["chunk"])
            sums = Counter()
            for p in g:
                sums[key(p)] += p["size"]
            half, run, left = sum(sums.values()) / 2, 0, None
            for k in sorted(sums):
                if run + sums[k] >= half:
                    left = k if abs(run + sums[k] - half) <= abs(run - half) or not run else before
                    break
                run, before = run + sums[k], k
            cut += [[p for p in g if key(p) <= left], [p for p in g if key(p) > left]]
        groups = cut
    return {p["doc_id"]: n for n, g in enumerate(groups) for p in g}


def brute_points(texts, shards):
    """Sizes, hashes, coordinates and chunks of texts, whose numbers are their ids."""
    import struct

    import xxhash

    signed = lambda x: x - (1 << 64) if x >> 63 else x
    points = []
    for k, t in enumerate(texts):
        raw = t.encode()
        size = len(raw) + 1
        points.append({"doc_id": k, "size": size, "h": signed(xxhash.xxh64_intdigest(raw, seed=42)), "d_bytes": math.log2(size) / 40, "d_script": len(t) / len(raw) if raw else 1.0, "d_words": t.count(" ") / len(t) if t else 0.0})
    total = sum(p["size"] for p in points)
    limit = max(1.0, total / shards * 0.0005, 4 * total / len(points))
    weight = Counter()
    for p in points:
        weight[p["h"]] += p["size"]
    for p in points:
        chunks = min(4096, math.ceil(weight[p["h"]] / limit)) if weight[p["h"]] > limit else 1
        p["chunk"] = signed(xxhash.xxh64_intdigest(struct.pack("<q", p["doc_id"]), seed=42)) % chunks
    return points


def test_many_shards_in_few_passes(spark):
    """1,024 shards take the same few jobs as 8 where nodes are small, and every leaf holds about as much."""
    rng = random.Random(8)
    df = spark.createDataFrame([(k, prose(rng, rng.randrange(5, 40))) for k in range(6000)], DOCS)
    out = sharding.shard(df, 1024).groupBy("shard").agg(F.sum("size").alias("w"), F.max("slot").alias("top"), F.count("*").alias("n")).collect()
    assert len(out) == 1024 and all(r["top"] == r["n"] - 1 for r in out)
    mean = sum(r["w"] for r in out) / 1024
    assert all(abs(r["w"] - mean) < 0.7 * mean for r in out)


def test_shards_against_sorting_everything(spark, monkeypatch):
    rng = random.Random(7)
    texts = [prose(rng, int(rng.expovariate(1 / 30))) + rng.choice(["", "é" * rng.randrange(60), " " * rng.randrange(60)]) for _ in range(800)] + [prose(rng, 50)] * 120
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3)
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(df, 8).collect()}
    rows = brute_points(texts, 8)
    total = sum(r["size"] for r in rows)
    assert got == brute_leaves(rows, 8)
    monkeypatch.setattr(sharding, "FEW", 60)  # most levels by joins and windows, the last ones in tasks
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(df, 8).collect()} == got
    assert {r["doc_id"]: r["shard"] for r in sharding.shard(df, 64).collect()} == brute_leaves(brute_points(texts, 64), 64)
    monkeypatch.undo()
    by_bytes = sharding.shard(df, target_bytes=total // 5)
    assert by_bytes.select("shard").distinct().count() == 8 and by_bytes.groupBy("shard").agg(F.sum("size").alias("w")).filter(F.col("w") > total // 5).count() == 0
    assert sharding.shard(df, target_bytes=10**12).select("shard").distinct().count() == 1
    with pytest.raises(ValueError, match="power of two"):
        sharding.shard(df, 6)


# ---- leaks: odd rows, and the SQL
def test_leaks_odd_rows_and_the_sql(spark, clashing):
    rng = random.Random(9)
    short = [(10 * n + k, " ".join(f"w{n}x{k}x{j}" for j in range(n))) for n in range(1, 13) for k in range(2)]
    long = prose(rng, 700)
    items = [*short, (500, long), (501, prose(rng, 15)), (501, "another text of the same name here"), (502, None), (None, "an item that nobody names at all")]
    docs = [(i, f"{prose(rng, rng.choice([0, 3, 90]))} {t} {prose(rng, rng.choice([0, 4, 90]))}") for i, t in short]
    twice = prose(rng, 5) + " " + short[20][1]
    docs += [(600, prose(rng, 5000) + " " + long + " " + prose(rng, 30_000)), (None, short[9][1]), (601, None), (602, ""), (603, "Another text of the SAME name here!"), (604, twice + " " + prose(rng, 900) + " " + twice), (604, twice), (605, "an item that nobody names at all")]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(clashing(d).repartition(3), b).toPandas().sort_values(["doc_id", "item_id", "first_word"]).reset_index(drop=True)
    assert {(600, 500), (603, 501)} <= set(zip(got.doc_id, got.item_id, strict=True)) and got[got.doc_id.isna()].item_id.tolist() == [short[9][0]] and len(got[got.doc_id == 604]) == 2
    kept = {r["doc_id"] for r in decontam.without_leaks(d, b).collect()}
    assert {601, 602} <= kept and not kept & {600, 603, 604, 605, None}
    # the SQL names documents and items by their ids, so it gets rows that are told apart by them
    one_d, one_b = [r for r in docs if r[0] not in (None, 604)], [r for r in items if r[0] not in (None, 501)]
    c = duckdb.connect()
    c.sql("create table documents (doc_id bigint, text varchar)")
    c.sql("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into documents values (?, ?)", one_d)
    c.executemany("insert into benchmark values (?, ?)", one_b)
    want = {(r[0], r[1]): tuple(r[2:]) for r in c.sql("select doc_id, item_id, score, question_overlap, answer_overlap, first_word from (" + decontam.OP3_SQL + ")").fetchall()}
    mine = {(r["doc_id"], r["item_id"]): tuple(round(x, 9) for x in r[2:]) for r in decontam.contamination(spark.createDataFrame(one_d, DOCS), spark.createDataFrame(one_b, "item_id long, text string")).collect()}
    assert mine.keys() == want.keys() and all(np.allclose(mine[k], want[k], atol=2e-9) for k in want) and len(want) > len(short)


# ---- chats: every message followed to its root by hand
def brute_chat(rows, schemas):
    by_turn, owner = {}, {}
    for conv, turn, *_ in rows:
        by_turn.setdefault(conv, {})[turn] = None
    for r in sorted(rows, key=lambda r: r[1]):
        by_turn[r[0]][r[1]] = r
        if r[4] is not None:
            owner.setdefault((r[0], r[4]), r[1])
    out = {}
    for conv, messages in by_turn.items():
        parent = {t: owner.get((conv, r[5])) if r[5] is not None else None for t, r in messages.items()}
        keys = {}
        for t in messages:
            # a message that names itself follows nothing, but is linked
            path, at = [t], parent[t]
            while at is not None and at not in path and at != path[-1]:
                path.append(at)
                at = parent[at] if parent[at] != at else None
            cyclic = at is not None and at in path and parent[t] != t
            keys[t] = (t, 0, t, cyclic) if cyclic else (max(path), len(path) - 1, t, False)
        for place, t in enumerate(sorted(messages, key=lambda t: keys[t][:3])):
            r = messages[t]
            status = "cycle" if keys[t][3] else "repeated id" if r[4] is not None and owner[conv, r[4]] != t else "orphan" if r[5] is not None and parent[t] is None else "linked" if parent[t] is not None else "root"
            wrong = None if r[6] is None else chat.check_arguments(r[7], chat.checked_schema(schemas[r[6]]) if r[6] in schemas else None) or None
            out[conv, t] = (place, status, parent[t], wrong)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chats_against_following_every_link(spark, seed):
    rng = random.Random(seed)
    schemas = {"add": {"required": ["x"], "properties": {"x": "integer", "s": "string"}}, "any": {"additional": True}}
    rows = []
    for conv in range(12):
        n = rng.choice([1, 5, 40, 90])
        for t in range(n):
            own = rng.choice([None, f"m{t}", f"m{rng.randrange(n)}"])
            follows = rng.choice([None, f"m{rng.randrange(n)}", f"m{max(0, t - 1)}", f"m{t + 1}", "nobody"])
            tool = rng.choice([None, "add", "any", "other"])
            args = rng.choice(['{"x": 1}', '{"x": "1"}', '{"x": 2, "s": "y"}', '{"y": 1}', "[]", "{", None, '{"x": 1.5}', '{"x": true}'])
            rows.append((conv, t, rng.choice(["user", "assistant", "tool", None]), rng.choice([None, "", "text"]), own, follows, tool, args))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, own_id string, follows_id string, tool string, arguments string").repartition(4)
    got = {(r["conv_id"], r["turn"]): (r["position"], r["status"], r["parent_turn"], r["arguments_error"]) for r in chat.format_chats(df, schemas).collect()}
    want = brute_chat(rows, schemas)
    assert got == want
    assert {"cycle", "repeated id", "orphan", "linked", "root"} <= {v[1] for v in want.values()}


def test_schemas_are_checked_first(spark):
    for bad in ({"properties": {"a": "date"}}, {"properties": {"a": {"type": "string", "format": "x"}}}, {"properties": {"a": {"items": 3}}}, {"required": "a"}, {"type": ["object", "thing"]}, {"properties": {"a": 7}}, {"properties": {"a": {"maxLength": True}}}):
        with pytest.raises(ValueError):
            chat.checked_schema(bad)
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string, own_id string, follows_id string, tool string, arguments string")
    with pytest.raises(ValueError):
        chat.format_chats(messages, {"t": {"properties": {"a": "date"}}})


def test_nested_arguments():
    schema = chat.checked_schema(
        {
            "required": ["q"],
            "properties": {
                "q": {"type": "string", "minLength": 2, "maxLength": 4},
                "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9},
                "unit": {"enum": ["c", "f", 1]},
                "where": {"type": "object", "required": ["x"], "properties": {"x": "number", "tags": {"type": "array", "items": {"type": "string"}}}},
                "free": "object",
            },
        }
    )
    cases = {
        '{"q": "ab"}': "",
        '{"q": "a"}': "q is too short",
        '{"q": "abcde"}': "q is too long",
        '{"n": 3}': "missing q",
        '{"q": "ab", "n": null}': "",
        '{"q": "ab", "n": true}': "n is no integer or null",
        '{"q": "ab", "n": 0}': "n is too small",
        '{"q": "ab", "n": 10}': "n is too large",
        '{"q": "ab", "unit": true}': "unit is none of those allowed",
        '{"q": "ab", "unit": 1}': "",
        '{"q": "ab", "where": {}}': "missing where.x",
        '{"q": "ab", "where": {"x": 1.5, "y": 2}}': "unknown where.y",
        '{"q": "ab", "where": {"x": 1, "tags": ["a", 2]}}': "where.tags[1] is no string",
        '{"q": "ab", "free": {"any": [1, {"thing": null}]}}': "",
        '{"q": "ab", "z": 1}': "unknown z",
        '{"q": "ab", "n": 1e999}': "no JSON",
        '{"q": NaN}': "no JSON",
        "[1]": "no object",
    }
    assert {raw: chat.check_arguments(raw, schema) for raw in cases} == cases
    assert chat.parsed('{"a":1e999}') == '{"a":1e999}' and chat.parsed('{"a":1e9}') == {"a": 1e9}
    assert chat.check_arguments('{"a":null}', chat.checked_schema({"properties": {"a": "null"}})) == ""


def brute_lexicon(rows):
    """Entries by log-odds from whole texts in one process; two words of ten letters at most differ by more than their beginnings."""
    toxic, clean = (sum(y == k for _, y in rows) for k in (1, 0))
    counts = {}
    for text, y in rows:
        for w in set(re.findall(r"[^\W_]+", toxicity.fold(text))):
            counts.setdefault(w, [0, 0])[1 - y] += 1
    stems = {}
    for w, (t, c) in counts.items():
        for k in range(4, 9):
            if len(w) > k:
                s = stems.setdefault(w[:k], [0, 0, 0])
                s[0], s[1], s[2] = s[0] + t, s[1] + c, s[2] + (t > 0)
    prior, found = toxic / (toxic + clean), []
    for whole, some in ((True, counts), (False, {w: x for w, x in stems.items() if x[2] >= 3})):
        for w, (t, c, *_) in some.items():
            if not t:
                continue
            q = t / (t + c)
            gain = t * math.log(q / prior) + (c * math.log((1 - q) / (1 - prior)) if c else 0.0)
            weight = math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
            if weight >= 2.5 and gain > math.log(max(2, len(counts))) + 2:
                found.append((-gain, whole, len(w), w, weight))
    out = []
    for _, whole, _, w, weight in sorted(found):
        if not any(w == e or w.startswith(e) and not other or e.startswith(w) and not whole for e, other, _ in out):
            out.append((w, whole, weight))
    return sorted(out)


def test_lexicon_against_counting_everything(spark):
    rng = random.Random(12)
    rows = []
    for k in range(1500):
        y = int(k % 5 == 0)
        words = [rng.choice(WORDS) for _ in range(rng.randrange(5, 30))]
        if y:
            words += rng.sample(["grobnik", "vexhound", "snarlfen", "snarlfot", "snarlfex", "snarlful", "Gr0bn1k"], 3)
        elif rng.random() < 0.02:
            words.append("vexhound")
        rows.append((" ".join(words), y))
    got = toxicity.learn(spark.createDataFrame(rows, "text string, y int").repartition(5))
    want = brute_lexicon(rows)
    assert [e[:2] for e in got] == [e[:2] for e in want] and len(want) >= 3
    assert [e[2] for e in got] == pytest.approx([e[2] for e in want])
    assert any(not whole and text.startswith("snar") for text, whole, _ in got)
