"""Benchmark decontamination: BM25 over test items with block-max pruning.

The test items are the index, the training passages the queries.  Items are
taken in blocks of about ``INDEX_ITEMS`` items and ``INDEX_WORDS`` words at
most, which bounds the index that is broadcast; every block meets every passage.
Counts, mean length and stride are those of all items, so blocks change no
result, and a block is released before the next is built.  A passage is a window
of words twice as wide as its stride, and the stride is no shorter than the
longest item, so every item fits into some passage.

Scores are BM25 of the passage's distinct words, as a share of what the item
scores against itself; all pairs at or above ``THRESHOLD`` are retrieved.  As in
WAND, the words of an item are split: the rare ones are *essential*, the others
can add at most a known rest.  A passage must reach the threshold less that rest
by essential words alone.  That is tested first for blocks of items by the
largest impact in each block, then for the items of surviving blocks; only
pairs that pass are scored in full.  No pair at the threshold is lost.

Retrieved pairs are verified: of the word trigrams of the question (the item
but for its last third) and of the answer (that third), enough must stand in
the passage.  Items of under six words are one question with no answer.  A
question or answer of one or two words is a single n-gram of that length, held
against the passage's n-grams of the same length.

Defined cases: null or blank texts and items match nothing; repeated rows match
each; a document that holds an item several times gives one row, of its best
passage; empty tables give no rows; an item without an id gives no pair, as
nothing names it, but the filtering stage drops the documents that hold it.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, table, unpacked
from .scratch import settle, unsettle

INDEX_ITEMS = 50_000
INDEX_WORDS = 1_000_000
#: Items are dealt over so many buckets, which blocks are made of.
BUCKETS = 65_536
THRESHOLD = 0.6
OVERLAP = 0.6
#: Share of an item's own score that its essential words make up at least.
ESSENTIAL = 0.75
BLOCK = 16
STRIDE = 64
K1, B = 1.2, 0.75

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _trigrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[k : k + 3]) for k in range(max(1, len(words) - 2))} if words else set()


def _overlap(grams: set[tuple[str, ...]], words: list[str], cache: dict[int, set[tuple[str, ...]]]) -> float:
    """Share of an item's n-grams that stand in a passage; ``cache`` keeps the passage's n-grams by length."""
    if not grams:
        return 1.0
    n = len(next(iter(grams)))
    if n not in cache:
        cache[n] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)}
    return len(grams & cache[n]) / len(grams)


class Index:
    """Postings of one block of items: full impacts, essential impacts and their maxima by block.

    ``corpus``: number of all items, their mean length, the stride, and in how many each word of the block stands.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, corpus: tuple[int, float, int, dict[str, int]] | None = None):
        items = [(i, w) for i, t in items if (w := words_of(t))]
        self.ids = [i for i, _ in items]
        self.threshold = threshold
        lengths = [len(w) for _, w in items]
        n = len(items)
        total, mean, self.stride, df = corpus or (n, sum(lengths) / max(1, n), max([STRIDE, *lengths]), Counter(w for _, ws in items for w in set(ws)))
        self.impacts: list[dict[str, float]] = []
        postings: dict[str, list[tuple[int, float]]] = {}
        self.need = np.zeros(n)
        for k, (_, ws) in enumerate(items):
            norm = K1 * (1 - B + B * len(ws) / mean)
            impact = {w: math.log1p((total - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + norm) for w, tf in Counter(ws).items()}
            own = sum(impact.values())
            impact = {w: x / own for w, x in impact.items()}
            self.impacts.append(impact)
            inside = 0.0
            for w in sorted(impact, key=lambda w: (df[w], w)):
                postings.setdefault(w, []).append((k, impact[w]))
                inside += impact[w]
                if inside >= ESSENTIAL:
                    break
            self.need[k] = max(threshold - (1 - inside), 1e-9) - 1e-9
        self.terms = {w: t for t, w in enumerate(postings)}
        lists = list(postings.values())
        self.starts = np.cumsum([0, *map(len, lists)])
        self.item = np.array([k for p in lists for k, _ in p], dtype=np.int64)
        self.impact = np.array([x for p in lists for _, x in p])
        blocks = []
        for p in lists:
            most: dict[int, float] = {}
            for k, x in p:
                most[k // BLOCK] = max(most.get(k // BLOCK, 0.0), x)
            blocks.append(sorted(most.items()))
        self.block_starts = np.cumsum([0, *map(len, blocks)])
        self.block = np.array([b for p in blocks for b, _ in p], dtype=np.int64)
        self.block_impact = np.array([x for p in blocks for _, x in p])
        self.block_need = np.array([self.need[k : k + BLOCK].min() for k in range(0, n, BLOCK)])
        self.grams = []
        for _, ws in items:
            cut = len(ws) - len(ws) // 3 if len(ws) >= 6 else len(ws)
            self.grams.append((_trigrams(ws[:cut]), _trigrams(ws[cut:])))

    @staticmethod
    def _expand(starts: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all postings of the terms, and which term each comes from."""
        sizes = starts[terms + 1] - starts[terms]
        owner = np.repeat(np.arange(len(terms)), sizes)
        return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[terms][owner], owner

    def search(self, words: list[str]) -> list[tuple[int, float, float, float, int]]:
        """(item position, score, question overlap, answer overlap, first word) of verified items, the best passage of each."""
        hits = [(k, t) for k, t in enumerate(map(self.terms.get, words)) if t is not None]
        if not hits:
            return []
        at, term = np.array(hits, dtype=np.int64).T
        # a word belongs to the passage that starts with its stride and to the one before
        passage = at // self.stride
        passage, term = np.concatenate([passage, passage - 1]), np.concatenate([term, term])
        both = np.unique(passage[passage >= 0] * len(self.starts) + term[passage >= 0])
        if not len(both):
            return []
        passage, term = both // len(self.starts), both % len(self.starts)
        first = passage.min()
        rows, blocks, items = int(passage.max() - first) + 1, len(self.block_need), len(self.ids)
        where, owner = self._expand(self.block_starts, term)
        cell, inverse = np.unique((passage[owner] - first) * blocks + self.block[where], return_inverse=True)
        sums = np.bincount(inverse, weights=self.block_impact[where])
        live = cell[sums >= self.block_need[cell % blocks]]
        if not len(live):
            return []
        where, owner = self._expand(self.starts, term)
        held = np.isin((passage[owner] - first) * blocks + self.item[where] // BLOCK, live)
        where, owner = where[held], owner[held]
        cell, inverse = np.unique((passage[owner] - first) * items + self.item[where], return_inverse=True)
        sums = np.bincount(inverse, weights=self.impact[where])
        best: dict[int, tuple[int, float, float, float, int]] = {}
        for c in cell[sums >= self.need[cell % items]].tolist():
            p, k = c // items + int(first), c % items
            window = words[p * self.stride : (p + 2) * self.stride]
            score = sum(self.impacts[k].get(w, 0.0) for w in set(window))
            if score >= self.threshold - 1e-12:
                held_grams: dict[int, set[tuple[str, ...]]] = {}
                question, answer = (_overlap(g, window, held_grams) for g in self.grams[k])
                if question >= OVERLAP and answer >= OVERLAP and (k not in best or (round(score, 12), -p * self.stride) > (round(best[k][1], 12), -best[k][4])):
                    best[k] = (k, score, question, answer, p * self.stride)
        return list(best.values())


def _search(shared):
    def run(batches):
        index = unpacked(shared)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 1000):
                rows = [(doc, index.ids[k], *found) for doc, text in zip(ids[lo : lo + 1000], texts.slice(lo, 1000).to_pylist(), strict=True) for k, *found in index.search(words_of(text))]
                if rows:
                    cols = zip(*rows, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap, first_word of all verified pairs.

    ``docs``: doc_id, text; ``benchmark``: item_id, text.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shared, last in indexes(benchmark.filter("item_id is not null"), threshold):
        out = texts.mapInArrow(_search(shared), "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long")
        if not last:
            out = settle(out)
            shared.destroy()
        found = out if found is None else found.unionByName(out)
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; filtered where they are read, and settled between blocks."""
    before = None
    for shared, last in indexes(benchmark, threshold):
        docs = docs.filter(~_leaky(shared)(F.col("text").cast("string")))
        if not last:
            docs = settle(docs)
            shared.destroy()
            if before is not None:
                unsettle(before)
            before = docs
    return docs


def _leaky(shared):
    @F.pandas_udf("boolean")
    def leaky(text: pd.Series) -> pd.Series:
        index = unpacked(shared)
        return pd.Series([bool(index.search(words_of(t))) for t in text], dtype=bool)

    return leaky


def indexes(benchmark: DataFrame, threshold: float = THRESHOLD):
    """(broadcast index, is it the last) of one block after the other; one at least."""
    spark = benchmark.sparkSession

    @F.pandas_udf("array<string>")
    def split(text: pd.Series) -> pd.Series:
        return pd.Series([words_of(t) for t in text], dtype=object)

    items = benchmark.filter("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    items = items.withColumn("words", split("text")).filter(F.size("words") > 0).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int"))
    items = settle(items.repartitionByRange("bucket").sortWithinPartitions("bucket"))  # a block's filter skips the files of others
    sizes = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("words")).alias("words"), F.max(F.size("words")).alias("longest")).orderBy("bucket").collect()  # BUCKETS rows at most
    df = settle(items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    total = sum(r["items"] for r in sizes)
    mean = sum(r["words"] for r in sizes) / max(1, total)
    stride = max([STRIDE, *(r["longest"] for r in sizes)])
    blocks: list[list[int]] = []  # first and last bucket, items, words
    for r in sizes:
        if not blocks or blocks[-1][2] + r["items"] > INDEX_ITEMS or blocks[-1][3] + r["words"] > INDEX_WORDS:
            blocks.append([r["bucket"], r["bucket"], 0, 0])
        blocks[-1] = [blocks[-1][0], r["bucket"], blocks[-1][2] + r["items"], blocks[-1][3] + r["words"]]
    blocks = blocks or [[0, 0, 0, 0]]
    for k, (lo, hi, _, _) in enumerate(blocks):
        part = items.filter(F.col("bucket").between(lo, hi))
        counts = {r["word"]: r["df"] for r in part.select(F.explode("words").alias("word")).distinct().join(df, "word").collect()}
        rows = [(r["item_id"], r["text"]) for r in part.select("item_id", "text").orderBy("item_id", "text").collect()]
        yield carried(spark, Index(rows, threshold, (total, mean, stride, counts))), k == len(blocks) - 1


def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumns({c: F.round(c, 9) for c in ("score", "question_overlap", "answer_overlap")})


#: Every passage is scored against every item; words are runs of letters and numbers.
OP3_SQL = r"""
WITH items AS (SELECT item_id, w, len(w) AS n FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL) WHERE len(w) > 0),
size AS (SELECT greatest(64, max(n)) AS stride, avg(n) AS mean, count(*) AS items FROM items),
tf AS (SELECT item_id, n, word, count(*) AS tf FROM (SELECT item_id, n, unnest(w) AS word FROM items) GROUP BY ALL),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word),
raw AS (SELECT item_id, word, ln(1 + (items - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean)) AS x FROM tf JOIN df USING (word), size),
impact AS (SELECT item_id, word, x / sum(x) OVER (PARTITION BY item_id) AS x FROM raw),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
words AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM texts),
held AS (SELECT DISTINCT doc_id, pos // stride - back AS p, word FROM words, size, (SELECT unnest([0, 1]) AS back) WHERE pos // stride - back >= 0),
scored AS (SELECT doc_id, p, item_id, sum(x) AS score FROM held JOIN impact USING (word) GROUP BY ALL HAVING sum(x) >= 0.6 - 1e-12),
windows AS (SELECT s.*, t.w[CAST(p * stride + 1 AS BIGINT):CAST((p + 2) * stride AS BIGINT)] AS w FROM scored s JOIN texts t USING (doc_id), size),
grams AS (SELECT doc_id, p, item_id, score, list_concat(w, list_concat(list_transform(range(1, len(w)), lambda k: array_to_string(w[k:k + 1], ' ')), list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k:k + 2], ' ')))) AS g FROM windows),
halves AS (SELECT item_id, w[1:cut] AS q, w[cut + 1:] AS a FROM (SELECT *, CASE WHEN n >= 6 THEN n - n // 3 ELSE n END AS cut FROM items)),
parts AS (SELECT item_id, CASE WHEN len(q) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(q) - 1)), lambda k: array_to_string(q[k:k + 2], ' '))) END AS q,
  CASE WHEN len(a) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(a) - 1)), lambda k: array_to_string(a[k:k + 2], ' '))) END AS a FROM halves),
checked AS (SELECT doc_id, item_id, p, score, CASE WHEN len(q) = 0 THEN 1.0 ELSE len(list_intersect(q, g)) / len(q) END AS qo, CASE WHEN len(a) = 0 THEN 1.0 ELSE len(list_intersect(a, g)) / len(a) END AS ao FROM grams JOIN parts USING (item_id))
SELECT doc_id, item_id, round(score, 9) AS score, round(qo, 9) AS question_overlap, round(ao, 9) AS answer_overlap, CAST(p * stride AS BIGINT) AS first_word
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(score, 12) DESC, p) AS r FROM checked WHERE qo >= 0.6 AND ao >= 0.6), size WHERE r = 1
"""
