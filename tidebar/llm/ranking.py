"""Ranked lexical search over document FP-trees.

Every document becomes a vector of the terms that some item asks for, with
their counts; texts are read once for a block of items.  Statistics (documents,
terms, how many documents hold a term) are sums over all documents.

A task takes its vectors some thousands at a time and builds an FP-tree of
them: terms in descending order of document frequency, so that vectors share
their first terms and with them a path of the trie.  The tree is kept as sorted
vectors and the lengths of their common paths: a node is a range of vectors, its
children the parts between which the path ends.  For a node, the greatest count
of each term in its subtree and the least length norm ``m`` bound what any of
its documents can score, as the score grows with counts and falls with ``m``.

The search goes down depth first, best child first, with the items that a node
may still serve: an item leaves where the bound is below its tenth score so far.
Ends of the trie are scored exactly.  The bests of all tasks meet in two steps,
the first in salted parts.  All arithmetic but a term's weight is in integers.

Defined cases: a null text has no terms, and documents without terms count
nowhere; every row of documents and every row of items stands for itself, also
with equal or null ids; among equal scores a null doc_id comes last; items
without terms, and without any document that holds one, give no rows.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, table, unpacked
from .scratch import settle

BEST = 10
#: Items of one pass over the texts, and their words with repeats.
ITEMS, WORDS = 50_000, 1_000_000
#: Items are dealt over so many buckets, which passes are made of.
BUCKETS = 65_536
#: Items that search a tree together, and the cells (terms x items) of their weights.
GROUP, CELLS = 256, 4_000_000
#: Documents of a tree and their counts, and documents that are scored at once.
TREE, ENTRIES, LEAF = 8192, 2_000_000, 32
#: Parts in which the tasks' bests of an item meet first.
SALTS = 64

#: Terms are runs of digits, letters and all that is not ASCII; only A-Z is lower-cased.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERMS).split()


def _restricted(shared):
    """(doc_id, text) to doc_id, number of terms and the counts of the wanted terms."""

    def run(batches):
        number = unpacked(shared)
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.slice(k, 1000)
                sizes, ends, terms, counts, keep = [], [0], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    words = terms_of(text)
                    if words:
                        held = Counter(words)
                        found = held.keys() & number.keys()
                        keep.append(i)
                        sizes.append(len(words))
                        terms.extend([number[w] for w in found])
                        counts.extend([held[w] for w in found])
                        ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(keep, pa.int64())), pa.array(sizes, pa.int64()), *[pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (terms, counts)]],
                    names=["doc_id", "n", "terms", "counts"],
                )

    return run


_VECTOR = "doc_id long, n long, terms array<int>, counts array<int>"


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """An FP-tree of documents as sorted vectors; term numbers follow falling document frequency."""

    def __init__(self, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        order = np.lexsort((terms, doc))
        terms, tf, starts = terms[order], tf[order], np.concatenate([[0], ends])
        paths = terms.astype(">u4").tobytes()
        self.doc = np.array(sorted(range(len(ends)), key=lambda k: paths[4 * starts[k] : 4 * starts[k + 1]]), dtype=np.int64)
        size = (ends - starts[:-1])[self.doc]
        self.at = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(starts[self.doc] - self.at[:-1], size) + np.arange(len(terms))
        self.terms, self.tf, self.m = terms[take], tf[take], m[self.doc]
        self.shared = np.zeros(len(ends), dtype=np.int64)  # length of the path that a vector shares with the one before
        live, least = np.arange(1, len(ends)), np.minimum(size[1:], size[:-1])
        while len(live):
            depth = self.shared[live]
            open_ = depth < least[live - 1]
            live, depth = live[open_], depth[open_]
            live = live[self.terms[self.at[live] + depth] == self.terms[self.at[live - 1] + depth]]
            self.shared[live] += 1
        self._most = np.zeros(n_terms, dtype=np.int64)

    def children(self, i: int, j: int) -> list[tuple[int, int]]:
        """The parts of the node [i, j) where its path ends; neighbours that are small together are one part."""
        path = self.shared[i + 1 : j]
        cuts = np.concatenate([[i], np.flatnonzero(path == path.min()) + i + 1, [j]]).tolist()
        parts = [(cuts[0], cuts[1])]
        for a, b in zip(cuts[1:], cuts[2:], strict=False):
            if b - parts[-1][0] <= LEAF:
                parts[-1] = (parts[-1][0], b)
            else:
                parts.append((a, b))
        return parts

    def bounds(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        """The terms of the subtree [i, j) and the most that each can add for a weight of 1."""
        t = self.terms[self.at[i] : self.at[j]]
        np.maximum.at(self._most, t, self.tf[self.at[i] : self.at[j]])
        held = np.flatnonzero(self._most) if len(t) > len(self._most) else np.unique(t)
        most = self._most[held]
        self._most[held] = 0
        return held, saturated(most, self.m[i:j].min(initial=1 << 40))

    def scores(self, i: int, j: int, weights: np.ndarray, items: np.ndarray) -> np.ndarray:
        lo, hi = self.at[i], self.at[j]
        held, place = np.unique(self.terms[lo:hi], return_inverse=True)
        row = np.repeat(np.arange(j - i), np.diff(self.at[i : j + 1]))
        dense = np.zeros((j - i, len(held)), dtype=weights.dtype)
        dense[row, place] = saturated(self.tf[lo:hi], self.m[i:j][row])
        return (dense @ weights[np.ix_(held, items)]).astype(np.int64)


class Tops:
    """The best documents of each item so far, as (-score, no id, id)."""

    def __init__(self, n: int):
        self.kept: list[list[tuple]] = [[] for _ in range(n)]
        self.least = np.ones(n, dtype=np.int64)

    def add(self, item: int, score: int, doc) -> None:
        kept = self.kept[item]
        insort(kept, (-score, doc is None, doc or 0))
        del kept[BEST:]
        if len(kept) == BEST:
            self.least[item] = -kept[-1][0]


def search(tree: Tree, weights: np.ndarray, tops: Tops, ids: list) -> int:
    """Branch and bound of all items over one tree; returns how many documents were scored."""
    scored, stack = 0, [(0, len(tree.doc), np.arange(weights.shape[1]), None)]
    while stack:
        i, j, live, bound = stack.pop()
        if bound is not None:
            live = live[bound >= tops.least[live]]
        if not len(live) or i == j:
            continue
        if j - i <= LEAF:
            scored += j - i
            points = tree.scores(i, j, weights, live)
            for k, c in zip(*(x.tolist() for x in np.nonzero(points >= tops.least[live])), strict=True):
                tops.add(int(live[c]), int(points[k, c]), ids[tree.doc[i + k]])
            continue
        found = []
        for a, b in tree.children(i, j):
            held, most = tree.bounds(a, b)
            bound = (most.astype(weights.dtype) @ weights[np.ix_(held, live)]).astype(np.int64)
            ok = bound >= tops.least[live]
            if ok.any():
                found.append((a, b, live[ok], bound[ok]))
        stack.extend(sorted(found, key=lambda x: int(x[3].max())))
    return scored


class Block:
    """Items of one pass in groups: their terms in order of frequency and their weights."""

    def __init__(self, items: list[tuple[int, Counter]], number: dict[bytes, int], df: dict[int, int], documents: int, terms: int):
        self.documents, self.terms, self.size = documents, max(1, terms), len(number)
        weight = {w: math.floor(1000 * math.log((2 * documents + 2) / (2 * df[k] + 1))) for w, k in number.items() if k in df}
        self.groups: list[tuple[list[int], list[int], list[tuple[int, int, int]]]] = []
        part: list[tuple[int, Counter]] = []
        held: set[bytes] = set()
        for row, words in items:
            words = Counter({w: k for w, k in words.items() if w in weight})
            if part and (len(part) == GROUP or len(held | words.keys()) * (len(part) + 1) > CELLS):
                self._add(part, held, number, df, weight)
                part, held = [], set()
            if words:
                part.append((row, words))
                held |= words.keys()
        if part:
            self._add(part, held, number, df, weight)

    def _add(self, part, held, number, df, weight) -> None:
        order = sorted(held, key=lambda w: (-df[number[w]], w))
        rank = {w: k for k, w in enumerate(order)}
        self.groups.append(([row for row, _ in part], [number[w] for w in order], [(rank[w], c, weight[w] * k) for c, (_, words) in enumerate(part) for w, k in words.items()]))

    def weights(self, k: int) -> np.ndarray:
        """Terms x items; in floating point where every sum stays an exact integer."""
        rows, order, cells = self.groups[k]
        out = np.zeros((len(order), len(rows)), dtype=np.int64)
        for t, c, w in cells:
            out[t, c] = w
        return out.astype(np.float64) if out.sum(axis=0).max(initial=0) * 1_000_000 < 1 << 53 else out


def _best(shared):
    """Vectors to the best documents of each item among them."""

    def run(batches):
        block: Block = unpacked(shared)
        tops = [Tops(len(rows)) for rows, _, _ in block.groups]

        def solve(parts):
            ids = [x for p in parts for x in p[0]]
            n, terms, tf = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
            size = np.concatenate([p[4] for p in parts])
            m = 25 + (75 * n * block.documents) // block.terms
            doc = np.repeat(np.arange(len(ids)), size)
            for k, (_, order, _) in enumerate(block.groups):
                rank = np.full(block.size, -1, dtype=np.int64)
                rank[order] = np.arange(len(order))
                mine = rank[terms]
                ok = mine >= 0
                some, per = np.unique(doc[ok], return_counts=True)
                tree = Tree(np.cumsum(per), mine[ok], tf[ok], m[some], len(order))
                search(tree, block.weights(k), tops[k], [ids[d] for d in some])

        held, docs, entries = [], 0, 0
        for batch in batches:
            for k in range(0, len(batch), 1024):
                part = batch.slice(k, 1024)
                terms, counts = part.column(2), part.column(3)
                size = np.diff(terms.offsets.to_numpy())
                held.append((part.column(0).to_pylist(), part.column(1).to_numpy(), terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64), size))
                docs, entries = docs + len(part), entries + int(size.sum())
                if docs >= TREE or entries >= ENTRIES:
                    solve(held)
                    held, docs, entries = [], 0, 0
        if held:
            solve(held)
        rows = [(row, -s, None if no_id else d) for (mine, _, _), top in zip(block.groups, tops, strict=True) for row, kept in zip(mine, top.kept, strict=True) for s, no_id, d in kept]
        for k in range(0, len(rows), 100_000):
            cols = list(zip(*rows[k : k + 100_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["row", "score", "doc_id"])

    return run


def _passes(items: DataFrame):
    """The items of one pass after the other, as (row, counts of its terms)."""
    sizes = items.groupBy("bucket").agg(F.count(F.lit(1)).alias("items"), F.sum(F.size("terms")).alias("words")).orderBy("bucket").collect()  # BUCKETS rows at most
    spans: list[list[int]] = []  # first and last bucket, items, words
    for r in sizes:
        if not spans or spans[-1][2] + r["items"] > ITEMS or spans[-1][3] + r["words"] > WORDS:
            spans.append([r["bucket"], r["bucket"], 0, 0])
        spans[-1] = [spans[-1][0], r["bucket"], spans[-1][2] + r["items"], spans[-1][3] + r["words"]]
    for lo, hi, _, _ in spans:
        yield [(r["row"], Counter(bytes(w) for w in r["terms"])) for r in items.filter(F.col("bucket").between(lo, hi)).select("row", "terms").orderBy("row").collect()]


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of every item's ``best`` documents, ten at most.

    ``docs``: doc_id, text; ``items``: item_id, text.
    """
    if not 1 <= best <= BEST:
        raise ValueError(f"best must be 1 to {BEST}")
    spark = docs.sparkSession

    @F.pandas_udf("array<binary>")
    def split(text: pd.Series) -> pd.Series:
        return pd.Series([terms_of(t) for t in text], dtype=object)

    asked = items.select("item_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row")).filter("text is not null")
    asked = asked.select("item_id", "row", split("text").alias("terms")).filter(F.size("terms") > 0).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(BUCKETS)).cast("int"))
    asked = settle(asked.repartitionByRange("bucket").sortWithinPartitions("bucket"))  # a pass skips the files of others
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for part in _passes(asked):
        number = {w: k for k, w in enumerate(sorted({w for _, words in part for w in words}))}
        wanted = carried(spark, number)
        vectors = settle(texts.mapInArrow(_restricted(wanted), _VECTOR))
        total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        df = {r["term"]: r["df"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # WORDS rows at most
        block = carried(spark, Block(part, number, df, total["docs"], total["terms"] or 0))
        top = settle(vectors.mapInArrow(_best(block), "row long, score long, doc_id long"))
        wanted.destroy()
        block.destroy()
        found = top if found is None else found.unionByName(top)
    if found is None:
        found = spark.createDataFrame([], "row long, score long, doc_id long")
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    first = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS)))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("row", "salt").orderBy(*by))).filter(F.col("r") <= best)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*by))).filter(F.col("rank") <= best)
    return last.join(asked.select("row", "item_id"), "row").select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Every document is scored for every item.
OP12_SQL = r"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, CAST(len(w) AS BIGINT) AS n FROM texts WHERE len(w) > 0),
size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
tf AS (SELECT d, word, count(*) AS tf FROM (SELECT d, unnest(w) AS word FROM docs) GROUP BY ALL),
weight AS (SELECT word, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS x FROM tf, size GROUP BY word, docs),
items AS (SELECT item_id, row_number() OVER () AS i, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
asked AS (SELECT i, item_id, word, count(*) AS k FROM (SELECT i, item_id, unnest(w) AS word FROM items) GROUP BY ALL),
scored AS (SELECT i, item_id, doc_id, d, CAST(sum(k * x * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (word) JOIN weight USING (word) JOIN docs USING (d), size GROUP BY ALL HAVING sum(k * x * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms)))) > 0)
SELECT item_id, CAST(r AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= 10
"""
