"""Relative Lempel-Ziv parsing: words that copy an earlier passage.

A document is factored against reference blocks; factors of ``window`` words or
more are copies of something that starts earlier.

1. Routing.  Every window of ``window`` words owns its least gram of ``GRAM``
   words (its anchors), so equal windows own equal anchors at equal places.  An
   anchor with all words that a window owning it can reach is a *phrase*.  One
   row for each anchor, with a hash of its phrase, is dealt by ranges of (anchor,
   phrase, place) and read in order: a phrase that stands earlier is a copy
   throughout, however many rows have it, and goes no further.
2. Reference blocks.  The different phrases of one anchor form a block: whatever
   can match a phrase is in its blocks, so a document meets every block that
   holds a factor of it and no other.  A block of over ``MAX_BLOCK`` phrases (a
   common line between different neighbours) is dealt into blocks by what its
   windows share: one for each half of the window starts and for each run of
   words that all windows of that half hold, again and again, until blocks are
   small or all phrases of one share a whole window.  Of these only the first
   place counts, which partial aggregates find.
3. Index and parse.  A block's phrases, aligned at the anchor, are indexed by
   refining classes of equal words column by column, which gives the longest
   match with an earlier phrase from every column (matching statistics).  The
   greedy parse takes the longest match again and again.  Factors of ``window``
   words or more are copies; windows that lie across a factor's end, which
   another phrase may hold whole, are looked up one by one.

Defined cases: a null text has no words; texts under ``window`` words lose
nothing.  Earlier means by (doc_id, text hash, place); a null doc_id stands
where the hash of its text would.  Rows equal in doc_id and text are documents
of their own: one of them counts as the first, the others copy it.  Words are
told apart by 64 bits of hash, phrases by 64 bits beside the anchor's 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import _sliding
from .common import table
from .hashing import Powers, mix, word_hashes
from .scratch import settle, unsettle

WINDOW = 20
#: Words of an anchor.
GRAM = 6
#: Phrases that one block may hold.
MAX_BLOCK = 512
#: Phrases that are indexed together, when blocks are small.
BATCH = 8192

_U = np.uint64
_POWERS: list[Powers] = []


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key (doc, h) that tells different texts apart even where ids are null or repeat."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("h"))


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode("utf-8", "surrogatepass"))


def anchored(words: np.ndarray, window: int, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and phrase hashes of the grams that are least in some window of words."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    if not _POWERS:
        _POWERS.append(Powers())
    up, down = _POWERS[0].to(n + 1)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(words * up[:-1], out=sums[1:])
    g = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    reach = window - gram
    least = _sliding(g, reach + 1, np.minimum, ~_U(0))
    spread = np.zeros(len(least) + 2 * reach, dtype=_U)
    spread[reach : reach + len(least)] = least
    at = np.flatnonzero(_sliding(spread, reach + 1, np.maximum, _U(0)) == g)
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + window, n)
    # the side on which the text ends first is part of the phrase
    c = mix(mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(_U)) + (at - lo).astype(_U))
    return at, g[at], c


def _emit(window: int):
    """(text, doc, h) to one row for each anchor: its hash, its phrase's hash and its place."""

    def run(batches):
        for batch in batches:
            texts, docs, hs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for k in range(0, len(docs), 500):
                found = [(i, *anchored(_words(text), window)) for i, text in enumerate(texts.slice(k, 500).to_pylist(), k)]
                found = [f for f in found if len(f[1])]
                if found:
                    i = np.concatenate([np.full(len(at), i) for i, at, _, _ in found])
                    at, g, c = (np.concatenate([f[j] for f in found]) for j in (1, 2, 3))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.view(np.int64), c.view(np.int64), docs[i], hs[i], at.astype(np.int32))], names=["a", "c", "doc", "h", "p"])

    return run


_ANCHOR = "a long, c long, doc long, h long, p int"
#: What the pass over a range tells: copies, phrases to compare, and the first and last anchor of the range.
COPY, PHRASE, END = 0, 1, 2


def _told(kind: int, cols: list[np.ndarray]):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, dtype=np.int32)), *map(pa.array, cols)], names=["kind", "a", "c", "doc", "h", "p"])


def _in_order(batches):
    """One range of sorted anchor rows to what they tell; one row and one phrase are held between batches."""
    row, held, linked, first = None, None, False, None

    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        first = cols[0][:1] if first is None else first
        chain = cols if row is None else [np.concatenate(x) for x in zip(row, cols, strict=True)]
        same = np.logical_and.reduce([x[1:] == x[:-1] for x in chain[:2]])
        again = same & np.logical_and.reduce([x[1:] == x[:-1] for x in chain[2:]])  # the same place of an equal row
        if row is None:
            same, again = np.concatenate([[False], same]), np.concatenate([[False], again])
        row = [x[-1:] for x in cols]
        copy = same & ~again
        if copy.any():
            yield _told(COPY, [x[copy] for x in cols])
        fresh = [x[~same] for x in cols]
        if len(fresh[0]):
            phrases = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            after = phrases[0][1:] == phrases[0][:-1]
            keep = np.concatenate([[linked], after[:-1]])[: len(after)] | after | (phrases[0][:-1] == first)
            if keep.any():
                yield _told(PHRASE, [x[:-1][keep] for x in phrases])
            linked, held = bool(after[-1]) if len(after) else linked, [x[-1:] for x in phrases]
    if held is not None:
        yield _told(PHRASE, held)
        yield _told(END, [np.concatenate([first, held[0]]), *[np.zeros(2, dtype=x.dtype) for x in held[1:]]])


def _phrases(window: int):
    """(text, doc, h, reps) to the words of each wanted phrase, padded at the text's start."""
    reach = window - GRAM

    def run(batches):
        for batch in batches:
            for text, doc, h, reps in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = _words(text)
                for k in range(0, len(reps), 10_000):
                    part = reps[k : k + 10_000]
                    p = np.array([r["p"] for r in part], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r["a"] for r in part], pa.int64()),
                            *[pa.array(np.full(len(part), x, dtype=t)) for x, t in ((0, np.int32), (reach, np.int32), (0, np.int64), (doc, np.int64), (h, np.int64))],
                            pa.array(p),
                            pa.array(np.maximum(reach - p, 0).astype(np.int32)),
                            pa.array([words[max(0, q - reach) : q + window].tobytes() for q in p.tolist()], pa.binary()),
                        ],
                        names=["a", "lo", "hi", "core", "doc", "h", "p", "pad", "words"],
                    )

    return run


_BLOCK = ["a", "lo", "hi", "core"]
_PHRASE = "a long, lo int, hi int, core long, doc long, h long, p int, pad int, words binary"
_SPAN = "doc long, h long, s int, e int"


def _halves(window: int):
    """Phrases of a large block to a row for each half of its window starts in which they have a window, keyed by the words that all these windows hold."""

    def run(batches):
        import xxhash

        for batch in batches:
            out = []
            for a, lo, hi, core, doc, h, p, pad, raw in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid + 1, hi)):
                    if max(x, pad) <= min(y, pad + len(raw) // 8 - window):
                        key = xxhash.xxh3_64_intdigest(raw[8 * (y - pad) : 8 * (x + window - pad)], seed=core & 0xFFFFFFFF)
                        out.append((a, x, y, key - (1 << 63), doc, h, p, pad, raw))
            for k in range(0, len(out), 10_000):
                cols = list(zip(*out[k : k + 10_000], strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds, strict=True)], names=[*_BLOCK, "doc", "h", "p", "pad", "words"])

    return run


def matching_statistics(block: np.ndarray, words: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For every row and start column the length of the longest match that an earlier row of the same block has there.

    ``block``: block of each row; ``words``: rows x columns, word numbers, 0 where
    there is none; ``wanted``: rows x starts, whether the start is of use.
    """
    n, columns = words.shape
    out = np.zeros(wanted.shape, dtype=np.int16)
    span = np.int64(words.max(initial=0)) + 1
    for start in range(wanted.shape[1]):
        rows = np.flatnonzero(wanted[:, start])
        held = block[rows].astype(np.int64)
        for j in range(start, columns):
            w = words[rows, j]
            if not w.all():
                rows, held, w = rows[w > 0], held[w > 0], w[w > 0]
            if len(rows) < 2:
                break
            _, at, held, size = np.unique(held * span + w, return_index=True, return_inverse=True, return_counts=True)
            earlier = at[held] < np.arange(len(rows))
            out[rows[earlier], start] = j + 1 - start
            both = size[held] > 1
            rows, held = rows[both], held[both]
    return out


def parsed(lengths: np.ndarray, lo: np.ndarray, hi: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of every row from ``lo``: (row, s, e) of factors of ``window`` words or more and of matched windows across factors' ends."""
    spans = []
    at, rows = lo.astype(np.int64), np.arange(len(lo))
    while len(rows := rows[at[rows] <= hi[rows]]):
        size = lengths[rows, at[rows]].astype(np.int64)
        end = at[rows] + np.maximum(size, 1)
        long = size >= window
        spans.append((rows[long], at[rows][long], end[long]))
        for ahead in range(1, int(min((end - at[rows]).max(), (hi[rows] - at[rows]).max() + 1))):
            j = at[rows] + ahead
            cross = (j < end) & (j <= hi[rows]) & (j + window > end)
            r, j = rows[cross], j[cross]
            whole = lengths[r, j] >= window
            spans.append((r[whole], j[whole], j[whole] + window))
        at[rows] = end
    return tuple(np.concatenate([s[k] for s in spans]) if spans else np.zeros(0, np.int64) for k in range(3))


def _factor(window: int, batch_rows: int = BATCH):
    """Phrases sorted by block and place to spans of copied words, some blocks at a time."""
    reach = window - GRAM
    columns = reach + window

    def solve(parts):
        cols = [np.concatenate([x[k] for x in parts]) for k in range(8)]
        raw = [r for x in parts for r in x[8]]
        new = np.ones(len(raw), dtype=bool)  # equal rows give a phrase twice
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:7]])
        cols, raw = [x[new] for x in cols], [r for r, keep in zip(raw, new, strict=True) if keep]
        _, lo, hi, _, doc, h, p, pad = cols
        block = np.concatenate([[0], np.cumsum(np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:4]]))])
        size = np.array([len(r) // 8 for r in raw])
        flat = np.unique(np.frombuffer(b"".join(raw), dtype=_U), return_inverse=True)[1].astype(np.int64) + 1
        words = np.zeros((len(raw), columns), dtype=np.int64)
        i = np.repeat(np.arange(len(raw)), size)
        words[i, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + pad[i]] = flat
        j = np.arange(reach + 1)
        lengths = matching_statistics(block, words, (j >= lo[:, None]) & (j <= hi[:, None]))
        r, s, e = parsed(lengths, lo, hi, window)
        origin = p[r].astype(np.int64) - reach
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(h[r]), pa.array((origin + s).astype(np.int32)), pa.array((origin + e).astype(np.int32))], names=["doc", "h", "s", "e"])

    def run(batches):
        held, count, last = [], 0, None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) if k < 8 else batch.column(k).to_pylist() for k in range(9)]
            if not len(batch):
                continue
            cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in cols[:4]])) + 1
            for b, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                key = tuple(x[b] for x in cols[:4])
                if key != last:
                    if count >= batch_rows:
                        yield solve(held)
                        held, count = [], 0
                    last = key
                held.append([x[b:e] for x in cols])
                count += e - b
        if held:
            yield solve(held)

    return run


def _blocks(phrases: DataFrame, window: int, max_block: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Phrases in blocks of ``max_block`` at most, and the spans of those that share a whole window with too many others."""
    small, spans = [], None
    while True:
        hot = settle(phrases.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_block).select(*_BLOCK))
        if hot.isEmpty():
            return [*small, phrases], spans
        small.append(phrases.join(hot, _BLOCK, "left_anti"))
        large = phrases.join(hot, _BLOCK, "left_semi")
        place = F.struct("doc", "h", "p")
        same = large.filter("lo = hi").select(*_BLOCK, "doc", "h", "p")
        firsts = same.groupBy(*_BLOCK).agg(F.min(place).alias("first"))
        s = F.col("p") - (window - GRAM) + F.col("lo")
        later = settle(same.join(firsts, _BLOCK).filter(place != F.col("first")).select("doc", "h", s.alias("s"), (s + window).alias("e")))
        spans = later if spans is None else spans.unionByName(later)
        phrases = settle(large.filter("lo < hi").select(*_BLOCK, "doc", "h", "p", "pad", "words").mapInArrow(_halves(window), _PHRASE))


def copied_spans(docs: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK) -> DataFrame:
    """Keys (doc, h) of the texts that copy earlier passages, with the spans (s, e) of copied words, which may overlap."""
    keyed = _keyed(docs)
    reach = window - GRAM
    rows = settle(keyed.select("text", "doc", "h").mapInArrow(_emit(window), _ANCHOR))
    order = ["a", "c", "doc", "h", "p"]
    told = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_in_order, f"kind int, {_ANCHOR}"))
    unsettle(rows)

    # what touches the ends of a range is put together: two anchors for each range at most
    ends = F.broadcast(told.filter(F.col("kind") == END).select("a").distinct())
    phrases, place = told.filter(F.col("kind") == PHRASE), F.struct("doc", "h", "p")
    edge = settle(phrases.join(ends, "a", "left_semi").groupBy("a", "c").agg(F.min(place).alias("first"), F.collect_set(place).alias("all")))  # a phrase has one row in each range
    copies = told.filter(F.col("kind") == COPY).select("doc", "h", "p").unionByName(edge.select("first", F.explode("all").alias("o")).filter("o <> first").select("o.*"))
    whole = copies.select("doc", "h", F.greatest(F.col("p") - reach, F.lit(0)).alias("s"), (F.col("p") + window).alias("e"))
    mixed = F.broadcast(edge.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a"))
    wanted = phrases.join(ends, "a", "left_anti").select("a", "doc", "h", "p").unionByName(edge.join(mixed, "a", "left_semi").select("a", "first.*"))
    reps = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "p")).alias("reps"))  # of one text
    texts = settle(keyed.join(reps, ["doc", "h"]).select("text", "doc", "h", "reps").mapInArrow(_phrases(window), _PHRASE))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small, spans = _blocks(texts, window, max_block)
    for part in small:
        found = settle(part.select(*_BLOCK, "doc", "h", "p", "pad", "words").repartition(parts, *_BLOCK).sortWithinPartitions(*_BLOCK, "doc", "h", "p").mapInArrow(_factor(window), _SPAN))
        spans = found if spans is None else spans.unionByName(found)
    return settle(whole.unionByName(spans).groupBy("doc", "h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")))


def _kept(words: list[bytes], spans: list | None) -> list[bytes]:
    """Words outside of the sorted spans."""
    out, at = [], 0
    for r in spans or ():
        if r["s"] > at:
            out.extend(words[at : r["s"]])
        at = max(at, r["e"])
    return out + words[at:]


def _cut(batches):
    for batch in batches:
        rest = batch.column(2)
        for k in range(0, len(rest), 1000):
            counts, removed, kept = [], [], []
            for text, spans in zip(batch.column(0).slice(k, 1000).to_pylist(), batch.column(1).slice(k, 1000).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()  # at the six bytes of white space
                left = _kept(words, spans)
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(text if text is None or not spans else b" ".join(left).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([rest.slice(k, 1000), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["rest", "n_words", "n_removed", "text"])


def _digest(batches):
    for batch in batches:
        rest = batch.column(2)
        for k in range(0, len(rest), 1000):
            counts, removed, digests = [], [], []
            for text, spans in zip(batch.column(0).slice(k, 1000).to_pylist(), batch.column(1).slice(k, 1000).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                left = _kept(words, spans)
                counts.append(len(words))
                removed.append(len(words) - len(left))
                digests.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([rest.slice(k, 1000), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests)], names=["rest", "n_words", "n_removed", "kept_sha256"])


def _applied(docs: DataFrame, rest, step, out: str, kind: str, nothing, window: int, max_block: int) -> DataFrame:
    """Columns ``rest``, n_words, n_removed and ``out`` of every row; of equal rows all but one lose what ``nothing`` stands for."""
    keyed = _keyed(docs).select("doc", "h")
    twins = settle(keyed.groupBy("doc", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc", "h", F.lit(True).alias("twin")))
    text = F.col("text").cast("string")
    rows = docs.select(rest.alias("rest"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), F.xxhash64(text).alias("h"))
    joined = rows.join(copied_spans(docs, window, max_block), ["doc", "h"], "left")
    some = not twins.isEmpty()
    if some:
        joined = joined.join(twins, ["doc", "h"], "left")
    joined = joined.select("text", "spans", F.struct("rest", "doc", "h", F.col("twin") if some else F.lit(None).cast("boolean").alias("twin")).alias("rest"))
    done = joined.mapInArrow(step, f"rest {dict(joined.dtypes)['rest']}, n_words long, n_removed long, {out} {kind}")
    done = done.select("rest.*", "n_words", "n_removed", out)
    if some:
        done = settle(done.withColumn("at", F.monotonically_increasing_id()))
        firsts = done.filter("twin").groupBy("doc", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("one"))
        gone = F.col("twin") & F.col("one").isNull() & (F.col("n_words") >= window)
        done = done.join(firsts, "at", "left").withColumns({"n_removed": F.when(gone, F.col("n_words")).otherwise(F.col("n_removed")), out: F.when(gone, nothing).otherwise(F.col(out))})
    return done.select("rest", "n_words", "n_removed", out)


def copy_digest(docs: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words joined by a space) for every row of ``docs``."""
    done = _applied(docs, F.col("doc_id").cast("long"), _digest, "kept_sha256", "string", F.lit(hashlib.sha256(b"").hexdigest()), window, max_block)
    return done.select(F.col("rest").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def without_copies(docs: DataFrame, window: int = WINDOW, max_block: int = MAX_BLOCK) -> DataFrame:
    """``docs`` with copied words cut out; a text that loses some is its kept words joined by a space. All rows and other columns stay."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    done = _applied(docs, rest, _cut, "text", "string", F.lit(""), window, max_block)
    return done.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op11_copied_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_digest(table(spark, sf_dir, "documents"))


#: Every window is compared with every other by its words.
OP11_SQL = r"""
WITH texts AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS w FROM documents),
words AS (SELECT doc_id, unnest(range(len(w))) AS p, unnest(w) AS word FROM texts),
windows AS (SELECT doc_id, unnest(range(len(w) - 19)) AS s, unnest(list_transform(range(len(w) - 19), lambda k: md5(array_to_string(w[k + 1:k + 20], ' ')))) AS x FROM texts WHERE len(w) >= 20),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS r FROM windows),
marked AS (SELECT words.doc_id, p, word, max(CASE WHEN r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY words.doc_id ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM words LEFT JOIN ranked ON words.doc_id = ranked.doc_id AND p = s),
kept AS (SELECT doc_id, sum(gone) AS n, sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE gone = 0), '')) AS d FROM marked GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(d, sha256('')) AS kept_sha256 FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id
"""
