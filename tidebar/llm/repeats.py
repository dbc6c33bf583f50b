"""Exact removal of repeated byte strings with a run-length positional index.

Which strings of ``length`` bytes start at two places of the corpus?

1. Anchors.  Every window of ``length`` bytes owns its least gram, so equal
   windows own equal anchors at equal places.  One row for each anchor, with a
   128-bit hash of its context (all bytes that a window owning it can reach), is
   all that is shuffled for the whole corpus, once: the rows are dealt by ranges
   of (anchor, context, place), so that a passage of a third of all documents is
   spread over as many tasks as its rows fill, and read in order.
2. A row whose neighbour has the same context repeats throughout.  One row of
   each context goes on if a neighbour has the same anchor in another context.
   Only what touches the ends of a range has to be put together afterwards, for
   two anchors of each range at most.
3. Their bytes, aligned at the anchor, are indexed by a Burrows-Wheeler
   transform.  As the alignment is known, it is the positional form of it: the
   order of the contexts by what precedes a column, column by column.  Inside a
   run of equal symbols the next order and the match lengths carry over; only
   at run ends is a length recomputed, as a range maximum between the ends.
   The matching statistics so streamed mark every window that another context
   shares, for all alignments that hold the anchor, which is exactly all.

A group of contexts with one anchor goes to one task up to ``MAX_GROUP``
contexts (some 3 MB), so that a line that stands between different neighbours in a
third of all documents is not gathered.  A larger group is dealt into groups by
what its windows share: one for each half of the window starts and for each
string that all windows of that half hold.  Of what is equal throughout a half
one context goes on, as in step 2; what is alone with its string matches
nothing; the rest are groups, which are dealt again until they are small.
Contexts are told apart by 128 bits of hash beside the anchor's 64, halves of
contexts of larger groups by 64 beside the group's 64.

Defined cases: a null text is an empty one; texts under ``length`` bytes lose
nothing; repeated rows are documents of their own, so both lose everything they
share; a null doc_id is kept and identified by its text's hash.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import GRAM, anchors
from .common import table
from .hashing import mix, prefix_sums
from .scratch import settle, unsettle

LENGTH = 200
#: Contexts of one group that one task may hold.
MAX_GROUP = 8192
#: Contexts that are indexed together, when groups are small.
BATCH = 8192

_U = np.uint64


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key (doc, h) that tells different texts apart even where ids are null or repeat."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), F.hash(text).alias("h"))


def _emit(length: int):
    """(text, doc, h) to one row for each anchor: its hash, the two halves of its context's hash and its place."""
    reach = length - GRAM

    def run(batches):
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            texts, docs, hs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            for k in range(0, len(docs), 500):
                a, c, which, where = [], [], [], []
                for i, text in enumerate(texts.slice(k, 500).to_pylist(), k):
                    raw = (text or "").encode("utf-8", "surrogatepass")
                    at, g = anchors(np.frombuffer(raw, dtype=np.uint8), length)
                    if len(at):
                        view = memoryview(raw)
                        a.append(g)
                        # the side on which the text ends first is part of the context
                        c.extend([digest(view[max(0, p - reach) : p + length], min(p, reach)) for p in at.tolist()])
                        which.append(np.full(len(at), i))
                        where.append(at)
                if a:
                    i = np.concatenate(which)
                    both = np.frombuffer(b"".join(c), dtype="<i8").reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(a).view(np.int64)), *[pa.array(np.ascontiguousarray(both[:, j])) for j in (0, 1)], pa.array(docs[i]), pa.array(hs[i].astype(np.int32)), pa.array(np.concatenate(where).astype(np.int32))],
                        names=["a", "c", "d", "doc", "h", "p"],
                    )

    return run


_ANCHOR = "a long, c long, d long, doc long, h int, p int"
#: What the pass over a range tells: rows that repeat, contexts to compare, and the first and last anchor of the range.
REPEATED, CONTEXT, END = 0, 1, 2


def _told(kind: int, cols: list[np.ndarray], single: np.ndarray):
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(single), kind, dtype=np.int32)), *map(pa.array, cols), pa.array(single)], names=["kind", "a", "c", "d", "doc", "h", "p", "single"])


def _step(held, same: bool, cols: list[np.ndarray], keys: int):
    """Rows of which both neighbours are known: the held one and all new ones but the last.

    Returns them, whether the first ``keys`` columns are those of the row before
    and of the row after, and the new held row with the first of these two.
    """
    if held is not None:
        cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
    after = np.logical_and.reduce([c[1:] == c[:-1] for c in cols[:keys]])
    before = np.concatenate([[same], after])
    return [c[:-1] for c in cols], before[:-1], after, [c[-1:] for c in cols], bool(before[-1])


def _neighbours(batches):
    """One range of sorted anchor rows to what they tell; only a row of either level is held between batches."""
    row, row_same, rep, rep_same, first = None, False, None, False, None

    def contexts(cols, before, after):
        a, single = cols[0], cols[-1]
        # groups of which all is seen and every context repeats have nothing left to find
        group = np.cumsum(~before)
        whole = np.ones(group[-1] + 1, dtype=bool)
        whole[group[0]] &= not before[0]
        whole[group[-1]] &= not after[-1]
        dead = whole & (np.bincount(group, weights=single, minlength=len(whole)) == 0)
        keep = (before | after) & ~dead[group] | (a == first)
        return _told(CONTEXT, [c[keep] for c in cols[:-1]], single[keep])

    def rows(cols, before, after):
        nonlocal rep, rep_same
        again = before | after
        if again.any():
            place = [c[again] for c in cols[3:]]
            yield _told(REPEATED, [np.zeros(len(place[0]), dtype=np.int64)] * 3 + place, ~again[again])
        new = [*[c[~before] for c in cols], ~after[~before]]
        if len(new[0]):
            *known, rep, rep_same = _step(rep, rep_same, new, 1)
            if len(known[0][0]):
                yield contexts(*known)

    for batch in batches:
        if len(batch):
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
            first = cols[0][0] if first is None else first
            *known, row, row_same = _step(row, row_same, cols, 3)
            if len(known[0][0]):
                yield from rows(*known)
    if row is not None:
        yield from rows(row, np.array([row_same]), np.array([False]))
        yield _told(CONTEXT, rep[:-1], rep[-1])
        ends = [np.array([x, y], dtype=c.dtype) for x, y, c in zip([first, 0, 0, 0, 0, 0], [row[0][0], 0, 0, 0, 0, 0], row, strict=True)]
        yield _told(END, ends, np.array([False, False]))


def _contexts(length: int):
    """(text, doc, h, reps) to the bytes of each wanted context, padded at the text's ends on the left."""
    reach = length - GRAM

    def run(batches):
        for batch in batches:
            for text, doc, h, reps in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                rows = [(r["a"], r["single"], doc, h, r["p"], max(0, reach - r["p"]), raw[max(0, r["p"] - reach) : r["p"] + length]) for r in reps]
                for k in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[k : k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, type=t) for x, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)],
                        names=["a", "single", "doc", "h", "p", "pad", "bytes"],
                    )

    return run


_CONTEXT = "a long, single boolean, doc long, h int, p int, pad int, bytes binary"
_SPAN = "doc long, h int, s int, e int"


def matched_windows(group: np.ndarray, symbols: np.ndarray, length: int) -> np.ndarray:
    """Which windows of ``length`` columns some other row of the same group shares.

    ``group``: ascending numbers below 255; ``symbols``: rows x columns of
    byte + 1, 0 where a row has no byte.  Returns rows x window starts.
    """
    rows, columns = symbols.shape
    found = np.zeros((rows, columns - length + 1), dtype=bool)
    order, since = np.arange(rows), np.zeros(rows, dtype=np.int32)  # since: first column from which a row agrees with the one before
    key0 = group.astype(np.uint16) * np.uint16(257)
    for j in range(columns):
        y = symbols[order, j]
        key = key0[order] + y
        to = np.argsort(key, kind="stable")
        key, y = key[to], y[to]
        fresh = np.full(rows, j + 1, dtype=np.int32)
        last, here = to[:-1], to[1:]
        run = (key[1:] == key[:-1]) & (y[1:] > 0)
        inside = run & (here == last + 1)
        fresh[1:][inside] = since[here[inside]]
        ends = np.flatnonzero(run & ~inside)
        if len(ends):
            low, high = last[ends] + 1, here[ends]
            level = np.frexp((high - low + 1).astype(np.float64))[1] - 1  # of the greatest power of two within the range
            tall, most = since, np.empty(len(ends), dtype=np.int32)
            top = int(level.max())
            for power in range(top + 1):
                at = level == power
                if at.any():
                    most[at] = np.maximum(tall[low[at]], tall[high[at] - (1 << power) + 1])
                if power < top:
                    tall = np.maximum(tall[: len(tall) - (1 << power)], tall[1 << power :])
            fresh[1:][ends] = most
        order, since = order[to], fresh
        start = j + 1 - length
        if start >= 0:
            pairs = np.flatnonzero(since[1:] <= start)
            found[order[pairs], start] = True
            found[order[pairs + 1], start] = True
    return found


def _spans(found: np.ndarray, single: np.ndarray, doc: np.ndarray, h: np.ndarray, origin: np.ndarray, length: int):
    """Spans (doc, h, s, e) of the matched windows of single rows; runs of starts are joined."""
    found = found & single[:, None]
    turns = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    r, s = np.nonzero(turns == 1)
    _, e = np.nonzero(turns == -1)
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[r]), pa.array(h[r].astype(np.int32)), pa.array((origin[r] + s).astype(np.int32)), pa.array((origin[r] + e - 1 + length).astype(np.int32))],
        names=["doc", "h", "s", "e"],
    )


def _index(length: int, batch_rows: int = BATCH):
    """Contexts sorted by anchor to the spans of single ones, some groups at a time."""
    reach = length - GRAM
    columns = reach + length

    def solve(parts):
        a, single, doc, h, p, pad, raw = (np.concatenate([np.asarray(x[k], dtype=object if k == 6 else None) for x in parts]) for k in range(7))
        _, group = np.unique(a, return_inverse=True)
        order = np.argsort(group, kind="stable")
        symbols = np.zeros((len(a), columns), dtype=np.uint16)
        for row, i in enumerate(order.tolist()):
            symbols[row, pad[i] : pad[i] + len(raw[i])] = np.frombuffer(raw[i], dtype=np.uint8)
        for row, i in enumerate(order.tolist()):
            symbols[row, pad[i] : pad[i] + len(raw[i])] += 1
        return _spans(matched_windows(group[order], symbols, length), single[order], doc[order], h[order], p[order] - reach, length)

    def run(batches):
        held, count, groups, last = [], 0, 0, None
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False) if k < 6 else batch.column(k).to_pylist() for k in range(7)]
            cuts = np.flatnonzero(np.diff(cols[0])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cols[0])], strict=True):
                if hi == lo:
                    continue
                if cols[0][lo] != last:
                    if held and (count >= batch_rows or groups >= 254):
                        yield solve(held)
                        held, count, groups = [], 0, 0
                    last, groups = cols[0][lo], groups + 1
                held.append([x[lo:hi] for x in cols])
                count += hi - lo
        if held:
            yield solve(held)

    return run


_GROUPED = "a long, lo int, hi int, single boolean, doc long, h int, p int, pad int, bytes binary"


def _halves(length: int):
    """Contexts of a large group to a row for each half of its window starts in which they have a window.

    A row has the group of its half (by the string that all its windows hold), a
    hash of all that it holds of that half, and the span of its windows.
    """
    reach = length - GRAM

    def run(batches):
        import struct

        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for a, lo, hi, single, doc, h, p, pad, raw in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                mid = (lo + hi) // 2
                for x, y in ((lo, mid), (mid + 1, hi)):
                    first, last = max(x, pad), min(y, pad + len(raw) - length)
                    if first <= last:
                        group = digest(struct.pack("<qii", a, x, y) + raw[y - pad : x - pad + length]) - (1 << 63)
                        whole = digest(raw[first - pad : last - pad + length], seed=((first - x) << 16) + last - x) - (1 << 63)
                        out.append((group, x, y, single, doc, h, p, pad, raw, whole, p - reach + first, p - reach + last + length))
            for k in range(0, len(out), 5_000):
                cols = list(zip(*out[k : k + 5_000], strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["a", "lo", "hi", "single", "doc", "h", "p", "pad", "bytes", "whole", "s", "e"])

    return run


def _dealt(texts: DataFrame, length: int, max_group: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Contexts in groups of ``max_group`` at most, and the spans of those that repeat throughout half of a larger group."""
    groups = texts.select("a", F.lit(0).alias("lo"), F.lit(length - GRAM).alias("hi"), "single", "doc", "h", "p", "pad", "bytes")
    small, spans = [], []
    while True:
        huge = settle(groups.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > max_group).select("a"))
        if huge.isEmpty():
            return [*small, groups], spans
        small.append(groups.join(huge, "a", "left_anti"))
        large = groups.join(huge, "a", "left_semi").select("a", "lo", "hi", "single", "doc", "h", "p", "pad", "bytes")
        halves = settle(large.mapInArrow(_halves(length), f"{_GROUPED}, whole long, s int, e int"))
        place = F.struct("doc", "h", "p")
        kinds = settle(halves.groupBy("a", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("rep")))
        again = kinds.filter("n > 1").select("a", "whole")
        spans.append(settle(halves.filter("single").select("a", "whole", "doc", "h", "s", "e").join(again, ["a", "whole"], "left_semi").select("doc", "h", "s", "e")))
        alive = kinds.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("a")
        reps = kinds.join(alive, "a", "left_semi").select("a", "whole", "n", "rep")
        before, groups = halves, settle(halves.join(reps, ["a", "whole"]).filter(place == F.col("rep")).withColumn("single", F.col("single") & (F.col("n") == 1)).select("a", "lo", "hi", "single", "doc", "h", "p", "pad", "bytes"))
        unsettle(before)


def repeated_spans(docs: DataFrame, length: int = LENGTH, max_group: int = MAX_GROUP) -> DataFrame:
    """Keys (doc, h) of the texts that hold repeated strings, with their spans (s, e), which may overlap."""
    keyed = _keyed(docs)
    reach = length - GRAM
    rows = settle(keyed.select("text", "doc", "h").mapInArrow(_emit(length), _ANCHOR))
    order = ["a", "c", "d", "doc", "h", "p"]
    told = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, f"kind int, {_ANCHOR}, single boolean"))
    unsettle(rows)

    # what touches the ends of a range is put together: two anchors for each range at most
    ends = F.broadcast(told.filter(F.col("kind") == END).select("a").distinct())
    contexts = told.filter(F.col("kind") == CONTEXT)
    place = F.struct("doc", "h", "p")
    joined = settle(
        contexts.join(ends, "a", "left_semi").groupBy("a", "c", "d").agg(F.sum(F.when(F.col("single"), 1).otherwise(2)).alias("n"), F.min(place).alias("rep"), F.collect_list(F.when(F.col("single"), place)).alias("ones"))  # a context has one row in each range
    )
    repeated = told.filter(F.col("kind") == REPEATED).select("doc", "h", "p").unionByName(joined.filter("n > 1").select(F.explode("ones").alias("o")).select("o.*"))
    whole = repeated.select("doc", "h", F.greatest(F.col("p") - reach, F.lit(0)).alias("s"), (F.col("p") + length).alias("e"))
    mixed = F.broadcast(joined.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.count_if(F.col("n") == 1).alias("singles")).filter("k > 1 and singles > 0").select("a"))
    wanted = contexts.join(ends, "a", "left_anti").select("a", "single", "doc", "h", "p").unionByName(joined.join(mixed, "a", "left_semi").select("a", (F.col("n") == 1).alias("single"), "rep.*"))
    reps = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("a", "single", "p")).alias("reps"))  # of one text
    texts = settle(keyed.join(reps, ["doc", "h"]).select("text", "doc", "h", "reps").mapInArrow(_contexts(length), _CONTEXT))
    # a text that repeats under one key gives its contexts twice; one of them stands for all
    small, spans = _dealt(texts, length, max_group)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["a", "single", "doc", "h", "p", "pad", "bytes"]
    usual = reduce(DataFrame.unionByName, [part.select(*columns) for part in small])
    found = settle(usual.repartition(parts, "a").sortWithinPartitions("a").mapInArrow(_index(length), _SPAN))
    return settle(reduce(DataFrame.unionByName, [whole, found, *spans]).groupBy("doc", "h").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans")))


def merged(spans: list | None, size: int) -> list[tuple[int, int]]:
    """Maximal runs of sorted spans, cut to the text."""
    runs: list[tuple[int, int]] = []
    for r in spans or ():
        s, e = r["s"], min(r["e"], size)
        if runs and s <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(e, runs[-1][1]))
        else:
            runs.append((s, e))
    return runs


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[s:e] for s, e in zip([0, *[e for _, e in runs]], [*[s for s, _ in runs], len(raw)], strict=True))


def _digest(batches):
    for batch in batches:
        ids = batch.column(0)
        for k in range(0, len(ids), 1000):
            rows = []
            for text, spans in zip(batch.column(1).slice(k, 1000).to_pylist(), batch.column(2).slice(k, 1000).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = merged(spans, len(raw))
                rows.append((len(raw), sum(e - s for s, e in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([ids.slice(k, 1000), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _clean(batches):
    for batch in batches:
        rest = batch.column(2)
        for k in range(0, len(rest), 1000):
            out = []
            for text, spans in zip(batch.column(0).slice(k, 1000).to_pylist(), batch.column(1).slice(k, 1000).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                # a character of which a byte is removed goes as a whole
                out.append(_kept(raw, merged(spans, len(raw))).decode("utf-8", "ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([rest.slice(k, 1000), pa.array(out, pa.string())], names=["rest", "text"])


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs``."""
    spanned = _keyed(docs).join(repeated_spans(docs, length), ["doc", "h"], "left").select("doc_id", "text", "spans")
    return spanned.mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of text; all rows and other columns stay."""
    others = [c for c in docs.columns if c != "text"]
    text = F.col("text").cast("string")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("rest"), text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(text)).alias("doc"), F.hash(text).alias("h"))
    spanned = keyed.join(repeated_spans(docs, length), ["doc", "h"], "left").select("text", "spans", "rest")
    cut = spanned.mapInArrow(_clean, f"rest {dict(spanned.dtypes)['rest']}, text string")
    return cut.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c}`").alias(c) for c in docs.columns])


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))
