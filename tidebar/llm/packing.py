"""Sequence packing by minimum bin slack over the histogram of piece lengths.

Every document is tokenised once, where Spark reads it, and cut into windows of
``capacity`` ids plus one remainder.  What has to be planned is then only *how
many* pieces of each length there are: a histogram of at most ``capacity``
entries, whatever the size of the corpus.  The driver runs the minimum-bin-slack
search on it: the longest piece left is placed first, a bitset subset-sum
dynamic program finds the multiset of remaining lengths that fills the window
closest to capacity, the choice is backtracked with counts and repeated as
often as the histogram allows.  Executors map (length, rank within that length)
to (sequence, offset) by binary search in that plan.

Defined cases: a null text is an empty one and packs as its single end id;
repeated rows are packed each; an empty table gives no rows; further columns
of the input are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import number_within, table
from .scratch import settle

CAPACITY = 4096
END_ID = 2
#: Words a worker remembers; with more, all but those of the last texts are forgotten.
CACHE_WORDS = 300_000
#: Bytes of text that are cut into words at once (one longer text alone).
CHUNK_BYTES = 4_000_000
#: Signs that end a word and whose ids follow the word's own; an apostrophe may belong to a suffix.
TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\n", b"abcdefghijklmnopqrstuvwxyz ")
_LINES = bytes.maketrans(b"\n", b" ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level tokenizers write for each byte: itself where it prints, the next free one from 256 on elsewhere."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in prints else next(free)) for b in range(256)}


class WordCache:
    """Ids of whole texts; each distinct word of a stretch of texts is looked up once.

    A space or newline always ends a word for this tokenizer (its pre-tokenizer
    drops white space and its normaliser never composes across it), so the ids
    of a text are those of its space-separated chunks put together.  Letters and
    the signs after them are words of their own, too.  It lower-cases, so words
    that differ in the case of A-Z are one, unless the texts hold ``<|``, with
    which a special token may begin.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.exact = Tokenizer.from_file(path)
        # words of Latin letters are normalised by lower-casing: their bytes go straight to the merges
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = _byte_letters()
        probe = "zürich naïve the ñandú"
        got = self.merges.encode(" ".join(w.encode().decode("latin-1").translate(self.letters) for w in probe.split()), add_special_tokens=False)
        self.direct = got.ids == self.exact.encode(probe, add_special_tokens=False).ids
        size = self.exact.get_vocab_size(with_added_tokens=True)
        self.word_end = np.array([(self.exact.id_to_token(i) or "").endswith("</w>") for i in range(size)], dtype=bool)
        self.codes: dict[bytes, int] = {}
        self.flat, self.sizes, self.starts = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def forget(self, keep: list[bytes]) -> None:
        """Start anew with the ids of ``keep`` only."""
        at = np.array([self.codes[w] for w in keep], dtype=np.int64)
        self.flat, self.sizes = self._gathered(at), self.sizes[at]
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.codes = {w: k for k, w in enumerate(keep)}

    def _gathered(self, code: np.ndarray) -> np.ndarray:
        """The ids of some codes in a row."""
        sizes = self.sizes[code]
        after = np.cumsum(sizes)
        return self.flat[np.arange(after[-1] if len(after) else 0) + np.repeat(self.starts[code] - after + sizes, sizes)]

    def _add(self, words: list, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.codes.update(zip(words, range(len(self.sizes), len(self.sizes) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes, self.flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, ids])

    def _exactly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one by one, and how many each has."""
        got = [e.ids for e in self.exact.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], dtype="<u4"), np.array([len(ids) for ids in got], dtype=np.int64)

    def _plainly(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for lower-case words of Latin letters: a thousand at a time, told apart by the tokens that end a word."""
        spelt = [w if w.isascii() else w.encode().decode("latin-1").translate(self.letters) for w in words]
        got = self.merges.encode_batch_fast([" ".join(spelt[j : j + 1000]) for j in range(0, len(spelt), 1000)], add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, "<u4"), *(np.array(e.ids, dtype="<u4") for e in got)])
        ends = np.flatnonzero(self.word_end[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else self._exactly(words)

    def learn(self, words: list[bytes]) -> None:
        """Encode new words."""
        cores: dict[str, int] = {}  # plain words without their signs
        rest: dict[str, int] = {}  # signs, and all other words
        of = np.zeros((2, len(words)), dtype=np.int64)  # from 1 on; 0 for none
        for k, w in enumerate(words):
            text = w.decode("utf-8", "surrogatepass")
            core = text.rstrip(TAIL)
            if self.direct and core.isalpha() and (core.isascii() or max(core) < "\u0250" and "\u0130" not in core):
                text = text[len(core) :]
                of[0, k] = cores.setdefault(core.lower(), len(cores) + 1)
            if text:
                of[1, k] = rest.setdefault(text, len(rest) + 1)
        parts = [self._plainly(list(cores)), self._exactly(list(rest))]
        sizes = np.concatenate([[0], parts[0][1], parts[1][1]]).astype(np.int64)
        starts = np.cumsum(sizes) - sizes
        which = np.where(of[1] > 0, of[1] + len(cores), 0)
        both = np.stack([of[0], which], axis=1).ravel()
        flat, counts = np.concatenate([parts[0][0], parts[1][0]]), sizes[both]
        after = np.cumsum(counts)
        ids = flat[np.arange(after[-1]) + np.repeat(starts[both] - after + counts, counts)]
        self._add(words, ids, counts.reshape(-1, 2).sum(axis=1))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row (little-endian unsigned 32-bit), and where each text's begin (one more for the end)."""
        raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        blob = b"\n".join([*raws, b""])
        blob = blob.translate(_LINES if b"<|" in blob else _LOWER)
        ends = np.flatnonzero(np.frombuffer(blob, dtype=np.uint8) == 32) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(blob)]).dictionary_encode()
        distinct = words.dictionary.buffers()[2].to_pybytes().split(b" ")[: len(words.dictionary)]
        missing = [w for w in distinct if w not in self.codes]
        if len(self.codes) + len(missing) > CACHE_WORDS:
            self.forget([w for w in distinct if w in self.codes])
        if missing:
            self.learn(missing)
        code = np.fromiter(map(self.codes.__getitem__, distinct), dtype=np.int64, count=len(distinct))[words.indices.to_numpy()]
        ids, after = self._gathered(code), np.cumsum(self.sizes[code])
        last = np.searchsorted(ends, np.cumsum([len(r) + 1 for r in raws]))
        return ids, np.concatenate([[0], after[last]]) if len(texts) else np.zeros(1, dtype=np.int64)


def stretches(sizes: list[int], most: int = CHUNK_BYTES):
    """Ranges of texts of about ``most`` bytes together, one at least."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


_PIECES = "doc_id long, doc_tokens long, start long, length int, ids_crc32 long, nth int"


def _cut(path: str, capacity: int, end_id: int):
    """Batches of (doc_id, text) to the pieces of each document."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        cache = WordCache(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in stretches(sizes):
                ids, bounds = cache.encode(batch.column(1).slice(lo, hi - lo).to_pylist())
                raw = memoryview(np.insert(ids, bounds[1:], end_id).astype("<u4", copy=False)).cast("B")
                bounds = bounds + np.arange(len(bounds))  # every text has its end id
                total = np.diff(bounds)
                pieces = -(-total // capacity)
                of = np.repeat(np.arange(len(total)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(capacity, total[of] - start)
                first = 4 * (bounds[of] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).take(pa.array(of)), pa.array(total[of]), pa.array(start), pa.array(length.astype(np.int32)), pa.array(crc, pa.int64()), pa.array(np.arange(len(of), dtype=np.int32))],
                    names=["doc_id", "doc_tokens", "start", "length", "ids_crc32", "nth"],
                )

    return run


def fill(lengths: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
    """The multiset of (length, count) whose sum is the largest not over ``room``.

    Bit s of the reach bitset says that s can be made of the lengths so far;
    the bitset before each length is kept for the way back, on which a length
    is used as often as takes the sum back to what was reachable without it.
    """
    if room <= 0:
        return []
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length, count in lengths:
        if length > room:
            continue
        before, left, step = reach, min(count, room // length), 1
        while left:
            take = min(step, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            step *= 2
        steps.append((length, before))
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, []
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            used.append((length, n))
    return used


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (how many sequences, [(length, copies), ...]) that use up the histogram.

    Each pattern is repeated until a length runs short, so their number depends
    on the number of distinct lengths, not on the number of pieces.
    """
    left, patterns = dict(histogram), []
    while left:
        longest = max(left)
        rest = sorted(((x, n - (x == longest)) for x, n in left.items() if n > (x == longest)), reverse=True)
        need = {longest: 1}
        for length, n in fill(rest, capacity - longest):
            need[length] = need.get(length, 0) + n
        times = min(left[x] // n for x, n in need.items())
        patterns.append((times, sorted(need.items(), reverse=True)))
        for x, n in need.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return patterns


def _slots(patterns) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, first offset)."""
    rows, taken, sequence = [], {}, 0
    for times, need in patterns:
        offset = 0
        for length, n in need:
            rows.append((length, taken.get(length, 0), n, sequence, offset))
            taken[length] = taken.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    ``docs`` has doc_id and text.  The tokenizer's file is read on the
    executors.  Returns doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.
    """
    path = tokenizer or default_tokenizer()
    pieces = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_cut(path, capacity, end_id), _PIECES))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    slots = _slots(plan(histogram, capacity))
    key = (slots[:, 0] << 44) + slots[:, 1]

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        size, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = slots[np.searchsorted(key, (size << 44) + rank, side="right") - 1]
        nth = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 3] + nth // at[:, 2], "offset": at[:, 4] + nth % at[:, 2] * size})

    ranked = number_within(pieces, ["length"], "nth", ["doc_id", "start", "ids_crc32"], "_rank")
    return ranked.withColumn("_at", place("length", "_rank")).select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset")
    )


def op5_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
