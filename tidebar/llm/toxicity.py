"""Toxicity scores: a weighted lexicon matched by Aho-Corasick on folded text.

Text is folded first (lower case, look-alike letters and accents to Latin base
letters, digits that stand for letters), so disguised spellings meet the same
lexicon entry.  The lexicon is learned: whole words, and word stems where an
inflected family of words marks the label together, weighted by log-odds; an
entry must beat chance by more than the number of candidates tried.  Hits must
start at a word boundary (whole words also end at one).  A hit inside an
exception phrase does not count: a hit with the word before or after it is an
exception if documents that hold this phrase are rather clean; these are
learned, and others can be given.  The summed weight is normalised by length and
calibrated by isotonic regression.

Labels are learned only from rows whose crc32(doc_id as text) mod 3 is not 1,
at most ``MAX_LABELLED`` of them, chosen by a hash of the id; that bound is also
what makes the labels' broadcast small, and the sample's texts a table that is
written once and read by every step of learning.

Defined cases: a null text is an empty one; with no usable label the lexicon is
empty and every score is exactly 0.5; repeated rows are scored each; a null doc_id is
scored and counts as not held out.
"""

from __future__ import annotations

import math
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calibration import calibrated, isotonic
from .common import held_out, table
from .scratch import settle

#: The model's parameters.
MAX_LABELLED = 100_000
MAX_ENTRIES = 5_000
MAX_EXCEPTIONS = 5_000
MIN_CLEAN = 5
EXCEPTION_WEIGHT = -1.0
MIN_WEIGHT = 2.5
STEM_LENGTHS = (4, 5, 6, 7, 8)
STEM_WORDS = 3
LOW, HIGH = 0.0, 8.0
#: A document is called toxic from this score on.
THRESHOLD = 0.7

#: Letters that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "з": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s",
}
#: Digits that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
#: Signs that stand for letters between letters.
SIGNS = {"@": "a", "$": "s", "!": "i"}


def _folding() -> dict[int, str]:
    """Translation table: look-alike letters, full-width and other compatibility forms, and digits to base letters.

    Accented letters stay: they are letters of their own in several languages,
    and folding them away would merge harmless words with lexicon entries.
    """
    to = {}
    for code in [*range(0x2100, 0x2200), *range(0xFF00, 0xFF5F)]:
        base = unicodedata.normalize("NFKC", chr(code)).lower()
        if base != chr(code):
            to[code] = base
    return to | {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}


_FOLD = _folding()
_DIGITS = str.maketrans(DIGITS)
_SIGN = re.compile(r"(?<=[a-z])[@$!](?=[a-z])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str | None) -> str:
    """Folded text; also l and i become one letter, as 1 stands for either."""
    text = (text or "").lower()
    text = text.translate(_DIGITS) if text.isascii() else text.translate(_FOLD)
    if "@" in text or "$" in text or "!" in text:
        text = _SIGN.sub(lambda m: SIGNS[m[0]], text)
    return text.replace("l", "i").replace("|", "i")


def _emitted(counts: dict[str, list[int]]):
    words = list(counts)
    for k in range(0, len(words), 50_000):
        part = words[k : k + 50_000]
        two = np.array([counts[w] for w in part], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["word", "toxic", "clean"])


def _count_words(batches):
    """Batches of (text, y) to (word, toxic, clean): in how many documents it stands, summed per task in bounded parts."""
    counts: dict[str, list[int]] = {}
    for batch in batches:
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in set(_WORD.findall(fold(text))):
                counts.setdefault(w, [0, 0])[1 - int(y)] += 1
            if len(counts) > 400_000:
                yield from _emitted(counts)
                counts = {}
    yield from _emitted(counts)


def learn(train: DataFrame) -> list[tuple[str, bool, float]]:
    """Lexicon entries (text, whether a whole word, weight) from settled rows (text, y)."""
    n = train.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).first()
    n_toxic, n_clean = n["toxic"] or 0, n["clean"] or 0
    if not n_toxic or not n_clean:
        return []
    words = settle(train.mapInArrow(_count_words, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    prior, tried = n_toxic / (n_toxic + n_clean), max(2, words.count())

    def marking(counts: DataFrame, text: str) -> list:
        q = F.col("toxic") / (F.col("toxic") + F.col("clean"))
        gain = F.col("toxic") * F.log(q / prior) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - q) / (1 - prior))).otherwise(0.0)
        weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
        held = counts.filter("toxic > 0").withColumn("weight", weight).filter((F.col("weight") >= MIN_WEIGHT) & (gain > math.log(tried) + 2))
        return held.withColumn("gain", gain).orderBy(F.desc("gain"), text).limit(MAX_ENTRIES).select(F.col(text).alias("text"), "weight", "gain").collect()  # MAX_ENTRIES rows at most

    stems = words.select(F.explode(F.array(*[F.struct(F.substring("word", 1, k).alias("stem"), F.lit(k).alias("k")) for k in STEM_LENGTHS])).alias("s"), "word", "toxic", "clean").filter(F.char_length("word") > F.col("s.k"))
    stems = stems.groupBy(F.col("s.stem").alias("stem")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("n")).filter(F.col("n") >= STEM_WORDS)
    # the candidate with most evidence first; what begins with it, or begins it, adds nothing
    found = [(r["gain"], r["text"], whole, float(r["weight"])) for whole, rows in ((False, marking(stems, "stem")), (True, marking(words, "word"))) for r in rows]
    entries: list[tuple[str, bool, float]] = []
    for _, text, whole, weight in sorted(found, key=lambda c: (-c[0], c[2], len(c[1]), c[1])):
        if not any(text.startswith(e) and not w or e.startswith(text) and not whole or e == text for e, w, _ in entries):
            entries.append((text, whole, weight))
    return sorted(entries)


class Matcher:
    """Aho-Corasick automaton over lexicon entries and exception phrases."""

    def __init__(self, lexicon: list[tuple[str, bool, float]], exceptions: tuple[str, ...] = ()):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(fold(phrase), (fold(phrase), True, None))
        for text, whole, weight in lexicon:
            self.automaton.add_word(text, (text, whole, weight))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """Counted hits (start, end, weight) in the folded text, and its length in words."""
        folded = fold(text)
        n = len(folded.split())
        if self.empty:
            return [], n
        hits, harmless, size = [], [], len(folded)
        for last, (entry, whole, weight) in self.automaton.iter(folded):
            start, end = last + 1 - len(entry), last + 1
            if start and folded[start - 1].isalnum() or whole and end < size and folded[end].isalnum():
                continue
            (harmless if weight is None else hits).append((start, end, weight))
        if harmless:
            hits = [h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in harmless)]
        return hits, n

    def density(self, text: str | None) -> float:
        """log1p of the summed weight for each hundred words; texts under 20 words count as 20."""
        hits, n = self.hits(text)
        return math.log1p(100 * sum(h[2] for h in hits) / max(20, n)) if hits else 0.0


def phrases(folded: str, hits: list[tuple[int, int, float]]) -> set[str]:
    """Every hit, to the end of its word, with the word before it and with the word after it."""
    found = set()
    for start, end, _ in hits:
        while end < len(folded) and folded[end].isalnum():
            end += 1
        if folded[end : end + 1] == " " and (after := _WORD.match(folded, end + 1)):
            found.add(folded[start : after.end()])
        first = start - 1
        while first > 0 and folded[first - 1].isalnum():
            first -= 1
        if first < start - 1 and folded[start - 1] == " ":
            found.add(folded[first:end])
    return found


def learn_exceptions(train: DataFrame, lexicon: list[tuple[str, bool, float]]) -> tuple[str, ...]:
    """Phrases around entries that stand in clean documents rather than in toxic ones, MAX_EXCEPTIONS at most."""
    n = train.agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean")).first()
    if not lexicon:
        return ()

    def count(batches):
        matcher = Matcher(lexicon)
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hits, _ = matcher.hits(text)
                for p in phrases(fold(text), hits) if hits else ():
                    counts.setdefault(p, [0, 0])[1 - int(y)] += 1
            if len(counts) > 400_000:
                yield from _emitted(counts)
                counts = {}
        yield from _emitted(counts)

    counts = train.select("text", "y").mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (n["toxic"] + 1)) - F.log((F.col("clean") + 0.5) / (n["clean"] + 1))
    found = counts.filter((F.col("clean") >= MIN_CLEAN) & (weight < EXCEPTION_WEIGHT)).orderBy(F.desc("clean"), "word").limit(MAX_EXCEPTIONS).select("word").collect()
    return tuple(sorted(r["word"] for r in found))


def _densities(lexicon, carried: list[str], exceptions: tuple[str, ...] = ()):
    def run(batches):
        matcher = Matcher(lexicon, exceptions)
        for batch in batches:
            texts = batch.column("text")
            for k in range(0, len(texts), 1000):
                found = [matcher.density(t) for t in texts.slice(k, 1000).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1000) for c in carried], pa.array(found, type=pa.float64())], names=[*carried, "density"])

    return run


def training(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Rows (doc_id, text, y) to learn from; the bounded labels are broadcast, the texts stay where they are."""
    y = labels.filter(F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    y = y.filter(~held_out())
    n = y.count()
    if n > MAX_LABELLED:
        y = y.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * MAX_LABELLED // n)
    y = settle(y)
    y = F.broadcast(y) if y.count() <= 2 * MAX_LABELLED else y  # a sample of about MAX_LABELLED rows, counted
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(y, "doc_id")


def score_toxicity(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Four fifths of the learned rows make the lexicon, the others calibrate it,
    so that words met by chance do not look certain.  ``exceptions``: phrases in
    which an entry is harmless, whatever the labels show.
    """
    train = settle(training(docs, labels))
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 0
    learned = train.filter(~calibrates).select("text", "y")
    lexicon = learn(learned)
    exceptions = (*exceptions, *learn_exceptions(learned, lexicon))
    knots = isotonic(train.filter(calibrates).select("text", "y").mapInArrow(_densities(lexicon, ["y"], exceptions), "y int, density double"), "density", "y", LOW, HIGH)
    densities = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_densities(lexicon, ["doc_id"], exceptions), "doc_id long, density double")

    fitted = bool(lexicon)

    @F.pandas_udf("double")
    def score(density: pd.Series) -> pd.Series:
        return pd.Series(calibrated(density.to_numpy(np.float64), knots, LOW, HIGH) if fitted else np.full(len(density), 0.5))

    return densities.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score("density").alias("score")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op8_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
