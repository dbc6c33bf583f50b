"""The corpus pipeline: quality, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before
kept, and returns a DataFrame; all but the last return the columns of documents.
Null texts and ids, repeated rows and empty tables behave in each stage as its
operator's module says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import decontam, minhash, packing, quality, repeats, scratch
from tidebar.llm.common import table

#: Scratch tables of the last stage by application and input, which its result still reads.
_made: dict[tuple[str, str], list[str]] = {}


def _staged(step):
    """A stage's scratch tables are dropped when the next stage starts: its result is written by then."""

    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf_dir)
        done = _made.pop(key, [])
        if step is not _keep_quality:
            scratch.drop(spark, done)
        with scratch.scope() as made:
            out = step(spark, docs, sf_dir)
        _made[key] = list(made)
        return out

    return stage


def _keep_quality(spark, docs, sf_dir):
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def _one_of_each(spark, docs, sf_dir):
    return minhash.one_of_each(docs)


def _cut_repeats(spark, docs, sf_dir):
    out = repeats.without_repeats(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _drop_leaks(spark, docs, sf_dir):
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def _pack(spark, docs, sf_dir):
    return packing.pack(docs)


_STEPS = [
    ("quality", _keep_quality),
    ("near_duplicates", _one_of_each),
    ("repeats", _cut_repeats),
    ("decontamination", _drop_leaks),
    ("packing", _pack),
]
STAGES = [(name, _staged(step)) for name, step in _STEPS]

#: Tokenising and the classifier are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and read again; of all tables only the last result stays."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, step) in enumerate(_STEPS):
        before, docs = docs, scratch.tidied(spark, lambda step=step, docs=docs: step(spark, docs, sf_dir))
        if k:
            scratch.unsettle(before)
    return docs
