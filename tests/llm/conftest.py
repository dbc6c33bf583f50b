import random

import pytest
from corpus_words import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows."""
    rng = random.Random(1)
    long = prose(rng, 30_000)
    same = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, same), (6, same), (7, same.upper()), (None, same), (None, None), (8, prose(rng, 3)), (8, prose(rng, 3)), (9, same + " x"), (9, same + " x"), (10, "é" * 300), (11, "a" * 1000)]
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


#: Column names that operators use inside.
CLASH = ["a", "c", "h", "doc", "u", "x", "y", "n", "p", "node", "chunk", "_salt", "_r", "key", "term", "line", "path", "kept"]


@pytest.fixture(scope="session")
def clashing():
    from pyspark.sql import functions as F

    return lambda df: df.withColumns({c: F.lit("z") for c in CLASH})
