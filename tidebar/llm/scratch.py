"""Intermediate tables in the shared folder that the cluster names.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading
it back, so a lost executor costs a re-read and never a recomputation of the
whole job.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import shared_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The open scopes of this thread (or other context), so that queries that run side by side keep their tables apart.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


#: Writes under way, and what the setting was before the first of them.
_LOCK, _WRITES = Lock(), [0, None]


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and return its reader."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebar-{uuid.uuid4().hex}"
    with _LOCK:
        _WRITES[0] += 1
        if _WRITES[0] == 1:
            _WRITES[1] = spark.conf.get(_CLEAN, None)
            spark.conf.set(_CLEAN, "true")  # this write's shuffle files go when it ends
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        with _LOCK:
            _WRITES[0] -= 1
            if not _WRITES[0]:
                spark.conf.unset(_CLEAN) if _WRITES[1] is None else spark.conf.set(_CLEAN, _WRITES[1])
    for scope in _SCOPES.get():
        scope.append(path)
    return spark.read.schema(df.schema).parquet(path)


def unsettle(df: DataFrame) -> None:
    """Delete the settled table that ``df`` reads, when nothing else will."""
    drop(df.sparkSession, [f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]])


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing will read again."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def tidied(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, settled, with every other table that it has made dropped."""
    with scope() as made:
        out = settle(make())
    drop(spark, made[:-1])
    return out


@contextmanager
def scope():
    """Gather the scratch tables made inside, so the caller can drop them."""
    made: list[str] = []
    before = _SCOPES.set((*_SCOPES.get(), made))
    try:
        yield made
    finally:
        _SCOPES.reset(before)
