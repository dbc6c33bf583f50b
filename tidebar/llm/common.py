"""Pieces that several operators share: numbering, components, readers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def carried(spark: SparkSession, value) -> Broadcast:
    """Broadcast a value of this package's classes so that executors need no copy of the package."""
    return spark.sparkContext.broadcast([cloudpickle.dumps(value)])


def unpacked(shared: Broadcast):
    """What ``carried`` has sent; unpacked once in each worker."""
    held = shared.value
    if isinstance(held[0], bytes):
        held[0] = cloudpickle.loads(held[0])
    return held[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the rows whose labels are never learned from."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 == 1


def number_within(df: DataFrame, keys: list[str], by: str, order: list[str], out: str) -> DataFrame:
    """Add ``out`` for ``by``: gapless numbers from 0 within each key, in no order of their own, without gathering a key.

    A key's rows are dealt over salts by the number ``by``, which must differ
    between equal rows, or a hot one would be gathered; rows are numbered within
    (key, salt) in ``order`` and shifted by the running count of the salts
    before.  ``df`` must be settled.  Null keys form a group.
    """
    salts = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    df = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).drop(by)
    ks = [*keys, "_salt"]
    counts = df.groupBy(*ks).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in ks],
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_shift"),
    )
    numbered = df.withColumn("_r", F.row_number().over(Window.partitionBy(*ks).orderBy(*order)))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in ks]
    joined = numbered.join(shifts, on, "left")
    return joined.withColumn(out, (F.col("_r") - 1 + F.col("_shift")).cast("long")).select(*[c for c in df.columns if c != "_salt"], out)


def number_sorted(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Add ``out``: gapless numbers from 0 within each key by ``order``, without gathering a key.

    Rows are dealt by ranges of (keys, order, row), so that neither a key nor
    equal rows meet in one task, and written in that order; a row's number is its
    place in its range, shifted by what the ranges before hold of its key.
    ``df`` must be settled.  Null keys form a group.
    """
    rows = df.withColumn("_row", F.monotonically_increasing_id())
    by = [*keys, *order, "_row"]
    rows = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    rows = rows.withColumn("_range", F.shiftright("_at", 33))
    w = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    bases = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), (F.col("_first") - F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_base"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(bases, [*on, F.col("_range") == F.col("_r")]).withColumn(out, (F.col("_at") - F.col("_base")).cast("long")).select(*df.columns, out)


def _forest(batches):
    """Union-find over one partition's edges: (node, smallest node) stars."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := parent.get(root, root)) != root:
            root = p
        while (p := parent.get(x, x)) != root:
            parent[x], x = root, p
        return root

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = list(parent)
    for k in range(0, len(nodes), 100_000):
        part = nodes[k : k + 100_000]
        pdf = pd.DataFrame({"a": np.array([find(x) for x in part], dtype="int64"), "b": np.array(part, dtype="int64")})
        yield pdf[pdf.a != pdf.b]


def _are_stars(e: DataFrame) -> bool:
    """Whether every node is either a centre or has one link, to its centre; centres are counted with map-side combination."""
    ends = e.select(F.col("a").alias("n"), F.lit(0).alias("k")).unionByName(e.select(F.col("b").alias("n"), F.lit(1).alias("k")))
    return ends.groupBy("n").agg(F.sum("k").alias("links"), F.min("k").alias("least")).filter("links > 1 or links = 1 and least = 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (a long, b long): rows (id, component), smallest id.

    Union-find within partitions, then alternating large-star and small-star
    steps, each settled in the shared folder, until only stars are left; nothing
    but the answer whether that is so comes to the driver.  Nodes without an
    edge to another node are not listed.
    """
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b")
    e = settle(e.mapInPandas(_forest, "a long, b long").distinct())
    while not _are_stars(e):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small-star: every node keeps one link to its least neighbour, the others link to that one
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("b", "a")).alias("b")).filter("a <> b")
        e = settle(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return e.select(F.col("b").alias("id"), F.col("a").alias("component"))
