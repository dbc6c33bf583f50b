"""Embedding near-duplicates by counting collisions of one-dimensional projections.

Vectors of one label are sorted along the first of ``PROJECTIONS`` random
directions and dealt into blocks of at most ``BLOCK`` rows; two blocks are
compared only if their ranges come within a wide window of each other, so no
label is ever gathered, and a hot one is many block pairs.  In a block pair
every vector is a query: each projection of the other block is sorted once, the
vectors in the window centred on the query collide with it, and only these
collisions are written down and counted by pair.  Pairs are verified by cosine
in double precision when their collisions reach the calibrated count.

Calibration: at the threshold t, two unit vectors differ along a Gaussian
direction by a normal variable of variance 2 - 2t.  The half-window is
``WINDOW`` of its standard deviations, in which every sixth of unrelated vectors
falls; the count is the largest that a pair at t reaches with probability
1 - ``MISS`` at least, which a few in a hundred unrelated pairs do.  The block
window is seven deviations.  In directions of many dimensions no window shuts
out all but a fixed part of unrelated vectors, so work grows with the square of
a label, a fiftieth of a dimension's product for each pair.

Equal vectors of a label are one node with a multiplicity.  A block pair returns
sums of links and one link to the least partner of each connected part, so
groups of thousands are not expanded into pairs.

Defined cases: null or empty vectors, zero vectors, null or non-finite
components and null labels link with nothing; vectors of different lengths
link with nothing; a null vec_id has a null component and is not kept; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table
from .scratch import settle

SIMILARITY = 0.98
PROJECTIONS = 24
WINDOW = 1.5
BLOCK = 2048
MISS = 1e-9
SEED = 11


def calibration(similarity: float, projections: int = PROJECTIONS, miss: float = MISS) -> tuple[float, int]:
    """Half-width of the windows and the collisions to ask for."""
    sigma = math.sqrt(max(2 - 2 * similarity, 1e-12))
    p = math.erf(WINDOW / math.sqrt(2))
    tail, count = 0.0, 0
    while count < projections:
        tail += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if tail > miss:
            break
        count += 1
    return WINDOW * sigma, count


def _directions(d: int) -> np.ndarray:
    return np.random.default_rng([SEED, d]).normal(size=(d, PROJECTIONS))


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def _project(batches):
    for batch in batches:
        vectors = batch.column(3).to_pylist()
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_size.setdefault(len(v), []).append(i)
        first = np.zeros(len(vectors))
        for d, rows in by_size.items():
            first[rows] = _unit(np.array([vectors[i] for i in rows])) @ _directions(d)[:, 0]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first)], names=[*batch.schema.names, "p0"])


def _blocks(size: int):
    """Rows sorted by (label, d, p0) to packed blocks."""

    def pack(part, held):
        number, (label, d) = part
        ids, weights, vectors, p0 = (np.concatenate([h[k] for h in held]) for k in range(4))
        return (f"{number}-{ids[0]}", label, d, float(p0[0]), float(p0[-1]), ids.tolist(), weights.tolist(), vectors.tobytes())

    def run(batches):
        from pyspark import TaskContext

        partition, key, held, count, number = TaskContext.get().partitionId(), None, [], 0, 0
        names = ["block", "label", "d", "lo", "hi", "ids", "weights", "vectors"]
        kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
        rows = []
        for batch in batches:
            labels, dims = batch.column("label").to_numpy(zero_copy_only=False), batch.column("d").to_numpy()
            cuts = [0, *(np.flatnonzero((labels[1:] != labels[:-1]) | (np.diff(dims) != 0)) + 1).tolist(), len(labels)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = (labels[a], int(dims[a]))
                while a < b:
                    if held and (now != key or count >= size):
                        rows.append(pack((f"{partition}-{number}", key), held))
                        held, count, number = [], 0, number + 1
                    key, take = now, min(b - a, size - count)
                    cut = batch.slice(a, take)
                    held.append((cut.column("rep").to_numpy(), cut.column("n").to_numpy(), np.array(cut.column("v").to_pylist(), dtype=np.float64), cut.column("p0").to_numpy()))
                    a, count = a + take, count + take
            if len(rows) >= 8:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if held:
            rows.append(pack((f"{partition}-{number}", key), held))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


#: Blocks of a label that meet each of its blocks under one key.
SPREAD = 64


def links_between(x: np.ndarray, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i, j) of two blocks whose cosine reaches the similarity."""
    width, need = calibration(similarity)
    ux, uy = _unit(x), _unit(y)
    a = _directions(x.shape[1])
    px, py = (ux @ a).T, (uy @ a).T
    order = np.argsort(py, axis=1)
    sorted_ = np.take_along_axis(py, order, axis=1)
    lo, hi = (np.stack([np.searchsorted(row, at + d, side=side) for row, at in zip(sorted_, px, strict=True)], axis=1).tolist() for d, side in ((-width, "left"), (width, "right")))
    rows = list(order)
    mine, theirs = [], []
    for q, (starts, ends) in enumerate(zip(lo, hi, strict=True)):
        # what collides along one direction stands in a row of its sorted order
        hits = np.bincount(np.concatenate([row[s:e] for row, s, e in zip(rows, starts, ends, strict=True)]), minlength=1)
        some = np.flatnonzero(hits >= need)
        if len(some):
            mine.append(np.full(len(some), q))
            theirs.append(some)
    if not mine:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(mine), np.concatenate(theirs)
    keep = np.zeros(len(i), dtype=bool)
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    for k in range(0, len(i), 20_000):
        s, t = i[k : k + 20_000], j[k : k + 20_000]
        keep[k : k + 20_000] = (x[s] * y[t]).sum(1) / (nx[s] * ny[t]) >= similarity
    return i[keep], j[keep]


def _compare(similarity: float):
    """Block pairs to (kind, a, b): kind 0 adds b links to vector a, kind 1 links a with b."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vx"]).reshape(-1, row["d"])
                same = row["bx"] == row["by"]
                y = x if same else np.frombuffer(row["vy"]).reshape(-1, row["d"])
                i, j = links_between(x, y, similarity)
                if same:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                ids = np.array(row["ix"] if same else row["ix"] + row["iy"])
                weights = np.array(row["wx"] if same else row["wx"] + row["wy"])
                j = j if same else j + len(x)
                links = np.bincount(i, weights=weights[j], minlength=len(ids)) + np.bincount(j, weights=weights[i], minlength=len(ids))
                least, before = ids.copy(), None
                while before is None or (least != before).any():
                    before = least.copy()
                    np.minimum.at(least, i, before[j])
                    np.minimum.at(least, j, before[i])
                some = np.flatnonzero(links)
                tied = np.flatnonzero(least != ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([0, 1], [len(some), len(tied)]).astype(np.int32)), pa.array(np.concatenate([ids[some], ids[tied]])), pa.array(np.concatenate([links[some].astype(np.int64), least[tied]]))],
                    names=["kind", "a", "b"],
                )

    return run


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    marks = [F.xxhash64("v").alias("k1"), F.hash("v").alias("k2"), F.size("v").alias("d")]
    rows = settle(rows.select("vec_id", "label", "v", F.coalesce(fine, F.lit(False)).alias("fine"), *marks))
    same = ["label", "k1", "k2", "d"]
    reps = settle(rows.filter("fine").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")))
    ordered = reps.select("rep", "label", "n", "v", "d").mapInArrow(_project, "rep long, label string, n long, v array<double>, d int, p0 double")
    ordered = settle(ordered).repartitionByRange("label", "d", "p0").sortWithinPartitions("label", "d", "p0")
    blocks = settle(ordered.mapInArrow(_blocks(block), "block string, label string, d int, lo double, hi double, ids array<long>, weights array<long>, vectors binary"))

    # ranges of blocks that come within seven deviations; a label's blocks are rows / BLOCK, and its pairs are
    # dealt by groups of SPREAD of their second blocks, so that a hot label's are not made under one key
    groups = settle(blocks.groupBy("label", "d").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("groups")))
    reach = 7 * math.sqrt(max(2 - 2 * similarity, 1e-12))
    x = blocks.select("label", "d", F.col("block").alias("bx"), F.col("lo").alias("lx"), F.col("hi").alias("hx"))
    y = blocks.select("label", "d", F.col("block").alias("by"), F.col("lo").alias("ly"), F.col("hi").alias("hy"))
    x = x.join(groups, ["label", "d"]).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    y = y.join(groups, ["label", "d"]).withColumn("group", F.pmod(F.xxhash64("by"), "groups").cast("int")).drop("groups")
    near = x.join(y, ["label", "d", "group"]).filter((F.col("bx") <= F.col("by")) & (F.col("ly") - F.col("hx") <= reach) & (F.col("lx") - F.col("hy") <= reach)).select("bx", "by")
    one = blocks.select(F.col("block").alias("bx"), "d", F.col("ids").alias("ix"), F.col("weights").alias("wx"), F.col("vectors").alias("vx"))
    two = blocks.select(F.col("block").alias("by"), F.col("ids").alias("iy"), F.col("weights").alias("wy"), F.col("vectors").alias("vy"))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(near).repartition(4 * parts, F.xxhash64("bx", "by")).join(one, "bx").join(two, "by")
    found = settle(dealt.mapInArrow(_compare(similarity), "kind int, a long, b long"))

    degree = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    grouped = components(found.filter("kind = 1").select("a", "b"))
    placed = settle(reps.drop("v").join(degree, "rep", "left").join(grouped.withColumnRenamed("id", "rep"), "rep", "left").select(*same, F.lit(True).alias("fine"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("of")))
    return (
        rows.drop("v")
        .join(placed, [*same, "fine"], "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("of", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id
  WHERE list_dot_product(x.e, y.e) / (sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least_id AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least_id l USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""
