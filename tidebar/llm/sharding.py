"""Sharding by a k-d tree whose cuts are distributed weighted medians.

A shard tree over text metadata (bytes, characters per byte, words per
character): every node is cut along its widest dimension at the point that
halves its bytes, until the leaves reach the target.  A level is a table of
nodes that is joined to the rows, and rows carry their node from level to level,
so plans do not grow with the tree.  The median is found by radix selection for
all nodes of a level at once: each pass sums bytes by the next 12 bits of the
sort key and a window over those sums finds the digit; once few rows are left to
choose from, their whole keys are summed at once.  Only counts come to the
driver.  A node of ``FEW`` rows or less is cut to its leaves in one task.

Equal texts have equal coordinates and an equal hash in the low bits of the
key, so a group of copies stays on one side of every cut.  Only a group heavier
than ``tolerance`` of a shard, and than ``GROUP`` documents of mean size, is
dealt into chunks of that weight (there are at most shards / tolerance such
groups, which bounds the broadcast), and then only a cut that falls inside the
group separates its chunks.  The law is ``bytes``.

Defined cases: a null text weighs 1 and has the CRC of the empty text; repeated
rows are sharded each; an empty table gives no rows; empty leaves are allowed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import number_within, table
from .scratch import settle, unsettle

DIMENSIONS = ["d_bytes", "d_script", "d_words"]
DIM_BITS, HASH_BITS, CHUNK_BITS, DIGIT = 20, 28, 12, 12
KEY_BITS = DIM_BITS + HASH_BITS + CHUNK_BITS
#: Nodes of so many rows are cut by one task, and so many keys of a node are summed whole.
FEW = 50_000
#: Groups up to the weight of so many documents of mean size are never cut.
GROUP = 4


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, a text hash and the coordinates in [0, 1]; the text is left behind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    nbytes, nchars = F.octet_length(text), F.char_length(text)
    spaces = nchars - F.char_length(F.replace(text, F.lit(" "), F.lit("")))
    size = F.when(F.col("text").isNull(), F.lit(1)).otherwise(nbytes + 1).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        (F.log2(size.cast("double")) / 40).alias("d_bytes"),
        F.coalesce(F.try_divide(nchars, nbytes), F.lit(1.0)).alias("d_script"),
        F.coalesce(F.try_divide(spaces, nchars), F.lit(0.0)).alias("d_words"),
    )


def _key(dim: str) -> Column:
    """Sort key along a dimension: its value, then the text's hash, then the chunk."""
    value = F.floor(F.col(dim) * (2**DIM_BITS - 1)).cast("long")
    return F.shiftleft(value, HASH_BITS + CHUNK_BITS) + F.shiftleft(F.pmod("h", F.lit(2**HASH_BITS)), CHUNK_BITS) + F.col("chunk")


def _chunked(points: DataFrame, target: float, tolerance: float) -> DataFrame:
    """Deal groups of equal texts that outweigh ``tolerance`` of a shard, and an ordinary group, into chunks."""
    mean = points.agg(F.avg("size")).first()[0] or 1.0
    limit = max(1.0, target * tolerance, GROUP * mean)
    heavy = points.groupBy("h", "size").agg(F.sum("size").alias("w")).filter(F.col("w") > limit).select("h", "size", F.least(F.ceil(F.col("w") / limit), F.lit(2**CHUNK_BITS)).alias("chunks"))
    joined = points.join(F.broadcast(heavy), ["h", "size"], "left")  # at most total / limit rows
    return joined.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.coalesce("chunks", F.lit(1)))).drop("chunks")


def _measured_nodes(rows: DataFrame) -> DataFrame:
    """A row for each node: rows, weight, and the number of its widest dimension."""
    sums = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), *[F.min(d).alias(f"lo_{d}") for d in DIMENSIONS], *[F.max(d).alias(f"hi_{d}") for d in DIMENSIONS])
    widths = [F.col(f"hi_{d}") - F.col(f"lo_{d}") for d in DIMENSIONS]
    widest = F.lit(len(DIMENSIONS) - 1)
    for k in range(len(DIMENSIONS) - 2, -1, -1):
        widest = F.when(widths[k] == F.greatest(*widths), k).otherwise(widest)
    return sums.select("node", "n", "total", widest.cast("int").alias("dim"))


def _finished(levels: int):
    """Rows of one node to their leaves: the rest of the tree below it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        size, h, chunk = (pdf[c].to_numpy(np.int64) for c in ("size", "h", "chunk"))
        low = ((h % 2**HASH_BITS) << CHUNK_BITS) + chunk
        places = [pdf[d].to_numpy() for d in DIMENSIONS]
        leaf = np.zeros(len(pdf), dtype=np.int64)
        todo = [(np.arange(len(pdf)), int(pdf["node"].iat[0]), levels)]
        while todo:
            at, node, left = todo.pop()
            if not left or not len(at):
                leaf[at] = node << left
                continue
            dim = max(range(len(places)), key=lambda k: places[k][at].max() - places[k][at].min())
            keys = (np.floor(places[dim][at] * (2**DIM_BITS - 1)).astype(np.int64) << (HASH_BITS + CHUNK_BITS)) + low[at]
            kinds, which = np.unique(keys, return_inverse=True)
            sums = np.cumsum(np.bincount(which, weights=size[at]))
            half = sums[-1] / 2
            k = int(np.searchsorted(sums, half))
            before = sums[k - 1] if k else 0.0
            # the nearer of the two sides of this key
            below = which <= k if abs(sums[k] - half) <= abs(before - half) or not before else which < k
            todo += [(at[below], 2 * node, left - 1), (at[~below], 2 * node + 1, left - 1)]
        return pd.DataFrame({"id": pdf["id"], "shard": leaf})

    return run


def _medians(keyed: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and the greatest key of its lower half; ``keyed``: node, size, key; ``nodes``: node, total."""
    cuts = settle(nodes.select("node", "total", F.lit(0).cast("long").alias("below"), F.lit(0).cast("long").alias("prefix")))
    known, left = KEY_BITS, None  # bits not yet known, rows of the greatest node that they leave
    while known:
        shift = 0 if left is not None and left <= FEW else known - DIGIT
        digit = F.shiftright("key", shift) - F.shiftleft(F.shiftright("key", known), known - shift)
        inside = keyed.join(F.broadcast(cuts.select("node", "prefix")), "node").filter(F.shiftright("key", known) == F.col("prefix"))  # one row for each node
        sums = inside.groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("rows"))  # 4096 or FEW for each node at most
        before = F.coalesce(F.sum("w").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        run, half = F.col("below") + F.col("before"), F.col("total") / 2
        reached = sums.withColumn("before", before).join(cuts.select("node", "total", "below", "prefix"), "node").filter(run + F.col("w") >= half)
        near = F.lit(True) if shift else (F.abs(run + F.col("w") - half) <= F.abs(run - half)) | (run == 0)
        first = reached.groupBy("node", "total", "prefix").agg(F.min(F.struct("digit", run.alias("run"), near.alias("near"), "rows")).alias("d"))
        place = F.shiftleft("prefix", known - shift) + F.col("d.digit") - F.when(F.col("d.near"), 0).otherwise(1)
        before_, cuts = cuts, settle(first.select("node", "total", F.col("d.run").alias("below"), place.alias("prefix"), F.col("d.rows").alias("rows")))
        unsettle(before_)
        known, left = shift, cuts.agg(F.max("rows")).first()[0]
    return cuts.select("node", F.col("prefix").alias("last"))


def cut(points: DataFrame, shards: int) -> DataFrame:
    """id and shard of every point; ``shards`` is a power of two.

    ``points`` has id, size, chunk, h and the dimensions, and is settled.
    """
    rows, done = points.withColumn("node", F.lit(0).cast("long")), None
    columns = rows.columns
    made = None
    for left in range(int(math.log2(shards)), 0, -1):
        nodes = settle(_measured_nodes(rows))
        small = F.broadcast(nodes.filter(F.col("n") <= FEW).select("node"))  # at most shards rows
        part = rows.join(small, "node", "left_semi").groupBy("node").applyInPandas(_finished(left), "id long, shard long")
        done = part if done is None else done.unionByName(part)
        large = nodes.filter(F.col("n") > FEW)
        if large.isEmpty():
            return settle(done)
        held = rows.join(F.broadcast(large), "node")
        key = _key(DIMENSIONS[-1])
        for k, d in enumerate(DIMENSIONS[:-1]):
            key = F.when(F.col("dim") == k, _key(d)).otherwise(key)
        keyed = held.withColumn("key", key)
        side = F.when(F.col("key") <= F.col("last"), 0).otherwise(1)
        next_ = settle(keyed.join(F.broadcast(_medians(keyed.select("node", "size", "key"), large)), "node").withColumn("node", F.col("node") * 2 + side).select(*columns))
        done = settle(done)
        if made is not None:
            unsettle(made)
        rows = made = next_
    leaves = rows.select("id", F.col("node").alias("shard"))
    return settle(leaves if done is None else done.unionByName(leaves))


def shard(docs: DataFrame, shards: int | None = 8, tolerance: float = 0.0005, target_bytes: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    Either ``shards``, a power of two, or ``target_bytes``: leaves are halved until they hold no more.
    """
    points = settle(measured(docs))
    total = points.agg(F.sum("size")).first()[0] or 0
    if target_bytes is not None:
        shards = 1 << max(0, math.ceil(math.log2(max(1, total) / target_bytes)))
    if not shards or shards & (shards - 1):
        raise ValueError(f"{shards} shards are no power of two")
    points = settle(_chunked(points, total / shards, tolerance).withColumn("id", F.monotonically_increasing_id()))
    leaves = cut(points.select("id", "size", "chunk", "h", *DIMENSIONS), shards)
    dealt = settle(points.join(leaves, "id").select("doc_id", "size", "text_crc32", "h", F.col("shard").cast("int").alias("shard"), "id"))
    return number_within(dealt, ["shard"], "id", ["h", "doc_id"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
