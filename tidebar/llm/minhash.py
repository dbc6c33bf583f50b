"""MinHash near-duplicates with tensored banding.

Table keys are pairs (i, j) of halves from two small hash collections: with
``BANDS`` halves of ``ROWS`` minima in each collection there are BANDS^2 tables
of 2 * ROWS minima, from only 2 * BANDS * ROWS minima per document, about the
square root of what as many independent tables would need.  Two documents of
similarity s meet unless no half of one collection agrees: with 14 halves of 2,
at s = 0.75 that is 2 * (1 - s^2)^14, two in a hundred thousand.

The halves also prune: a document meets nobody unless one of its halves in
*each* collection is shared, so only the shared halves of such documents are
multiplied out into table keys.

Candidates are verified on full shingle sets: first every bucket member with
the bucket's smallest document; then, where a bucket still spans several
components, the members outside its smallest component with one member of that
component, another one in every bucket; last, what is still apart and can be
similar at all, with all members of other components, each pair in its first
common table only.  Documents with equal sets are one node throughout; copies
are never expanded into pairs.

Defined cases: a null or blank text has no shingles and links with nothing; a
null doc_id links with nothing, its component_id is null and kept is false;
rows that repeat an id share a component, with whatever any of their texts is
linked to; an empty table gives no rows; further columns of the input are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, table
from .hashing import mix, shingles
from .scratch import settle

WIDTH = 5
SIMILARITY = 75  # per cent
BANDS = 14
ROWS = 2
#: Hash classes of the bound on intersections.
CLASSES = 64

_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=_U) * _U(0xA24BAED4963EE407)) | _U(1)


def halves(u: np.ndarray) -> np.ndarray:
    """The 2 * BANDS halves of a non-empty set, each a hash of ROWS minima and its own index."""
    minima = np.empty(len(_SEEDS), dtype=_U)
    for k, seed in enumerate(_SEEDS):
        z = u * seed
        minima[k] = (z ^ (z >> _U(32))).min()
    out = np.arange(1, 2 * BANDS + 1, dtype=_U)
    for r in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + minima[r::ROWS])
    return out.view(np.int64)


_SIGNATURE = "doc_id long, n_shingles long, fp1 long, fp2 long, a array<long>, b array<long>"


def _signatures(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k in range(0, len(ids), 1000):
            n, fp1, fp2, a, b = [], [], [], [], []
            for text in texts.slice(k, 1000).to_pylist():
                u = shingles(text, WIDTH)
                n.append(len(u))
                if len(u):
                    fp1.append(int(mix(u).sum().view(np.int64)))
                    fp2.append(int(mix(u ^ _U(0x5851F42D4C957F2D)).sum().view(np.int64)))
                    h = halves(u)
                    a.append(h[:BANDS])
                    b.append(h[BANDS:])
                else:
                    fp1.append(0)
                    fp2.append(0)
                    a.append(None)
                    b.append(None)
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(k, 1000), pa.array(n, pa.int64()), pa.array(fp1, pa.int64()), pa.array(fp2, pa.int64()), pa.array(a, many), pa.array(b, many)],
                names=["doc_id", "n_shingles", "fp1", "fp2", "a", "b"],
            )


def _sets(batches):
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for k in range(0, len(ids), 500):
            rows = [shingles(t, WIDTH).view(np.int64) for t in texts.slice(k, 500).to_pylist()]
            fp1 = [int(mix(u.view(_U)).sum().view(np.int64)) if len(u) else 0 for u in rows]
            yield pa.RecordBatch.from_arrays([ids.slice(k, 500), pa.array(fp1, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["doc_id", "fp1", "u"])


def _shared(reps: DataFrame, side: str) -> DataFrame:
    """Per node the halves of one collection that another node has too: (doc_id, fp1, side)."""
    out = reps.select("doc_id", "fp1", F.explode(side).alias("h"))
    multi = out.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo <> hi").select("h")
    return out.join(multi, "h", "left_semi").groupBy("doc_id", "fp1").agg(F.sort_array(F.collect_set("h")).alias(side))  # BANDS of them at most


def _verified(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) among distinct candidate pairs (x, fx, y, fy)."""
    left = sets.select(F.col("doc_id").alias("x"), F.col("fp1").alias("fx"), F.col("u").alias("ux"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("fp1").alias("fy"), F.col("u").alias("uy"))
    both = pairs.join(right, ["y", "fy"]).join(left, ["x", "fx"])
    common = F.size(F.array_intersect("ux", "uy"))
    return both.select("x", "y", common.alias("c"), (F.size("ux") + F.size("uy")).alias("s")).filter(F.col("c") * 100 >= (F.col("s") - F.col("c")) * similarity).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()


def _apart(keyed: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of buckets that span several components of ``links``: (ka, kb, doc_id, fp1, c, main), main the least component."""
    named = keyed.join(settle(components(links)).withColumnRenamed("id", "doc_id"), "doc_id", "left").select("ka", "kb", "doc_id", "fp1", F.coalesce("component", "doc_id").alias("c"))
    named = settle(named)
    mixed = named.groupBy("ka", "kb").agg(F.min("c").alias("main"), F.max("c").alias("top")).filter("main <> top").select("ka", "kb", "main")
    return settle(named.join(settle(mixed), ["ka", "kb"]))


def _across(apart: DataFrame, both: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs (x, fx, y, fy) of different components that meet in a bucket and can be similar.

    Shingles that no other of these documents has are in no intersection.  The
    others are counted by CLASSES hash classes: two documents share no more than
    the sum of the lesser counts, which leaves little but true links to verify.
    """
    who = apart.select("doc_id", "fp1").distinct()
    own = sets.join(who, ["doc_id", "fp1"], "left_semi").select("doc_id", "fp1", F.size("u").alias("n"), "u")
    each = own.select("doc_id", "fp1", F.explode("u").alias("g"))
    twice = each.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("g")
    classes = each.join(twice, "g", "left_semi").groupBy("doc_id", "fp1", F.pmod("g", F.lit(CLASSES)).cast("int").alias("k")).agg(F.count(F.lit(1)).cast("int").alias("m"))
    counts = classes.groupBy("doc_id", "fp1").agg(F.sum("m").alias("s"), F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("by"))  # CLASSES entries at most
    counts = counts.select("doc_id", "fp1", "s", F.expr(f"transform(sequence(0, {CLASSES - 1}), k -> coalesce(by[k], 0))").alias("m"))
    can = own.drop("u").join(counts, ["doc_id", "fp1"]).filter(F.col("s") * 100 >= F.col("n") * similarity)
    rows = apart.select("ka", "kb", "doc_id", "fp1", "c", "main").join(settle(can.join(both.select("doc_id", "fp1", "a", "b"), ["doc_id", "fp1"])), ["doc_id", "fp1"])
    rows = settle(rows)
    keep = ("doc_id", "fp1", "c", "a", "b", "n", "s", "m")
    outside = rows.filter("c <> main").select("ka", "kb", "main", *[F.col(k).alias(f"o_{k}") for k in keep])
    inside = rows.select("ka", "kb", *[F.col(k).alias(f"i_{k}") for k in keep])
    met = outside.join(inside, ["ka", "kb"]).filter(
        f"o_c <> i_c and (i_c = main or o_c < i_c) and {100 + similarity} * least(o_s, i_s) >= {similarity} * (o_n + i_n)"
        " and element_at(array_intersect(o_a, i_a), 1) = ka and element_at(array_intersect(o_b, i_b), 1) = kb"
        f" and {100 + similarity} * aggregate(zip_with(o_m, i_m, (p, q) -> least(p, q)), 0, (t, v) -> t + v) >= {similarity} * (o_n + i_n)"
    )
    return met.select(F.col("o_doc_id").alias("x"), F.col("o_fp1").alias("fx"), F.col("i_doc_id").alias("y"), F.col("i_fp1").alias("fy"))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = settle(docs.mapInArrow(_signatures, _SIGNATURE))
    same = ["fp1", "fp2", "n_shingles"]
    some = signed.filter("doc_id is not null and n_shingles > 0")
    # one node for each distinct set: the smallest id that has it
    nodes = settle(some.groupBy(*same).agg(F.min("doc_id").alias("node")))
    reps = settle(some.join(nodes.select(F.col("node").alias("doc_id"), *same), ["doc_id", *same], "left_semi").dropDuplicates(["doc_id", *same]))

    only_a = _shared(reps, "a")
    with_b = reps.select("doc_id", "fp1", "b").join(only_a, ["doc_id", "fp1"])
    with_b = settle(with_b)
    both = settle(with_b.select("doc_id", "fp1", "a").join(_shared(with_b, "b"), ["doc_id", "fp1"]))
    keyed = both.select("doc_id", "fp1", F.explode("a").alias("ka"), "b").select("doc_id", "fp1", "ka", F.explode("b").alias("kb"))
    lead = keyed.groupBy("ka", "kb").agg(F.min(F.struct("doc_id", "fp1")).alias("lead"), F.max("doc_id").alias("hi")).filter("lead.doc_id <> hi").select("ka", "kb", "lead")
    keyed = settle(keyed.join(settle(lead), ["ka", "kb"]))

    members = keyed.select("doc_id", "fp1").distinct()
    sets = settle(docs.join(members.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, fp1 long, u array<long>").join(members, ["doc_id", "fp1"], "left_semi").dropDuplicates(["doc_id", "fp1"]))
    stars = keyed.filter("doc_id <> lead.doc_id").select(F.col("lead.doc_id").alias("x"), F.col("lead.fp1").alias("fx"), F.col("doc_id").alias("y"), F.col("fp1").alias("fy")).distinct()
    links = settle(_verified(stars, sets, similarity))

    # what the stars left apart: first a few members of the main component that differ from bucket to bucket ...
    apart = _apart(keyed, links)
    if not apart.isEmpty():
        quarter = apart.filter(F.pmod(F.xxhash64("ka", "kb"), F.lit(4)) == 0)
        hub = quarter.filter("c = main").groupBy("ka", "kb").agg(F.min_by(F.struct("doc_id", "fp1"), F.xxhash64("ka", "kb", "doc_id")).alias("hub"))
        tries = quarter.filter("c <> main").join(hub, ["ka", "kb"]).select(F.col("hub.doc_id").alias("x"), F.col("hub.fp1").alias("fx"), F.col("doc_id").alias("y"), F.col("fp1").alias("fy")).distinct()
        links = settle(links.unionByName(_verified(tries, sets, similarity)))
        apart = _apart(keyed, links)
    # ... then everything that still can be similar across components
    if not apart.isEmpty():
        links = links.unionByName(_verified(_across(apart, both, sets, similarity), sets, similarity))

    # an id with several sets ties them, and whatever else has one of them
    several = settle(some.groupBy("doc_id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).filter("lo <> hi").select("doc_id"))
    if not several.isEmpty():
        named = some.join(several, "doc_id", "left_semi").select("doc_id", *same).distinct().join(nodes, same).select("doc_id", "node")
        links = links.unionByName(named.filter("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))

    grouped = components(links)
    placed = nodes.join(grouped.select(F.col("id").alias("node"), "component"), "node", "left").select(*same, F.coalesce("component", "node").alias("of"))
    return (
        signed.select("doc_id", *same)
        .join(settle(placed), same, "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("of", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def one_of_each(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest id.

    Different texts under one id are documents of their own (and come before
    others in their group); rows equal in id and text are one document, of which
    the row of the least hash stays.  Rows with a null doc_id all stay.
    """
    number = F.col("doc_id").cast("long")
    own = docs.select(number.alias("doc_id"), F.col("text").cast("string").alias("text"))
    many = settle(own.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    if many.isEmpty():
        kept = settle(near_duplicates(own, similarity).filter("kept").select("doc_id"))
        return docs.join(kept, docs["doc_id"].cast("long") == kept["doc_id"], "left_semi").unionByName(docs.filter("doc_id is null"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # negative keys stand for (id, text)
    key = -1 - F.shiftrightunsigned(F.xxhash64(number, F.col("text").cast("string")), 1)
    rows = docs.select(number.alias("key"), key.alias("other"), row.alias("row"))
    alone = rows.join(many, F.col("key") == many["doc_id"], "left_anti").select("key", "row")
    shared = rows.join(many, F.col("key") == many["doc_id"], "left_semi").groupBy(F.col("other").alias("key")).agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    each = settle(alone.unionByName(shared))
    kept = settle(near_duplicates(each.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), similarity).filter("kept").select(F.col("doc_id").alias("key")))
    return each.join(kept, "key", "left_semi").unionByName(each.filter("key is null")).select("row.*")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb, count(*) AS c
  FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs WHERE 100 * c >= 75 * (na + nb - c)
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), least_id AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least_id l USING (doc_id)
"""
