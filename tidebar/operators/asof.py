"""Point-in-time joins: the last state no later than a moment.

Requests and history are one sorted stream in which the last known state is
carried forward; no range join makes candidates.  ``stretch`` cuts every key
into stretches of time: the last state of each is found with partial
aggregates, carried over the stretches, and each stretch starts from it, so a
key with all the rows there are is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(requests: DataFrame, history: DataFrame, on: list[str], at: str, stretch: str | None = None, prefix: str = "as_") -> DataFrame:
    """Every request with the latest history row of equal ``on`` whose ``at`` is no later than its own.

    The history's other columns, and its ``at``, come with ``prefix``; NULL where
    nothing is known yet.  Of history rows of one moment the greatest counts.
    A NULL in ``on`` meets NULL; requests without a time know nothing, history
    without a time is never known.  ``stretch``: a duration as ``window`` takes
    it, for times that it can cut.
    """
    taken = [c for c in history.columns if c not in on]
    state = F.struct(F.col(at).alias(at), *[F.col(c).alias(c) for c in taken if c != at])
    known = history.filter(F.col(at).isNotNull()).select(*on, F.col(at).alias("_t"), F.lit(0).alias("_asks"), state.alias("_state"))
    asked = requests.select(*on, F.col(at).alias("_t"), F.lit(1).alias("_asks"), F.struct(*requests.columns).alias("_row"))
    both = known.unionByName(asked, allowMissingColumns=True)
    by = list(on)
    if stretch is not None:
        timed = both.filter("_t is not null").withColumn("_cut", F.window("_t", stretch).start)
        ends = timed.groupBy(*on, "_cut").agg(F.max(F.when(F.col("_asks") == 0, F.struct("_t", "_state"))).alias("_e"))
        before = F.last("_e", ignorenulls=True).over(Window.partitionBy(*on).orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1))
        carried = ends.select(*on, "_cut", before.alias("_b")).filter("_b is not null").select(*on, "_cut", F.lit(None).cast(both.schema["_t"].dataType).alias("_t"), F.lit(0).alias("_asks"), F.col("_b._state").alias("_state"))
        untimed = both.filter("_t is null").withColumn("_cut", F.lit(None).cast(timed.schema["_cut"].dataType))
        both, by = timed.unionByName(carried, allowMissingColumns=True).unionByName(untimed), [*on, "_cut"]
    last = F.last("_state", ignorenulls=True).over(Window.partitionBy(*by).orderBy(F.col("_t").asc_nulls_first(), "_asks", "_state").rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_last", F.when(F.col("_t").isNotNull(), last)).filter("_asks = 1")
    return out.select("_row.*", *[F.col(f"_last.{c}").alias(f"{prefix}{c}") for c in taken])
