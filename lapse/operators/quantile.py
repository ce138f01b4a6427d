"""Exact quantiles of every group by histogram refinement.

Values are counted once per group and value (added up in a task before the
shuffle) and written. A round deals each range that still holds a wanted rank
into buckets between its least and greatest value, counts them, keeps the bucket
that holds the rank, and goes on with that bucket's own least and greatest value,
until they are equal. Dealing keeps the order of values, so that the result is
exact; a round splits off the least and the greatest value at least, and usually
all but one of BUCKETS shares. No task holds a group's distinct values: what a
round gathers is a row a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lapse.session import materialize

BUCKETS = 1024


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    """Equal keys; a null key is a group."""
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def _dealt(v: Column, lo: Column, hi: Column, buckets: int) -> Column:
    """Bucket of a value between lo and hi: never smaller for a greater value; infinities and NaN (the greatest, as in Spark's
    own order) have buckets of their own."""
    share = F.floor((v - lo) / (hi - lo) * F.lit(float(buckets)))
    inside = F.when(hi > lo, F.greatest(F.least(share, F.lit(buckets - 1)), F.lit(0))).otherwise(0)
    # the greatest value apart from those below it, so that a round always splits
    return (F.when(F.isnan(v), buckets + 2).when(v == float("inf"), buckets + 1).when(v == float("-inf"), -1)
            .when(v >= hi, buckets).otherwise(inside).cast("int"))


def grouped_quantiles(df: DataFrame, groups: Sequence[str], col: str, probs: Sequence[float] = (0.5,),
                      buckets: int = BUCKETS) -> DataFrame:
    """(groups, q0, q1, ...): the quantiles of `col` in each group, the same doubles as Spark's `percentile`.

    Groups whose values are all null have no row."""
    keys = [f"_g{i}" for i in range(len(groups))] or ["_g0"]
    own = [F.col(g).alias(k) for g, k in zip(groups, keys, strict=False)] or [F.lit(0).alias("_g0")]
    counted = materialize(df.select(*own, F.col(col).cast("double").alias("v")).where("v IS NOT NULL")
                          .groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), "quantile-counts")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    sizes = counted.groupBy(*keys).agg(F.sum("n").alias("size"), F.coalesce(F.min(finite), F.lit(0.0)).alias("lo"),
                                       F.coalesce(F.max(finite), F.lit(0.0)).alias("hi"))
    # A quantile lies between two ranks (from 0), the floor and the ceiling of its position.
    place = [(F.col("size") - 1).cast("double") * F.lit(float(p)) for p in probs]
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("t"), f(x).cast("long").alias("k"))
                      for i, x in enumerate(place) for up, f in enumerate((F.floor, F.ceil))])
    wanted = materialize(sizes.select(*keys, "size", "lo", "hi", F.explode(ranks).alias("r")).select(
        *keys, "size", "r.t", "r.k", "lo", "hi", F.lit(None).cast("double").alias("value")), "quantile-ranks")
    first = True
    while True:
        todo = wanted.where("value IS NULL")
        if todo.isEmpty():
            break
        ranges = todo.select(*(F.col(k).alias(f"r{k}") for k in keys), "lo", "hi").distinct()
        inside = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"r{k}")) for k in keys])
        if not first:  # at first the infinities and NaN count too
            inside &= F.col("v").between(F.col("lo"), F.col("hi"))
        by = [*(f"r{k}" for k in keys), "lo", "hi"]
        histogram = (counted.join(ranges, inside).withColumn("b", _dealt(F.col("v"), F.col("lo"), F.col("hi"), buckets))
                     .groupBy(*by, "b").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")))
        upto = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        placed = histogram.withColumn("upto", F.sum("n").over(upto)).select(
            *(F.col(c).alias(f"h{c}") for c in by), (F.col("upto") - F.col("n")).alias("before"), "upto", "least", "most")
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"h{h}")) for c, h in zip([*keys, "lo", "hi"], by, strict=True)])
        kept = todo.join(placed, same & (F.col("before") <= F.col("k")) & (F.col("k") < F.col("upto")))
        one = F.col("least").eqNullSafe(F.col("most"))
        done = kept.select(*keys, "size", "t", (F.col("k") - F.col("before")).alias("k"), F.col("least").alias("lo"), F.col("most").alias("hi"),
                           F.when(one, F.col("least")).alias("value"))
        wanted = materialize(wanted.where("value IS NOT NULL").unionByName(done), "quantile-ranks")
        first = False
    found = wanted.groupBy(*keys).agg(F.first("size").alias("size"), *[F.max(F.when(F.col("t") == t, F.col("value"))).alias(f"v{t}")
                                                                        for t in range(2 * len(probs))])
    out = []
    for i, p in enumerate(probs):
        at, low, high = (F.col("size") - 1).cast("double") * F.lit(float(p)), F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        between = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        out.append(F.when((F.ceil(at) == F.floor(at)) | (low == high), low).otherwise(between).alias(f"q{i}"))
    return found.select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=False)), *out)


def with_median(summary: DataFrame, df: DataFrame, groups: Sequence[str], col: str, name: str) -> DataFrame:
    """`summary`, a table with a row for each group of `df`, with the group's exact median of `col` as `name`."""
    medians = grouped_quantiles(df, groups, col).withColumnsRenamed({g: f"_m_{g}" for g in groups}).withColumnRenamed("q0", name)
    same = reduce(lambda x, y: x & y, [F.col(g).eqNullSafe(F.col(f"_m_{g}")) for g in groups])
    return summary.join(medians, same, "left").drop(*(f"_m_{g}" for g in groups))
