"""Distributed global order: ranks and running sums without a single-task window.

A `Window.orderBy(...)` with no partition key moves every row into one task.
Here the rows are range-partitioned on the sort key and sorted inside each
partition; each row gets its local position (and local running sums), the
per-partition totals (one row per partition, so bounded by the partition
count, never by the data) are turned into offsets and broadcast back.

The ranged table (with its partition id and local position as columns) is
written as a Parquet table in the shared checkpoint folder between the two
passes, so positions are fixed even if executors are lost, and the second pass
is an ordinary columnar scan.
The sort key must be a total order (append the id as a tie-break) for ranks to
be deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.session import materialize

_LOW_BITS = (1 << 33) - 1

# Groups over which `top_n` spreads its first cut.
TOPN_GROUPS = 64


def _range_sorted(df: DataFrame, order: Sequence[Column], partitions: int | None) -> DataFrame:
    """Range-partition on `order` and sort inside partitions.

    Without an explicit count, AQE may coalesce the range partitions; it only
    merges contiguous ones, so partition ids stay in key order and the
    per-partition offsets remain exact.
    """
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    return ranged.sortWithinPartitions(*order)


def _offsets(local: DataFrame, sums: Sequence[str]) -> DataFrame:
    """Exclusive prefix of per-partition totals; one row per partition."""
    totals = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off_n"),
        *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank_col: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """Add a 1-based, gap-free rank along `order` (row_number semantics)."""
    ranged = _range_sorted(df, order, partitions).withColumn("_mid", F.monotonically_increasing_id())
    ranged = materialize(ranged.select(
        *df.columns, F.shiftright("_mid", 33).cast("int").alias("_pid"),
        (F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)) + 1).alias("_pos")), "ranked")
    offs = _offsets(ranged, [])
    return (ranged.join(F.broadcast(offs), "_pid")
                  .select(*df.columns, (F.col("_off_n") + F.col("_pos")).cast("long").alias(rank_col)))


def running_sums(df: DataFrame, order: Sequence[Column], sums: Sequence[str], rank_col: str | None = None,
                 prefix: str = "cum_", partitions: int | None = None,
                 group_cols: Sequence[str] = ()) -> DataFrame:
    """Inclusive running sums of numeric `sums` columns (and optionally the rank) along `order`.

    The per-partition pass is a vectorised pandas cumsum over Arrow batches of a
    range partition (no second shuffle); offsets are added JVM-side. With
    `group_cols` (which must lead `order`), sums restart in every group: a group's
    rows are neighbours, so only the first group of a partition can have begun in an
    earlier one, and what it brought is one row a partition, broadcast. No row is
    joined by its group.
    """
    if "n" in sums:
        raise ValueError("a sum column may not be named 'n' (reserved for the row-count offsets)")
    # Arrow hands pandas NaN back as null: carry a NaN flag per float column through the pass
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    ranged = _range_sorted(df, order, partitions).select(
        "*", F.spark_partition_id().alias("_pid"), *[F.isnan(c).alias(f"_nan{i}") for i, c in enumerate(floats)])
    out_schema = T.StructType([*ranged.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_first", T.BooleanType()),
                               T.StructField("_pos", T.LongType()), *(T.StructField(f"_loc_{c}", T.DoubleType()) for c in sums)])
    sum_cols, by = list(sums), list(group_cols)

    def local_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, in_first = 0, True
        carry = dict.fromkeys(["_pos", *sum_cols], 0.0)  # of the group that the last batch ended in
        last: pd.DataFrame | None = None
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            begins = np.zeros(n, dtype=bool)
            if by:
                keys = pdf[by] if last is None else pd.concat([last, pdf[by]])
                before, null = keys.shift(), keys.isna()
                differs = ((keys != before) & ~(null & before.isna())).any(axis=1).to_numpy()
                begins = differs[-n:].copy()
                begins[0] &= last is not None  # a partition's first row begins no group after another
                last = pdf[by].iloc[-1:]
            group = begins.cumsum()
            pdf["_row"] = np.arange(rows + 1, rows + n + 1)
            pdf["_first"] = in_first & (group == 0)
            for c in ["_pos", *sum_cols]:
                own = pd.Series(np.ones(n), index=pdf.index) if c == "_pos" else pdf[c].astype("float64").fillna(0.0)
                summed = own.groupby(group).cumsum() if by else own.cumsum()
                summed += np.where(group == 0, carry[c], 0.0)
                pdf["_pos" if c == "_pos" else f"_loc_{c}"] = summed.astype("int64") if c == "_pos" else summed
                carry[c] = float(summed.iloc[-1])
            rows += n
            in_first &= group[-1] == 0
            yield pdf

    local = materialize(ranged.mapInPandas(local_pass, out_schema), "running")
    key = F.struct(*by) if by else F.lit(0)
    ends = local.groupBy("_pid").agg(
        F.min_by(key, F.col("_row")).alias("_begin"), F.max_by(key, F.col("_row")).alias("_end"),
        F.max_by("_pos", F.col("_row")).alias("_t_n"), *[F.max_by(f"_loc_{c}", F.col("_row")).alias(f"_t_{c}") for c in sums])
    # What the group that a partition begins with has in earlier partitions: they end in it.
    names = ["n", *sums]
    brought = ends.select("_pid", F.col("_end").alias("_key"), F.lit(0).alias("_asks"), *[F.col(f"_t_{c}") for c in names])
    asked = ends.select("_pid", F.col("_begin").alias("_key"), F.lit(1).alias("_asks"), *[F.lit(None).cast(t).alias(f"_t_{c}") for c, t in
                                                                                     zip(names, ["long", *["double"] * len(sums)], strict=True)])
    earlier = Window.partitionBy("_key").orderBy("_pid").rangeBetween(Window.unboundedPreceding, -1)
    offs = brought.unionByName(asked).select("_pid", "_asks", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_off_{c}") for c in names])
    offs = offs.where("_asks = 1").drop("_asks")
    integral = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.IntegerType, T.LongType, T.ShortType))}
    nan_back = {c: F.when(F.col(f"_nan{i}"), F.lit(float("nan")).cast(df.schema[c].dataType)).otherwise(F.col(c))
                for i, c in enumerate(floats)}
    cols = [nan_back[c].alias(c) if c in nan_back else F.col(c) for c in df.columns]
    begun = lambda c: F.when(F.col("_first"), F.col(f"_off_{c}")).otherwise(0)
    for c in sums:
        cum = begun(c) + F.col(f"_loc_{c}")
        cols.append((F.round(cum).cast("long") if c in integral else cum).alias(f"{prefix}{c}"))
    if rank_col:
        cols.append((begun("n") + F.col("_pos")).cast("long").alias(rank_col))
    return local.join(F.broadcast(offs), "_pid").select(*cols)


def top_n(df: DataFrame, order: Sequence[Column], n: int, deal_by: str) -> DataFrame:
    """The first n rows along `order` (a total order: end it with the id); building the plan starts no job.

    Rows are dealt by the hash of an id into a fixed number of groups and each group keeps its first n: the group limit applies before the
    shuffle, and no task receives more than its group's share of n rows from every input partition. Only the
    survivors, n for each group at most, are ordered together.
    """
    if n <= 0:
        return df.limit(0)
    w = Window.partitionBy("_group").orderBy(*order)
    dealt = df.withColumn("_group", F.pmod(F.xxhash64(deal_by), F.lit(TOPN_GROUPS)))
    first = dealt.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= n).drop("_place", "_group")
    return first.orderBy(*order).limit(n)
