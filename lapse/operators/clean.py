"""Cleaning operators (TotalCharges coercion and imputation, binary target,
whitespace stripping, IQR outlier flag). Row count is preserved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.config import OUTLIER_IQR_MULTIPLIER, TARGET_COL
from lapse.functions.columns import strip_ws


#: A decimal number: what else a cast would take ('NaN', '5d', 'Infinity') counts as missing.
NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def total_charges_number() -> Column:
    """TotalCharges as a double; NULL for whatever isn't a decimal number (try_cast never throws under ANSI)."""
    text = F.trim(F.col("TotalCharges").cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def coerce_total_charges(df: DataFrame) -> DataFrame:
    """Text -> double; whatever isn't a decimal number becomes NULL."""
    return df.withColumn("TotalCharges", total_charges_number())


def impute_total_charges(df: DataFrame) -> DataFrame:
    """Any NULL TotalCharges -> MonthlyCharges."""
    return df.withColumn("TotalCharges", F.coalesce(F.col("TotalCharges"), F.col("MonthlyCharges")))


def binary_target(df: DataFrame, col: str = TARGET_COL) -> DataFrame:
    """'Yes' -> 1 else 0 (NULL -> 0); applied before stripping, as in the original."""
    return df.withColumn(col, F.coalesce((F.col(col) == "Yes").cast("int"), F.lit(0)))


def senior_int(df: DataFrame) -> DataFrame:
    return df.withColumn("SeniorCitizen", F.col("SeniorCitizen").cast("int"))


def strip_strings(df: DataFrame) -> DataFrame:
    """Strip whitespace from every string column in one projection."""
    return df.select(*[
        strip_ws(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def quantiles(df: DataFrame, col: str, probs: list[float], approx: bool = False,
              distributed: bool = False) -> list:
    """Scalar-subquery columns for quantiles of `col` (exact linear interpolation by default).

    The default exact form (Spark's `percentile`) keeps one (value -> count)
    map per partial aggregate and merges them in one task, so its memory is
    bounded by the number of distinct values (whole cents here).
    `distributed=True` gives the same exact values for unbounded domains
    without that single-task merge; `approx=True` uses a fixed-size sketch.
    """
    if distributed:
        return distributed_quantiles(df, col, probs)
    arr = F.array(*[F.lit(float(p)) for p in probs])
    agg = (F.percentile_approx(col, arr, F.lit(100000)) if approx else F.percentile(F.col(col), arr))
    qs = df.select(agg.cast("array<double>")).scalar()
    return [qs[i] for i in range(len(probs))]


def distributed_quantiles(df: DataFrame, col: str, probs: list[float]) -> list:
    """Exact quantiles equal to Spark's `percentile`, with no task holding the distinct values.

    Counts per distinct value (partial aggregation), a distributed running
    count along the value, then one aggregate picks the keys at the floor and
    ceiling of position (n - 1) * p and interpolates as `percentile` does.
    """
    from lapse.operators.ordered import running_sums
    g = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("double").alias("_v"))
         .agg(F.count(F.lit(1)).alias("cnt")))
    cum = running_sums(g, [F.col("_v")], ["cnt"], prefix="cum_")
    n = g.select(F.sum("cnt")).scalar()
    before = F.col("cum_cnt") - F.col("cnt")

    def pos(p: float) -> Column:
        return (n - 1).cast("double") * F.lit(float(p))

    def key_at(i: Column) -> Column:
        return F.max(F.when((before <= i) & (i < F.col("cum_cnt")), F.col("_v")))

    picked = cum.agg(*[x for k, p in enumerate(probs) for x in (key_at(F.floor(pos(p))).alias(f"_lo{k}"),
                                                                  key_at(F.ceil(pos(p))).alias(f"_hi{k}"))])
    out = []
    for k, p in enumerate(probs):
        lo, hi, lower, higher = F.col(f"_lo{k}"), F.col(f"_hi{k}"), F.floor(pos(p)), F.ceil(pos(p))
        out.append(F.when((higher == lower) | (hi == lo), lo)
                   .otherwise((higher - pos(p)) * lo + (pos(p) - lower) * hi))
    qs = picked.select(F.array(*out)).scalar()
    return [qs[i] for i in range(len(probs))]


def flag_outliers(df: DataFrame, col: str = "MonthlyCharges", k: float = OUTLIER_IQR_MULTIPLIER,
                  approx: bool = False, out_col: str = "is_charges_outlier") -> DataFrame:
    """1 when col < q1 - k*IQR or col > q3 + k*IQR; rows are kept."""
    q1, q3 = quantiles(df, col, [0.25, 0.75], approx)
    iqr = q3 - q1
    flag = ((F.col(col) < q1 - F.lit(k) * iqr) | (F.col(col) > q3 + F.lit(k) * iqr))
    return df.withColumn(out_col, F.coalesce(flag.cast("int"), F.lit(0)))


def clean(df: DataFrame, approx: bool = False) -> DataFrame:
    """Full cleaning chain over the raw 21-column table."""
    return (df.transform(coerce_total_charges)
              .transform(impute_total_charges)
              .transform(binary_target)
              .transform(senior_int)
              .transform(strip_strings)
              .transform(lambda d: flag_outliers(d, approx=approx)))


def sql_view(df: DataFrame) -> DataFrame:
    """The SQL pack's `customers` view: cleaned numerics, Churn kept as Yes/No."""
    cleaned = (df.transform(coerce_total_charges).transform(impute_total_charges)
                 .transform(senior_int).transform(strip_strings))
    return cleaned
