"""Feature engineering: one projection over the cleaned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lapse.config import (BINARY_COLS, CLV_MONTHS, HIGH_VALUE_PERCENTILE, NON_MODEL_COLS, ONE_HOT,
                          SERVICE_COLS)
from lapse.functions.columns import tenure_band, yes_flag
from lapse.operators.clean import quantiles


def avg_monthly_revenue() -> F.Column:
    return F.when(F.col("tenure") > 0, F.col("TotalCharges") / F.col("tenure")).otherwise(F.col("MonthlyCharges"))


def service_count() -> F.Column:
    total = None
    for c in SERVICE_COLS:
        total = yes_flag(c) if total is None else total + yes_flag(c)
    return total.cast("int")


def engineered_columns(high_value_cut) -> list:
    """Engineered columns, computed from the readable categories (before encoding)."""
    amr = avg_monthly_revenue()
    return [
        tenure_band("tenure").alias("tenure_band"),
        amr.alias("avg_monthly_revenue"),
        (F.col("MonthlyCharges") - amr).alias("charges_delta"),
        (F.col("MonthlyCharges") * CLV_MONTHS).alias("clv_estimate"),
        service_count().alias("service_count"),
        F.coalesce(F.lower(F.col("PaymentMethod")).contains("automatic"), F.lit(False)).cast("int").alias("is_autopay"),
        F.coalesce(F.col("Contract").isin("One year", "Two year"), F.lit(False)).cast("int").alias("is_longterm_contract"),
        (~F.col("InternetService").eqNullSafe("No")).cast("int").alias("has_internet"),
        F.col("InternetService").eqNullSafe("Fiber optic").cast("int").alias("is_fiber"),
        F.col("SeniorCitizen").cast("int").alias("is_senior"),
        F.coalesce((F.col("MonthlyCharges") >= high_value_cut), F.lit(False)).cast("int").alias("is_high_value"),
    ]


def one_hot_columns(vocab: dict[str, list[str]] = ONE_HOT) -> list:
    return [F.col(src).eqNullSafe(v).cast("int").alias(f"{src}_{v}") for src, vals in vocab.items() for v in vals]


def engineer(cleaned: DataFrame, high_value_cut=None, vocab: dict[str, list[str]] = ONE_HOT,
             approx: bool = False) -> DataFrame:
    """Cleaned -> feature layer.

    `high_value_cut` is the MonthlyCharges cut for is_high_value; by default the
    median of the input (a scalar subquery), or a frozen training value.
    """
    if high_value_cut is None:
        high_value_cut = quantiles(cleaned, "MonthlyCharges", [HIGH_VALUE_PERCENTILE], approx)[0]
    keep = [c for c in cleaned.columns if c not in vocab and c not in BINARY_COLS]
    binary = [yes_flag(c).alias(c) for c in BINARY_COLS]
    return cleaned.select(*keep, *binary, *engineered_columns(high_value_cut), *one_hot_columns(vocab))


_NUMERIC = (T.IntegerType, T.LongType, T.DoubleType, T.FloatType, T.ShortType, T.ByteType, T.DecimalType)


def model_columns(df: DataFrame) -> list[str]:
    """Numeric feature columns in a fixed order (schema order), minus id/target/flags."""
    return [f.name for f in df.schema.fields
            if f.name not in NON_MODEL_COLS and isinstance(f.dataType, _NUMERIC)]
