"""Exploratory and cohort aggregates (the tables behind the charts).

Input: the analysis view (cleaned, Churn 0/1, plus tenure_band and
service_count). Group-bys drop NULL keys, as the original pandas code does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.functions.columns import round_half_up, rounded_mean
from lapse.operators.quantile import with_median

#: Most columns of a pivot over a column without a listed vocabulary.
PIVOT_COLUMNS = 1_000


def _status():
    return F.when(F.col("Churn") == 1, "Churned").otherwise("Retained")


def overall_churn_rate(df: DataFrame) -> DataFrame:
    """total, churned, retained, churn_rate, monthly revenue of churners (one global aggregate)."""
    n = F.count(F.lit(1))
    churned = F.sum("Churn")
    return df.agg(n.alias("total_customers"), churned.cast("long").alias("churned"),
                  (n - churned).cast("long").alias("retained"),
                  (churned.cast("double") / n).alias("churn_rate"),
                  round_half_up(F.sum(F.when(F.col("Churn") == 1, F.col("MonthlyCharges")).otherwise(0.0)), 2)
                  .alias("monthly_rev_at_risk"))


def churn_by_category(df: DataFrame, col: str) -> DataFrame:
    """mean churn and count per value, highest rate first."""
    return (df.where(F.col(col).isNotNull()).groupBy(col)
            .agg(F.avg("Churn").alias("churn_rate"), F.count(F.lit(1)).alias("customers"))
            .orderBy(F.col("churn_rate").desc(), F.col(col)))


def churn_by_tenure(df: DataFrame) -> DataFrame:
    return (df.where(F.col("tenure_band").isNotNull()).groupBy("tenure_band")
            .agg(F.avg("Churn").alias("churn_rate"), F.count(F.lit(1)).alias("customers"))
            .orderBy("tenure_band"))


def charges_histogram(df: DataFrame, nbins: int = 40, col: str = "MonthlyCharges") -> DataFrame:
    """Exactly `nbins` equal-width bins from min to max (last bin closed), split churned/retained.

    min/max come from one scalar subquery; the binning is a projection and the
    count a partial-aggregated group-by over at most 2*nbins keys.
    """
    mm = df.select(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi"))).scalar()
    lo, hi = mm["lo"], mm["hi"]
    width = (hi - lo) / float(nbins)
    # one value alone has no width: all in bin 0
    place = F.when(width > 0, F.least(F.floor((F.col(col) - lo) / F.nullif(width, F.lit(0.0))).cast("int"), F.lit(nbins - 1))) \
        .otherwise(F.when(F.col(col).isNotNull(), 0))
    binned = df.select(place.alias("bin"),
                       _status().alias("status"))
    return (binned.groupBy("bin", "status").agg(F.count(F.lit(1)).alias("customers"))
            .select("bin", "status", "customers", (lo + F.col("bin") * width).alias("bin_start"),
                    (lo + (F.col("bin") + 1) * width).alias("bin_end")))


def revenue_by_status(df: DataFrame, segment_col: str) -> DataFrame:
    status = F.when(F.col("Churn") == 1, "At Risk").otherwise("Retained")
    return (df.where(F.col(segment_col).isNotNull()).groupBy(segment_col, status.alias("status"))
            .agg(round_half_up(F.sum("MonthlyCharges"), 2).alias("revenue")))


def _values(df: DataFrame, col: str) -> list[str]:
    from lapse.config import ONE_HOT, TENURE_LABELS
    if col in ONE_HOT:
        return ONE_HOT[col]
    if col == "tenure_band":
        return TENURE_LABELS
    # data-driven vocabulary: the distinct keys of one column, as many as a pivot may have and one to tell more
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(PIVOT_COLUMNS + 1).collect()]
    if len(found) > PIVOT_COLUMNS:
        raise ValueError(f"{col} has more than {PIVOT_COLUMNS} values: too many columns for a pivot")
    return sorted(found)


def churn_heatmap(df: DataFrame, col_x: str, col_y: str, digits: int | None = None) -> DataFrame:
    """Mean churn pivot: rows col_y, one column per value of col_x (explicit values: no extra pass)."""
    agg = F.avg("Churn")
    out = df.where(F.col(col_y).isNotNull()).groupBy(col_y).pivot(col_x, _values(df, col_x)).agg(agg)
    if digits is not None:
        out = out.select(col_y, *[round_half_up(F.col(f"`{c}`"), digits).alias(c) for c in out.columns if c != col_y])
    return out


def churn_by_tenure_contract(df: DataFrame) -> DataFrame:
    return (df.where(F.col("tenure_band").isNotNull() & F.col("Contract").isNotNull())
            .groupBy("tenure_band", "Contract").agg(F.avg("Churn").alias("churn_rate")))


def service_adoption_vs_churn(df: DataFrame) -> DataFrame:
    return (df.groupBy("service_count")
            .agg(F.avg("Churn").alias("churn_rate"), F.count(F.lit(1)).alias("customers"))
            .orderBy("service_count"))


def revenue_lifecycle(df: DataFrame) -> DataFrame:
    """Per tenure month: mean, exact median and count of MonthlyCharges."""
    known = df.where(F.col("tenure").isNotNull())
    summary = known.groupBy("tenure").agg(rounded_mean("MonthlyCharges", 4).alias("avg_charge"), F.count(F.lit(1)).alias("count"))
    return (with_median(summary, known, ["tenure"], "MonthlyCharges", "median_charge")
            .select("tenure", "avg_charge", "median_charge", "count").orderBy("tenure"))


def cohort_churn_table(df: DataFrame) -> DataFrame:
    """tenure_band x Contract mean churn, 3 dp (half-up)."""
    return churn_heatmap(df, "Contract", "tenure_band", digits=3)


_INSIGHT = [("Contract", "Contract Type"), ("InternetService", "Internet Service"), ("PaymentMethod", "Payment Method")]


def insight_table(df: DataFrame) -> DataFrame:
    """One scan: unpivot the three attributes to (Attribute, Value) and aggregate once."""
    pairs = ", ".join(f"'{label}', {col}" for col, label in _INSIGHT)
    long = df.selectExpr(f"stack({len(_INSIGHT)}, {pairs}) as (Attribute, Value)", "Churn")
    return (long.where(F.col("Value").isNotNull()).groupBy("Attribute", "Value")
            .agg(F.count(F.lit(1)).alias("Customers"), F.avg("Churn").alias("churn_rate")))


def churned_vs_retained(df: DataFrame) -> DataFrame:
    return df.groupBy(_status().alias("Status")).agg(
        F.count("customerID").alias("Customers"),
        rounded_mean("MonthlyCharges", 2).alias("Avg_Monthly"),
        round_half_up(F.avg("tenure"), 1).alias("Avg_Tenure"),
        rounded_mean("TotalCharges", 2).alias("Avg_Total"))


def churn_by_senior(df: DataFrame) -> DataFrame:
    label = F.when(F.col("SeniorCitizen") == 1, "Senior").otherwise("Non-Senior").alias("senior_status")
    return df.groupBy(label).agg(F.avg("Churn").alias("churn_rate"), F.count(F.lit(1)).alias("customers"))


def driver_flags(median_charge: Column) -> list[tuple[str, Column]]:
    return [
        ("Month-to-month contract", F.col("Contract") == "Month-to-month"),
        ("Short tenure (0-12 months)", F.col("tenure").between(0, 12)),
        ("Fiber optic internet", F.col("InternetService") == "Fiber optic"),
        ("Electronic check payment", F.col("PaymentMethod") == "Electronic check"),
        ("Senior citizen", F.col("SeniorCitizen") == 1),
        ("Two year contract", F.col("Contract") == "Two year"),
        ("No online security", F.col("OnlineSecurity") == "No"),
        ("High charges without long contract",
         (F.col("MonthlyCharges") >= median_charge) & (F.col("Contract") == "Month-to-month")),
    ]


def driver_lift(df: DataFrame) -> DataFrame:
    """Churn rate per driver flag and its ratio to the base rate: one scan of
    conditional sums, unpivoted; the base rate and median are scalar subqueries."""
    stats = df.select(F.struct(F.avg("Churn").alias("base"), F.median("MonthlyCharges").alias("med"))).scalar()
    flags = driver_flags(stats["med"])
    aggs = []
    for i, (_, cond) in enumerate(flags):
        hit = F.coalesce(cond, F.lit(False))
        aggs += [F.sum(hit.cast("long")).alias(f"n{i}"), F.sum(F.when(hit, F.col("Churn")).otherwise(0)).cast("long").alias(f"c{i}")]
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{name}', n{i}, c{i}" for i, (name, _) in enumerate(flags))
    long = wide.selectExpr(f"stack({len(flags)}, {pairs}) as (driver, customers, churned)")
    rate = F.col("churned").cast("double") / F.col("customers")
    return (long.where(F.col("customers") > 0)
            .select("driver", "customers", "churned", rate.alias("churn_rate"), (rate / stats["base"]).alias("lift_vs_base")))
