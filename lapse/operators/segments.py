"""Risk/value segmentation and the per-segment reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lapse.config import HIGH_VALUE_PERCENTILE, ID_COL, SEGMENTS
from lapse.operators.clean import quantiles
from lapse.operators.ordered import top_n
from lapse.operators.quantile import with_median

SEGMENT_DIM_SCHEMA = ("risk_tier string, value_tier string, segment_label string, segment_priority int, "
                      "recommended_action string, segment_color string")


def segment_dim(spark: SparkSession) -> DataFrame:
    """The 4-row (risk_tier, value_tier) -> label/priority/action/color dimension."""
    return spark.createDataFrame([tuple(r) for r in SEGMENTS], SEGMENT_DIM_SCHEMA)


def assign_segments(scored: DataFrame, median_charge=None, approx: bool = False) -> DataFrame:
    """risk tier from the prediction, value tier from the MonthlyCharges median, then a
    broadcast join to the 4-row dimension (fixed size, so the broadcast is bounded)."""
    if median_charge is None:
        median_charge = quantiles(scored, "MonthlyCharges", [HIGH_VALUE_PERCENTILE], approx)[0]
    tiered = scored.withColumn(
        "risk_tier", F.when(F.col("churn_predicted") == 1, "high_risk").otherwise("low_risk")
    ).withColumn(
        "value_tier", F.when(F.col("MonthlyCharges") >= median_charge, "high_value").otherwise("low_value"))
    return tiered.join(F.broadcast(segment_dim(scored.sparkSession)), ["risk_tier", "value_tier"], "left")


def segment_summary(scored: DataFrame) -> DataFrame:
    """count, mean p, sum rar, mean charge, exact median tenure per segment (2 dp, half-up)."""
    from lapse.functions.columns import round_half_up as r
    from lapse.functions.columns import rounded_mean
    own = ["segment_label", "segment_priority", "segment_color"]
    summary = scored.groupBy(*own).agg(
        F.count(ID_COL).alias("customers"),
        r(F.avg("churn_probability"), 2).alias("avg_churn_prob"),
        r(F.sum("revenue_at_risk"), 2).alias("total_revenue_at_risk"),
        rounded_mean("MonthlyCharges", 2).alias("avg_monthly_charges"))
    return (with_median(summary, scored, own, "tenure", "median_tenure").withColumn("median_tenure", r("median_tenure", 2))
            .orderBy("segment_priority", "segment_label"))


def risk_value_matrix(scored: DataFrame) -> DataFrame:
    return (scored.groupBy("segment_label", "risk_tier", "value_tier", "segment_color")
            .agg(F.count(ID_COL).alias("customers"),
                 F.avg("churn_probability").alias("avg_churn_prob"),
                 F.sum("revenue_at_risk").alias("total_revenue_at_risk")))


def actual_churn_by_segment(scored: DataFrame) -> DataFrame:
    """Observed churn per segment; empty (same schema) when there is no label column."""
    if "Churn" not in scored.columns:
        return scored.sparkSession.createDataFrame([], "segment_label string, actual_churn_rate double, customers long")
    return (scored.groupBy("segment_label")
            .agg(F.avg("Churn").alias("actual_churn_rate"), F.count(ID_COL).alias("customers"))
            .orderBy(F.col("actual_churn_rate").desc(), "segment_label"))


def segment_exposure(scored: DataFrame) -> DataFrame:
    """Sum of revenue at risk per segment with its share of the total (one pass + scalar subquery)."""
    total = scored.select(F.sum("revenue_at_risk")).scalar()
    return (scored.groupBy("segment_label")
            .agg(F.sum("revenue_at_risk").alias("revenue_at_risk"))
            .withColumn("share_of_exposure", F.col("revenue_at_risk") / total)
            .orderBy(F.col("revenue_at_risk").desc(), "segment_label"))


def segment_kpis(scored: DataFrame) -> DataFrame:
    """Per segment: count, mean p, sum rar, exact median charge."""
    summary = scored.groupBy("segment_label").agg(
        F.count(ID_COL).alias("customers"),
        F.avg("churn_probability").alias("avg_churn_prob"),
        F.sum("revenue_at_risk").alias("total_revenue_at_risk"))
    return with_median(summary, scored, ["segment_label"], "MonthlyCharges", "median_monthly_charges")


def top_customers(scored: DataFrame, n: int, segment: str | None = None, per_segment: bool = False,
                  order: list[Column] | None = None) -> DataFrame:
    """Top-n by revenue at risk (customerID tie-break): overall, within one segment, or per segment.

    Overall: `ordered.top_n`. Per segment:
    `row_number() <= n` is planned with a partial WindowGroupLimit before the
    shuffle, so a hot segment sends at most n rows per map task.
    """
    order = order or [F.col("revenue_at_risk").desc(), F.col(ID_COL).asc()]
    df = scored if segment is None else scored.where(F.col("segment_label") == segment)
    if not per_segment:
        return top_n(df, order, n, ID_COL)
    w = Window.partitionBy("segment_label").orderBy(*order)
    return df.withColumn("segment_rank", F.row_number().over(w)).where(F.col("segment_rank") <= n)


def segment_ids(scored: DataFrame, segment: str | None = None) -> DataFrame:
    """Customer ids, optionally of one segment."""
    df = scored if segment is None else scored.where(F.col("segment_label") == segment)
    return df.select(ID_COL)


def segments_present(scored: DataFrame) -> DataFrame:
    return scored.select("segment_label").distinct()
