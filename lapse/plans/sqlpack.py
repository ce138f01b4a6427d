"""The analytics query pack over the `customers` view, as DataFrame plans.

Rates are 100 * churned / customers, half-up rounded. Group-bys keep NULL
keys (SQL semantics). The service-adoption report reads the table once and
unpivots one aggregate row instead of scanning once per service.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lapse.config import ADOPTION_SERVICES
from lapse.functions.columns import rate_pct, round_half_up, rounded_mean, tenure_band_sql



def _churned():
    return F.sum(F.when(F.col("Churn") == "Yes", 1).otherwise(0))


def overall_churn(c: DataFrame) -> DataFrame:
    return c.agg(F.count(F.lit(1)).alias("total_customers"), _churned().cast("long").alias("churned"),
                 rate_pct(_churned(), F.count(F.lit(1)), 2).alias("churn_rate_pct"))


def revenue_at_risk_actual(c: DataFrame) -> DataFrame:
    churned = c.where(F.col("Churn") == "Yes")
    return churned.agg(round_half_up(F.sum("MonthlyCharges"), 2).alias("total_monthly_revenue_at_risk"),
                       rounded_mean("MonthlyCharges", 2).alias("avg_monthly_charges_churned"),
                       F.count(F.lit(1)).alias("churned_customers"))


def churn_by(c: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """customers, churned, churn_rate_pct per value of `key`, highest rate first."""
    return (c.groupBy(key).agg(F.count(F.lit(1)).alias("customers"), _churned().cast("long").alias("churned"),
                               rate_pct(_churned(), F.count(F.lit(1)), digits).alias("churn_rate_pct"))
            .orderBy(F.col("churn_rate_pct").desc(), F.col(key)))


def churn_by_tenure_band(c: DataFrame) -> DataFrame:
    return (c.withColumn("tenure_band", tenure_band_sql("tenure"))
            .groupBy("tenure_band")
            .agg(F.count(F.lit(1)).alias("customers"), _churned().cast("long").alias("churned"),
                 rate_pct(_churned(), F.count(F.lit(1)), 2).alias("churn_rate_pct"), F.min("tenure").alias("_o"))
            .orderBy("_o").drop("_o"))


def churned_vs_retained(c: DataFrame) -> DataFrame:
    return c.groupBy(F.col("Churn").alias("churn_status")).agg(
        F.count(F.lit(1)).alias("customers"),
        rounded_mean("MonthlyCharges", 2).alias("avg_monthly_charges"),
        rounded_mean("TotalCharges", 2).alias("avg_total_charges"),
        round_half_up(F.avg("tenure"), 1).alias("avg_tenure_months"))


def service_adoption(c: DataFrame) -> DataFrame:
    """One scan: seven conditional sums, then `stack` the single row into (service, pct)."""
    n = F.count(F.lit(1))
    wide = c.agg(*[rate_pct(F.sum(F.when(F.col(s) == "Yes", 1).otherwise(0)), n, 1).alias(s)
                   for s in ADOPTION_SERVICES])
    pairs = ", ".join(f"'{s}', `{s}`" for s in ADOPTION_SERVICES)
    return (wide.selectExpr(f"stack({len(ADOPTION_SERVICES)}, {pairs}) as (service, adoption_pct)")
            .orderBy(F.col("adoption_pct").desc(), "service"))


def high_value_churners(c: DataFrame, top: int = 20, pct: float = 0.75) -> DataFrame:
    """Churners at or above the P75 charge of all customers (scalar subquery), top 20 by charge."""
    p75 = c.select(F.percentile(F.col("MonthlyCharges"), F.lit(pct))).scalar()
    rows = c.where((F.col("Churn") == "Yes") & (F.col("MonthlyCharges") >= p75))
    return (rows.select("customerID", "tenure", "Contract", "InternetService", "MonthlyCharges", "TotalCharges",
                        round_half_up(F.col("TotalCharges") / F.nullif(F.col("tenure"), F.lit(0)), 2)
                        .alias("avg_monthly_revenue"))
            .orderBy(F.col("MonthlyCharges").desc(), F.col("customerID")).limit(top))


def cohort_matrix(c: DataFrame) -> DataFrame:
    return (c.withColumn("tenure_band", tenure_band_sql("tenure"))
            .groupBy("Contract", "tenure_band")
            .agg(F.count(F.lit(1)).alias("customers"), _churned().cast("long").alias("churned"),
                 rate_pct(_churned(), F.count(F.lit(1)), 1).alias("churn_rate_pct"), F.min("tenure").alias("_o"))
            .orderBy("Contract", "_o").drop("_o"))


def clv_by_contract(c: DataFrame) -> DataFrame:
    return (c.where(F.col("Churn") == "No").groupBy("Contract")
            .agg(F.count(F.lit(1)).alias("customers"),
                 rounded_mean("MonthlyCharges", 2).alias("avg_monthly_charges"),
                 round_half_up(F.avg("tenure"), 1).alias("avg_tenure"),
                 round_half_up(F.avg("MonthlyCharges") * 24, 2).alias("estimated_24mo_clv"))
            .orderBy(F.col("estimated_24mo_clv").desc()))


def senior_comparison(c: DataFrame) -> DataFrame:
    return (c.groupBy("SeniorCitizen")
            .agg(F.count(F.lit(1)).alias("customers"),
                 rounded_mean("MonthlyCharges", 2).alias("avg_monthly_charges"),
                 rate_pct(_churned(), F.count(F.lit(1)), 2).alias("churn_rate_pct"))
            .select(F.when(F.col("SeniorCitizen") == 1, "Senior").otherwise("Non-Senior").alias("segment"),
                    "customers", "avg_monthly_charges", "churn_rate_pct"))


def create_customers_view(c: DataFrame, name: str = "customers") -> None:
    """Register the pack's input as a view, so that the pack's SQL text, or any other, runs by `spark.sql`."""
    c.createOrReplaceTempView(name)
