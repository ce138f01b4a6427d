"""Scoring of new arrivals (batch or streaming) and the per-customer risk factors.

Everything here is a row-local projection with constants frozen at training
time (median charge, threshold, feature list), so it runs unchanged on a
streaming DataFrame: no aggregate, no state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import HIGH_VALUE_PERCENTILE, ID_COL, PROTECTIVE_SHOWN, RISK_FACTORS
from lapse.operators import clean as C
from lapse.operators import features as FE
from lapse.operators.clean import quantiles
from lapse.operators.scoring import missing_input
from lapse.operators.segments import segment_dim

#: Raw columns that every model input follows from; an arrival that lacks one can't be scored.
ARRIVAL_INPUTS = ["tenure", "MonthlyCharges", "SeniorCitizen"]


def factor_conditions(median_charge) -> list[Column]:
    """The eight risk-factor conditions, in RISK_FACTORS order."""
    internet_on = F.col("InternetService") != "No"
    return [
        F.col("Contract") == "Month-to-month",
        F.col("tenure") < 12,
        F.col("InternetService") == "Fiber optic",
        F.col("PaymentMethod") == "Electronic check",
        (F.col("OnlineSecurity") == "No") & internet_on,
        (F.col("TechSupport") == "No") & internet_on,
        F.col("MonthlyCharges") >= median_charge,
        ~F.lower(F.col("PaymentMethod")).contains("automatic"),
    ]


def risk_factors(df: DataFrame, median_charge=None, as_text: bool = True) -> DataFrame:
    """Active factors and protective factors (first five, 'No ...') per customer."""
    if median_charge is None:
        median_charge = quantiles(df, "MonthlyCharges", [HIGH_VALUE_PERCENTILE])[0]
    # materialise the flags first: a scalar subquery may not sit inside a higher-order function
    flagged = df.select(ID_COL, *[c.alias(f"_f{i}") for i, c in enumerate(factor_conditions(median_charge))])
    conds = [F.col(f"_f{i}") for i in range(len(RISK_FACTORS))]
    active = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in zip(conds, RISK_FACTORS)]), lambda x: x.isNotNull())
    inactive = F.filter(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in zip(conds, RISK_FACTORS)]),
                        lambda x: x.isNotNull())
    protective = F.transform(F.slice(inactive, 1, PROTECTIVE_SHOWN), lambda x: F.concat(F.lit("No "), F.lower(x)))
    if as_text:
        return flagged.select(ID_COL, F.array_join(active, "; ").alias("risk_factors"),
                              F.array_join(protective, "; ").alias("protective_factors"))
    return flagged.select(ID_COL, active.alias("risk_factors"), protective.alias("protective_factors"))


def prepare_arrivals(raw: DataFrame, high_value_cut: float, feature_cols: list[str]) -> DataFrame:
    """Raw-shaped rows -> model feature columns; absent model columns are 0. Stateless."""
    if "Churn" in raw.columns:
        raw = raw.transform(C.binary_target)
    cleaned = (raw.transform(C.coerce_total_charges).transform(C.impute_total_charges)
                  .transform(C.senior_int).transform(C.strip_strings)
                  .withColumn("tenure", F.when(F.col("tenure") < 0, 0).otherwise(F.col("tenure"))))
    feats = FE.engineer(cleaned, high_value_cut=F.lit(float(high_value_cut)))
    present = set(feats.columns)
    missing = [F.lit(0).alias(c) for c in feature_cols if c not in present]
    return feats.select("*", *missing)


def score_arrivals(raw: DataFrame, model, threshold: float, high_value_cut: float, feature_cols: list[str],
                   model_name: str = "model") -> DataFrame:
    """Probability, prediction, tiers, segment and revenue at risk for new rows (batch or stream).

    `model` is a fitted PipelineModel that starts from the raw feature columns
    (assembler first). The segment lookup is a broadcast join to a 4-row table.
    """
    from pyspark.ml.functions import vector_to_array
    # As in the batch path, rows that lack a model input are left out. Every model column follows from these raw ones
    # (TotalCharges is imputed, categories become flags), so the test stays a filter on the scan.
    feats = prepare_arrivals(raw.where(~missing_input(ARRIVAL_INPUTS)), high_value_cut, feature_cols)
    out = model.transform(feats)
    p = vector_to_array(F.col("probability"))[1]
    scored = out.select(
        ID_COL, "MonthlyCharges", p.alias("churn_probability"),
        (p >= F.lit(float(threshold))).cast("int").alias("churn_predicted"),
        (p * F.col("MonthlyCharges")).alias("revenue_at_risk"),
        F.when(p >= F.lit(float(threshold)), "high_risk").otherwise("low_risk").alias("risk_tier"),
        F.when(F.col("MonthlyCharges") >= F.lit(float(high_value_cut)), "high_value").otherwise("low_value")
        .alias("value_tier"),
        F.lit(model_name).alias("scoring_model"))
    return scored.join(F.broadcast(segment_dim(raw.sparkSession)), ["risk_tier", "value_tier"], "left")
