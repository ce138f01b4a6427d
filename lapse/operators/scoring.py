"""Scoring: probability -> prediction, revenue at risk, unique risk rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import ID_COL
from lapse.operators.ordered import global_rank
from lapse.session import materialize


def churn_probability(model_output: DataFrame, prob_col: str = "probability") -> DataFrame:
    """Positive-class probability from a Spark ML `probability` vector."""
    from pyspark.ml.functions import vector_to_array
    return model_output.withColumn("churn_probability", vector_to_array(F.col(prob_col))[1])


def predict(df: DataFrame, threshold: float) -> DataFrame:
    return df.withColumn("churn_predicted", (F.col("churn_probability") >= F.lit(float(threshold))).cast("int"))


def revenue_at_risk(df: DataFrame) -> DataFrame:
    return df.withColumn("revenue_at_risk", F.col("churn_probability") * F.col("MonthlyCharges"))


def risk_rank(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Unique 1..N by revenue_at_risk desc; ties broken by customerID (distributed, no single-task window)."""
    return global_rank(df, [F.col("revenue_at_risk").desc(), F.col(ID_COL).asc()], "risk_rank", partitions) \
        .withColumn("risk_rank", F.col("risk_rank").cast("int"))


def score_frame(df: DataFrame, threshold: float, model_name: str, partitions: int | None = None,
                rank: bool = True) -> DataFrame:
    """Rows already carrying churn_probability -> prediction, revenue at risk, scoring model, risk rank.

    With rank=False the rank is left to the caller (so that it can be the last,
    materialising step of a layer).
    """
    df = (df.transform(lambda d: predict(d, threshold)).transform(revenue_at_risk)
            .withColumn("scoring_model", F.lit(model_name)))
    return risk_rank(df, partitions) if rank else df


def score(features: DataFrame, probabilities: DataFrame, threshold: float, model_name: str,
          partitions: int | None = None, rank: bool = True) -> DataFrame:
    """features + a separate (customerID, churn_probability) table (one join on the id)."""
    df = features.join(probabilities.select(ID_COL, "churn_probability"), ID_COL)
    return score_frame(df, threshold, model_name, partitions, rank)


def model_inputs(model) -> list[str]:
    """Columns that a fitted pipeline's assembler reads."""
    return model.stages[0].getInputCols()


def missing_input(cols: list[str]) -> Column:
    """Whether a row lacks a model input (NULL or NaN): it can't be scored, in batch or stream alike."""
    lacks = lambda c: F.col(f"`{c}`").isNull() | F.isnan(F.col(f"`{c}`").cast("double"))
    return F.array_contains(F.array(*(lacks(c) for c in cols)), True)


def rejected(features: DataFrame, cols: list[str]) -> DataFrame:
    """The rows that scoring leaves out, with the columns that each lacks."""
    lacking = F.filter(F.array(*(F.when(missing_input([c]), F.lit(c)) for c in cols)), lambda x: x.isNotNull())
    return features.where(missing_input(cols)).select(ID_COL, lacking.alias("missing"))


def score_model(model, features: DataFrame, threshold: float, model_name: str, partitions: int | None = None,
                rank: bool = True) -> DataFrame:
    """features scored by a fitted pipeline: its output is row for row, so nothing is joined back. Rows that lack a
    model input are left out (`rejected` lists them), so that no NaN enters ranks and sums."""
    features = features.where(~missing_input(model_inputs(model)))
    out = churn_probability(model.transform(features)).select(*features.columns, "churn_probability")
    return score_frame(out, threshold, model_name, partitions, rank)


def score_once(model, features: DataFrame, threshold: float, model_name: str, median_charge=None) -> DataFrame:
    """Scored and segmented rows, written: what reads them, a range pass that samples its input among it, never evaluates the
    model again."""
    from lapse.operators.segments import assign_segments
    scored = score_model(model, features, threshold, model_name, rank=False)
    return materialize(assign_segments(scored, median_charge=median_charge), "model-scored")


def score_summary(scored: DataFrame) -> DataFrame:
    """One-row KPI strip: totals, high-risk share, revenue at risk, actual rate, top-segment count."""
    has_label = "Churn" in scored.columns
    has_seg = "segment_label" in scored.columns
    return scored.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("churn_predicted").cast("long").alias("high_risk_customers"),
        (F.sum("churn_predicted") / F.count(F.lit(1))).alias("high_risk_share"),
        F.sum("revenue_at_risk").alias("total_revenue_at_risk"),
        (F.avg("Churn") if has_label else F.lit(None).cast("double")).alias("actual_churn_rate"),
        (F.sum((F.col("segment_label") == "Save Immediately").cast("int")) if has_seg
         else F.lit(None).cast("long")).cast("long").alias("save_immediately_customers"),
    )
