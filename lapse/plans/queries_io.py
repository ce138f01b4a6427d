"""Registered queries for sources, sinks, exports and the streaming scorer.

Each writes Spark-derived data to a fresh folder under the shared checkpoint
folder and reads it back through the source under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.config import RAW_COLUMNS
from lapse.functions.columns import fmt_dollar, fmt_pct, round_half_up
from lapse.operators import segments as SG
from lapse.plans import layers as L
from lapse.plans.registry import register
from lapse.sources import files as IO


def _csv_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "raw-csv")
    IO.write_csv(L.raw(spark, sf), path)
    return IO.validate(IO.load_raw(spark, path, "csv"))


register("a01_load_raw_csv", f"select {', '.join(RAW_COLUMNS)} from customers")(_csv_roundtrip)


def _layer_roundtrip(spark, sf):
    path = IO.scratch_path(spark, "cleaned-layer")
    IO.write_layer(L.cleaned(spark, sf), path)
    return IO.read_layer(spark, path, "the cleaning step")


register("a03_cleaned_layer", "select * from cleaned")(_layer_roundtrip)


def _features_layer(spark, sf):
    path = IO.scratch_path(spark, "features-layer")
    IO.write_layer(L.features(spark, sf), path, partition_by=["Contract_Two year"])
    return IO.read_layer(spark, path, "feature engineering")


register("a04_features_layer", "select * from features")(_features_layer)


def _scored_layer(spark, sf):
    path = IO.scratch_path(spark, "scored-layer")
    IO.write_scored(L.scored(spark, sf).select("customerID", "churn_probability", "risk_rank", "segment_label"), path)
    return IO.read_layer(spark, path, "scoring")


register("a05_scored_layer", "select customerID, churn_probability, risk_rank, segment_label from scored")(_scored_layer)

_EXPORT_COLS = ["customerID", "segment_label", "churn_probability", "MonthlyCharges", "revenue_at_risk",
                "recommended_action"]


def _export(spark, sf):
    path = IO.scratch_path(spark, "segment-export")
    IO.export_segment(L.scored_by_segment(spark, sf).select(*_EXPORT_COLS), "Save Immediately", path)
    return spark.read.schema("customerID string, segment_label string, churn_probability double, "
                             "MonthlyCharges double, revenue_at_risk double, recommended_action string") \
        .option("header", True).csv(path)


register("a10_export_segment", f"select {', '.join(_EXPORT_COLS)} from scored where segment_label = 'Save Immediately'")(
    _export)


def _export_targets(spark, sf):
    from lapse.operators import budget as B
    path = IO.scratch_path(spark, "targets-export")
    targets = B.allocate_budget(L.scored(spark, sf), 5000.0)[0].select("customerID", "roi_rank", "expected_save_value")
    IO.export_targets(targets, path)
    return spark.read.schema("customerID string, roi_rank int, expected_save_value double").option("header", True).csv(path)


register("a11_export_targets", """
select customerID, cast(row_number() over (order by MonthlyCharges * churn_probability * cast(0.3 as double) * cast(12 as double) / cast(50 as double) desc, customerID) as integer) as roi_rank,
  MonthlyCharges * churn_probability * cast(0.3 as double) * cast(12 as double) as expected_save_value
from scored qualify roi_rank <= 100""")(_export_targets)


register("a13_formatted_segments", """
select segment_label, printf('%.1f%%', cast(floor(avg(churn_probability) * 100.0 * 10.0 + 0.5) / 10.0 as double)) as avg_churn_prob,
  '$' || format('{:,.0f}', cast(floor(sum(revenue_at_risk) + 0.5) as double)) as revenue_at_risk,
  '$' || format('{:,.2f}', cast(floor(avg(MonthlyCharges) * 100.0 + 0.5) / 100.0 as double)) as avg_monthly_charges
from scored group by segment_label""")(
    lambda spark, sf: SG.segment_kpis(L.scored(spark, sf)).join(
        L.scored(spark, sf).groupBy("segment_label").agg(F.avg("MonthlyCharges").alias("_m")), "segment_label")
    .select("segment_label", fmt_pct(round_half_up(F.col("avg_churn_prob") * 100.0, 1) / 100.0).alias("avg_churn_prob"),
            fmt_dollar(round_half_up("total_revenue_at_risk", 0), 0).alias("revenue_at_risk"),
            fmt_dollar(round_half_up("_m", 2), 2).alias("avg_monthly_charges")))
