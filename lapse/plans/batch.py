"""End-to-end batch pipeline: raw -> cleaned -> features -> train -> score -> segment -> decide.

Every layer is written once as Parquet under `out_root` (a shared folder on a
cluster) and read back by the next step, so each step starts from a short
lineage and a failed run can resume from the last written layer.

    python -m lapse.plans.batch --sf /root/testdata/sf0.01 --out /shared/run1 [--quick]
"""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lapse import config as K
from lapse.operators import budget as B
from lapse.operators import clean as C
from lapse.operators import explain as EX
from lapse.operators import features as FE
from lapse.operators import scoring as S
from lapse.operators import segments as SG
from lapse.operators import split as SP
from lapse.operators import train as T
from lapse.sources import files as IO
from lapse.session import drop_tables, intermediate_scope
from lapse.sources import fixture


def run(spark: SparkSession, out_root: str, sf_dir: str | None = None, raw_path: str | None = None,
        raw_format: str = "csv", profile: T.Profile | None = None, explain: bool = True) -> dict:
    """Run the whole pipeline; returns the output paths and the small report tables as rows.

    Intermediate tables of this run (rank and running-count passes) are dropped
    from the shared folder at the end: every output is then written and the
    report rows are collected, so nothing reads them any more.
    """
    with intermediate_scope() as written:
        report = _run(spark, out_root, sf_dir, raw_path, raw_format, profile, explain)
    report["dropped_intermediates"] = drop_tables(spark, written)
    return report


def _run(spark: SparkSession, out_root: str, sf_dir: str | None, raw_path: str | None, raw_format: str,
         profile: T.Profile | None, explain: bool) -> dict:
    profile = profile or T.Profile.reference()
    p = {name: os.path.join(out_root, name) for name in
         ["cleaned", "features", "split", "models", "model_results", "importance", "scored", "scenarios", "summary"]}

    raw = fixture.customers(spark, sf_dir) if sf_dir else IO.load_raw(spark, raw_path, raw_format)
    # Counts come with the writes that are run anyway.
    raw, seen_raw = IO.counted(IO.validate(raw), ("without_id", F.col(K.ID_COL).isNull()),
                               ("without_number_in_total_charges", C.total_charges_number().isNull()),
                               ("without_label", F.col(K.TARGET_COL).isNull()))
    cleaned, seen_cleaned = IO.counted(C.clean(raw), ("outliers", F.col("is_charges_outlier") == 1))
    IO.write_layer(cleaned, p["cleaned"])
    cleaned = IO.read_layer(spark, p["cleaned"], "cleaning")

    IO.write_layer(FE.engineer(cleaned), p["features"])
    features = IO.read_layer(spark, p["features"], "feature engineering")
    feature_cols = FE.model_columns(features)

    IO.write_layer(SP.stratified_split(cleaned), p["split"])
    split = IO.read_layer(spark, p["split"], "the split")

    fits = T.Fits(features, split, feature_cols, profile)
    IO.write_model_results(fits.results(), p["model_results"])
    models = {name: m for (name, _), m in fits.models(fits.names).items()}
    IO.save_models(models, p["models"])
    results = IO.read_model_results(spark, p["model_results"])

    if explain:
        IO.write_importance([
            T.feature_importance(models["random_forest"], feature_cols, "Random Forest"),
            T.feature_importance(models["gbt"], feature_cols, "Gradient Boosted Trees"),
            EX.tree_shap_mean_abs(models["gbt"].stages[-1], features, feature_cols, "SHAP"),
        ], p["importance"])

    best = results.orderBy(F.col("test_auc").desc(), "model").first()
    name, threshold = best["model"], float(best["threshold"])
    # model output is row for row: no join back, and the median charge comes from the features layer
    median = C.quantiles(features, "MonthlyCharges", [K.HIGH_VALUE_PERCENTILE])[0]
    # written before it is ranked: the range pass samples its input, and the model is evaluated once a row
    inputs, seen_inputs = IO.counted(features, ("rejected", S.missing_input(feature_cols)))
    ranked, seen_scored = IO.counted(S.risk_rank(S.score_once(models[name], inputs, threshold, name, median)),
                                     ("at_risk", F.col("churn_predicted") == 1))
    IO.write_scored(ranked, p["scored"])
    scored = IO.read_layer(spark, p["scored"], "scoring")

    scenarios = B.budget_scenarios(scored, K.PIPELINE_BUDGETS)
    IO.write_layer(scenarios, p["scenarios"])
    summary = B.business_summary(scored)
    IO.write_layer(summary, p["summary"])

    return {
        "paths": p,
        "counts": {"raw": dict(seen_raw.get), "cleaned": dict(seen_cleaned.get), "scoring_input": dict(seen_inputs.get),
                   "scored": dict(seen_scored.get)},
        "best_model": name,
        "threshold": threshold,
        "results": [r.asDict() for r in results.collect()],             # one row per model
        "segments": [r.asDict() for r in SG.segment_summary(scored).collect()],   # four rows
        "scenarios": [r.asDict() for r in spark.read.parquet(p["scenarios"]).orderBy("budget").collect()],
        "summary": spark.read.parquet(p["summary"]).first().asDict(),
    }


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", help="test-data folder (fixture source)")
    ap.add_argument("--raw", help="raw CSV/Parquet path instead of the fixture")
    ap.add_argument("--raw-format", default="csv")
    ap.add_argument("--out", required=True)
    ap.add_argument("--quick", action="store_true", help="small model sizes")
    args = ap.parse_args()
    from lapse.session import build_session
    spark = build_session()
    report = run(spark, args.out, args.sf, args.raw, args.raw_format,
                 T.Profile.quick() if args.quick else T.Profile.reference())
    print(json.dumps(report, default=str, indent=1))


if __name__ == "__main__":
    main()
