"""The end-to-end batch run writes every layer and reports consistent tables."""

import os
import uuid

from conftest import SF_SMALL
from lapse.operators import train as T
from lapse.plans import batch
from lapse.session import ensure_checkpoint_dir


def test_batch_run_writes_layers(spark):
    out = os.path.join(ensure_checkpoint_dir(spark), f"batch-{uuid.uuid4().hex}")
    tiny = T.Profile(rf_trees=5, gbt_rounds=3, lr_max_iter=30, cv_folds=2, parallelism=4)
    report = batch.run(spark, out, sf_dir=SF_SMALL, profile=tiny, explain=False)
    for layer in ["cleaned", "features", "split", "scored", "scenarios", "summary"]:
        assert spark.read.parquet(report["paths"][layer]).count() > 0
    assert {r["model"] for r in report["results"]} == {"logistic", "random_forest", "gbt"}
    assert report["summary"]["customers"] == 150
    assert [r["n_targeted"] for r in report["scenarios"]] == [50, 100, 150, 150]
    scored = spark.read.parquet(report["paths"]["scored"])
    assert scored.select("risk_rank").distinct().count() == 150
    # counted by the writes, not by jobs of their own
    assert report["counts"]["raw"] == {"rows": 150, "without_id": 0, "without_number_in_total_charges": 1, "without_label": 0}
    assert report["counts"]["cleaned"]["rows"] == report["counts"]["scoring_input"]["rows"] == report["counts"]["scored"]["rows"] == 150
    assert report["counts"]["scoring_input"]["rejected"] == 0
    assert report["counts"]["scored"]["at_risk"] == report["summary"]["predicted_at_risk"]
    # the run's own intermediate tables are gone; its outputs (read above) are intact
    assert report["dropped_intermediates"] > 0


def test_batch_counts_rejected_rows_and_writes_importances(spark):
    """Rows that lack a model input are counted, not scored; the importance table is written."""
    from pyspark.sql import functions as F

    from lapse.plans import layers as L
    from lapse.sources import files as IO
    root = os.path.join(ensure_checkpoint_dir(spark), f"batch-{uuid.uuid4().hex}")
    first = L.raw(spark, SF_SMALL).agg(F.min("customerID")).first()[0]
    IO.write_csv(L.raw(spark, SF_SMALL).withColumn("tenure", F.when(F.col("customerID") != first, F.col("tenure"))), f"{root}/raw")
    tiny = T.Profile(rf_trees=3, gbt_rounds=2, lr_max_iter=10, cv_folds=2)
    report = batch.run(spark, f"{root}/out", raw_path=f"{root}/raw", profile=tiny)
    assert report["counts"]["scoring_input"] == {"rows": 150, "rejected": 1} and report["counts"]["scored"]["rows"] == 149
    importance = IO.read_importance(spark, report["paths"]["importance"])
    assert {r["model"]: r["count"] for r in importance.groupBy("model").count().collect()} == {
        "Random Forest": 36, "Gradient Boosted Trees": 36, "SHAP": 36}
    assert importance.where("importance IS NULL OR importance < 0").count() == 0


def test_counting_a_write_starts_no_job_of_its_own(spark):
    from pyspark.sql import functions as F

    from lapse.sources import files as IO
    df, seen = IO.counted(spark.range(100).toDF("n"), ("even", F.col("n") % 2 == 0))
    path = os.path.join(ensure_checkpoint_dir(spark), f"counted-{uuid.uuid4().hex}")
    spark.sparkContext.setJobGroup("counted", "write")
    IO.write_layer(df, path)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    assert seen.get == {"rows": 100, "even": 50}
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) == jobs
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
