"""Model gates of the original test-suite, attribution, persistence and stream == batch scoring."""

import os
import uuid

import pytest
from pyspark.ml.feature import StandardScaler
from pyspark.sql import functions as F

from conftest import SF_MID
from lapse.operators import explain as EX
from lapse.operators import features as FE
from lapse.operators import serving as SV
from lapse.operators import split as SP
from lapse.operators import train as T
from lapse.plans import layers as L
from lapse.session import ensure_checkpoint_dir
from lapse.sources import files as IO
from lapse.streaming.scoring import score_backlog

PROFILE = T.Profile(rf_trees=20, gbt_rounds=10, lr_max_iter=100, cv_folds=3, parallelism=8)


@pytest.fixture(scope="module")
def trained(spark):
    feats = L.features(spark, SF_MID).persist()
    split = SP.stratified_split(L.cleaned(spark, SF_MID)).persist()
    cols = FE.model_columns(feats)
    models, results, test_scores = T.train_all(feats, split, cols, PROFILE)
    return feats, cols, models, {r["model"]: r.asDict() for r in results.collect()}, test_scores


def test_results_structure_and_gates(trained):
    _, _, models, res, test_scores = trained
    assert set(res) == {"logistic", "random_forest", "gbt"}
    for r in res.values():
        for k in ["test_auc", "test_f1", "test_recall", "threshold", "cv_auc_mean", "cv_auc_std", "val_f1"]:
            assert r[k] is not None
        assert r["test_auc"] > 0.70
        assert 0.10 <= r["threshold"] <= 0.70
    assert max(r["test_recall"] for r in res.values()) >= 0.55
    assert test_scores.where(~F.col("p").between(0, 1)).count() == 0


def test_logistic_uses_scaler(trained):
    _, _, models, _, _ = trained
    assert any(isinstance(s, type(StandardScaler().fit)) or "StandardScaler" in type(s).__name__
               for s in models["logistic"].stages)


def test_importance_and_shap(trained, spark):
    feats, cols, models, _, _ = trained
    rf = T.feature_importance(models["random_forest"], cols, "Random Forest")
    assert rf.count() == 36 and set(rf.columns) == {"feature", "importance", "model"}
    sample = SP.seeded_sample(feats, 40)
    shap = EX.tree_shap_mean_abs(models["gbt"].stages[-1], sample, cols).toPandas()
    assert len(shap) == 36 and (shap.importance >= 0).all() and shap.importance.sum() > 0
    lin = EX.linear_shap_mean_abs(models["logistic"], sample, cols).toPandas()
    assert len(lin) == 36


def test_tree_shap_local_accuracy_on_gbt(trained, spark):
    """sum(phi) + E[F] equals the GBT margin for every explained row."""
    feats, cols, models, _, _ = trained
    gbt = models["gbt"].stages[-1]
    trees, weights = EX.ensemble_trees(gbt, spark)
    rows = feats.select(*[F.col(f"`{c}`").cast("double") for c in cols]).limit(5).toPandas().to_numpy()
    for x, phi in zip(rows, EX.shap_matrix([(w, EX.leaves(t)) for t, w in zip(trees, weights)], rows)):
        margin = sum(w * t.predict(x) for t, w in zip(trees, weights))
        base = sum(w * t.expected_value() for t, w in zip(trees, weights))
        assert abs(phi.sum() + base - margin) < 1e-9


def test_model_persistence_roundtrip(trained, spark):
    _, _, models, _, _ = trained
    root = os.path.join(ensure_checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    IO.save_models({"logistic": models["logistic"]}, root)
    loaded = IO.load_models(spark, root)
    assert set(loaded) == {"logistic"}


def test_stream_equals_batch(trained, spark):
    feats, cols, models, res, _ = trained
    median = feats.select(F.median("MonthlyCharges")).first()[0]
    raw = L.raw(spark, SF_MID).drop("Churn")
    batch = SV.score_arrivals(raw, models["logistic"], res["logistic"]["threshold"], median, cols, "logistic")
    root = ensure_checkpoint_dir(spark)
    src = os.path.join(root, f"arrivals-{uuid.uuid4().hex}")
    raw.repartition(3).write.parquet(src)
    out = score_backlog(spark, src, os.path.join(root, f"sink-{uuid.uuid4().hex}"),
                        os.path.join(root, f"ckpt-{uuid.uuid4().hex}"), models["logistic"],
                        res["logistic"]["threshold"], median, cols, "logistic")
    key = ["customerID", "churn_probability", "segment_label"]
    a = sorted(tuple(r) for r in batch.select(*key).collect())
    b = sorted(tuple(r) for r in out.select(*key).collect())
    assert a == b and len(a) == 1500
