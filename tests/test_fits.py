"""Fits are made one by one, when asked for, once, and found again in the shared folder."""

import uuid

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lapse.operators import features as FE
from lapse.operators import split as SP
from lapse.operators import train as T
from lapse.plans import layers as L
from lapse.plans import queries_models as QM


@pytest.fixture()
def parts(spark):
    feats = L.features(spark, SF_SMALL)
    # a column of its own, so that no earlier run's fits are found
    return feats.withColumn("run", F.lit(uuid.uuid4().hex)), L.split(spark, SF_SMALL), FE.model_columns(feats)


def profile():
    return T.Profile(rf_trees=3, gbt_rounds=2, lr_max_iter=10, cv_folds=3)


def test_only_what_is_asked_for_is_fitted_and_once(parts):
    fits = T.Fits(*parts, profile())
    assert fits.made == []
    first = fits.model("logistic")
    assert fits.model("logistic") is first and fits.made == [("logistic", None)]
    assert fits.scores("logistic", "test").count() > 0 and fits.made == [("logistic", None)]
    fits.holdout(["logistic", "random_forest"])
    assert sorted(fits.made, key=str) == [("logistic", None), ("random_forest", None)]
    fits.cv_auc(["logistic"])
    assert sorted(k for n, k in fits.made if n == "logistic" and k is not None) == [0, 1, 2]
    assert not any(n == "gbt" for n, _ in fits.made)


def test_another_run_over_the_same_data_loads_what_was_fitted(parts, spark):
    feats, split, cols = parts
    one = T.Fits(feats, split, cols, profile())
    p = {r["customerID"]: r["p"] for r in one.scores("gbt", "test").collect()}
    two = T.Fits(feats, split, cols, profile())
    assert {r["customerID"]: r["p"] for r in two.scores("gbt", "test").collect()} == p and two.made == []
    # other settings, other rows or another split are other fits
    other = T.Fits(feats, split, cols, T.Profile(rf_trees=3, gbt_rounds=3, lr_max_iter=10, cv_folds=3))
    other.model("gbt")
    fewer = T.Fits(feats.where("tenure > 3"), split, cols, profile())
    fewer.model("gbt")
    assert other.made == fewer.made == [("gbt", None)]


def test_results_equal_for_saved_and_new_fits(parts):
    a = sorted(map(str, T.train_all(*parts, profile())[1].collect()))
    b = sorted(map(str, T.train_all(*parts, profile())[1].collect()))
    assert a == b and len(a) == 3


def test_weights_of_a_fold_come_from_its_own_rows(parts, spark):
    feats, split, cols = parts
    fits = T.Fits(feats, split, cols, profile())
    for fold in (None, 0, 2):
        rows = fits.rows(fold)
        seen = {r["Churn"]: (r["w"], r["g"]) for r in rows.groupBy("Churn").agg(F.first("weight").alias("w"), F.first("gbt_weight").alias("g")).collect()}
        own = fits.train if fold is None else fits.train.where(F.col("fold") != fold)
        want = {r["Churn"]: r for r in SP.class_weights(own).collect()}
        assert seen == {0: (want[0]["weight"], 1.0), 1: (want[1]["weight"], want[1]["scale_pos_weight"])}


def test_a_coefficient_query_fits_no_tree(spark):
    t = QM.Trained(spark, SF_SMALL, profile())
    t.fits._data_print += uuid.uuid4().hex
    QM._MODEL_QUERIES["f17_logistic_coefficients"](t, spark, SF_SMALL).collect()
    assert t.fits.made == [("logistic", None)]
    QM._MODEL_QUERIES["f18_top_shap_features"](t, spark, SF_SMALL).collect()
    assert sorted(t.fits.made) == [("gbt", None), ("logistic", None)]
    QM._MODEL_QUERIES["g01_model_churn_probability"](t, spark, SF_SMALL).collect()
    assert all(fold is None for _, fold in t.fits.made) and len(t.fits.made) == 3


def test_fitted_models_score_in_a_session_that_has_observed_a_write(parts, spark):
    from lapse.sources import files as IO
    df, seen = IO.counted(spark.range(5).toDF("n"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 5}
    fits = T.Fits(*parts, profile())
    for name in fits.names:
        assert fits.scores(name, "test").count() > 0
    assert len(fits.made) == 3
