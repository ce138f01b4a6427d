"""Scorecards: pipelines built from parameters, read back, and compiled to SQL score alike."""

import pytest
from conftest import SF_SMALL
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lapse.operators import features as FE
from lapse.operators import scorecard as SC
from lapse.operators import train as T
from lapse.plans import layers as L
from lapse.sources import files as IO

COLS = ("tenure", "MonthlyCharges", "is_fiber")
TREE = SC.Split("tenure", 12.0, 3.0, SC.Leaf(0.75, 40.0), SC.Split("is_fiber", 0.5, 1.0, SC.Leaf(0.125, 60.0), SC.Leaf(0.5, 20.0)))
STUMP = SC.Split("MonthlyCharges", 61.25, 2.0, SC.Leaf(0.25, 64.0), SC.Leaf(0.625, 56.0))
CARDS = {"logistic": SC.Logistic(COLS, (30.0, 60.0, 0.4), (20.0, 10.0, 0.5), (-0.8, 0.3, 0.5), -1.0),
         "random_forest": SC.Forest(COLS, (TREE, STUMP)), "gbt": SC.Boosted(COLS, (TREE, STUMP), (1.0, -0.25))}


def probabilities(model, df):
    return {r[0]: r[1] for r in model.transform(df).select("customerID", vector_to_array("probability")[1]).collect()}


def compiled(card, df):
    return {r[0]: r[1] for r in df.select("customerID", F.expr(SC.probability_sql(card, "`"))).collect()}


@pytest.mark.parametrize("name", list(CARDS))
def test_built_pipelines_score_as_their_sql(spark, name):
    df = L.features(spark, SF_SMALL)
    got, want = probabilities(SC.pipeline(spark, CARDS[name]), df), compiled(CARDS[name], df)
    assert len(set(want.values())) > 3 and max(abs(got[k] - want[k]) for k in want) < 1e-12


@pytest.mark.parametrize("name", list(CARDS))
def test_built_pipelines_are_read_back_and_saved(spark, name, tmp_path):
    model = SC.pipeline(spark, CARDS[name])
    assert SC.read(model, spark) == CARDS[name]
    IO.save_models({name: model}, str(tmp_path))
    assert SC.read(IO.load_models(spark, str(tmp_path))[name], spark) == CARDS[name]


def test_fitted_pipelines_compile_to_sql(spark):
    df = L.features(spark, SF_SMALL)
    cols = FE.model_columns(df)
    fits = T.Fits(df, L.split(spark, SF_SMALL), cols, T.Profile(rf_trees=6, gbt_rounds=4, lr_max_iter=30))
    for name in CARDS:
        card = SC.read(fits.model(name), spark)
        got, want = probabilities(fits.model(name), df), compiled(card, df)
        assert max(abs(got[k] - want[k]) for k in want) < 1e-12


def test_native_importance_of_a_built_forest(spark):
    rows = {r["feature"]: r["importance"] for r in T.feature_importance(SC.pipeline(spark, CARDS["random_forest"]), list(COLS), "x").collect()}
    # gain * rows, to one for each tree, and for their sum
    first = {"tenure": 3.0 * 120 / (3.0 * 120 + 1.0 * 80), "is_fiber": 1.0 * 80 / (3.0 * 120 + 1.0 * 80)}
    assert rows == pytest.approx({"tenure": first["tenure"] / 2, "is_fiber": first["is_fiber"] / 2, "MonthlyCharges": 0.5})
