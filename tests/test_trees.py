"""Forests grown from histograms: Spark ML's trees where nothing is drawn, and the same trees again where something is."""

import math
import uuid

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lapse.operators import features as FE
from lapse.operators import train as T
from lapse.operators import trees as TR
from lapse.plans import layers as L


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random((900, 5)).round(3)
    x[:, 3:] = x[:, 3:] > 0.4
    y = (x[:, 0] + 0.5 * x[:, 3] + 0.3 * rng.random(900) > 0.9).astype(float)
    df = spark.createDataFrame([(*map(float, r), float(c), float(1 + c)) for r, c in zip(x, y, strict=True)], "a double, b double, c double, d double, e double, label double, w double")
    df = VectorAssembler(inputCols=list("abcde"), outputCol="features", handleInvalid="keep").transform(df.repartition(3))
    return df.withColumn("one", F.lit(1.0)).checkpoint()


def settings(**more):
    return dict(featuresCol="features", labelCol="label", weightCol="one", numTrees=2, maxDepth=4, minInstancesPerNode=4, seed=3) | more


def probabilities(model, df):
    return [r[0] for r in model.transform(df).select(vector_to_array("probability")[1]).collect()]


def test_without_draws_it_is_spark_mls_forest(rows):
    fixed = settings(featureSubsetStrategy="all", bootstrap=False)
    one, two = (kind(**fixed).fit(rows) for kind in (RandomForestClassifier, TR.HistogramForestClassifier))
    assert two.toDebugString.splitlines()[1:] == one.toDebugString.splitlines()[1:]
    assert probabilities(two, rows) == probabilities(one, rows)
    assert np.allclose(two.featureImportances.toArray(), one.featureImportances.toArray(), rtol=1e-12)


def test_weights_and_rows_of_each_leaf_are_those_that_reach_it(rows):
    mixed = rows.withColumn("w", F.col("w") * (1 + F.col("d")))  # not one weight a class
    tree = TR.HistogramForestClassifier(**settings(featureSubsetStrategy="all", bootstrap=False, weightCol="w", numTrees=1)).fit(mixed).trees[0]
    out = tree.setLeafCol("leaf").transform(mixed).select("leaf", "label", "w", vector_to_array("probability")[1].alias("p"))
    leaves = out.groupBy("leaf", "p").agg(F.sum(F.col("w") * F.col("label")).alias("one"), F.sum("w").alias("all"), F.count("*").alias("n")).collect()
    assert len(leaves) > 4 and all(math.isclose(r["p"], r["one"] / r["all"], rel_tol=1e-9, abs_tol=1e-12) for r in leaves)
    assert min(r["n"] for r in leaves) >= 4


def test_draws_come_again_and_differ_by_tree(rows):
    drawn = settings(featureSubsetStrategy="sqrt", weightCol="w", numTrees=40)
    one, two, known = (kind(**drawn).fit(rows) for kind in (TR.HistogramForestClassifier, TR.HistogramForestClassifier, RandomForestClassifier))
    assert one.toDebugString.splitlines()[1:] == two.toDebugString.splitlines()[1:] and one.getNumTrees == 40
    assert len({t.toDebugString.split("\n", 1)[1] for t in one.trees}) > 30
    assert np.abs(np.subtract(probabilities(one, rows), probabilities(known, rows))).mean() < 0.05


def test_a_row_is_drawn_a_poisson_number_of_times():
    plan = {"seed": 7, "share": 1.0, "replace": True}
    own, hits = TR._bag(plan, 1, 2, 200_000)
    assert len(np.unique(own)) == len(own)
    for k in range(1, 6):
        assert abs((hits == k).sum() / 200_000 - math.exp(-1) / math.factorial(k)) < 0.005
    assert abs(hits.sum() / 200_000 - 1) < 0.02 and not np.array_equal(own, TR._bag(plan, 2, 2, 200_000)[0])
    own, hits = TR._bag(plan | {"replace": False}, 0, 0, 100)
    assert len(own) == 100 and set(hits) == {1.0}


def test_cut_points_are_midpoints_at_equal_shares():
    assert TR.cut_points(np.array([1.0, 0.0, -0.0, 1.0]), np.ones(4), 31).tolist() == [0.5]
    assert TR.cut_points(np.array([2.0, 2.0]), np.ones(2), 31).size == 0
    cuts = TR.cut_points(np.arange(1000.0), np.ones(1000), 31)
    assert len(cuts) == 31 and np.abs(np.diff(cuts) - 1000 / 32).max() <= 1.5


def test_a_forest_of_many_rows_is_grown_from_histograms_saved_and_found_again(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 20)
    feats = L.features(spark, SF_SMALL).withColumn("run", F.lit(uuid.uuid4().hex))
    args = (feats, L.split(spark, SF_SMALL), FE.model_columns(feats), T.Profile(rf_trees=3, gbt_rounds=2, lr_max_iter=10, cv_folds=3))
    assert isinstance(T.build_pipelines(args[2], 21, args[3])["random_forest"].getStages()[-1], TR.HistogramForestClassifier)
    assert type(T.build_pipelines(args[2], 20, args[3])["random_forest"].getStages()[-1]) is RandomForestClassifier
    one, two = T.Fits(*args), T.Fits(*args)
    p = sorted(map(str, one.scores("random_forest", "test").collect()))
    assert sorted(map(str, two.scores("random_forest", "test").collect())) == p and two.made == []


def test_folds_share_the_cores(spark, monkeypatch):
    monkeypatch.setattr(T, "ROWS_PER_TASK", 1)
    feats = L.features(spark, SF_SMALL)
    f = T.Fits(feats, L.split(spark, SF_SMALL), FE.model_columns(feats), T.Profile(cv_folds=2))
    f.train = f.train.repartition(3 * spark.sparkContext.defaultParallelism)
    assert f.rows(1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism // 2
    assert f.rows(1).count() == sum(f.counts(1).values())
