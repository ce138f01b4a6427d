"""Values that must not poison results: malformed numbers, missing model inputs, constant columns, huge counts."""

import math

import pytest
from conftest import SF_SMALL, raw_row
from pyspark.sql import functions as F

from lapse.operators import clean as C
from lapse.operators import cohorts as H
from lapse.operators import evaluate as EV
from lapse.operators import features as FE
from lapse.operators import scoring as S
from lapse.operators import serving as SV
from lapse.operators import split as SP
from lapse.operators import train as T
from lapse.plans import layers as L
from lapse.plans import sqlpack


@pytest.mark.parametrize(("text", "number"), [
    ("NaN", None), ("5d", None), ("5f", None), ("Infinity", None), ("", None), (" ", None), ("1,5", None), (None, None), ("0x1A", None),
    (" 12.50 ", 12.5), ("-3", -3.0), ("1e3", 1000.0), (".5", 0.5), ("7.", 7.0)])
def test_coerced_numbers(spark, raw_df, text, number):
    got = raw_df([raw_row("a", total=text, monthly=44.0)]).transform(C.coerce_total_charges)
    assert got.first()["TotalCharges"] == number
    assert got.transform(C.impute_total_charges).first()["TotalCharges"] == (44.0 if number is None else number)


def test_constant_and_single_value_histograms(spark):
    one = spark.createDataFrame([(50.0, 1), (50.0, 0), (50.0, 1), (None, 0)], "MonthlyCharges double, Churn int")
    got = {(r["bin"], r["status"]): r["customers"] for r in H.charges_histogram(one).collect()}
    assert got[(0, "Churned")] == 2 and got[(0, "Retained")] == 1
    assert H.charges_histogram(one.limit(0)).count() == 0


def test_auc_of_counts_beyond_a_bigint(spark, monkeypatch):
    """Products of counts of some 1e11 rows pass 64 bits; the counts stand in for rows."""
    counts = spark.createDataFrame([("m", 0.2, 10**10, 6 * 10**10), ("m", 0.5, 2 * 10**10, 3 * 10**10), ("m", 0.9, 7 * 10**10, 10**10)],
                                   "model string, p double, pos long, neg long")
    monkeypatch.setattr(EV, "score_groups", lambda scores: scores)
    got = EV.auc(counts).first()
    below, pairs = 0, 0.0
    for _, _, pos, neg in counts.orderBy("p").collect():
        pairs += pos * (below + neg / 2)
        below += neg
    assert math.isclose(got["auc"], pairs / (got["n_pos"] * got["n_neg"]), rel_tol=1e-12)


def test_running_groups_are_not_shuffled_by_group(spark):
    s = spark.range(200).selectExpr("concat('m', id % 2) AS model", "id / 200.0D AS p", "CAST(id % 3 = 0 AS int) AS label")
    plan = EV._cumulative_desc(s)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_class_weights_read_the_rows_once(spark):
    df = spark.createDataFrame([("a", 1), ("b", 0), ("c", 0), ("d", 0)], "customerID string, Churn int")
    w = {r["Churn"]: (r["weight"], r["scale_pos_weight"]) for r in SP.class_weights(df).collect()}
    assert w == {1: (2.0, 3.0), 0: (4 / 6, 3.0)}
    assert SP.class_weights(df)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
    only = SP.class_weights(df.where("Churn = 0")).first()
    assert only["weight"] == 0.5 and only["scale_pos_weight"] is None


def test_folds_fit_by_their_own_rows(spark, monkeypatch):
    """Penalty and class weights of a fold's fit come from the rows that it sees."""
    feats = L.features(spark, SF_SMALL)
    split = SP.stratified_split(L.cleaned(spark, SF_SMALL))
    cols, seen = FE.model_columns(feats), []
    real = T.build_pipelines
    monkeypatch.setattr(T, "build_pipelines", lambda c, n, p: seen.append(n) or real(c, n, p))
    T.train_all(feats, split, cols, T.Profile(rf_trees=2, gbt_rounds=1, lr_max_iter=5, cv_folds=3), models=["logistic"])
    n = split.where("split = 'train'").count()
    folds = [n - r["count"] for r in split.where("split = 'train'").groupBy(SP.fold_of(3)).count().collect()]
    assert sorted(seen) == sorted([*folds, n])


def test_rows_without_a_model_input_are_left_out_and_listed(spark):
    feats = L.features(spark, SF_SMALL)
    cols = FE.model_columns(feats)
    gone = feats.limit(1).first()["customerID"]
    holed = feats.withColumn("tenure", F.when(F.col("customerID") != gone, F.col("tenure"))).cache()
    train = T.weighted(feats).withColumn("fold", F.lit(0))
    model = T.build_pipelines(cols, feats.count(), T.Profile(lr_max_iter=20))["logistic"].fit(train)
    scored = S.score_model(model, holed, 0.5, "logistic")
    assert scored.count() == feats.count() - 1
    assert not math.isnan(scored.agg(F.sum("revenue_at_risk")).first()[0])
    assert [(r["customerID"], r["missing"]) for r in S.rejected(holed, cols).collect()] == [(gone, ["tenure"])]
    raw = L.raw(spark, SF_SMALL).withColumn("tenure", F.when(F.col("customerID") != gone, F.col("tenure")))
    stream = SV.score_arrivals(raw, model, 0.5, 60.0, cols)
    assert stream.count() == feats.count() - 1


def test_pack_runs_as_sql_on_a_view(spark):
    view = C.sql_view(L.raw(spark, SF_SMALL))
    sqlpack.create_customers_view(view)
    got = spark.sql("SELECT count(*) AS n, sum(CASE WHEN Churn = 'Yes' THEN 1 ELSE 0 END) AS churned FROM customers").first()
    want = sqlpack.overall_churn(view).first()
    assert (got["n"], got["churned"]) == (want["total_customers"], want["churned"])
