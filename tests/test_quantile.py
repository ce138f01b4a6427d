"""Exact grouped quantiles against Spark's `percentile`, bit for bit."""

import math
import random

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from lapse.operators import cohorts as CO
from lapse.operators import quantile as Q
from lapse.operators import segments as SG
from lapse.plans import layers as L

PROBS = (0.0, 0.25, 0.5, 0.9, 1.0)


def same(df, groups, col, probs=PROBS, **more):
    got = {tuple(r)[: len(groups)]: [repr(x) for x in tuple(r)[len(groups):]] for r in Q.grouped_quantiles(df, groups, col, probs, **more).collect()}
    want = df.groupBy(*groups).agg(*[F.percentile(col, F.lit(p)).alias(f"q{i}") for i, p in enumerate(probs)])
    want = {tuple(r)[: len(groups)]: [repr(x) for x in tuple(r)[len(groups):]] for r in want.collect() if r["q0"] is not None}
    assert got == want
    return got


@pytest.mark.parametrize("buckets", [2, 7, 1024])
def test_equals_percentile_for_any_number_of_buckets(spark, buckets):
    rnd = random.Random(buckets)
    values = [0.0, 0.1, 1 / 3, 1e300, -1e300, 5e-324, 2.0, 2.0, 2.0000000000000004]
    rows = [(rnd.choice(["a", "b", "c", None]), rnd.choice([*values, rnd.uniform(-5, 5), None])) for _ in range(300)]
    rows += [("one", 4.5), ("nulls", None), ("nulls", None), ("same", 7.0), ("same", 7.0)]
    got = same(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", buckets=buckets)
    assert ("nulls",) not in got and len(got) == 6


def test_infinities_and_nan_have_their_places(spark):
    inf = math.inf
    rows = [("x", v) for v in (-inf, -inf, 1.0, 2.0, inf, math.nan, math.nan)] + [("y", inf), ("y", inf), ("z", math.nan)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["q0"], r["q1"], r["q2"]) for r in Q.grouped_quantiles(df, ["g"], "v", (0.0, 0.5, 4 / 6)).collect()}
    assert got["x"] == (-inf, 2.0, inf) and got["y"] == (inf, inf, inf) and math.isnan(got["z"][0])


def test_whole_table_several_groups_and_empty_table(spark):
    df = L.scored(spark, SF_SMALL)
    same(df, ["segment_label", "tenure_band"], "MonthlyCharges")
    one = Q.grouped_quantiles(df, [], "MonthlyCharges").first()[0]
    assert repr(one) == repr(df.select(F.median("MonthlyCharges")).first()[0])
    assert Q.grouped_quantiles(df.limit(0), ["segment_label"], "tenure").count() == 0


def test_reports_use_it_and_agree_with_median(spark):
    cleaned, scored = L.cleaned(spark, SF_SMALL), L.scored(spark, SF_SMALL)
    for got, df, by, col, name in ((CO.revenue_lifecycle(cleaned), cleaned, "tenure", "MonthlyCharges", "median_charge"),
                                   (SG.segment_kpis(scored), scored, "segment_label", "MonthlyCharges", "median_monthly_charges")):
        want = {r[0]: r[1] for r in df.groupBy(by).agg(F.median(col)).collect()}
        assert {r[by]: r[name] for r in got.collect()} == want
        assert "median" not in got._jdf.queryExecution().optimizedPlan().toString().replace(name, "")


def test_a_pivot_over_too_many_values_is_refused(spark):
    df = L.analysis(spark, SF_SMALL).withColumn("many", F.monotonically_increasing_id())
    with pytest.raises(ValueError, match="more than 20 values"):
        limit, CO.PIVOT_COLUMNS = CO.PIVOT_COLUMNS, 20
        try:
            CO.churn_heatmap(df, "many", "tenure_band")
        finally:
            CO.PIVOT_COLUMNS = limit
    assert CO.churn_heatmap(df.withColumn("few", F.col("tenure") % 3), "few", "tenure_band").columns == ["tenure_band", "0", "1", "2"]
