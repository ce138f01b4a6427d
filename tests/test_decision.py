"""Scoring, segmentation, budget and similar-customer invariants."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lapse.operators import budget as B
from lapse.operators import segments as SG
from lapse.operators.similar import similar_customers
from lapse.plans import layers as L

VALID = {"Save Immediately", "Assess & Offer", "Nurture & Upsell", "Monitor Only"}


def test_scored_invariants(spark):
    s = L.scored(spark, SF_SMALL).cache()
    n = s.count()
    assert s.where(~F.col("churn_probability").between(0, 1)).count() == 0
    assert s.select("risk_rank").distinct().count() == n
    assert s.agg(F.min("risk_rank"), F.max("risk_rank")).first() == (1, n)
    assert {r[0] for r in s.select("segment_label").distinct().collect()} <= VALID
    assert s.where(F.col("recommended_action").isNull()).count() == 0
    assert s.where(F.col("revenue_at_risk") < 0).count() == 0
    means = {r[0]: r[1] for r in s.groupBy("segment_label").agg(F.avg("churn_probability")).collect()}
    assert means["Save Immediately"] > means["Monitor Only"]


def test_budget_5000_targets_exactly_100(spark):
    s = L.scored(spark, SF_SMALL)
    targets, summary = B.allocate_budget(s, budget=5000.0)
    r = summary.first()
    assert r["n_targeted"] == 100 and r["expected_revenue_saved"] > 0 and r["roi_multiple"] > 0
    t = targets.orderBy("roi_rank").toPandas()
    assert list(t.roi_rank) == list(range(1, 101))
    assert (t.roi_score.diff().dropna() <= 0).all()


def test_budget_edges(spark):
    s = L.scored(spark, SF_SMALL)
    n_rows = s.count()
    for budget, expected in [(0.0, 0), (49.0, 0), (10_000_000.0, n_rows)]:
        assert B.allocate_budget(s, budget=budget)[1].first()["n_targeted"] == expected
    empty = B.allocate_budget(s, budget=5000.0, segment_filter="No such segment")[1].first()
    assert empty["n_targeted"] == 0 and empty["roi_multiple"] == 0.0


def test_scenarios_agree_with_allocation(spark):
    s = L.scored(spark, SF_SMALL).cache()
    grid = {r["budget"]: r for r in B.budget_scenarios(s, [1000.0, 2500.0, 5000.0]).collect()}
    for b in [1000.0, 2500.0, 5000.0]:
        one = B.allocate_budget(s, budget=b)[1].first()
        assert grid[b]["n_targeted"] == one["n_targeted"]
        assert abs(grid[b]["expected_revenue_saved"] - one["expected_revenue_saved"]) < 1e-6


def test_impact_curve_monotone(spark):
    curve = B.impact_curve(L.scored(spark, SF_SMALL), max_budget=10_000, step=500).orderBy("budget").toPandas()
    assert len(curve) == 21 and curve.expected_revenue_saved.iloc[0] == 0.0
    assert (curve.expected_revenue_saved.diff().dropna() >= -1e-9).all()


def test_top_per_segment(spark):
    s = L.scored(spark, SF_SMALL)
    top = SG.top_customers(s, 5, per_segment=True).toPandas()
    assert top.groupby("segment_label").size().max() <= 5


def _brute_similar(pdf, k=8):
    out = []
    for _, q in pdf.iterrows():
        c = q.MonthlyCharges
        cand = pdf[(pdf.segment_label == q.segment_label) & (pdf.customerID != q.customerID)
                   & (pdf.MonthlyCharges >= c * 0.85) & (pdf.MonthlyCharges <= c * 1.15)]
        cand = cand.sort_values(["revenue_at_risk", "customerID"], ascending=[False, True]).head(k)
        out += [(q.customerID, cid) for cid in cand.customerID]
    return sorted(out)


def test_similar_customers_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 300
    # a hot segment and many repeated charges
    pdf = pd.DataFrame({
        "customerID": [f"c{i:03d}" for i in range(n)],
        "segment_label": np.where(rng.random(n) < 0.6, "Hot", rng.choice(["A", "B"], n)),
        "MonthlyCharges": rng.choice(np.round(rng.uniform(20, 110, 40), 2), n),
        "revenue_at_risk": np.round(rng.uniform(0, 50, n), 1),
        "churn_probability": rng.random(n),
    })
    got = similar_customers(spark.createDataFrame(pdf)).select("customerID", "similar_id").toPandas()
    assert sorted(map(tuple, got.to_numpy())) == _brute_similar(pdf)


def test_roi_ties_broken_by_customer_id(spark):
    rows = [(f"c{i}", 60.0, 0.5, 30.0, "Save Immediately") for i in range(6)]
    df = spark.createDataFrame(rows, "customerID string, MonthlyCharges double, churn_probability double, "
                                     "revenue_at_risk double, segment_label string")
    targets, summary = B.allocate_budget(df, budget=150.0)
    got = [r["customerID"] for r in targets.orderBy("roi_rank").collect()]
    assert got == ["c0", "c1", "c2"]
    assert summary.first()["n_targeted"] == 3


def test_empty_segment_reports(spark):
    s = L.scored(spark, SF_SMALL).where(F.col("segment_label") == "nothing")
    assert SG.segment_summary(s).count() == 0
    assert B.budget_scenarios(s, [5000.0]).first()["n_targeted"] == 0


def test_top_n_by_roi_is_brute_force(spark):
    """One plan for every n: rows and ranks equal a full sort, from few rows to more than there are."""
    roi = B.compute_roi(L.scored(spark, SF_SMALL)).select("customerID", "roi_score")
    want = sorted(((r["customerID"], r["roi_score"]) for r in roi.collect()), key=lambda x: (-x[1], x[0]))
    for n in (1, 37, len(want), len(want) + 5):
        got = [(r["customerID"], r["roi_rank"]) for r in B.top_n_by_roi(roi, n).orderBy("roi_rank").collect()]
        assert got == [(i, k + 1) for k, (i, _) in enumerate(want[:n])]


def test_top_n_plan_starts_no_job(spark):
    from lapse.operators import ordered as O
    s = L.scored(spark, SF_SMALL)
    sc = spark.sparkContext
    sc.setJobGroup("plan-only", "top_n")
    for n in (10, 5_000_000):
        O.top_n(s, [F.col("revenue_at_risk").desc(), F.col("customerID")], n, "customerID")
    assert not sc.statusTracker().getJobIdsForGroup("plan-only")
    sc.setLocalProperty("spark.jobGroup.id", None)


def test_similar_customers_window_edges(spark):
    """Charges on and just past the inclusive +-15 % edges, repeated values, a one-row segment."""
    charges = [100.0, 85.0, 115.0, 84.99, 115.01, 100.0, 20.0, 17.0, 23.0, 23.01, 40.0]
    pdf = pd.DataFrame({
        "customerID": [f"e{i:02d}" for i in range(len(charges))] + ["solo"],
        "segment_label": ["S"] * len(charges) + ["Lonely"],
        "MonthlyCharges": charges + [50.0],
        "revenue_at_risk": [5.0, 5.0, 1.0, 9.0, 9.0, 5.0, 2.0, 2.0, 3.0, 3.0, 4.0, 7.0],
        "churn_probability": [0.5] * (len(charges) + 1),
    })
    got = similar_customers(spark.createDataFrame(pdf), k=3).select("customerID", "similar_id").toPandas()
    assert sorted(map(tuple, got.to_numpy())) == _brute_similar(pdf, k=3)
    assert "solo" not in set(got.customerID)


def test_similar_customers_property(spark):
    """Random skew, repeated charges, heavy ties and k: the range top-k equals brute force."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
    @given(seed=st.integers(0, 10_000), n=st.integers(1, 120), n_charges=st.integers(1, 30), k=st.integers(1, 6),
           hot=st.floats(0.0, 0.9))
    def check(seed, n, n_charges, k, hot):
        rng = np.random.default_rng(seed)
        pdf = pd.DataFrame({
            "customerID": [f"p{i:03d}" for i in range(n)],
            "segment_label": np.where(rng.random(n) < hot, "Hot", rng.choice(["A", "B", "C"], n)),
            "MonthlyCharges": rng.choice(np.round(rng.uniform(10, 60, n_charges), 2), n),
            "revenue_at_risk": rng.integers(0, 4, n).astype(float),
            "churn_probability": rng.random(n),
        })
        got = similar_customers(spark.createDataFrame(pdf), k=k).select("customerID", "similar_id").toPandas()
        assert sorted(map(tuple, got.to_numpy())) == _brute_similar(pdf, k=k)

    check()


def test_top_n_sample_and_customers_are_brute_force(spark):
    from lapse.operators import split as SP
    feats, s = L.features(spark, SF_SMALL), L.scored(spark, SF_SMALL)
    keyed = sorted((r[0], r[1]) for r in feats.select(SP.seeded_key(), "customerID").collect())
    assert sorted(r[0] for r in SP.seeded_sample(feats, 40).select("customerID").collect()) == sorted(i for _, i in keyed[:40])
    ranked = sorted((-r["revenue_at_risk"], r["customerID"]) for r in s.select("customerID", "revenue_at_risk").collect())
    got = [r["customerID"] for r in SG.top_customers(s, 12).select("customerID", "revenue_at_risk").collect()]
    assert got == [i for _, i in ranked[:12]]


def test_report_tables_are_sorted(spark):
    s = L.scored(spark, SF_SMALL)
    order = [r["segment_priority"] for r in SG.segment_summary(s).collect()]
    assert order == sorted(order)
    rates = [r["actual_churn_rate"] for r in SG.actual_churn_by_segment(s).collect()]
    assert rates == sorted(rates, reverse=True)
    exposure = [r["revenue_at_risk"] for r in SG.segment_exposure(s).collect()]
    assert exposure == sorted(exposure, reverse=True)
