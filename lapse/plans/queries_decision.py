"""Registered queries: scoring, segmentation, budget decisions (fixture scores, threshold 0.54)."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.config import PIPELINE_BUDGETS, SIMULATOR_BUDGETS
from lapse.functions.columns import round_half_up as rh
from lapse.operators import budget as B
from lapse.operators import cohorts as CO
from lapse.operators import scoring as S
from lapse.operators import segments as SG
from lapse.operators import serving as SV
from lapse.plans import layers as L
from lapse.plans.registry import register


def _r(expr: str, d: int = 2) -> str:
    return f"cast(floor(({expr}) * {10 ** d}.0 + 0.5) / {10 ** d}.0 as double)"


_SCORE_COLS = ["customerID", "churn_probability", "churn_predicted", "revenue_at_risk", "risk_rank", "scoring_model",
               "risk_tier", "value_tier", "segment_label", "segment_priority", "recommended_action", "segment_color"]

# ---------------------------------------------------------------- G2-G8: the scored layer
register("g02_churn_predicted", "select customerID, churn_probability, churn_predicted from scored")(
    lambda spark, sf: L.scored(spark, sf).select("customerID", "churn_probability", "churn_predicted"))
register("g03_revenue_at_risk", "select customerID, MonthlyCharges, revenue_at_risk from scored")(
    lambda spark, sf: L.scored(spark, sf).select("customerID", "MonthlyCharges", "revenue_at_risk"))
register("g04_risk_rank", "select customerID, revenue_at_risk, risk_rank from scored")(
    lambda spark, sf: L.scored(spark, sf).select("customerID", "revenue_at_risk", "risk_rank"))
register("g05_scored_customers", f"select {', '.join(_SCORE_COLS)} from scored")(
    lambda spark, sf: L.scored(spark, sf).select(*_SCORE_COLS))
register("g06_score_summary", f"""
select count(*) as total_customers, cast(sum(churn_predicted) as bigint) as high_risk_customers,
  cast(sum(churn_predicted) as double) / count(*) as high_risk_share, {_r('sum(revenue_at_risk)')} as total_revenue_at_risk,
  avg(Churn) as actual_churn_rate,
  cast(sum(case when segment_label = 'Save Immediately' then 1 else 0 end) as bigint) as save_immediately_customers
from scored""")(lambda spark, sf: S.score_summary(L.scored(spark, sf))
                .withColumn("total_revenue_at_risk", rh("total_revenue_at_risk")))
register("g07_risk_value_tiers", "select customerID, churn_predicted, MonthlyCharges, risk_tier, value_tier from scored")(
    lambda spark, sf: L.scored(spark, sf).select("customerID", "churn_predicted", "MonthlyCharges", "risk_tier",
                                                 "value_tier"))
register("g08_segment_lookup", """
select customerID, segment_label, segment_priority, recommended_action, segment_color from scored""")(
    lambda spark, sf: L.scored(spark, sf).select("customerID", "segment_label", "segment_priority",
                                                 "recommended_action", "segment_color"))

# ---------------------------------------------------------------- G9-G15 segment reports
register("g09_segment_summary", f"""
select segment_label, segment_priority, segment_color, count(customerID) as customers,
  {_r('avg(churn_probability)')} as avg_churn_prob, {_r('sum(revenue_at_risk)')} as total_revenue_at_risk,
  {_r('avg(MonthlyCharges)')} as avg_monthly_charges, {_r('quantile_cont(tenure, 0.5)')} as median_tenure
from scored group by 1, 2, 3""")(lambda spark, sf: SG.segment_summary(L.scored(spark, sf)))
register("g10_risk_value_matrix", f"""
select segment_label, risk_tier, value_tier, segment_color, count(customerID) as customers,
  {_r('avg(churn_probability)', 6)} as avg_churn_prob, {_r('sum(revenue_at_risk)')} as total_revenue_at_risk
from scored group by 1, 2, 3, 4""")(
    lambda spark, sf: SG.risk_value_matrix(L.scored(spark, sf)).select(
        "segment_label", "risk_tier", "value_tier", "segment_color", "customers",
        rh("avg_churn_prob", 6).alias("avg_churn_prob"), rh("total_revenue_at_risk").alias("total_revenue_at_risk")))
register("g11_actual_churn_by_segment", """
select segment_label, avg(Churn) as actual_churn_rate, count(customerID) as customers from scored group by 1""")(
    lambda spark, sf: SG.actual_churn_by_segment(L.scored(spark, sf)))
register("g12_segment_exposure", f"""
select segment_label, {_r('sum(revenue_at_risk)')} as revenue_at_risk,
  {_r('sum(revenue_at_risk) / (select sum(revenue_at_risk) from scored)', 6)} as share_of_exposure
from scored group by 1""")(
    lambda spark, sf: SG.segment_exposure(L.scored(spark, sf)).select(
        "segment_label", rh("revenue_at_risk").alias("revenue_at_risk"),
        rh("share_of_exposure", 6).alias("share_of_exposure")))
register("g13_top_customers", """
select customerID, segment_label, churn_probability, MonthlyCharges, revenue_at_risk from scored
order by revenue_at_risk desc, customerID limit 10""")(
    lambda spark, sf: SG.top_customers(L.scored(spark, sf), 10)
    .select("customerID", "segment_label", "churn_probability", "MonthlyCharges", "revenue_at_risk"))
register("g13_top_per_segment", """
select customerID, segment_label, revenue_at_risk,
  row_number() over (partition by segment_label order by revenue_at_risk desc, customerID) as segment_rank
from scored qualify segment_rank <= 20""")(
    lambda spark, sf: SG.top_customers(L.scored(spark, sf), 20, per_segment=True)
    .select("customerID", "segment_label", "revenue_at_risk", F.col("segment_rank").cast("bigint")))
register("g14_segment_kpis", f"""
select segment_label, count(customerID) as customers, {_r('avg(churn_probability)', 6)} as avg_churn_prob,
  {_r('sum(revenue_at_risk)')} as total_revenue_at_risk, quantile_cont(MonthlyCharges, 0.5) as median_monthly_charges
from scored group by 1""")(
    lambda spark, sf: SG.segment_kpis(L.scored(spark, sf)).select(
        "segment_label", "customers", rh("avg_churn_prob", 6).alias("avg_churn_prob"),
        rh("total_revenue_at_risk").alias("total_revenue_at_risk"), "median_monthly_charges"))
register("g15_segment_histogram", """
, seg as (select * from scored where segment_label = 'Save Immediately'),
mm as (select min(MonthlyCharges) as lo, max(MonthlyCharges) as hi from seg),
b as (select least(cast(floor((MonthlyCharges - lo) / ((hi - lo) / 30.0)) as integer), 29) as bin,
             case when Churn = 1 then 'Churned' else 'Retained' end as status, lo, hi from seg, mm)
select bin, status, count(*) as customers,
  lo + bin * ((hi - lo) / 30.0) as bin_start, lo + (bin + 1) * ((hi - lo) / 30.0) as bin_end
from b group by bin, status, lo, hi""".replace("\n, seg", ", seg", 1))(
    lambda spark, sf: CO.charges_histogram(L.scored(spark, sf).where(F.col("segment_label") == "Save Immediately"), 30))

# ---------------------------------------------------------------- G18-G24 budget decisions
_ROI = """, roi as (select *, MonthlyCharges * churn_probability * cast(0.3 as double) * cast(12 as double) as expected_save_value
  from scored),
roi2 as (select *, expected_save_value / cast(50 as double) as roi_score from roi)"""

register("g18_compute_roi", _ROI.replace("\n, roi", ", roi", 1) + """
select customerID, expected_save_value, roi_score,
  cast(row_number() over (order by roi_score desc, customerID) as integer) as roi_rank from roi2""")(
    lambda spark, sf: B.roi_ranked(L.scored(spark, sf)).select("customerID", "expected_save_value", "roi_score",
                                                                 "roi_rank"))


def _targets_sql(n: int, seg: str | None = None) -> str:
    where = f"where segment_label = '{seg}'" if seg else ""
    return (_ROI.replace("\n, roi", ", roi", 1) + f"""
select customerID, segment_label, churn_probability, MonthlyCharges, revenue_at_risk, expected_save_value, roi_score,
  recommended_action, cast(row_number() over (order by roi_score desc, customerID) as integer) as roi_rank,
  row_number() over (order by roi_score desc, customerID) * cast(50 as double) as cumulative_cost
from roi2 {where} qualify roi_rank <= {n}""")


_T_COLS = ["customerID", "segment_label", "churn_probability", "MonthlyCharges", "revenue_at_risk",
           "expected_save_value", "roi_score", "recommended_action", "roi_rank", "cumulative_cost"]
register("g19_allocate_targets", _targets_sql(100))(
    lambda spark, sf: B.allocate_budget(L.scored(spark, sf), 5000.0)[0].select(*_T_COLS)
    .withColumn("roi_rank", F.col("roi_rank").cast("int")))
register("g19_allocate_targets_segment", _targets_sql(40, "Assess & Offer"))(
    lambda spark, sf: B.allocate_budget(L.scored(spark, sf), 2000.0, segment_filter="Assess & Offer")[0]
    .select(*_T_COLS).withColumn("roi_rank", F.col("roi_rank").cast("int")))


def _summary_sql(n: int, budget: float) -> str:
    return (_targets_sql(n) + "\n").replace("select customerID, segment_label", ", t as (select customerID, segment_label", 1) \
        .replace(f"qualify roi_rank <= {n}", f"qualify roi_rank <= {n})") + f"""
select cast({budget!r} as double) as budget, count(*) as n_targeted, count(*) * cast(50 as double) as total_cost,
  {_r('coalesce(sum(expected_save_value), 0)')} as expected_revenue_saved,
  {_r('(select sum(revenue_at_risk) from scored)')} as do_nothing_revenue_loss,
  {_r('coalesce(sum(expected_save_value), 0) / (count(*) * cast(50 as double))', 4)} as roi_multiple,
  {_r('coalesce(sum(expected_save_value), 0) / (select sum(revenue_at_risk) from scored)', 4)} as pct_risk_covered,
  {_r('coalesce(sum(expected_save_value), 0) / ((select sum(revenue_at_risk) from scored) * 12)', 4)} as pct_risk_covered_horizon
from t"""


def _summary_spark(spark, sf, budget):
    s = B.allocate_budget(L.scored(spark, sf), budget)[1]
    return s.select("budget", "n_targeted", "total_cost", rh("expected_revenue_saved").alias("expected_revenue_saved"),
                    rh("do_nothing_revenue_loss").alias("do_nothing_revenue_loss"),
                    rh("roi_multiple", 4).alias("roi_multiple"), rh("pct_risk_covered", 4).alias("pct_risk_covered"),
                    rh("pct_risk_covered_horizon", 4).alias("pct_risk_covered_horizon"))


register("g19_allocate_summary", _summary_sql(100, 5000.0))(lambda spark, sf: _summary_spark(spark, sf, 5000.0))

register("g20_impact_curve", _ROI.replace("\n, roi", ", roi", 1) + f"""
, rk as (select expected_save_value, row_number() over (order by roi_score desc, customerID) as r from roi2),
grid as (select cast(k * 500.0 as double) as budget, cast(floor(k * 500.0 / 50.0) as integer) as n from range(0, 101) t(k))
select budget, {_r('coalesce((select sum(expected_save_value) from rk where r <= grid.n), 0)')} as expected_revenue_saved,
  n as n_customers from grid""")(
    lambda spark, sf: B.impact_curve(L.scored(spark, sf)).select(
        "budget", rh("expected_revenue_saved").alias("expected_revenue_saved"), "n_customers"))

register("g21_segment_roi", _ROI.replace("\n, roi", ", roi", 1) + f"""
select segment_label, {_r('avg(roi_score)', 6)} as roi_score from roi2 group by 1""")(
    lambda spark, sf: B.segment_roi(L.scored(spark, sf)).select("segment_label", rh("roi_score", 6).alias("roi_score")))

register("g22_act_vs_nothing", _summary_sql(100, 5000.0).replace(
    "\nselect cast(5000.0 as double) as budget,", "\n, s as (select cast(5000.0 as double) as budget,").rstrip()
    + f""")
select budget, expected_revenue_saved, do_nothing_revenue_loss as do_nothing_monthly,
  {_r('do_nothing_revenue_loss - expected_revenue_saved')} as with_budget_monthly_bar,
  {_r('do_nothing_revenue_loss * 12')} as do_nothing_horizon,
  {_r('do_nothing_revenue_loss * 12 - expected_revenue_saved')} as with_budget_horizon from s""")(
    lambda spark, sf: B.act_vs_nothing(_summary_spark(spark, sf, 5000.0)).select(
        "budget", "expected_revenue_saved", "do_nothing_monthly",
        rh("with_budget_monthly_bar").alias("with_budget_monthly_bar"),
        rh("do_nothing_horizon").alias("do_nothing_horizon"), rh("with_budget_horizon").alias("with_budget_horizon")))

_GRID_BUDGETS = sorted(set(PIPELINE_BUDGETS + SIMULATOR_BUDGETS))
_GRID_COSTS, _GRID_RATES, _GRID_MONTHS = [50.0, 75.0], [0.2, 0.3], [12, 24]


def _scenario_sql() -> str:
    vals = ", ".join(f"({float(b)!r}, {c!r}, {r!r}, {m}, {int(b // c)})"
                     for b in _GRID_BUDGETS for c in _GRID_COSTS for r in _GRID_RATES for m in _GRID_MONTHS)
    return f"""
, rk as (select MonthlyCharges * churn_probability as base,
           row_number() over (order by MonthlyCharges * churn_probability desc, customerID) as r from scored),
g as (select * from (values {vals}) t(budget, intervention_cost, save_rate, lifetime_months, n)),
s as (select g.*, (select count(*) from rk where r <= g.n) as n_targeted,
             coalesce((select sum(base) from rk where r <= g.n), 0) * save_rate * lifetime_months as saved from g)
select cast(budget as double) as budget, cast(intervention_cost as double) as intervention_cost,
  cast(save_rate as double) as save_rate, cast(lifetime_months as integer) as lifetime_months, n_targeted,
  n_targeted * cast(intervention_cost as double) as total_cost, {_r('saved')} as expected_revenue_saved,
  {_r('(select sum(revenue_at_risk) from scored)')} as do_nothing_revenue_loss,
  {_r('case when n_targeted > 0 then saved / (n_targeted * intervention_cost) else 0 end', 4)} as roi_multiple,
  {_r('saved / (select sum(revenue_at_risk) from scored)', 4)} as pct_risk_covered
from s""".replace("\n, rk", ", rk", 1)


register("g23_budget_scenarios", _scenario_sql())(
    lambda spark, sf: B.budget_scenarios(L.scored(spark, sf), _GRID_BUDGETS, _GRID_COSTS, _GRID_RATES, _GRID_MONTHS)
    .select("budget", "intervention_cost", "save_rate", "lifetime_months", "n_targeted", "total_cost",
            rh("expected_revenue_saved").alias("expected_revenue_saved"),
            rh("do_nothing_revenue_loss").alias("do_nothing_revenue_loss"),
            rh("roi_multiple", 4).alias("roi_multiple"), rh("pct_risk_covered", 4).alias("pct_risk_covered")))

register("g24_business_summary", f"""
select count(*) as customers, avg(Churn) as actual_churn_rate, cast(sum(churn_predicted) as bigint) as predicted_at_risk,
  cast(sum(churn_predicted) as double) / count(*) as predicted_at_risk_share,
  {_r('sum(revenue_at_risk)')} as monthly_revenue_at_risk,
  {_r("sum(case when segment_label = 'Save Immediately' then revenue_at_risk else 0 end)")} as top_segment_revenue_at_risk,
  {_r("sum(case when segment_label = 'Save Immediately' then revenue_at_risk else 0 end) / sum(revenue_at_risk)", 6)} as top_segment_share
from scored""")(
    lambda spark, sf: B.business_summary(L.scored(spark, sf)).select(
        "customers", "actual_churn_rate", "predicted_at_risk", "predicted_at_risk_share",
        rh("monthly_revenue_at_risk").alias("monthly_revenue_at_risk"),
        rh("top_segment_revenue_at_risk").alias("top_segment_revenue_at_risk"),
        rh("top_segment_share", 6).alias("top_segment_share")))

# ---------------------------------------------------------------- G26, G27
_FLAG_SQL = """[case when Contract = 'Month-to-month' then 'Month-to-month contract' end,
  case when tenure < 12 then 'Short tenure (< 12 months)' end,
  case when InternetService = 'Fiber optic' then 'Fiber optic internet' end,
  case when PaymentMethod = 'Electronic check' then 'Electronic check payment' end,
  case when OnlineSecurity = 'No' and InternetService <> 'No' then 'No online security' end,
  case when TechSupport = 'No' and InternetService <> 'No' then 'No tech support' end,
  case when MonthlyCharges >= med then 'High monthly charges' end,
  case when not contains(lower(PaymentMethod), 'automatic') then 'Not on auto-pay' end]"""
_INV_SQL = _FLAG_SQL.replace("case when ", "case when not coalesce(").replace(" then '", ", false) then '")
register("g26_risk_factors", f"""
, m as (select quantile_cont(MonthlyCharges, 0.5) as med from cleaned)
select customerID,
  array_to_string(list_filter({_FLAG_SQL}, lambda x: x is not null), '; ') as risk_factors,
  array_to_string(list_transform(list_slice(list_filter({_INV_SQL}, lambda x: x is not null), 1, 5),
                  lambda x: 'No ' || lower(x)), '; ') as protective_factors
from cleaned, m""".replace("\n, m", ", m", 1))(lambda spark, sf: SV.risk_factors(L.cleaned(spark, sf)))

register("g27_segments_present", "select distinct segment_label from scored")(
    lambda spark, sf: SG.segments_present(L.scored(spark, sf)))
register("g27_customer_ids_segment", "select customerID from scored where segment_label = 'Nurture & Upsell'")(
    lambda spark, sf: SG.segment_ids(L.scored(spark, sf), "Nurture & Upsell"))

# ---------------------------------------------------------------- G16, G17
from lapse.operators import profile as PR  # noqa: E402
from lapse.operators import similar as SIM  # noqa: E402

register("g17_similar_customers", """
select q.customerID, s.customerID as similar_id,
  row_number() over (partition by q.customerID order by s.revenue_at_risk desc, s.customerID) as similar_rank,
  s.churn_probability, s.MonthlyCharges, s.revenue_at_risk
from scored q join scored s on s.segment_label = q.segment_label and s.customerID <> q.customerID
  and s.MonthlyCharges between q.MonthlyCharges * 0.85::double and q.MonthlyCharges * 1.15::double
qualify similar_rank <= 8""")(
    lambda spark, sf: SIM.similar_customers(L.scored(spark, sf)).withColumn("similar_rank",
                                                                            F.col("similar_rank").cast("bigint")))


def _profile_sql() -> str:
    from lapse.plans.layers import DISPLAY_SCORE_COLS

    def txt(f):
        if f in PR.PCT_FIELDS:
            return f"printf('%.1f%%', cast(floor(({f}) * 100.0 * 10.0 + 0.5) / 10.0 as double))"
        if f in PR.MONEY_FIELDS:
            return f"'$' || format('{{:,.2f}}', cast(floor(({f}) * 100.0 + 0.5) / 100.0 as double))"
        return f"cast({f} as varchar)"
    parts = [f"select customerID, '{g}' as profile_group, '{PR.attribute_label(f)}' as attribute, "
             f"coalesce({txt(f)}, '—') as value from display"
             for g, fields in PR.PROFILE_GROUPS for f in fields]
    disp = (", display as (select c.*, " + ", ".join("s." + x for x in DISPLAY_SCORE_COLS)
            + " from cleaned c left join scored s using (customerID))\n")
    return disp + "\nunion all\n".join(parts)


register("g16_customer_profile", _profile_sql())(lambda spark, sf: PR.customer_profile(L.display(spark, sf)))
