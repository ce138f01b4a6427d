"""Registered queries: split, threshold tuning, evaluation curves and metrics, holdout, display view.

Scores are the deterministic fixture scorers (`model_scores`: fixture and
planted), so every evaluation operator is checked against SQL without ML.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.functions.columns import round_half_up as rh
from lapse.operators import evaluate as EV
from lapse.operators import split as SP
from lapse.plans import layers as L
from lapse.plans.registry import register


def _r(expr: str, d: int = 2) -> str:
    return f"cast(floor(({expr}) * {10 ** d}.0 + 0.5) / {10 ** d}.0 as double)"


# ---- shared DuckDB CTEs (continue the WITH list)
_SPLIT = """, sp0 as (select customerID, Churn,
    row_number() over (partition by Churn order by md5(customerID || '#42'), customerID) as class_pos,
    count(*) over (partition by Churn) as class_n from cleaned),
sp as (select customerID, Churn, class_pos,
    case when class_pos * 100 <= class_n * 70 then 'train' when class_pos * 100 <= class_n * 85 then 'val'
         else 'test' end as split from sp0),
ms as (select m.*, sp.split from model_scores m join sp using (customerID))"""

_CURVE = """, grid as (select distinct model, cast(i as double) / cast(100 as double) as threshold
    from {src}, range(10, 71) t(i)),
cv as (select g.model, g.threshold,
    cast(sum(case when s.p >= g.threshold and s.label = 1 then 1 else 0 end) as bigint) as tp,
    cast(sum(case when s.p >= g.threshold and s.label = 0 then 1 else 0 end) as bigint) as fp,
    cast(sum(case when s.p < g.threshold and s.label = 1 then 1 else 0 end) as bigint) as fn
    from grid g join {src} s on s.model = g.model group by g.model, g.threshold),
curve as (select model, threshold, tp, fp, fn,
    case when tp + fp > 0 then cast(tp as double) / cast(tp + fp as double) else 0.0 end as precision,
    case when tp + fn > 0 then cast(tp as double) / cast(tp + fn as double) else 0.0 end as recall,
    case when 2 * tp + fp + fn > 0 then cast(2 * tp as double) / cast(2 * tp + fp + fn as double) else 0.0 end as f1
    from cv),
best as (select model, case when f1 > 0 then threshold else 0.5 end as threshold,
    case when f1 > 0 then f1 else 0.0 end as val_f1 from curve
    qualify row_number() over (partition by model order by f1 desc, threshold) = 1)"""


def _val_scores(spark, sf):
    return L.eval_scores(spark, sf)


# ---------------------------------------------------------------- F1, F2, F6, F16
register("f01_stratified_split", _SPLIT + """
select customerID, Churn, split, class_pos from sp""")(
    lambda spark, sf: L.split(spark, sf).withColumn("class_pos", F.col("class_pos").cast("long")))

register("f02_class_weights", _SPLIT + f"""
, tr as (select * from sp where split = 'train')
select Churn, count(*) as n_c, cast((select count(*) from tr) as double) / (2.0 * count(*)) as weight,
  {_r("cast((select count(*) from tr where Churn = 0) as double) / (select count(*) from tr where Churn = 1)")} as scale_pos_weight
from tr group by Churn""")(
    lambda spark, sf: SP.class_weights(
        L.cleaned(spark, sf).join(L.split(spark, sf).where(F.col("split") == "train")
                                  .select("customerID"), "customerID")))

register("f06_cv_folds", _SPLIT + """
select customerID, cast((class_pos - 1) % 5 as integer) as fold from sp where split = 'train'""")(
    lambda spark, sf: SP.cv_folds(L.split(spark, sf)))

register("f16_seeded_sample", """
select customerID, MonthlyCharges, Churn from features order by md5(customerID || '#42'), customerID limit 500""")(
    lambda spark, sf: SP.seeded_sample(L.features(spark, sf), 500).select("customerID", "MonthlyCharges", "Churn"))

# ---------------------------------------------------------------- F7, F8 on the validation split
register("f07_tune_threshold", _SPLIT + "\n, vs as (select * from ms where split = 'val')" + _CURVE.format(src="vs") + """
select model, threshold, val_f1 from best""")(
    lambda spark, sf: EV.tune_threshold(_val_scores(spark, sf).where(F.col("split") == "val")))

register("f08_threshold_curve", _SPLIT + "\n, vs as (select * from ms where split = 'val')" + _CURVE.format(src="vs") + """
select model, threshold, tp, fp, fn, precision, recall, f1 from curve""")(
    lambda spark, sf: EV.threshold_curve(_val_scores(spark, sf).where(F.col("split") == "val")))

# ---------------------------------------------------------------- F9-F13 on the test split
_AUC = """, {n}_g as (select model, p, count(*) as cnt, sum(label) as pos from {src} group by model, p),
{n}_r as (select *, coalesce(sum(cnt) over (partition by model order by p rows between unbounded preceding and 1 preceding), 0) as below
    from {n}_g),
{n}s as (select model, sum(pos) as P, sum(cnt) - sum(pos) as N, sum(pos * (2 * below + cnt + 1)) as S2 from {n}_r group by model),
{n} as (select model, case when P > 0 and N > 0 then cast(S2 - P * (P + 1) as double) / (2.0 * cast(P as double) * cast(N as double)) end as auc
    from {n}s)"""

_TEST = "\n, vs as (select * from ms where split = 'val'), ts as (select * from ms where split = 'test')"


def _test_eval(spark, sf):
    s = _val_scores(spark, sf)
    th = EV.tune_threshold(s.where(F.col("split") == "val"))
    return s.where(F.col("split") == "test"), th


register("f09_metrics_table", _SPLIT + _TEST + _CURVE.format(src="vs") + _AUC.format(src="ts", n="auc") + f"""
, pr as (select ts.model, b.threshold, ts.label, case when ts.p >= b.threshold then 1 else 0 end as pred
    from ts join best b using (model)),
c as (select model, threshold, sum(pred * label) as tp, sum(pred * (1 - label)) as fp,
    sum((1 - pred) * label) as fn, sum((1 - pred) * (1 - label)) as tn from pr group by model, threshold)
select c.model, threshold, {_r('auc', 4)} as roc_auc,
  {_r('case when tp + fp > 0 then cast(tp as double) / cast(tp + fp as double) else 0.0 end', 4)} as precision,
  {_r('case when tp + fn > 0 then cast(tp as double) / cast(tp + fn as double) else 0.0 end', 4)} as recall,
  {_r('case when 2 * tp + fp + fn > 0 then cast(2 * tp as double) / cast(2 * tp + fp + fn as double) else 0.0 end', 4)} as f1,
  {_r('cast(tp + tn as double) / cast(tp + fp + fn + tn as double)', 4)} as accuracy
from c join auc using (model)""")(lambda spark, sf: EV.metrics_table(*_test_eval(spark, sf)))

register("f10_pick_best", _SPLIT + _TEST + _AUC.format(src="ts", n="auc") + f"""
select model, {_r('auc', 4)} as roc_auc from auc order by roc_auc desc, model limit 1""")(
    lambda spark, sf: EV.pick_best(EV.auc(_test_eval(spark, sf)[0]).select("model", rh("auc", 4).alias("roc_auc"))))

register("f09_exact_auc", _SPLIT + _TEST + _AUC.format(src="ts", n="auc") + """
select a.model, a.auc, cast(s.P as bigint) as n_pos, cast(s.N as bigint) as n_neg from auc a join aucs s using (model)""")(
    lambda spark, sf: EV.auc(_test_eval(spark, sf)[0]))

_CUM = """, cg as (select model, p, sum(label) as pos, count(*) - sum(label) as neg from {src} group by model, p),
cum as (select model, p, pos, neg,
    sum(pos) over (partition by model order by p desc rows between unbounded preceding and current row) as cum_pos,
    sum(neg) over (partition by model order by p desc rows between unbounded preceding and current row) as cum_neg,
    sum(pos) over (partition by model) as n_pos, sum(neg) over (partition by model) as n_neg from cg)"""

register("f11_roc_curve", _SPLIT + _TEST + _CUM.format(src="ts") + """
select model, p as threshold, case when n_neg > 0 then cast(cum_neg as double) / cast(n_neg as double) else 0.0 end as fpr,
  case when n_pos > 0 then cast(cum_pos as double) / cast(n_pos as double) else 0.0 end as tpr from cum
union all
select distinct model, cast(null as double), 0.0, 0.0 from ts""")(
    lambda spark, sf: EV.roc_curve(_test_eval(spark, sf)[0]))

register("f12_pr_curve", _SPLIT + _TEST + _CUM.format(src="ts") + """
select model, p as threshold, cast(cum_pos as double) / cast(cum_pos + cum_neg as double) as precision,
  case when n_pos > 0 then cast(cum_pos as double) / cast(n_pos as double) else 0.0 end as recall from cum
union all
select distinct model, cast(null as double), 1.0, 0.0 from ts""")(
    lambda spark, sf: EV.pr_curve(_test_eval(spark, sf)[0]))

register("f12_average_precision", _SPLIT + _TEST + _CUM.format(src="ts") + f"""
select model, (select avg(label) from ts t where t.model = cum.model) as base_rate,
  {_r('sum(case when n_pos > 0 then cast(pos as double) / cast(n_pos as double) * (cast(cum_pos as double) / cast(cum_pos + cum_neg as double)) else 0 end)', 6)} as average_precision
from cum group by model""")(
    lambda spark, sf: EV.average_precision(_test_eval(spark, sf)[0])
    .withColumn("average_precision", rh("average_precision", 6)))

register("f13_confusion_matrix", _SPLIT + _TEST + _CURVE.format(src="vs") + """
, cells as (select b.model, a.actual, pcol.predicted from best b, (values (0), (1)) a(actual), (values (0), (1)) pcol(predicted)),
pr as (select ts.model, ts.label as actual, case when ts.p >= b.threshold then 1 else 0 end as predicted
    from ts join best b using (model))
select c.model, c.actual, c.predicted, cast(count(pr.model) as bigint) as count
from cells c left join pr on pr.model = c.model and pr.actual = c.actual and pr.predicted = c.predicted
group by c.model, c.actual, c.predicted""")(
    lambda spark, sf: EV.confusion_matrix(*_test_eval(spark, sf)))

# ---------------------------------------------------------------- A9, A12
register("a09_holdout", _SPLIT + """
select f.customerID, f.Churn, f.MonthlyCharges, f.tenure from features f join sp using (customerID) where sp.split = 'test'""")(
    lambda spark, sf: L.features(spark, sf).join(
        L.split(spark, sf).where(F.col("split") == "test").select("customerID"), "customerID")
    .select("customerID", "Churn", "MonthlyCharges", "tenure"))

_DISPLAY_COLS = ["churn_probability", "churn_predicted", "revenue_at_risk", "risk_rank", "scoring_model", "risk_tier",
                 "value_tier", "is_high_value", "segment_label", "segment_priority", "recommended_action",
                 "segment_color", "service_count", "tenure_band", "is_autopay", "is_longterm_contract",
                 "avg_monthly_revenue", "charges_delta", "clv_estimate"]
register("a12_display_view", f"""
select c.*, {', '.join('s.' + x for x in _DISPLAY_COLS)} from cleaned c left join scored s using (customerID)""")(
    lambda spark, sf: L.display(spark, sf))
