"""Three models of known parameters, and the SQL of their scores.

They let every operator behind training (tuning, cross-validated AUC, holdout
metrics, importances, Shapley values, scoring, segments, persistence, streams)
be checked against SQL: the parameters are constants, so an SQL engine can score
the same customers from the compiled expressions.
"""

from __future__ import annotations

from lapse.operators import scorecard as SC

FEATURES = ("tenure", "MonthlyCharges", "service_count", "is_fiber", "has_internet", "is_autopay", "is_longterm_contract",
            "Contract_Month-to-month", "PaymentMethod_Electronic check", "PaperlessBilling")

LOGISTIC = SC.Logistic(
    FEATURES,
    means=(36.0, 62.0, 3.0, 0.44, 0.78, 0.43, 0.45, 0.55, 0.34, 0.59),
    stds=(21.0, 11.0, 1.5, 0.5, 0.41, 0.5, 0.5, 0.5, 0.47, 0.49),
    coefficients=(-0.85, 0.06, 0.04, 0.38, 0.21, -0.07, -0.45, 0.52, 0.33, 0.02),
    intercept=-1.1)

_LEAF, _SPLIT = SC.Leaf, SC.Split
_BY_CONTRACT = _SPLIT("Contract_Month-to-month", 0.5, 6.0,
                      _SPLIT("tenure", 20.5, 1.5, _LEAF(0.3125, 160.0), _LEAF(0.0625, 320.0)),
                      _SPLIT("tenure", 12.5, 2.5, _LEAF(0.75, 128.0), _SPLIT("is_fiber", 0.5, 1.0, _LEAF(0.25, 256.0), _LEAF(0.5, 192.0))))
_BY_TENURE = _SPLIT("tenure", 24.5, 4.0, _SPLIT("is_fiber", 0.5, 1.25, _LEAF(0.375, 256.0), _LEAF(0.625, 128.0)), _LEAF(0.125, 672.0))
_BY_PAYMENT = _SPLIT("PaymentMethod_Electronic check", 0.5, 2.0, _LEAF(0.1875, 704.0),
                     _SPLIT("Contract_Month-to-month", 0.5, 0.75, _LEAF(0.25, 160.0), _LEAF(0.6875, 192.0)))
FOREST = SC.Forest(FEATURES, (_BY_CONTRACT, _BY_TENURE, _BY_PAYMENT))

_M1 = _SPLIT("Contract_Month-to-month", 0.5, 5.0, _LEAF(-0.9375, 480.0), _SPLIT("tenure", 12.5, 2.0, _LEAF(0.8125, 128.0), _LEAF(-0.25, 448.0)))
_M2 = _SPLIT("tenure", 24.5, 3.5, _SPLIT("is_fiber", 0.5, 1.25, _LEAF(0.125, 256.0), _LEAF(0.75, 128.0)), _LEAF(-0.5625, 672.0))
_M3 = _SPLIT("PaymentMethod_Electronic check", 0.5, 1.5, _LEAF(-0.25, 704.0), _LEAF(0.4375, 352.0))
_M4 = _SPLIT("MonthlyCharges", 63.125, 0.5, _LEAF(-0.0625, 544.0), _SPLIT("has_internet", 0.5, 0.25, _LEAF(-0.125, 96.0), _LEAF(0.1875, 416.0)))
BOOSTED = SC.Boosted(FEATURES, (_M1, _M2, _M3, _M4), (1.0, 0.5, 0.5, 0.25))

CARDS: dict[str, SC.Scorecard] = {"logistic": LOGISTIC, "random_forest": FOREST, "gbt": BOOSTED}


# ---------------------------------------------------------------- DuckDB oracles (continue the WITH list of `oracle.prefix`)
def r9(expr: str) -> str:
    return f"cast(floor(({expr}) * 1000000000.0 + 0.5) / 1000000000.0 as double)"


def _scores() -> str:
    parts = [f"select '{name}' as model, customerID, Churn as label, MonthlyCharges, {SC.probability_sql(card)} as p from features"
             for name, card in CARDS.items()]
    return ", kp as (" + "\n union all ".join(parts) + """),
ks as (select kp.*, sp.split, cast((sp.class_pos - 1) % 5 as integer) as fold from kp join sp using (customerID))"""


def _splits(node: SC.Node, tree: int, kind: str) -> list[str]:
    if isinstance(node, SC.Leaf):
        return []
    own = f"('{kind}', {tree}, '{node.feature}', cast({node.gain * node.count!r} as double))"
    return [own, *_splits(node.left, tree, kind), *_splits(node.right, tree, kind)]


def _importances() -> str:
    """gain * rows of each split; a forest's trees are brought to a sum of 1 first, then each model's sum."""
    rows = [x for kind, card in (("Random Forest", FOREST), ("Gradient Boosted Trees", BOOSTED)) for i, t in enumerate(card.trees) for x in _splits(t, i, kind)]
    names = ", ".join(f"('{f}')" for f in FEATURES)
    return f""", im_s(model, tree, feature, gain) as (values {", ".join(rows)}),
im_t as (select model, feature, case when model = 'Random Forest' then gain / sum(gain) over (partition by model, tree) else gain end as part from im_s),
im_f(feature) as (values {names}),
importances as (select f.feature, m.model, coalesce(sum(t.part), 0.0) / (select sum(part) from im_t x where x.model = m.model) as importance
  from im_f f cross join (select distinct model from im_s) m left join im_t t on t.feature = f.feature and t.model = m.model group by f.feature, m.model)"""


def _shap() -> str:
    phi = SC.shapley_sql(BOOSTED)
    parts = [f"select '{f}' as feature, avg(abs({phi.get(f, '0.0')})) as importance from features" for f in FEATURES]
    return ", shap as (" + "\n union all ".join(parts) + ")"


def _linear() -> str:
    parts = [f"""select '{f}' as feature, avg(abs({c!r} * (("{f}" - {m!r}) / {s!r}))) as importance from features"""
             for f, m, s, c in zip(LOGISTIC.features, LOGISTIC.means, LOGISTIC.stds, LOGISTIC.coefficients, strict=True)]
    return ", linear as (" + "\n union all ".join(parts) + ")"


def _metric(num: str, den: str) -> str:
    return f"cast(floor((case when {den} > 0 then cast({num} as double) / cast({den} as double) else 0.0 end) * 10000.0 + 0.5) / 10000.0 as double)"


def oracles(split: str, curve: str, auc: str) -> dict[str, str]:
    """Oracle bodies by query; `split`, `curve` and `auc` are the shared CTEs of the evaluation queries."""
    scores = split + _scores()
    cv = ", cf as (select model || '#' || fold as model, p, label from ks where split = 'train')" + auc.format(src="cf", n="cauc")
    cv += """, cvs as (select split_part(model, '#', 1) as model, avg(auc) as cv_auc_mean, stddev_pop(auc) as cv_auc_std from cauc group by 1)"""
    holdout = ", vs as (select * from ks where split = 'val'), ts as (select * from ks where split = 'test')" + curve.format(src="vs") + auc.format(src="ts", n="auc") + f"""
, pr as (select ts.model, b.threshold, b.val_f1, ts.label, case when ts.p >= b.threshold then 1 else 0 end as pred from ts join best b using (model)),
c as (select model, threshold, val_f1, sum(pred * label) as tp, sum(pred * (1 - label)) as fp, sum((1 - pred) * label) as fn from pr group by all),
ho as (select c.model, val_f1, threshold, cast(floor(auc * 10000.0 + 0.5) / 10000.0 as double) as test_auc, {_metric('tp', 'tp + fp')} as test_precision,
  {_metric('tp', 'tp + fn')} as test_recall, {_metric('2 * tp', '2 * tp + fp + fn')} as test_f1 from c join auc using (model))"""
    results = """, rs as (select model, cv_auc_mean, cv_auc_std, val_f1, threshold, test_auc, test_precision, test_recall, test_f1 from cvs join ho using (model))"""
    best = """, bm as (select model, threshold from ho order by test_auc desc, model limit 1),
bs as (select kp.customerID, kp.MonthlyCharges, kp.p, bm.model, cast(case when kp.p >= bm.threshold then 1 else 0 end as integer) as pred,
  kp.p * kp.MonthlyCharges as rar, case when kp.p >= bm.threshold then 'high_risk' else 'low_risk' end as risk_tier,
  case when kp.MonthlyCharges >= (select quantile_cont(MonthlyCharges, 0.5) from features) then 'high_value' else 'low_value' end as value_tier
  from kp join bm using (model)),
bd as (select * from bs join seg_dim using (risk_tier, value_tier))"""
    rounded = f"""select model, {r9('cv_auc_mean')} as cv_auc_mean, {r9('cv_auc_std')} as cv_auc_std, {r9('val_f1')} as val_f1, {r9('threshold')} as threshold,
  {r9('test_auc')} as test_auc, {r9('test_precision')} as test_precision, {r9('test_recall')} as test_recall, {r9('test_f1')} as test_f1 from rs"""
    r4 = lambda c: f"cast(floor({c} * 10000.0 + 0.5) / 10000.0 as double) as {c}"
    test = f"select model, customerID, label, {r9('p')} as p from ks where split = 'test'"
    imp = lambda src, where="": f"select feature, {r9('importance')} as importance, model from {src}{where}"
    shap_rows = f"select feature, {r9('importance')} as importance, 'SHAP' as model from shap"
    coefficients = ", ".join(f"('{f}', cast({c!r} as double))" for f, c in zip(FEATURES, LOGISTIC.coefficients, strict=True))
    arrivals = f"""select risk_tier, value_tier, customerID, {r9('MonthlyCharges')} as MonthlyCharges, {r9('p')} as churn_probability, pred as churn_predicted,
  {r9('rar')} as revenue_at_risk, model as scoring_model, segment_label, cast(segment_priority as integer) as segment_priority, recommended_action, segment_color from bd"""
    return {
        "f03_logistic_test_scores": scores + "\n" + test + " and model = 'logistic'",
        "f04_random_forest_test_scores": scores + "\n" + test + " and model = 'random_forest'",
        "f05_gbt_test_scores": scores + "\n" + test + " and model = 'gbt'",
        "a08_model_roundtrip": scores + "\n" + test,
        "f06_cv_auc": scores + cv + f"\nselect model, {r9('cv_auc_mean')} as cv_auc_mean, {r9('cv_auc_std')} as cv_auc_std from cvs",
        "f20_train_all": scores + cv + holdout + results + f"""
select model, {r4('cv_auc_mean')}, {r4('cv_auc_std')}, {r4('val_f1')}, {r9('threshold')} as threshold, test_auc, test_precision, test_recall, test_f1 from rs""",
        "a06_model_results": scores + cv + holdout + results + "\n" + rounded,
        "a06_model_results_json": scores + cv + holdout + results + "\n" + rounded,
        "f19_comparison_table": scores + cv + holdout + results + f"""
select model, {r9('threshold')} as threshold, test_auc, test_precision, test_recall, test_f1, printf('%.4f ± %.4f', cv_auc_mean, cv_auc_std) as cv_auc from rs""",
        "f10_best_model_by_f1": scores + cv + holdout + results + "\n" + rounded + " order by rs.test_f1 desc, model limit 1",
        "f14_native_importance": _importances() + "\n" + imp("importances"),
        "f15_tree_shap": _shap() + "\n" + shap_rows,
        "f18_top_shap_features": _shap() + "\n" + shap_rows,
        "f15_linear_shap": _linear() + f"\nselect feature, {r9('importance')} as importance, 'SHAP-linear' as model from linear",
        "f17_logistic_coefficients": f", co(feature, coefficient) as (values {coefficients})\nselect feature, {r9('coefficient')} as coefficient from co",
        "a07_importance_table": _importances() + _shap() + "\n" + imp("importances") + " union all " + shap_rows,
        "g01_model_churn_probability": scores + holdout + best + f"\nselect customerID, {r9('p')} as churn_probability, model as scoring_model from bs",
        "g05_model_score_all": scores + holdout + best + f"""
select customerID, {r9('p')} as churn_probability, pred as churn_predicted, {r9('rar')} as revenue_at_risk,
  cast(row_number() over (order by rar desc, customerID) as integer) as risk_rank, segment_label from bd""",
        "g25_score_new": scores + holdout + best + "\n" + arrivals,
        "g25_stream_score": scores + holdout + best + "\n" + arrivals,
    }
