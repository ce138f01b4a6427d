"""Registered queries: cleaning, features, the SQL pack and the cohort tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lapse.operators import cohorts as CO
from lapse.plans import layers as L
from lapse.plans import sqlpack as P
from lapse.plans.oracle import _SQL_BAND
from lapse.plans.registry import register


def _r(expr: str, d: int = 2) -> str:
    """DuckDB half-up rounding as double (same bits as the Spark helper)."""
    return f"cast(floor(({expr}) * {10 ** d}.0 + 0.5) / {10 ** d}.0 as double)"


def _rate(num: str, den: str, d: int) -> str:
    return _r(f"100.0::double * ({num}) / ({den})", d)


_CH = "sum(case when Churn = 'Yes' then 1 else 0 end)"

# ---------------------------------------------------------------- 2.B / 2.C
register("clean_customers", """
select customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines, InternetService,
  OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies, Contract,
  PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn, is_charges_outlier from cleaned
""")(lambda spark, sf: L.cleaned(spark, sf))

register("features", "select * from features")(lambda spark, sf: L.features(spark, sf))

# ---------------------------------------------------------------- 2.D SQL pack
register("d01_overall_churn", f"""
select count(*) as total_customers, cast({_CH} as bigint) as churned, {_rate(_CH, 'count(*)', 2)} as churn_rate_pct
from sqlview""")(lambda spark, sf: P.overall_churn(L.sql_view(spark, sf)))

register("d02_revenue_at_risk", f"""
select {_r('sum(MonthlyCharges)')} as total_monthly_revenue_at_risk, {_r('avg(MonthlyCharges)')} as avg_monthly_charges_churned,
  count(*) as churned_customers from sqlview where Churn = 'Yes'""")(
    lambda spark, sf: P.revenue_at_risk_actual(L.sql_view(spark, sf)))


def _by(key: str, d: int = 2) -> str:
    return f"""select {key}, count(*) as customers, cast({_CH} as bigint) as churned, {_rate(_CH, 'count(*)', d)} as churn_rate_pct
from sqlview group by {key}"""


register("d03_churn_by_contract", _by("Contract"))(lambda spark, sf: P.churn_by(L.sql_view(spark, sf), "Contract"))
register("d04_churn_by_internet", _by("InternetService"))(
    lambda spark, sf: P.churn_by(L.sql_view(spark, sf), "InternetService"))
register("d05_churn_by_tenure_band", f"""
select {_SQL_BAND} as tenure_band, count(*) as customers, cast({_CH} as bigint) as churned,
  {_rate(_CH, 'count(*)', 2)} as churn_rate_pct from sqlview group by 1""")(
    lambda spark, sf: P.churn_by_tenure_band(L.sql_view(spark, sf)))
register("d06_churned_vs_retained", f"""
select Churn as churn_status, count(*) as customers, {_r('avg(MonthlyCharges)')} as avg_monthly_charges,
  {_r('avg(TotalCharges)')} as avg_total_charges, {_r('avg(tenure)', 1)} as avg_tenure_months from sqlview group by Churn""")(
    lambda spark, sf: P.churned_vs_retained(L.sql_view(spark, sf)))
register("d07_service_adoption", "\nunion all\n".join(
    f"select '{s}' as service, {_rate(f'sum(case when {s} = ' + chr(39) + 'Yes' + chr(39) + ' then 1 else 0 end)', 'count(*)', 1)} as adoption_pct from sqlview"
    for s in ["PhoneService", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
              "StreamingMovies"]))(lambda spark, sf: P.service_adoption(L.sql_view(spark, sf)))
register("d08_churn_by_payment", _by("PaymentMethod"))(
    lambda spark, sf: P.churn_by(L.sql_view(spark, sf), "PaymentMethod"))
register("d09_high_value_churners", f"""
select customerID, tenure, Contract, InternetService, MonthlyCharges, TotalCharges,
  {_r('TotalCharges / nullif(tenure, 0)')} as avg_monthly_revenue
from sqlview where Churn = 'Yes'
  and MonthlyCharges >= (select quantile_cont(MonthlyCharges, 0.75) from sqlview)
order by MonthlyCharges desc, customerID limit 20""")(lambda spark, sf: P.high_value_churners(L.sql_view(spark, sf)))
register("d10_cohort_matrix", f"""
select Contract, {_SQL_BAND} as tenure_band, count(*) as customers, cast({_CH} as bigint) as churned,
  {_rate(_CH, 'count(*)', 1)} as churn_rate_pct from sqlview group by 1, 2""")(
    lambda spark, sf: P.cohort_matrix(L.sql_view(spark, sf)))
register("d11_clv_by_contract", f"""
select Contract, count(*) as customers, {_r('avg(MonthlyCharges)')} as avg_monthly_charges,
  {_r('avg(tenure)', 1)} as avg_tenure, {_r('avg(MonthlyCharges) * 24')} as estimated_24mo_clv
from sqlview where Churn = 'No' group by Contract""")(lambda spark, sf: P.clv_by_contract(L.sql_view(spark, sf)))
register("d12_senior_comparison", f"""
select case when SeniorCitizen = 1 then 'Senior' else 'Non-Senior' end as segment, count(*) as customers,
  {_r('avg(MonthlyCharges)')} as avg_monthly_charges, {_rate(_CH, 'count(*)', 2)} as churn_rate_pct
from sqlview group by SeniorCitizen""")(lambda spark, sf: P.senior_comparison(L.sql_view(spark, sf)))

# ---------------------------------------------------------------- 2.E cohort / EDA tables
register("e01_overall_churn_rate", f"""
select count(*) as total_customers, cast(sum(Churn) as bigint) as churned, cast(count(*) - sum(Churn) as bigint) as retained,
  cast(sum(Churn) as double) / count(*) as churn_rate,
  {_r('sum(case when Churn = 1 then MonthlyCharges else 0 end)')} as monthly_rev_at_risk from analysis""")(
    lambda spark, sf: CO.overall_churn_rate(L.analysis(spark, sf)))

register("e02_churn_by_payment", """
select PaymentMethod, avg(Churn) as churn_rate, count(*) as customers from analysis
where PaymentMethod is not null group by PaymentMethod""")(
    lambda spark, sf: CO.churn_by_category(L.analysis(spark, sf), "PaymentMethod"))

register("e03_churn_by_tenure", """
select tenure_band, avg(Churn) as churn_rate, count(*) as customers from analysis
where tenure_band is not null group by tenure_band""")(lambda spark, sf: CO.churn_by_tenure(L.analysis(spark, sf)))

register("e04_charges_histogram", """
, mm as (select min(MonthlyCharges) as lo, max(MonthlyCharges) as hi from analysis),
b as (select least(cast(floor((MonthlyCharges - lo) / ((hi - lo) / 40.0)) as integer), 39) as bin,
             case when Churn = 1 then 'Churned' else 'Retained' end as status, lo, hi from analysis, mm)
select bin, status, count(*) as customers,
  lo + bin * ((hi - lo) / 40.0) as bin_start, lo + (bin + 1) * ((hi - lo) / 40.0) as bin_end
from b group by bin, status, lo, hi""".replace("\n, mm", ", mm", 1))(
    lambda spark, sf: CO.charges_histogram(L.analysis(spark, sf), 40))

register("e05_revenue_by_status_contract", f"""
select Contract, case when Churn = 1 then 'At Risk' else 'Retained' end as status,
  {_r('sum(MonthlyCharges)')} as revenue from analysis where Contract is not null group by 1, 2""")(
    lambda spark, sf: CO.revenue_by_status(L.analysis(spark, sf), "Contract"))


def _pivot_sql(y: str, x: str, values: list[str], digits: int | None = None) -> str:
    def cell(v):
        e = f"avg(case when {x} = '{v}' then Churn end)"
        return (_r(e, digits) if digits is not None else e) + f' as "{v}"'
    return f"select {y}, {', '.join(cell(v) for v in values)} from analysis where {y} is not null group by {y}"


_CONTRACTS = ["Month-to-month", "One year", "Two year"]
register("e06_heatmap_band_contract", _pivot_sql("tenure_band", "Contract", _CONTRACTS))(
    lambda spark, sf: CO.churn_heatmap(L.analysis(spark, sf), "Contract", "tenure_band"))
register("e06_heatmap_contract_internet", _pivot_sql("Contract", "InternetService", ["DSL", "Fiber optic", "No"]))(
    lambda spark, sf: CO.churn_heatmap(L.analysis(spark, sf), "InternetService", "Contract"))
register("e06_heatmap_contract_payment", _pivot_sql(
    "Contract", "PaymentMethod",
    ["Bank transfer (automatic)", "Credit card (automatic)", "Electronic check", "Mailed check"]))(
    lambda spark, sf: CO.churn_heatmap(L.analysis(spark, sf), "PaymentMethod", "Contract"))

register("e07_churn_by_tenure_contract", """
select tenure_band, Contract, avg(Churn) as churn_rate from analysis
where tenure_band is not null and Contract is not null group by 1, 2""")(
    lambda spark, sf: CO.churn_by_tenure_contract(L.analysis(spark, sf)))

register("e08_service_adoption_vs_churn", """
select service_count, avg(Churn) as churn_rate, count(*) as customers from analysis group by service_count""")(
    lambda spark, sf: CO.service_adoption_vs_churn(L.analysis(spark, sf)))

register("e09_revenue_lifecycle", f"""
select tenure, {_r('avg(MonthlyCharges)', 4)} as avg_charge, quantile_cont(MonthlyCharges, 0.5) as median_charge,
  count(*) as count from analysis where tenure is not null group by tenure""")(
    lambda spark, sf: CO.revenue_lifecycle(L.analysis(spark, sf)))

register("e10_cohort_churn_table", _pivot_sql("tenure_band", "Contract", _CONTRACTS, 3))(
    lambda spark, sf: CO.cohort_churn_table(L.analysis(spark, sf)))

register("e11_insight_table", """
select 'Contract Type' as Attribute, Contract as Value, count(*) as Customers, avg(Churn) as churn_rate
from analysis where Contract is not null group by Contract
union all
select 'Internet Service', InternetService, count(*), avg(Churn) from analysis where InternetService is not null group by InternetService
union all
select 'Payment Method', PaymentMethod, count(*), avg(Churn) from analysis where PaymentMethod is not null group by PaymentMethod""")(
    lambda spark, sf: CO.insight_table(L.analysis(spark, sf)))

register("e12_churned_vs_retained", f"""
select case when Churn = 1 then 'Churned' else 'Retained' end as Status, count(customerID) as Customers,
  {_r('avg(MonthlyCharges)')} as Avg_Monthly, {_r('avg(tenure)', 1)} as Avg_Tenure, {_r('avg(TotalCharges)')} as Avg_Total
from analysis group by 1""")(lambda spark, sf: CO.churned_vs_retained(L.analysis(spark, sf)))

register("e13_churn_by_senior", """
select case when SeniorCitizen = 1 then 'Senior' else 'Non-Senior' end as senior_status, avg(Churn) as churn_rate,
  count(*) as customers from analysis group by 1""")(lambda spark, sf: CO.churn_by_senior(L.analysis(spark, sf)))

register("e14_driver_lift", """
, base as (select avg(Churn) as base_rate, quantile_cont(MonthlyCharges, 0.5) as med from analysis),
flags as (
  select 'Month-to-month contract' as driver, Churn from analysis where Contract = 'Month-to-month'
  union all select 'Short tenure (0-12 months)', Churn from analysis where tenure between 0 and 12
  union all select 'Fiber optic internet', Churn from analysis where InternetService = 'Fiber optic'
  union all select 'Electronic check payment', Churn from analysis where PaymentMethod = 'Electronic check'
  union all select 'Senior citizen', Churn from analysis where SeniorCitizen = 1
  union all select 'Two year contract', Churn from analysis where Contract = 'Two year'
  union all select 'No online security', Churn from analysis where OnlineSecurity = 'No'
  union all select 'High charges without long contract', Churn from analysis, base
    where MonthlyCharges >= med and Contract = 'Month-to-month')
select driver, count(*) as customers, cast(sum(Churn) as bigint) as churned, avg(Churn) as churn_rate,
  avg(Churn) / max(base_rate) as lift_vs_base
from flags, base group by driver""".replace("\n, base", ", base", 1))(
    lambda spark, sf: CO.driver_lift(L.analysis(spark, sf)))

# ---------------------------------------------------------------- per-step cleaning / feature operators
from lapse.operators import clean as CL  # noqa: E402
from lapse.operators import features as FEAT  # noqa: E402
from lapse.sources import fixture as FX  # noqa: E402

register("b01_coerce_total_charges", """
select customerID, case when regexp_matches(trim(TotalCharges), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim(TotalCharges) as double) end as TotalCharges from customers""")(
    lambda spark, sf: CL.coerce_total_charges(FX.customers(spark, sf)).select("customerID", "TotalCharges"))
register("b02_impute_total_charges", """
select customerID, coalesce(case when regexp_matches(trim(TotalCharges), '^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$') then try_cast(trim(TotalCharges) as double) end, MonthlyCharges) as TotalCharges from customers""")(
    lambda spark, sf: CL.impute_total_charges(CL.coerce_total_charges(FX.customers(spark, sf)))
    .select("customerID", "TotalCharges"))
register("b03_binary_target", """
select customerID, cast(case when Churn = 'Yes' then 1 else 0 end as integer) as Churn from customers""")(
    lambda spark, sf: CL.binary_target(FX.customers(spark, sf)).select("customerID", "Churn"))
register("b05_strip_strings", """
select regexp_replace(customerID, '^\\s+|\\s+$', '', 'g') as customerID,
  regexp_replace(PaymentMethod, '^\\s+|\\s+$', '', 'g') as PaymentMethod,
  regexp_replace(TotalCharges, '^\\s+|\\s+$', '', 'g') as TotalCharges from customers""")(
    lambda spark, sf: CL.strip_strings(FX.customers(spark, sf).select("customerID", "PaymentMethod", "TotalCharges")))
register("b06_outlier_flags", """
, q as (select quantile_cont(MonthlyCharges, 0.25) as q1, quantile_cont(MonthlyCharges, 0.75) as q3 from customers)
select customerID, MonthlyCharges, cast(case when MonthlyCharges < q1 - 3 * (q3 - q1) or MonthlyCharges > q3 + 3 * (q3 - q1)
  then 1 else 0 end as integer) as is_charges_outlier from customers, q""".replace("\n, q", ", q", 1))(
    lambda spark, sf: CL.flag_outliers(FX.customers(spark, sf).select("customerID", "MonthlyCharges")))

register("c01_tenure_band", "select customerID, tenure, tenure_band from features")(
    lambda spark, sf: L.features(spark, sf).select("customerID", "tenure", "tenure_band"))
register("c05_service_count", "select customerID, service_count from features")(
    lambda spark, sf: L.features(spark, sf).select("customerID", "service_count"))
register("c11_high_value_flag", "select customerID, MonthlyCharges, is_high_value from features")(
    lambda spark, sf: L.features(spark, sf).select("customerID", "MonthlyCharges", "is_high_value"))


def _one_hot_cols():
    from lapse.config import one_hot_columns
    return one_hot_columns()


register("c13_one_hot", "select customerID, " + ", ".join(f'"{c}"' for c in _one_hot_cols()) + " from features")(
    lambda spark, sf: L.features(spark, sf).select("customerID", *[F.col(f"`{c}`") for c in _one_hot_cols()]))


def _model_matrix(spark, sf):
    f = L.features(spark, sf)
    return f.select("customerID", *[F.col(f"`{c}`") for c in FEAT.model_columns(f)])


register("c14_model_matrix", """
select customerID, SeniorCitizen, tenure, MonthlyCharges, TotalCharges, Partner, Dependents, PhoneService,
  PaperlessBilling, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies,
  MultipleLines, avg_monthly_revenue, charges_delta, clv_estimate, service_count, is_autopay, is_longterm_contract,
  has_internet, is_fiber, is_senior, """ + ", ".join(f'"{c}"' for c in _one_hot_cols()) + " from features")(_model_matrix)


def _assembled(spark, sf):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    f = L.features(spark, sf)
    cols = FEAT.model_columns(f)
    v = VectorAssembler(inputCols=cols, outputCol="x").transform(f)
    arr = vector_to_array("x")
    return v.select("customerID", F.size(arr).alias("n_features"),
                    F.aggregate(arr, F.lit(0.0), lambda a, b: a + b).alias("row_sum"))


_MODEL_COLS = ["SeniorCitizen", "tenure", "MonthlyCharges", "TotalCharges", "Partner", "Dependents", "PhoneService", "PaperlessBilling",
               "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "MultipleLines",
               "avg_monthly_revenue", "charges_delta", "clv_estimate", "service_count", "is_autopay", "is_longterm_contract",
               "has_internet", "is_fiber", "is_senior", *_one_hot_cols()]
register("c15_assembled_vectors", f"""
select customerID, cast({len(_MODEL_COLS)} as integer) as n_features,
  cast(0.0 as double) + {' + '.join(f'cast("{c}" as double)' for c in _MODEL_COLS)} as row_sum from features""")(_assembled)

register("b04_senior_int", "select customerID, cast(SeniorCitizen as integer) as SeniorCitizen from customers")(
    lambda spark, sf: CL.senior_int(FX.customers(spark, sf)).select("customerID", "SeniorCitizen"))
register("c02_revenue_features", """
select customerID, avg_monthly_revenue, charges_delta, clv_estimate from features""")(
    lambda spark, sf: L.features(spark, sf).select("customerID", "avg_monthly_revenue", "charges_delta", "clv_estimate"))
register("c06_binary_flags", """
select customerID, is_autopay, is_longterm_contract, has_internet, is_fiber, is_senior from features""")(
    lambda spark, sf: L.features(spark, sf).select("customerID", "is_autopay", "is_longterm_contract", "has_internet",
                                                   "is_fiber", "is_senior"))
_BIN = ["Partner", "Dependents", "PhoneService", "PaperlessBilling", "OnlineSecurity", "OnlineBackup",
        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "MultipleLines"]
register("c12_binary_encoding", f"select customerID, {', '.join(_BIN)} from features")(
    lambda spark, sf: L.features(spark, sf).select("customerID", *_BIN))
