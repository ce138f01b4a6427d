"""DuckDB-dialect building blocks for the SQL oracles.

Each oracle is `WITH <layers> <query>` over the raw test tables; DuckDB
inlines unused CTEs, so every oracle carries the whole layer stack.
"""

from __future__ import annotations

from lapse.config import ONE_HOT


def _h(salt: str) -> str:
    return f"(cast(('0x' || substr(md5(c.c_custkey::varchar || ':{salt}'), 1, 7)) as bigint) % 10000)"


_SALTS = ["gen", "sen", "par", "dep", "ten", "pho", "int", "con", "pap", "pay", "tot", "noi", "scr",
          "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport",
          "StreamingTV", "StreamingMovies"]
_ADDONS = ["OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies"]

_POINTS = """((case Contract when 'Month-to-month' then 3000 when 'One year' then 800 else 0 end)
   + (case when tenure <= 12 then 2500 when tenure <= 24 then 1200 when tenure <= 48 then 500 else 0 end)
   + (case InternetService when 'Fiber optic' then 1500 when 'DSL' then 500 else 0 end)
   + (case PaymentMethod when 'Electronic check' then 1000 else 0 end))"""


def _base_cte() -> str:
    hashes = ", ".join(f"{_h(s)} as u_{s}" for s in _SALTS)
    addons = ",\n  ".join(
        f"case when InternetService = 'No' then 'No internet service' when u_{a} < 4400 then 'Yes' else 'No' end as {a}"
        for a in _ADDONS)
    return f"""fx_o as (select o_custkey, avg(o_totalprice) as avg_tp from orders group by o_custkey),
fx_b as (select c.c_name as customerID,
  cast(floor(coalesce(o.avg_tp, 250000) / 40 + 0.5) as bigint) as mc_cents, {hashes}
  from customer c left join fx_o o on o.o_custkey = c.c_custkey),
fx_d as (select *, cast(u_ten % 73 as integer) as tenure,
  case when u_con < 5500 then 'Month-to-month' when u_con < 7600 then 'One year' else 'Two year' end as Contract,
  case when u_int < 3400 then 'DSL' when u_int < 7800 then 'Fiber optic' else 'No' end as InternetService,
  case when u_pay < 3400 then 'Electronic check' when u_pay < 5700 then 'Mailed check'
       when u_pay < 7900 then 'Bank transfer (automatic)' else 'Credit card (automatic)' end as PaymentMethod,
  case when u_pho < 9000 then 'Yes' else 'No' end as PhoneService from fx_b),
fx_base as (select customerID,
  case when u_gen < 5000 then 'Female' else 'Male' end as gender,
  cast(case when u_sen < 1600 then 1 else 0 end as integer) as SeniorCitizen,
  case when u_par < 4800 then 'Yes' else 'No' end as Partner,
  case when u_dep < 3000 then 'Yes' else 'No' end as Dependents,
  tenure, PhoneService,
  case when PhoneService = 'No' then 'No phone service' when u_MultipleLines < 4200 then 'Yes' else 'No' end as MultipleLines,
  InternetService,
  {addons},
  Contract,
  case when u_pap < 5900 then 'Yes' else 'No' end as PaperlessBilling,
  PaymentMethod,
  cast(mc_cents as double) / cast(100 as double) as MonthlyCharges,
  case when tenure = 0 then ' ' else cast(cast((mc_cents * tenure * (45000 + u_tot)) // 50000 as double) / cast(100 as double) as varchar) end as TotalCharges,
  case when {_POINTS} * 10 + u_noi * 6 > 83000 then 'Yes' else 'No' end as Churn,
  cast(5 * {_POINTS} + u_scr as double) / cast(50000 as double) as churn_probability,
  cast({_POINTS} as double) / cast(8000 as double) as planted_probability
  from fx_d)"""


RAW_COLS = ("customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines, "
            "InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, "
            "StreamingMovies, Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn")

_STRING_COLS = ["customerID", "gender", "Partner", "Dependents", "PhoneService", "MultipleLines", "InternetService",
                "OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV",
                "StreamingMovies", "Contract", "PaperlessBilling", "PaymentMethod"]


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


#: What counts as a number in TotalCharges, as a DuckDB string.
NUMBER = "'^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$'"
_BAND = """case when tenure >= 0 and tenure <= 12 then '0-12 mo' when tenure > 12 and tenure <= 24 then '13-24 mo'
       when tenure > 24 and tenure <= 48 then '25-48 mo' when tenure > 48 and tenure <= 72 then '49+ mo' end"""
_SQL_BAND = """case when tenure between 0 and 12 then '0-12 mo' when tenure between 13 and 24 then '13-24 mo'
       when tenure between 25 and 48 then '25-48 mo' else '49+ mo' end"""
_SVC = " + ".join(f"(case when {c} = 'Yes' then 1 else 0 end)" for c in
                  ["PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
                   "TechSupport", "StreamingTV", "StreamingMovies"])


def _views_cte() -> str:
    trimmed = ", ".join(f"{_strip(c)} as {c}" for c in _STRING_COLS)
    return f"""sqlview as (select {trimmed}, SeniorCitizen, tenure, MonthlyCharges,
  coalesce(case when regexp_matches(trim(TotalCharges), {NUMBER}) then try_cast(trim(TotalCharges) as double) end, MonthlyCharges) as TotalCharges, {_strip('Churn')} as Churn
  from customers),
analysis as (select *, {_BAND} as tenure_band, cast({_SVC} as integer) as service_count from cleaned)"""


def _cleaned_cte() -> str:
    trimmed = ", ".join(f"{_strip(c)} as {c}" for c in _STRING_COLS)
    return f"""cl_a as (select {trimmed}, SeniorCitizen, tenure, MonthlyCharges,
  coalesce(case when regexp_matches(trim(TotalCharges), {NUMBER}) then try_cast(trim(TotalCharges) as double) end, MonthlyCharges) as TotalCharges,
  cast(case when Churn = 'Yes' then 1 else 0 end as integer) as Churn from customers),
cl_q as (select quantile_cont(MonthlyCharges, 0.25) as q1, quantile_cont(MonthlyCharges, 0.75) as q3 from cl_a),
cleaned as (select customerID, gender, SeniorCitizen, Partner, Dependents, tenure, PhoneService, MultipleLines,
  InternetService, OnlineSecurity, OnlineBackup, DeviceProtection, TechSupport, StreamingTV, StreamingMovies,
  Contract, PaperlessBilling, PaymentMethod, MonthlyCharges, TotalCharges, Churn,
  cast(case when MonthlyCharges < q1 - 3 * (q3 - q1) or MonthlyCharges > q3 + 3 * (q3 - q1) then 1 else 0 end as integer) as is_charges_outlier
  from cl_a, cl_q)"""


def _features_cte() -> str:
    svc = _SVC
    binary = ", ".join(f"cast(case when {c} = 'Yes' then 1 else 0 end as integer) as {c}" for c in
                       ["Partner", "Dependents", "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
                        "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "PaperlessBilling"])
    dummies = ", ".join(
        f"cast(case when {src} = '{v}' then 1 else 0 end as integer) as \"{src}_{v}\""
        for src, vals in ONE_HOT.items() for v in vals)
    return f"""ft_m as (select quantile_cont(MonthlyCharges, 0.5) as med from cleaned),
features as (select customerID, SeniorCitizen, {binary}, tenure, MonthlyCharges, TotalCharges, Churn, is_charges_outlier,
  {_BAND} as tenure_band,
  case when tenure > 0 then TotalCharges / tenure else MonthlyCharges end as avg_monthly_revenue,
  MonthlyCharges - (case when tenure > 0 then TotalCharges / tenure else MonthlyCharges end) as charges_delta,
  MonthlyCharges * 24 as clv_estimate,
  cast({svc} as integer) as service_count,
  cast(case when coalesce(contains(lower(PaymentMethod), 'automatic'), false) then 1 else 0 end as integer) as is_autopay,
  cast(case when Contract in ('One year', 'Two year') then 1 else 0 end as integer) as is_longterm_contract,
  cast(case when InternetService is distinct from 'No' then 1 else 0 end as integer) as has_internet,
  cast(case when InternetService is not distinct from 'Fiber optic' then 1 else 0 end as integer) as is_fiber,
  SeniorCitizen as is_senior,
  cast(case when MonthlyCharges >= med then 1 else 0 end as integer) as is_high_value,
  {dummies}
  from cleaned, ft_m)"""


def _scored_cte(threshold: float = 0.54) -> str:
    seg_rows = """select * from (values
  ('high_risk', 'high_value', 'Save Immediately', 1, 'Personal outreach + tailored discount offer', '#d62728'),
  ('high_risk', 'low_value', 'Assess & Offer', 2, 'Self-serve retention offer or automated email', '#ff7f0e'),
  ('low_risk', 'high_value', 'Nurture & Upsell', 3, 'Loyalty program or upgrade promotion', '#2ca02c'),
  ('low_risk', 'low_value', 'Monitor Only', 4, 'No immediate action — standard lifecycle comms', '#7f7f7f'))
  as t(risk_tier, value_tier, segment_label, segment_priority, recommended_action, segment_color)"""
    return f"""sc_p as (select f.*, s.churn_probability,
  cast(case when s.churn_probability >= cast({threshold!r} as double) then 1 else 0 end as integer) as churn_predicted,
  s.churn_probability * f.MonthlyCharges as revenue_at_risk
  from features f join scores s using (customerID)),
sc_m as (select quantile_cont(MonthlyCharges, 0.5) as med from sc_p),
sc_r as (select sc_p.*, cast(row_number() over (order by revenue_at_risk desc, customerID) as integer) as risk_rank,
  'fixture' as scoring_model,
  case when churn_predicted = 1 then 'high_risk' else 'low_risk' end as risk_tier,
  case when MonthlyCharges >= med then 'high_value' else 'low_value' end as value_tier
  from sc_p, sc_m),
seg_dim as ({seg_rows}),
scored as (select sc_r.*, d.segment_label, cast(d.segment_priority as integer) as segment_priority,
  d.recommended_action, d.segment_color
  from sc_r join seg_dim d using (risk_tier, value_tier))"""


def prefix(threshold: float = 0.54) -> str:
    """WITH clause defining customers, scores, cleaned, features, scored, model_scores."""
    return f"""with {_base_cte()},
customers as (select {RAW_COLS} from fx_base),
scores as (select customerID, churn_probability from fx_base),
model_scores as (
  select 'fixture' as model, customerID, cast(case when Churn = 'Yes' then 1 else 0 end as integer) as label,
         churn_probability as p from fx_base
  union all
  select 'planted' as model, customerID, cast(case when Churn = 'Yes' then 1 else 0 end as integer) as label,
         planted_probability as p from fx_base),
{_cleaned_cte()},
{_views_cte()},
{_features_cte()},
{_scored_cte(threshold)}
"""


def sql(body: str) -> str:
    return prefix() + body
