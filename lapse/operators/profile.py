"""Customer profile in long form: (customerID, group, attribute, value) rows.

Works on a whole table (or a semi-joined table of ids) with one `stack`
projection; display formats are half-up rounded first, so the text is the
same in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.config import ID_COL
from lapse.functions.columns import round_half_up

# ---------------------------------------------------------------------------
# FIXED VALUES: profile groups and their fields, in display order
PROFILE_GROUPS = [
    ("Account", ["tenure", "Contract", "PaymentMethod", "PaperlessBilling", "is_autopay", "is_longterm_contract"]),
    ("Services", ["InternetService", "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
                  "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies", "service_count"]),
    ("Financials", ["MonthlyCharges", "TotalCharges", "avg_monthly_revenue", "charges_delta", "clv_estimate"]),
    ("Risk scores", ["churn_probability", "revenue_at_risk", "risk_rank", "segment_label", "risk_tier", "value_tier"]),
]
PCT_FIELDS = {"churn_probability"}
MONEY_FIELDS = {"MonthlyCharges", "TotalCharges", "avg_monthly_revenue", "charges_delta", "clv_estimate",
                "revenue_at_risk"}
# ---------------------------------------------------------------------------


def attribute_label(field: str) -> str:
    return field.replace("_", " ").title()


def _text(field: str) -> Column:
    c = F.col(field)
    if field in PCT_FIELDS:
        return F.format_string("%.1f%%", round_half_up(c * 100.0, 1))
    if field in MONEY_FIELDS:
        return F.concat(F.lit("$"), F.format_number(round_half_up(c, 2), 2))
    return c.cast("string")


def customer_profile(display: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Long-form profile of every row of `display` (or only of `ids`, via a left-semi join)."""
    rows = display if ids is None else display.join(ids.select(ID_COL), ID_COL, "left_semi")
    entries = [(g, f) for g, fields in PROFILE_GROUPS for f in fields]
    texts = rows.select(ID_COL, *[F.coalesce(_text(f), F.lit("—")).alias(f"v{i}") for i, (_, f) in enumerate(entries)])
    pairs = ", ".join(f"'{g}', '{attribute_label(f)}', v{i}" for i, (g, f) in enumerate(entries))
    return texts.selectExpr(ID_COL, f"stack({len(entries)}, {pairs}) as (profile_group, attribute, value)")


def lookup(layer: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rows of the given customers, a list that a person names. On a bucketed layer, their buckets and few row groups
    are read (`session.bucketed`), and a join of layers is cut on both sides."""
    return layer.where(F.col(ID_COL).isin(list(ids)))
