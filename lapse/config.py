"""Constants, vocabularies and the raw schema of the subscriber table.

Everything that must equal the original pipeline's values for identical
results is collected in the FIXED VALUES block below, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the original pipeline for identical results)
# ---------------------------------------------------------------------------
ID_COL = "customerID"
TARGET_COL = "Churn"
SEED = 42
CV_FOLDS = 5
HIGH_VALUE_PERCENTILE = 0.50
DEFAULT_INTERVENTION_COST = 50.0
DEFAULT_SAVE_RATE = 0.30
DEFAULT_BUDGET = 5_000.0
DEFAULT_LIFETIME_MONTHS = 12
OUTLIER_IQR_MULTIPLIER = 3.0
CLV_MONTHS = 24

TENURE_BINS = [0, 12, 24, 48, 72]
TENURE_LABELS = ["0-12 mo", "13-24 mo", "25-48 mo", "49+ mo"]

# (risk_tier, value_tier) -> label, priority, action, color
SEGMENTS = [
    ("high_risk", "high_value", "Save Immediately", 1,
     "Personal outreach + tailored discount offer", "#d62728"),
    ("high_risk", "low_value", "Assess & Offer", 2,
     "Self-serve retention offer or automated email", "#ff7f0e"),
    ("low_risk", "high_value", "Nurture & Upsell", 3,
     "Loyalty program or upgrade promotion", "#2ca02c"),
    ("low_risk", "low_value", "Monitor Only", 4,
     "No immediate action — standard lifecycle comms", "#7f7f7f"),
]

# services counted by service_count (before encoding)
SERVICE_COLS = [
    "PhoneService", "MultipleLines", "OnlineSecurity", "OnlineBackup",
    "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies",
]
# Yes -> 1, everything else -> 0
BINARY_COLS = [
    "Partner", "Dependents", "PhoneService", "PaperlessBilling",
    "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies", "MultipleLines",
]
# one-hot sources and their vocabularies (dummy columns in sorted value order)
ONE_HOT = {
    "gender": ["Female", "Male"],
    "InternetService": ["DSL", "Fiber optic", "No"],
    "Contract": ["Month-to-month", "One year", "Two year"],
    "PaymentMethod": [
        "Bank transfer (automatic)", "Credit card (automatic)",
        "Electronic check", "Mailed check",
    ],
}
# services reported by the adoption query of the SQL pack
ADOPTION_SERVICES = [
    "PhoneService", "OnlineSecurity", "OnlineBackup", "DeviceProtection",
    "TechSupport", "StreamingTV", "StreamingMovies",
]
# columns never used as model inputs
NON_MODEL_COLS = {"customerID", "Churn", "tenure_band", "is_high_value", "is_charges_outlier"}
REQUIRED_RAW_COLS = {"customerID", "Churn", "MonthlyCharges", "TotalCharges", "tenure"}

# threshold search grid: i/100 for i in 10..70
THRESHOLD_GRID = (10, 70)
DEFAULT_THRESHOLD = 0.5

# budget scenario lists of the batch report and of the simulator table
PIPELINE_BUDGETS = [2_500, 5_000, 10_000, 25_000]
SIMULATOR_BUDGETS = [1_000, 2_500, 5_000, 10_000, 25_000, 50_000]
IMPACT_MAX_BUDGET = 50_000
IMPACT_STEP = 500

# risk-factor flags of the new-customer view, in display order
RISK_FACTORS = [
    "Month-to-month contract",
    "Short tenure (< 12 months)",
    "Fiber optic internet",
    "Electronic check payment",
    "No online security",
    "No tech support",
    "High monthly charges",
    "Not on auto-pay",
]
PROTECTIVE_SHOWN = 5

# model settings (original values; the quick profile is for checks on small data)
LOGISTIC_C = 0.5
LOGISTIC_MAX_ITER = 2000
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 400, 10, 8
GBT_ROUNDS, GBT_DEPTH, GBT_STEP, GBT_SUBSAMPLE, GBT_COLSAMPLE, GBT_MIN_CHILD = 400, 4, 0.04, 0.8, 0.8, 5
TOP_FEATURES = 15
# ---------------------------------------------------------------------------

# Model names used throughout (display name -> key)
MODEL_KEYS = ["logistic", "random_forest", "gbt"]

# Explicit raw schema: never infer.
RAW_SCHEMA = T.StructType([
    T.StructField("customerID", T.StringType()),
    T.StructField("gender", T.StringType()),
    T.StructField("SeniorCitizen", T.IntegerType()),
    T.StructField("Partner", T.StringType()),
    T.StructField("Dependents", T.StringType()),
    T.StructField("tenure", T.IntegerType()),
    T.StructField("PhoneService", T.StringType()),
    T.StructField("MultipleLines", T.StringType()),
    T.StructField("InternetService", T.StringType()),
    T.StructField("OnlineSecurity", T.StringType()),
    T.StructField("OnlineBackup", T.StringType()),
    T.StructField("DeviceProtection", T.StringType()),
    T.StructField("TechSupport", T.StringType()),
    T.StructField("StreamingTV", T.StringType()),
    T.StructField("StreamingMovies", T.StringType()),
    T.StructField("Contract", T.StringType()),
    T.StructField("PaperlessBilling", T.StringType()),
    T.StructField("PaymentMethod", T.StringType()),
    T.StructField("MonthlyCharges", T.DoubleType()),
    T.StructField("TotalCharges", T.StringType()),
    T.StructField("Churn", T.StringType()),
])
RAW_COLUMNS = [f.name for f in RAW_SCHEMA.fields]


def one_hot_columns() -> list[str]:
    """Dummy column names, `<source>_<value>`, in source then value order."""
    return [f"{src}_{v}" for src, vals in ONE_HOT.items() for v in vals]
