"""Schemas, feature lists and the fixed business constants.

Every value in the "fixed values" blocks must equal the original churn
pipeline's for results to match; they are stated here once, in natural order.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Category codes
# --------------------------------------------------------------------------
GEOGRAPHY_CODES = {"France": 0, "Germany": 1, "Spain": 2}
GENDER_CODES = {"Female": 0, "Male": 1}

# --------------------------------------------------------------------------
# Model feature list, in model order (label excluded)
# --------------------------------------------------------------------------
FEATURES = [
    "CreditScore", "Geography", "Gender", "Age", "Tenure",
    "Balance", "NumOfProducts", "HasCrCard", "IsActiveMember",
    "EstimatedSalary",
    "balance_salary_ratio", "products_per_year", "age_group",
    "engagement_score", "credit_score_band", "is_zero_balance",
    "high_value_customer", "tenure_stability", "age_tenure_ratio",
    "inactive_high_balance", "clv_estimated",
]
ENGINEERED = FEATURES[10:]
LABEL = "Exited"
ID_COLS = ["RowNumber", "CustomerId"]

# --------------------------------------------------------------------------
# Display labels for risk factors (others are title-cased)
# --------------------------------------------------------------------------
RISK_LABELS = {
    "inactive_high_balance": "Inactive account with high balance",
    "is_zero_balance": "Zero account balance",
    "engagement_score": "Low product engagement",
    "age_group": "Customer age above 45",
    "NumOfProducts": "Too many products (overexposed)",
    "tenure_stability": "Short customer relationship",
    "balance_salary_ratio": "Disproportionate balance vs income",
    "Geography": "German market (higher churn segment)",
    "IsActiveMember": "Inactive member",
    "Age": "Customer age risk factor",
    "Balance": "Balance level risk",
    "CreditScore": "Credit score risk",
}

# --------------------------------------------------------------------------
# Recommended actions, rule 1..6 in priority order
# --------------------------------------------------------------------------
ACTIONS = {
    1: "Priority call: offer wealth management consultation",
    2: "Offer savings account with bonus interest rate",
    3: "Send personalized product recommendation email",
    4: "Assign dedicated senior relationship manager",
    5: "Review product portfolio — simplify offering",
    6: "Standard retention: loyalty reward or fee waiver",
}

# --------------------------------------------------------------------------
# Dashboard display labels for coded columns
# --------------------------------------------------------------------------
GEOGRAPHY_LABELS = {0: "France", 1: "Germany", 2: "Spain"}
GENDER_LABELS = {0: "Female", 1: "Male"}
AGE_GROUP_LABELS = {0: "Young (18-30)", 1: "Prime (31-45)", 2: "Senior (46-60)", 3: "Elderly (61+)"}
TENURE_LABELS = {0: "New (0-2yr)", 1: "Developing (3-5yr)", 2: "Loyal (6+yr)"}
CREDIT_LABELS = {0: "Poor (<580)", 1: "Fair (580-669)", 2: "Good (670-739)",
                 3: "Very Good (740-799)", 4: "Exceptional (800+)"}

# --------------------------------------------------------------------------
# Business parameters
# --------------------------------------------------------------------------
RISK_HIGH = 0.6
RISK_MEDIUM = 0.35
RETENTION_SUCCESS_RATE = 0.30
OUTREACH_COST = 10.0
DEFAULT_THRESHOLD = 0.5
HIGH_BALANCE = 50_000.0
MODEL_VERSION_SUFFIX = "2.0.0"

# Threshold grid: numpy's arange(0.2, 0.81, 0.01), 62 points ending at 0.81
# (float overshoot).  Sweeps compare against the raw values; the F1 column
# and reported thresholds use the values rounded to 2 digits.
THRESHOLD_GRID_RAW = [float(t) for t in np.arange(0.2, 0.81, 0.01)]
THRESHOLD_GRID = [round(t, 2) for t in THRESHOLD_GRID_RAW]

# --------------------------------------------------------------------------
# CLV profiles (training and serving), see features.clv
# keys: salary rate, per-product multiplier, per-year tenure multiplier,
#       balance rate (per 1000), credit bonus, lower clip, upper clip
# --------------------------------------------------------------------------
CLV_TRAINING = dict(salary=0.03, product=0.2, tenure=0.08, balance=0.01, credit=0.3, lo=50.0, hi=5_000.0)
CLV_SERVING = dict(salary=0.05, product=0.3, tenure=0.1, balance=0.02, credit=0.5, lo=100.0, hi=10_000.0)

# --------------------------------------------------------------------------
# Scorecard logit terms (intercept -4.5)
# --------------------------------------------------------------------------
SCORECARD_INTERCEPT = -4.5
SCORECARD_WEIGHTS = {
    "germany": 1.5,
    "inactive": 1.3,
    "age_over_60": 1.0,
    "age_over_45": 0.5,
    "inactive_high_balance": 1.8,
    "products_3_plus": 0.8,
    "tenure_2_or_less": 0.5,
    "credit_below_580": 0.4,
}

# --------------------------------------------------------------------------
# Request contract bounds (inclusive unless noted)
# --------------------------------------------------------------------------
CONTRACT_BOUNDS = {
    "CreditScore": (300, 850),
    "Age": (18, 95),
    "Tenure": (0, 10),
    "NumOfProducts": (1, 4),
    "HasCrCard": (0, 1),
    "IsActiveMember": (0, 1),
}
# Balance >= 0, EstimatedSalary > 0 (strict)

# What-if defaults for missing inputs
WHATIF_DEFAULTS = dict(CreditScore=650, Geography="France", Gender="Male", Age=40, Tenure=5,
                       Balance=0.0, NumOfProducts=1, HasCrCard=1, IsActiveMember=1,
                       EstimatedSalary=50_000.0)

# Data-quality gate defaults
LABEL_RATE_RANGE = (0.15, 0.25)

# --------------------------------------------------------------------------
# Struct types
# --------------------------------------------------------------------------
RAW_SCHEMA = T.StructType([
    T.StructField("RowNumber", T.LongType()),
    T.StructField("CustomerId", T.LongType()),
    T.StructField("Surname", T.StringType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.IntegerType()),
    T.StructField("HasCrCard", T.IntegerType()),
    T.StructField("IsActiveMember", T.IntegerType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
    T.StructField("Exited", T.IntegerType()),
])

REQUEST_SCHEMA = T.StructType([
    T.StructField("CustomerId", T.LongType()),
    T.StructField("CreditScore", T.IntegerType()),
    T.StructField("Geography", T.StringType()),
    T.StructField("Gender", T.StringType()),
    T.StructField("Age", T.IntegerType()),
    T.StructField("Tenure", T.IntegerType()),
    T.StructField("Balance", T.DoubleType()),
    T.StructField("NumOfProducts", T.IntegerType()),
    T.StructField("HasCrCard", T.IntegerType()),
    T.StructField("IsActiveMember", T.IntegerType()),
    T.StructField("EstimatedSalary", T.DoubleType()),
])

_INT_FEATURES = {"CreditScore", "Geography", "Gender", "Age", "Tenure", "NumOfProducts", "HasCrCard",
                 "IsActiveMember", "age_group", "credit_score_band", "is_zero_balance",
                 "high_value_customer", "tenure_stability", "inactive_high_balance"}

FEATURE_SCHEMA = T.StructType(
    [T.StructField("RowNumber", T.LongType()), T.StructField("CustomerId", T.LongType())]
    + [T.StructField(f, T.IntegerType() if f in _INT_FEATURES else T.DoubleType()) for f in FEATURES]
    + [T.StructField(LABEL, T.IntegerType())]
)
