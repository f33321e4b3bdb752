"""Closed vocabularies and fixed values shared by the operators.

Every literal here is a fixed value: results depend on the exact spelling, so the lists are written out plainly.
"""

from __future__ import annotations

# Rule categories.
RULE_CATEGORIES = ("completeness", "format", "consistency", "accuracy", "uniqueness", "privacy", "custom")

# Kinds of personal data.
PII_TYPES = (
    "name", "email", "phone", "address", "ssn", "date_of_birth", "ip_address", "credit_card",
    "account_number", "username", "password", "other", "not_pii",
)

# Severity per kind of personal data; every kind that is not listed has severity 3.
PII_SEVERITY = {
    "ssn": 5, "credit_card": 5, "password": 5,
    "date_of_birth": 4, "email": 4, "phone": 4, "address": 4,
}
PII_SEVERITY_DEFAULT = 3

# A column whose lower-cased name holds one of these is treated as personal data.
PII_NAME_INDICATORS = (
    "ssn", "social", "tax", "id", "ident", "passport", "license",
    "account", "user", "email", "phone", "mobile", "address", "zip",
    "postal", "name", "first", "last", "birth", "dob", "credit", "card",
    "password", "secret", "token", "ip", "location", "geo",
)

# Inferred types that are personal data whatever the column is called.
PII_SEMANTIC_TYPES = ("email", "phone", "ip_address")

# Patterns for semantic types, tested in this order.
SEMANTIC_PATTERNS = (
    ("email", r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"),
    ("phone", r"^\+?[\d\s\(\)\-]{7,20}$"),
    ("url", r"^(http|https)://"),
    ("zip_code", r"^\d{5}(-\d{4})?$"),
    ("ip_address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"),
)

# Value patterns that mark a text column as personal data.
PII_VALUE_PATTERNS = (
    r"^\d{3}-\d{2}-\d{4}$",
    r"^\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}$",
)

# Detection patterns of the default rule catalogue.
CATALOGUE_PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone": r"(\+\d{1,3}[\s-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$",
    "date_of_birth": r"^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
}

# Quality dimensions and the words that select them; the first dimension with a hit wins.
QUALITY_DIMENSIONS = (
    ("Completeness", ("completeness", "missing", "null", "isnotnull")),
    ("Accuracy", ("accuracy", "entropy", "zscore", "outlier", "anomaly", "mean", "sum", "count")),
    ("Consistency", ("consistency", "standarddeviation", "variance", "correlation")),
    ("Validity", ("validity", "minimum", "maximum", "datatype", "pattern", "regex")),
    ("Uniqueness", ("uniqueness", "countdistinct", "distinctness", "duplicate")),
    ("Timeliness", ("timeliness", "freshness", "lag", "delay", "timestamp")),
)
QUALITY_DIMENSION_DEFAULT = "Accuracy"

# Dimensions of the error report, where one metric may belong to several.
ERROR_DIMENSIONS = (
    ("Completeness", ("count", "records", "null", "missing")),
    ("Uniqueness", ("duplicate", "unique")),
    ("Validity", ("format", "range", "min", "max")),
    ("Accuracy", ("mean", "median", "quantile")),
    ("Consistency", ("correlation",)),
)

# Engineered suffixes removed from a metric name to find the raw metric.
DERIVED_SUFFIXES = (
    "_rolling_7d_mean", "_rolling_14d_mean", "_rolling_30d_mean",
    "_rolling_7d_std", "_zscore_7d", "_zscore_14d", "_zscore_30d",
    "_ratio_7d", "_ratio_14d", "_ratio_30d", "_diff_7d", "_diff_14d",
    "_lag_1d", "_lag_2d", "_lag_3d", "_diff_lag_1d", "_diff_lag_2d", "_diff_lag_3d",
)

# Names that mark a metric as derived, so that no lag is built on it.
LAG_EXCLUDED_MARKS = (
    "_rolling_", "_zscore_", "_anomaly_", "_diff_", "_ratio_", "_trend_", "_mean", "_std", "_min", "_max",
)

# Metric suffixes read by the target feature selection, and the engineered fall-back.
TARGET_BASE_SUFFIXES = ("_Mean", "_StandardDeviation", "_ApproxQuantiles", "_CountDistinct")
TARGET_ENGINEERED_SUFFIXES = (
    "_Mean_zscore_7d", "_StandardDeviation_zscore_7d", "_Completeness_anomaly_7d", "_CountDistinct_anomaly_7d",
)

# Metric names whose rate of change is watched.
RATE_MARKS = ("_pct", "_mean", "_total", "_count", "_ratio")


def pii_severity(pii_type: str) -> int:
    """Default severity (1-5) of a kind of personal data."""
    return PII_SEVERITY.get(pii_type, PII_SEVERITY_DEFAULT)
