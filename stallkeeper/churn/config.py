"""Column groups and settings of the churn model."""

from __future__ import annotations

# fixed values: names of features in model order, of snapshot columns and of models
NUMERIC_FEATURES = (
    "days_since_last_order", "days_since_first_order", "total_orders", "orders_last_30d", "orders_last_90d",
    "avg_days_between_orders", "lifetime_spend", "avg_order_value", "spend_last_90d", "spend_trend", "category_count",
    "historical_item_count", "discount_order_rate", "return_count", "return_order_rate", "return_item_rate",
    "review_count", "avg_rating_given", "late_delivery_count", "avg_delivery_delay", "customer_tenure_days",
)
BINARY_FEATURES = ("is_single_order_customer", "has_return", "has_review", "has_completed_delivery")
CHANNEL_FEATURES = ("signup_channel",)
BEHAVIORAL_FEATURES = NUMERIC_FEATURES + BINARY_FEATURES

ID, SNAPSHOT, LABEL, WINDOW_ORDERS = "customer_id", "snapshot_date", "churned", "orders_in_prediction_window"

SNAPSHOT_COLUMNS = (
    ID, SNAPSHOT, "signup_channel", "segment", "region", "signup_date", "customer_tenure_days",
    "days_since_last_order", "days_since_first_order", "total_orders", "orders_last_30d", "orders_last_90d",
    "avg_days_between_orders", "lifetime_spend", "avg_order_value", "spend_last_90d", "spend_trend", "category_count",
    "historical_item_count", "discount_order_rate", "return_count", "return_order_rate", "return_item_rate",
    "has_return", "review_count", "avg_rating_given", "has_review", "late_delivery_count", "avg_delivery_delay",
    "has_completed_delivery", "is_single_order_customer", WINDOW_ORDERS, LABEL,
)

#: what identifies a row, knows its future, or decides the label by construction: all columns that are no feature, but for region
FORBIDDEN_FEATURES = tuple(c for c in SNAPSHOT_COLUMNS if c not in (*NUMERIC_FEATURES, *BINARY_FEATURES, *CHANNEL_FEATURES, "region"))

CHURN_WINDOW_DAYS = 90
MODEL_NAMES = {"behavioral": "behavioral_only", "channel": "behavioral_plus_channel"}
MODEL_VERSION = "churn_v1"
SCORE_THRESHOLD = 0.30
