"""Declared schemas of the raw entities and of the score table."""

from __future__ import annotations

from pyspark.sql.types import StructType

# fixed values: column names and types of the source files; drifted amounts arrive as text
_DDL = {
    "customers": "customer_id string, cust_ext_id string, email string, first_name string, last_name string, "
    "region string, country_code string, segment string, signup_date date, signup_channel string, "
    "account_status string, created_at timestamp_ntz, updated_at timestamp_ntz, promo_code string, "
    "loyalty_points string, referral_source string",
    "sellers": "seller_id string, seller_external_id string, business_name string, seller_type string, tier string, "
    "onboarding_date date, sales_profile string, sales_end_date date, region string, country_code string, "
    "primary_category string, avg_rating double, total_reviews bigint, is_verified boolean, is_suspended boolean, "
    "commission_rate double, created_at timestamp_ntz, updated_at timestamp_ntz",
    "products": "product_id string, product_sku string, seller_id string, product_name string, category string, "
    "subcategory string, brand string, price double, cost double, weight_kg double, avg_rating double, "
    "review_count bigint, return_rate double, is_active boolean, launch_date date, created_at timestamp_ntz, "
    "updated_at timestamp_ntz",
    "orders": "order_id string, order_number string, customer_id string, region string, order_status string, "
    "order_channel string, device_type string, order_placed_at timestamp_ntz, currency string, subtotal string, "
    "discount_amount string, tax_amount double, shipping_cost string, total_amount string, item_count bigint, "
    "is_first_order boolean, created_at timestamp_ntz, updated_at timestamp_ntz, _ingestion_delay_days int",
    "order_items": "order_item_id string, order_id string, product_id string, seller_id string, category string, "
    "quantity int, unit_price string, unit_cost string, discount_amount double, tax_amount double, line_total string",
    "payments": "payment_id string, order_id string, payment_method string, card_brand string, payment_status string, "
    "amount double, currency string, processor string, processor_transaction_id string, attempted_at timestamp_ntz, "
    "completed_at timestamp_ntz, failure_reason string, is_retry boolean, retry_of_payment_id string, "
    "created_at timestamp_ntz, updated_at timestamp_ntz",
    "shipments": "shipment_id string, order_id string, carrier string, tracking_number string, shipping_method string, "
    "status string, shipped_at timestamp_ntz, estimated_delivery_at timestamp_ntz, delivered_at timestamp_ntz, "
    "weight_kg double, shipping_cost double, is_international boolean, delay_days bigint, delivery_attempts int, "
    "created_at timestamp_ntz, updated_at timestamp_ntz",
    "returns": "return_id string, order_id string, order_item_id string, customer_id string, product_id string, "
    "category string, return_reason string, return_status string, initiated_at timestamp_ntz, "
    "received_at timestamp_ntz, refund_amount double, is_partial_refund boolean, created_at timestamp_ntz, "
    "updated_at timestamp_ntz",
    "reviews": "review_id string, order_id string, order_item_id string, product_id string, customer_id string, "
    "seller_id string, rating int, title string, review_text string, is_verified_purchase boolean, "
    "helpful_votes bigint, total_votes bigint, submitted_at timestamp_ntz, created_at timestamp_ntz, "
    "updated_at timestamp_ntz",
}

_SCORES_DDL = (
    "customer_id string, score_date date, signup_channel string, region string, segment string, "
    "days_since_last_order int, total_orders int, orders_last_90d int, lifetime_spend double, "
    "return_order_rate double, discount_order_rate double, is_single_order_customer int, churn_probability double, "
    "predicted_churn_flag int, risk_decile int, risk_segment string, recommended_action string, "
    "lifetime_spend_missing_flag int, probability_threshold double, model_name string, model_version string, "
    "scored_at_utc timestamp_ntz"
)

ENTITIES = tuple(_DDL)


def raw_schema(entity: str) -> StructType:
    return StructType.fromDDL(_DDL[entity])


def raw_columns(entity: str) -> dict[str, str]:
    """Names and types as text, also without a session."""
    return dict(column.split(" ") for column in _DDL[entity].split(", "))


def score_schema() -> StructType:
    return StructType.fromDDL(_SCORES_DDL)
