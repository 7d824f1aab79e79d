"""Cleaned tables out of raw ones."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.operators import clean as c
from stallkeeper.operators.dedupe import dedupe

CUSTOMER_COLUMNS = (
    "customer_id", "customer_external_id", "email", "first_name", "last_name", "region", "country_code", "segment",
    "signup_date", "signup_channel", "account_status", "created_at", "updated_at", "promo_code", "loyalty_points",
    "referral_source",
)
ORDER_COLUMNS = (
    "order_id", "order_number", "customer_id", "region", "order_status", "order_channel", "device_type",
    "order_placed_at", "currency", "subtotal", "discount_amount", "tax_amount", "shipping_cost", "total_amount",
    "item_count", "is_first_order", "created_at", "updated_at", "ingestion_delay_days", "is_late_arrival",
    "_has_negative_shipping", "_has_impossible_discount",
)
ITEM_COLUMNS = (
    "order_item_id", "order_id", "product_id", "seller_id", "category", "quantity", "_had_negative_quantity",
    "unit_price", "unit_cost", "discount_amount", "tax_amount", "line_total",
)
PAYMENT_COLUMNS = (
    "payment_id", "order_id", "payment_method", "card_brand", "payment_status", "amount", "currency", "processor",
    "processor_transaction_id", "attempted_at", "completed_at", "failure_reason", "is_retry", "retry_of_payment_id",
    "created_at", "updated_at",
)
SHIPMENT_COLUMNS = (
    "shipment_id", "order_id", "carrier", "tracking_number", "shipping_method", "status", "shipped_at",
    "estimated_delivery_at", "delivered_at", "weight_kg", "shipping_cost", "is_international", "delay_days",
    "delivery_attempts", "created_at", "updated_at",
)


def silver_customers(raw: DataFrame, keep: str = "first") -> DataFrame:
    df = c.remove_zombies(raw)
    df = c.conform_schema(df, {"cust_ext_id": "customer_external_id"}, ["promo_code", "loyalty_points", "referral_source"])
    df = c.standardize_nulls(df, ["email", "first_name", "last_name", "signup_channel"]).select(*CUSTOMER_COLUMNS)
    return dedupe(df, "customer_external_id", "updated_at", "customer_id", keep)


def silver_orders(raw: DataFrame) -> DataFrame:
    df = c.standardize_nulls(raw, ["order_number", "currency"])
    df = c.clean_numbers(df, ["subtotal", "discount_amount", "shipping_cost", "total_amount"])
    df = c.flag_late_arrivals(df)
    rules = {
        "_has_negative_shipping": F.col("shipping_cost") < 0,
        "_has_impossible_discount": F.col("discount_amount") > F.col("subtotal"),
    }
    df = c.flag_business_rules(df, rules).select(*ORDER_COLUMNS)
    return dedupe(df, "order_number", "updated_at", "order_id", "last", drop_null_key=True)


def silver_order_items(raw: DataFrame) -> DataFrame:
    df = c.null_negative(c.remove_orphan_ids(raw, "order_id"), "quantity", "_had_negative_quantity")
    return c.clean_numbers(df, ["unit_price", "unit_cost", "line_total"]).select(*ITEM_COLUMNS)


def silver_payments(raw: DataFrame) -> DataFrame:
    df = c.standardize_nulls(c.remove_orphan_ids(raw, "order_id"), ["card_brand", "failure_reason"])
    # attempts that share an id and a time differ by transaction
    return dedupe(df.select(*PAYMENT_COLUMNS), "payment_id", "updated_at", "processor_transaction_id", "last")


def silver_shipments(raw: DataFrame) -> DataFrame:
    df = c.standardize_nulls(raw, ["carrier", "tracking_number"])
    return dedupe(df.select(*SHIPMENT_COLUMNS), "shipment_id", "updated_at", "order_id", "last")


def silver_reviews(raw: DataFrame) -> DataFrame:
    return c.remove_orphan_ids(raw, "product_id")


def silver_passthrough(raw: DataFrame) -> DataFrame:
    return raw


BUILDERS = {
    "customers": silver_customers,
    "orders": silver_orders,
    "order_items": silver_order_items,
    "payments": silver_payments,
    "shipments": silver_shipments,
    "reviews": silver_reviews,
    "sellers": silver_passthrough,
    "products": silver_passthrough,
    "returns": silver_passthrough,
}


def silver(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    return {name: build(raw[name]) for name, build in BUILDERS.items()}
