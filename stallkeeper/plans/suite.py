"""The marketplace's data checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.operators.checks import Check
from stallkeeper.operators.clean import ORPHAN_PREFIX, ZOMBIE_ID_PREFIX

# fixed values: accepted domains
SEGMENTS = ("whale", "regular", "bargain_hunter", "low_frequency")
ACCOUNT_STATUSES = ("active", "suspended", "closed")
ORDER_STATUSES = ("placed", "paid", "shipped", "in_transit", "delivered", "cancelled", "refunded")
ORDER_CHANNELS = ("web", "mobile_app", "marketplace_api")
PAYMENT_METHODS = ("credit_card", "debit_card", "paypal", "apple_pay", "google_pay", "bank_transfer")
PAYMENT_STATUSES = ("pending", "authorized", "captured", "failed", "refunded", "chargeback")
SHIPPING_METHODS = ("standard", "express", "next_day", "same_day")
RATINGS = (1, 2, 3, 4, 5)
MONTHS = tuple(range(1, 13))
ACTIVITY = ("active", "at_risk", "dormant", "churned", "never_ordered")
HEALTH = ("active", "at_risk", "churned", "no_sales")
RISK_SEGMENTS = ("high_risk", "medium_risk", "low_risk")
ACTIONS = (
    "priority_retention_outreach", "service_recovery_review", "targeted_retention_incentive",
    "standard_retention_campaign", "low_cost_reengagement", "no_immediate_action",
)
REGIONS = ("US", "EU", "LATAM")

Rules = Mapping[str, Mapping[str, Sequence[object]]]


def _expand(rules: Rules) -> list[Check]:
    """``table -> column -> [kind | (kind, values) | "warn"]``."""
    suite = []
    for table, columns in rules.items():
        for column, kinds in columns.items():
            severity = "warn" if "warn" in kinds else "error"
            for kind in kinds:
                if kind == "warn":
                    continue
                if isinstance(kind, str):
                    suite.append(Check(table, kind, column, severity=severity))
                elif kind[0] == "accepted":
                    suite.append(Check(table, "accepted", column, values=tuple(kind[1])))
                else:
                    suite.append(Check(table, "relationship", column, to=kind[1], severity=kind[2]))
    return suite


KEY = ("not_null", "unique")
SET = ("not_null",)


def one_of(values: Sequence[object]) -> tuple:
    return ("not_null", ("accepted", values))


def refers(table: str, column: str, severity: str = "error") -> tuple:
    return ("not_null", ("relationship", (table, column), severity))


def raw_suite() -> list[Check]:
    return _expand({
        "bronze_customers": {"customer_id": SET},
        "bronze_orders": {"order_id": SET},
        "bronze_order_items": {"order_item_id": SET},
        "bronze_sellers": {"seller_id": KEY},
        "bronze_products": {"product_id": KEY},
        "bronze_payments": {"payment_id": SET},
        "bronze_shipments": {"shipment_id": SET},
        "bronze_returns": {"return_id": KEY},
        "bronze_reviews": {"review_id": KEY},
    })


def silver_suite(regions: Sequence[str] = REGIONS) -> list[Check]:
    return _expand({
        "silver_customers": {
            "customer_id": KEY, "customer_external_id": KEY, "region": one_of(regions), "segment": one_of(SEGMENTS),
            "account_status": one_of(ACCOUNT_STATUSES), "signup_date": SET,
        },
        "silver_orders": {
            "order_id": KEY, "customer_id": SET, "order_status": one_of(ORDER_STATUSES),
            "order_channel": one_of(ORDER_CHANNELS), "subtotal": ("not_null", "warn"),
            "total_amount": ("not_null", "warn"), "order_placed_at": SET,
        },
        "silver_order_items": {
            "order_item_id": KEY, "order_id": SET, "product_id": SET, "unit_price": ("not_null", "warn"),
            "line_total": ("not_null", "warn"),
        },
        "silver_payments": {
            "payment_id": KEY, "order_id": SET, "payment_method": one_of(PAYMENT_METHODS),
            "payment_status": one_of(PAYMENT_STATUSES), "amount": SET,
        },
        "silver_shipments": {"shipment_id": KEY, "order_id": SET, "shipping_method": one_of(SHIPPING_METHODS)},
        "silver_sellers": {"seller_id": KEY},
        "silver_products": {"product_id": KEY},
        "silver_returns": {"return_id": KEY},
        "silver_reviews": {"review_id": KEY, "rating": one_of(RATINGS)},
    })


def gold_suite() -> list[Check]:
    return _expand({
        "dim_dates": {"date_day": KEY, "year": SET, "month": one_of(MONTHS)},
        "dim_customers": {"customer_id": KEY, "signup_cohort": SET},
        "dim_sellers": {"seller_id": KEY, "commission_rate": SET},
        "dim_products": {"product_id": KEY, "price": SET, "gross_margin_pct": SET},
        "fact_orders": {
            "order_id": KEY, "customer_id": refers("dim_customers", "customer_id", "warn"), "order_date": SET,
            "total_amount_cents": ("not_null", "warn"),
        },
        "fact_order_items": {
            "order_item_id": KEY, "order_id": SET, "product_id": refers("dim_products", "product_id"),
        },
        "mart_gmv_daily": {"order_date": SET, "gmv_cents": SET, "order_count": SET},
        "mart_customer_ltv": {
            "customer_id": KEY, "total_orders": SET, "lifetime_revenue_cents": ("not_null", "warn"),
            "activity_status": one_of(ACTIVITY),
        },
        "mart_seller_health": {"seller_id": KEY, "total_gmv_cents": SET, "health_status": one_of(HEALTH)},
    })


def score_suite(model_names: Sequence[str] = ("behavioral_only",)) -> list[Check]:
    return _expand({
        "scores": {
            "customer_id": ("not_null", "unique", ("relationship", ("dim_customers", "customer_id"), "error")),
            "score_date": SET, "churn_probability": SET, "predicted_churn_flag": one_of((0, 1)),
            "risk_decile": one_of(tuple(range(1, 11))), "risk_segment": one_of(RISK_SEGMENTS),
            "recommended_action": one_of(ACTIONS), "lifetime_spend_missing_flag": one_of((0, 1)),
            "probability_threshold": SET, "model_name": one_of(model_names), "model_version": SET,
            "scored_at_utc": SET,
        },
    })


# Single-purpose checks: each returns the violating rows.


def negative_gmv(mart_gmv: DataFrame) -> DataFrame:
    keys = ["order_date", "region", "category", "customer_segment", "gmv_cents"]
    return mart_gmv.where("gmv_cents < 0").select(*keys)


def orphan_items(silver_items: DataFrame) -> DataFrame:
    return silver_items.where(F.col("order_id").startswith(ORPHAN_PREFIX)).select("order_item_id")


def zombies_left(silver_customers: DataFrame) -> DataFrame:
    email = F.col("email")
    left = F.col("customer_id").startswith(ZOMBIE_ID_PREFIX) | email.like("%test@test%") | email.like("%@localhost%")
    return silver_customers.where(left).select("customer_id")


def orders_before_signup(fact_orders: DataFrame, dim_customers: DataFrame) -> DataFrame:
    signed = dim_customers.select("customer_id", "signup_date")
    joined = fact_orders.select("order_id", "order_date", "customer_id").join(signed, "customer_id")
    return joined.where("order_date < signup_date").select("order_id", "order_date", "signup_date")


def missing_spend_flag_wrong(scores: DataFrame) -> DataFrame:
    expected = F.when(F.col("lifetime_spend").isNull(), 1).otherwise(0)
    wrong = scores.where(F.col("lifetime_spend_missing_flag") != expected)
    return wrong.select("customer_id", "lifetime_spend", "lifetime_spend_missing_flag")


def probability_out_of_range(scores: DataFrame) -> DataFrame:
    p = F.col("churn_probability")
    return scores.where(p.isNull() | (p < 0) | (p > 1)).select("customer_id", "churn_probability")


def risk_segment_wrong(scores: DataFrame) -> DataFrame:
    d = F.col("risk_decile")
    expected = (
        F.when(d.between(1, 2), "high_risk").when(d.between(3, 5), "medium_risk").when(d.between(6, 10), "low_risk")
    )
    return scores.where(F.col("risk_segment") != expected).select("customer_id", "risk_decile", "risk_segment")


def special_checks(
    mart_gmv: DataFrame, silver_items: DataFrame, silver_customers: DataFrame, fact_orders: DataFrame,
    dim_customers: DataFrame,
) -> dict[Check, DataFrame]:
    return {
        Check("mart_gmv_daily", "non_negative", "gmv"): negative_gmv(mart_gmv),
        Check("silver_order_items", "no_orphans", "order_id"): orphan_items(silver_items),
        Check("silver_customers", "no_zombies", "customer_id"): zombies_left(silver_customers),
        Check("fact_orders", "after_signup", "order_date", severity="warn"): orders_before_signup(
            fact_orders, dim_customers
        ),
    }


def score_checks(scores: DataFrame) -> dict[Check, DataFrame]:
    return {
        Check("scores", "flag_matches", "lifetime_spend_missing_flag"): missing_spend_flag_wrong(scores),
        Check("scores", "in_unit_range", "churn_probability"): probability_out_of_range(scores),
        Check("scores", "matches_decile", "risk_segment"): risk_segment_wrong(scores),
    }
