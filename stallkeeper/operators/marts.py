"""Gold marts.

Several distinct counts in one group-by would make Spark expand every row once per count. The marts
group by (mart key, order) first: that step is mostly done map-side or reuses the fact join's
partitioning, and it also spreads a hot customer or seller over many tasks.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import div_half_up, mean_dollars, pct, recency_band, sum_if
from stallkeeper.operators.facts import eligible, margin_cents

ACTIVITY = ((30, 90, 180), ("active", "at_risk", "dormant", "churned"), "never_ordered")
HEALTH = ((30, 90), ("active", "at_risk", "churned"), "no_sales")


def item_sums() -> list[Column]:
    """Additive item measures shared by marts and reports."""
    gmv, margin = F.col("is_gmv_valid"), F.col("is_margin_valid")
    return [
        F.max(gmv.cast("int")).alias("any_valid"),
        sum_if(F.col("quantity").cast("bigint"), gmv).alias("items_sold"),
        F.count_if(~gmv).alias("invalid_gmv_item_count"),
        F.count_if(~margin).alias("invalid_margin_item_count"),
        F.count_if(gmv).alias("valid_items"),
        sum_if(F.col("gross_gmv_cents"), gmv).alias("gross_gmv_cents"),
        sum_if(F.col("net_gmv_cents"), gmv).alias("net_gmv_cents"),
        sum_if(F.col("discount_amount_cents"), gmv).alias("total_discounts_cents"),
        sum_if(F.coalesce("tax_amount_cents", F.lit(0)), gmv).alias("total_item_tax_cents"),
        sum_if(F.col("merchandise_cost_cents"), margin).alias("total_cost_cents"),
        sum_if(margin_cents(), margin).alias("gross_profit_cents"),
        sum_if(F.col("net_gmv_cents"), margin).alias("margin_net_gmv_cents"),
    ]


ITEM_SUMS = (
    "items_sold", "invalid_gmv_item_count", "invalid_margin_item_count", "valid_items", "gross_gmv_cents",
    "net_gmv_cents", "total_discounts_cents", "total_item_tax_cents", "total_cost_cents", "gross_profit_cents",
    "margin_net_gmv_cents",
)


def item_measures(
    fact_items: DataFrame, by: list[str | Column], extra: list[str] | None = None, orders: bool = True
) -> DataFrame:
    """Measures of eligible items per ``by``, with exact distinct orders (all and financially valid).

    ``orders=False`` leaves the order counts out and needs only one small shuffle.
    """
    names = ["_k%d" % i for i in range(len(by))]
    keyed = eligible(fact_items).withColumns(
        {n: (F.col(b) if isinstance(b, str) else b) for n, b in zip(names, by)}
    )
    if not orders:
        return keyed.groupBy(*names).agg(*item_sums())
    per_order = keyed.groupBy(*names, "order_id", *(extra or [])).agg(*item_sums())
    distinct = [F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in (extra or [])]
    return per_order.groupBy(*names).agg(
        F.count("order_id").alias("order_count"),
        F.sum("any_valid").alias("financially_valid_order_count"),
        *distinct,
        *[F.sum(c).alias(c) for c in ITEM_SUMS],
    )


def mart_gmv_daily(fact_items: DataFrame) -> DataFrame:
    keys = ["order_date", "region", "category", "customer_segment"]
    m = item_measures(fact_items, keys, extra=["customer_id"])
    net, margin_net = F.col("net_gmv_cents"), F.col("margin_net_gmv_cents")
    return m.select(
        *[F.col("_k%d" % i).alias(k) for i, k in enumerate(keys)],
        "order_count",
        "financially_valid_order_count",
        F.col("distinct_customer_id").alias("customer_count"),
        "items_sold",
        "invalid_gmv_item_count",
        "invalid_margin_item_count",
        "gross_gmv_cents",
        net,
        net.alias("gmv_cents"),
        "total_discounts_cents",
        "total_item_tax_cents",
        "total_cost_cents",
        "gross_profit_cents",
        mean_dollars(net, F.col("valid_items")).alias("avg_item_value"),
        F.when(margin_net > 0, pct(F.col("gross_profit_cents"), margin_net, 2)).otherwise(0.0).alias("gross_margin_pct"),
    )


def mart_customer_ltv(dim_customers: DataFrame, fact_orders: DataFrame, as_of: dt.date) -> DataFrame:
    per_order = (
        eligible(fact_orders)
        .groupBy("customer_id", "order_id")
        .agg(
            F.count("total_amount_cents").alias("paid_rows"),
            F.sum("total_amount_cents").alias("amount"),
            F.max(F.col("total_amount_cents").isNull().cast("int")).alias("has_null"),
            F.min("order_date").alias("first_date"),
            F.max("order_date").alias("last_date"),
        )
    )
    per_customer = per_order.groupBy("customer_id").agg(
        F.count("order_id").alias("total_orders"),
        F.count_if(F.col("paid_rows") > 0).alias("financially_valid_orders"),
        F.sum("has_null").alias("invalid_financial_orders"),
        F.min("first_date").alias("first_order_date"),
        F.max("last_date").alias("last_order_date"),
        F.coalesce(F.sum("amount"), F.lit(0)).alias("spend"),
        F.sum("paid_rows").alias("paid_rows"),
    )
    days = F.datediff(F.lit(as_of), F.col("last_order_date")).cast("bigint")
    zero = F.lit(0).cast("bigint")
    orders = F.coalesce("total_orders", zero)
    return dim_customers.join(per_customer, "customer_id", "left").select(
        "customer_id",
        "customer_external_id",
        "region",
        "segment",
        "signup_cohort",
        "signup_channel",
        "is_unknown_customer",
        orders.alias("total_orders"),
        F.coalesce("financially_valid_orders", zero).alias("financially_valid_orders"),
        F.coalesce("invalid_financial_orders", zero).alias("invalid_financial_orders"),
        "first_order_date",
        "last_order_date",
        F.coalesce("spend", zero).alias("lifetime_customer_spend_cents"),
        F.coalesce("spend", zero).alias("lifetime_revenue_cents"),
        mean_dollars(F.col("spend"), F.col("paid_rows")).alias("avg_order_value"),
        (orders > 1).alias("is_repeat_customer"),
        F.datediff("last_order_date", "first_order_date").cast("bigint").alias("customer_lifespan_days"),
        days.alias("days_since_last_order"),
        recency_band(days, *ACTIVITY).alias("activity_status"),
    )


def mart_seller_health(dim_sellers: DataFrame, fact_items: DataFrame, as_of: dt.date) -> DataFrame:
    valid = F.col("is_gmv_valid")
    sales = eligible(fact_items)
    # by order first, which facts stored in buckets of order_id need no exchange for, and by product beside it
    per_order = sales.groupBy("seller_id", "order_id").agg(
        sum_if(F.col("quantity").cast("bigint"), valid).alias("qty"),
        sum_if(F.col("net_gmv_cents"), valid).alias("net"),
        sum_if(F.col("gross_gmv_cents"), valid).alias("gross"),
        F.count_if(~valid).alias("bad"),
        F.count_if(valid).alias("good"),
        F.min("order_date").alias("first_date"),
        F.max("order_date").alias("last_date"),
    )
    per_seller = per_order.groupBy("seller_id").agg(
        F.count("order_id").alias("total_orders"),
        *[F.sum(c).alias(c) for c in ("qty", "net", "gross", "bad", "good")],
        F.min("first_date").alias("first_sale_date"),
        F.max("last_date").alias("last_sale_date"),
    )
    products = sales.where(valid & F.col("product_id").isNotNull()).groupBy("seller_id", "product_id").agg(F.count("*").alias("n"))
    sold = products.groupBy("seller_id").agg(F.count("*").alias("active_products_sold"))
    per_seller = per_seller.join(sold, "seller_id", "left")
    zero = F.lit(0).cast("bigint")
    basis_points = F.floor(F.coalesce("commission_rate", F.lit(0.0)) * F.lit(10000.0) + F.lit(0.5))
    days = F.datediff(F.lit(as_of), F.col("last_sale_date")).cast("bigint")
    net = F.coalesce("net", zero)
    return dim_sellers.join(per_seller, "seller_id", "left").select(
        "seller_id",
        "seller_external_id",
        "business_name",
        "tier",
        "seller_type",
        "region",
        "primary_category",
        "commission_rate",
        "avg_rating",
        "onboarding_cohort",
        F.coalesce("total_orders", zero).alias("total_orders"),
        F.coalesce("qty", zero).alias("total_items_sold"),
        net.alias("total_gmv_cents"),
        F.coalesce("gross", zero).alias("gross_gmv_cents"),
        net.alias("net_gmv_cents"),
        div_half_up(net * basis_points, 10000).alias("commission_revenue_cents"),
        F.coalesce("bad", zero).alias("invalid_financial_item_count"),
        F.coalesce("active_products_sold", zero).alias("active_products_sold"),
        mean_dollars(F.col("net"), F.col("good")).alias("avg_item_value"),
        "first_sale_date",
        "last_sale_date",
        days.alias("days_since_last_sale"),
        recency_band(days, *HEALTH).alias("health_status"),
    )
