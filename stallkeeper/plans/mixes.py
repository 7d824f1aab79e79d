"""Distributions of the source tables: counts by attribute and a few rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import cents, count_if, dollars, mean_dollars, pct, ratio, rnd
from stallkeeper.operators.shares import top_k


def mix(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("count"))


def order_mix(orders: DataFrame, by: str) -> DataFrame:
    amount = cents("total_amount")
    return orders.groupBy(by).agg(
        F.count("*").alias("orders"),
        dollars(F.coalesce(F.sum(amount), F.lit(0))).alias("total_gmv"),
        mean_dollars(F.sum(amount), F.count(amount)).alias("avg_order_value"),
    )


def monthly_order_volume(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.trunc("order_placed_at", "month").alias("month")).agg(
        F.count("*").alias("orders"), dollars(F.coalesce(F.sum(cents("total_amount")), F.lit(0))).alias("monthly_gmv")
    )


def first_and_last_months(monthly: DataFrame, k: int = 3) -> DataFrame:
    head = top_k(monthly, k, F.asc("month")).withColumn("end", F.lit("first"))
    return head.unionByName(top_k(monthly, k, F.desc("month")).withColumn("end", F.lit("last")))


def order_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    amount = cents("total_amount")
    both = orders.select(amount.alias("amount"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(
        items.select(F.lit(None).cast("bigint").alias("amount"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    return both.agg(
        ratio(F.sum("i"), F.sum("o")).alias("avg_items_per_order"),
        dollars(F.sum("amount")).alias("total_gmv"),
        mean_dollars(F.sum("amount"), F.count("amount")).alias("avg_order_value"),
    )


def items_by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("category").agg(
        F.count("*").alias("items_sold"), dollars(F.sum(cents("line_total"))).alias("category_revenue")
    )


def payment_rates(payments: DataFrame) -> DataFrame:
    failed = count_if(F.col("payment_status") == "failed")
    return payments.agg(
        count_if(F.col("is_retry")).alias("retries"),
        F.count("*").alias("payments"),
        pct(count_if(F.col("is_retry")), F.count("*")).alias("retry_pct"),
        pct(failed, F.count("*")).alias("failure_pct"),
    )


def failure_reasons(payments: DataFrame) -> DataFrame:
    return mix(payments.where(F.col("failure_reason").isNotNull()), "failure_reason")


def share_of_items(part: DataFrame, items: DataFrame, name: str) -> DataFrame:
    """Number of ``part`` rows and their percent of the item rows, in one pass over both."""
    both = part.select(F.lit(1).alias("p"), F.lit(0).alias("i")).unionByName(
        items.select(F.lit(0).alias("p"), F.lit(1).alias("i"))
    )
    return both.agg(
        F.sum("p").alias(name), F.sum("i").alias("items"), pct(F.sum("p"), F.sum("i")).alias(f"{name}_pct")
    )


def review_summary(reviews: DataFrame, items: DataFrame) -> DataFrame:
    both = reviews.select(F.col("rating").cast("bigint").alias("rating"), F.lit(1).alias("r"), F.lit(0).alias("i"))
    both = both.unionByName(
        items.select(F.lit(None).cast("bigint").alias("rating"), F.lit(0).alias("r"), F.lit(1).alias("i"))
    )
    return both.agg(
        F.sum("r").alias("reviews"),
        pct(F.sum("r"), F.sum("i")).alias("review_rate_pct"),
        ratio(F.sum("rating"), F.count("rating")).alias("avg_rating"),
    )


def category_catalog(products: DataFrame) -> DataFrame:
    rate = F.floor(F.col("return_rate") * F.lit(10000.0) + F.lit(0.5))
    return products.groupBy("category").agg(
        F.count("*").alias("products"),
        mean_dollars(F.sum(cents("price")), F.count("price")).alias("avg_price"),
        rnd(F.sum(rate) / F.count("return_rate") / F.lit(10000.0), 4).alias("avg_return_rate"),
    )


def sellers_by_product_count(products: DataFrame, k: int = 10) -> DataFrame:
    counted = products.groupBy("seller_id").agg(F.count("*").alias("product_count"))
    return top_k(counted, k, F.desc("product_count"), F.asc("seller_id"))


def active_share(products: DataFrame) -> DataFrame:
    active = count_if(F.col("is_active"))
    return products.agg(
        active.alias("active_products"), F.count("*").alias("products"), pct(active, F.count("*")).alias("active_pct")
    )


def commission_rate_by_tier(sellers: DataFrame) -> DataFrame:
    points = F.floor(F.col("commission_rate") * F.lit(10000.0) + F.lit(0.5))
    return sellers.groupBy("tier").agg(
        rnd(F.sum(points) / F.count("commission_rate") / F.lit(10000.0), 4).alias("avg_commission")
    )
