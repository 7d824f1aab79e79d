"""Compact report tables and the filtered views a page asks of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import count_if, dollars, mean_dollars, pct, ratio, rnd
from stallkeeper.operators.marts import item_measures
from stallkeeper.operators.shares import share_of_total, top_k
from stallkeeper.plans.business import avg_commission_pct
from stallkeeper.plans.governed import eligible_order_counts, real_customers

def monthly_marketplace(mart_gmv: DataFrame, fact_orders: DataFrame) -> DataFrame:
    money = mart_gmv.groupBy(F.trunc("order_date", "month").alias("month")).agg(
        dollars(F.sum("net_gmv_cents")).alias("net_gmv")
    )
    return money.join(eligible_order_counts(fact_orders, F.trunc("order_date", "month"), "month"), on="month")


def region_performance(fact_items: DataFrame, fact_orders: DataFrame) -> DataFrame:
    money = item_measures(fact_items, ["region"], orders=False).withColumnRenamed("_k0", "region")
    orders = eligible_order_counts(fact_orders, F.col("region"), "region", customers=True)
    return money.join(orders, on="region").select(
        "region",
        dollars("net_gmv_cents").alias("net_gmv"),
        "eligible_orders",
        "customers",
        dollars("gross_profit_cents").alias("gross_margin_amount"),
        dollars("margin_net_gmv_cents").alias("margin_net_gmv"),
        pct("gross_profit_cents", "margin_net_gmv_cents").alias("weighted_margin"),
    )


def _with_category(fact_items: DataFrame) -> DataFrame:
    return fact_items.where(F.col("category").isNotNull())


def category_summary(fact_items: DataFrame) -> DataFrame:
    return item_measures(_with_category(fact_items), ["category"]).select(
        F.col("_k0").alias("category"),
        dollars("gross_gmv_cents").alias("gross_gmv"),
        dollars("net_gmv_cents").alias("net_gmv"),
        F.col("financially_valid_order_count").alias("orders"),
        F.col("items_sold").alias("items"),
        dollars("gross_profit_cents").alias("gross_margin_amount"),
        dollars("margin_net_gmv_cents").alias("margin_net_gmv"),
        pct("gross_profit_cents", "margin_net_gmv_cents").alias("weighted_margin"),
        dollars("total_discounts_cents").alias("item_discounts"),
    )


def category_monthly(fact_items: DataFrame) -> DataFrame:
    return item_measures(_with_category(fact_items), [F.trunc("order_date", "month"), "category"]).select(
        F.col("_k0").alias("month"),
        F.col("_k1").alias("category"),
        dollars("net_gmv_cents").alias("net_gmv"),
        F.col("financially_valid_order_count").alias("orders"),
        F.col("items_sold").alias("items"),
        dollars("gross_profit_cents").alias("gross_margin_amount"),
        dollars("margin_net_gmv_cents").alias("margin_net_gmv"),
    )


def category_segment(fact_items: DataFrame) -> DataFrame:
    segment = F.coalesce("customer_segment", F.lit("unknown"))
    return item_measures(_with_category(fact_items), ["category", segment]).select(
        F.col("_k0").alias("category"),
        F.col("_k1").alias("customer_segment"),
        dollars("net_gmv_cents").alias("net_gmv"),
        F.col("financially_valid_order_count").alias("orders"),
    )


def customer_health(ltv: DataFrame) -> DataFrame:
    return real_customers(ltv).groupBy("activity_status").agg(
        F.count("*").alias("customers"),
        mean_dollars(F.sum("lifetime_revenue_cents"), F.count("*")).alias("avg_lifetime_spend"),
        ratio(F.sum("total_orders"), F.count("*"), 1).alias("avg_orders"),
    )


def only(df: DataFrame, column: str, value: object | None) -> DataFrame:
    """Rows with the value, or all rows when no value is chosen."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def _cents_of(column: str) -> Column:
    # report tables hold currency with two decimals: back to cents so sums stay exact
    return F.sum(F.floor(F.col(column) * F.lit(100.0) + F.lit(0.5)).cast("bigint"))


def category_kpis(summary: DataFrame, category: str | None = None) -> DataFrame:
    return only(summary, "category", category).agg(
        dollars(_cents_of("net_gmv")).alias("net_gmv"),
        F.sum("orders").alias("orders"),
        F.sum("items").alias("items"),
        pct(_cents_of("gross_margin_amount"), _cents_of("margin_net_gmv")).alias("weighted_margin"),
    )


def category_trend(monthly: DataFrame, category: str | None = None) -> DataFrame:
    return only(monthly, "category", category).groupBy("month").agg(
        dollars(_cents_of("net_gmv")).alias("net_gmv"),
        F.sum("orders").alias("orders"),
        pct(_cents_of("gross_margin_amount"), _cents_of("margin_net_gmv")).alias("weighted_margin"),
    )


def category_comparison(summary: DataFrame) -> DataFrame:
    cols = ["category", "gross_gmv", "net_gmv", "orders", "items", "weighted_margin", "item_discounts"]
    return summary.select(*cols).orderBy(F.desc("net_gmv"))


def segment_mix(cat_segment: DataFrame, category: str | None = None) -> DataFrame:
    grouped = only(cat_segment, "category", category).groupBy("customer_segment").agg(
        _cents_of("net_gmv").alias("n"), F.sum("orders").alias("orders")
    )
    return share_of_total(grouped, "n", "net_gmv_share_pct").withColumn("net_gmv", dollars("n")).drop("n")


def seller_status_counts(seller_health: DataFrame) -> DataFrame:
    status = F.col("health_status")
    return seller_health.agg(
        F.count("*").alias("total_sellers"),
        *[count_if(status == s).alias(f"{s}_sellers") for s in ("active", "at_risk", "churned", "no_sales")],
    )


def health_by_tier(seller_health: DataFrame) -> DataFrame:
    return seller_health.groupBy("health_status", "tier").agg(
        F.count("*").alias("sellers"),
        dollars(F.sum("net_gmv_cents")).alias("net_gmv"),
        mean_dollars(F.sum("net_gmv_cents"), F.count("*")).alias("avg_net_gmv"),
    )


def tier_summary(seller_health: DataFrame) -> DataFrame:
    tenths = F.floor(F.col("avg_rating") * F.lit(100.0) + F.lit(0.5))
    return seller_health.groupBy("tier").agg(
        F.count("*").alias("sellers"),
        dollars(F.sum("net_gmv_cents")).alias("net_gmv"),
        dollars(F.sum("commission_revenue_cents")).alias("commission_revenue"),
        rnd(F.sum(tenths) / F.count("avg_rating") / F.lit(100.0)).alias("avg_rating"),
        avg_commission_pct().alias("avg_commission_pct"),
    )


def seller_top(seller_health: DataFrame, k: int = 20, status: str | None = None) -> DataFrame:
    best = top_k(only(seller_health, "health_status", status), k, F.desc("net_gmv_cents"), F.asc("seller_id"))
    return best.select(
        "business_name",
        "tier",
        "region",
        "primary_category",
        "total_orders",
        "total_items_sold",
        dollars("net_gmv_cents").alias("net_gmv"),
        dollars("commission_revenue_cents").alias("commission_revenue"),
        "days_since_last_sale",
        "avg_rating",
        "health_status",
    )


def filter_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted distinct non-null values of each filter column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")) for c in columns])
    values = df.select(F.inline(pairs)).where(F.col("value").isNotNull()).groupBy("filter", "value").agg(
        F.count("*").alias("rows")
    )
    return values.select("filter", "value").orderBy("filter", "value")
