"""Business reports over the gold marts.

Mart order and customer counts are not additive over categories and segments; reports that sum them
say so, and ``governed`` has the distinct versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallkeeper.functions import cents, dollars, mean_dollars, pct, ratio, rnd
from stallkeeper.operators.ranking import global_rank, ntile
from stallkeeper.operators.shares import growth, share_of_total, top_k


def whole_dollars(total_cents: Column) -> Column:
    return rnd(dollars(total_cents), 0)


def _avg_margin() -> Column:
    # margins have two decimals, so their sum is exact in hundredths
    return rnd(F.sum(cents("gross_margin_pct")) / F.count("gross_margin_pct") / F.lit(100.0), 1)


def monthly_gmv_growth(mart_gmv: DataFrame) -> DataFrame:
    monthly = mart_gmv.groupBy(F.trunc("order_date", "month").alias("month")).agg(
        whole_dollars(F.sum("gmv_cents")).alias("gmv"),
        F.sum("order_count").alias("orders"),
        F.sum("customer_count").alias("customers"),
        mean_dollars(F.sum("gmv_cents"), F.sum("order_count")).alias("aov"),
    )
    year_ago = growth(monthly, "month", "gmv", 12)
    return monthly.select(
        "*",
        growth(monthly, "month", "gmv").alias("mom_growth_pct"),
        F.lag("gmv", 12).over(W.orderBy("month")).alias("gmv_year_ago"),
        year_ago.alias("yoy_growth_pct"),
    )


def segment_economics(ltv: DataFrame) -> DataFrame:
    grouped = ltv.groupBy("segment").agg(
        F.count("*").alias("customers"),
        mean_dollars(F.sum("lifetime_revenue_cents"), F.count("*")).alias("avg_ltv"),
        ratio(F.sum("total_orders"), F.count("*"), 1).alias("avg_orders"),
        F.sum("lifetime_revenue_cents").alias("revenue"),
    )
    shared = share_of_total(share_of_total(grouped, "customers", "pct_of_customers"), "revenue", "pct_of_revenue")
    return shared.withColumn("total_revenue", whole_dollars(F.col("revenue"))).drop("revenue")


def whale_profile(ltv: DataFrame, loss: float = 0.05, segment: str = "whale") -> DataFrame:
    whales = ltv.where(F.col("segment") == segment).groupBy("segment").agg(
        F.count("*").alias("customers"),
        whole_dollars(F.sum("lifetime_revenue_cents")).alias("total_revenue"),
        mean_dollars(F.sum("lifetime_revenue_cents"), F.count("*")).alias("avg_ltv"),
        dollars(F.min("lifetime_revenue_cents")).alias("min_ltv"),
        dollars(F.max("lifetime_revenue_cents")).alias("max_ltv"),
        ratio(F.sum("total_orders"), F.count("*"), 1).alias("avg_orders"),
    )
    return whales.withColumns(
        {
            "revenue_at_risk": rnd(F.col("total_revenue") * F.lit(loss), 2),
            "customers_at_risk": F.floor(F.col("customers") * F.lit(loss)).cast("bigint"),
        }
    )


def regional_comparison(mart_gmv: DataFrame) -> DataFrame:
    grouped = mart_gmv.groupBy("region").agg(
        F.sum("gmv_cents").alias("gmv"),
        F.sum("order_count").alias("total_orders"),
        mean_dollars(F.sum("gmv_cents"), F.sum("order_count")).alias("aov"),
        _avg_margin().alias("avg_margin"),
        F.sum("customer_count").alias("total_customers"),
    )
    shared = share_of_total(grouped, "gmv", "gmv_share_pct")
    return shared.withColumn("total_gmv", whole_dollars(F.col("gmv"))).drop("gmv")


def aov_gap(regions: DataFrame) -> DataFrame:
    best, worst = F.struct("aov", "region"), F.struct("aov", "region")
    ends = regions.agg(F.max(best).alias("hi"), F.min(worst).alias("lo"))
    return ends.select(
        F.col("hi.region").alias("highest_region"),
        F.col("hi.aov").alias("highest_aov"),
        F.col("lo.region").alias("lowest_region"),
        F.col("lo.aov").alias("lowest_aov"),
        rnd(F.col("hi.aov") - F.col("lo.aov")).alias("aov_gap"),
    )


def category_profitability(mart_gmv: DataFrame) -> DataFrame:
    grouped = mart_gmv.groupBy("category").agg(
        F.sum("gmv_cents").alias("gmv"),
        whole_dollars(F.sum("gross_profit_cents")).alias("total_profit"),
        _avg_margin().alias("avg_margin"),
        F.sum("order_count").alias("total_orders"),
        F.sum("items_sold").alias("total_items"),
        whole_dollars(F.sum("total_discounts_cents")).alias("total_discounts"),
        pct(F.sum("total_discounts_cents"), F.sum("gmv_cents")).alias("discount_rate_pct"),
    )
    shared = share_of_total(grouped, "gmv", "gmv_share_pct")
    return shared.withColumn("total_gmv", whole_dollars(F.col("gmv"))).drop("gmv")


def category_leaders(categories: DataFrame) -> DataFrame:
    """Largest category by revenue and by profit; the flag is set when they differ."""
    ends = categories.agg(
        F.max(F.struct("total_gmv", "category")).alias("g"), F.max(F.struct("total_profit", "category")).alias("p")
    )
    return ends.select(
        F.col("g.category").alias("revenue_leader"),
        F.col("g.total_gmv").alias("leader_gmv"),
        F.col("p.category").alias("profit_leader"),
        F.col("p.total_profit").alias("leader_profit"),
        (~F.col("g.category").eqNullSafe(F.col("p.category"))).alias("leaders_differ"),
    )


def top_sellers(seller_health: DataFrame, k: int = 10) -> DataFrame:
    best = top_k(seller_health, k, F.desc("total_gmv_cents"), F.asc("seller_id"))
    return best.select(
        "business_name",
        "tier",
        "region",
        "primary_category",
        "total_orders",
        whole_dollars(F.col("total_gmv_cents")).alias("total_gmv"),
        whole_dollars(F.col("commission_revenue_cents")).alias("commission_revenue"),
        "avg_rating",
        "health_status",
    )


def seller_concentration(seller_health: DataFrame, n: int = 10) -> DataFrame:
    ranked = global_rank(seller_health.select("seller_id", "total_gmv_cents"), "total_gmv_cents", "seller_id")
    tiles = ranked.withColumn("decile", ntile(F.col("rank"), F.col("rank_n"), n))
    grouped = tiles.groupBy("decile").agg(F.count("*").alias("sellers"), F.sum("total_gmv_cents").alias("gmv"))
    shared = share_of_total(grouped, "gmv", "gmv_share_pct")
    return shared.withColumn("total_gmv", whole_dollars(F.col("gmv"))).drop("gmv")


def single_order_status(ltv: DataFrame) -> DataFrame:
    return ltv.where("total_orders = 1").groupBy("activity_status").agg(
        F.count("*").alias("customers"),
        mean_dollars(F.sum("lifetime_revenue_cents"), F.count("*")).alias("avg_lifetime_spend"),
        ratio(F.sum("total_orders"), F.count("*"), 1).alias("avg_orders"),
    )


def single_order_opportunity(ltv: DataFrame, rate: float = 0.10) -> DataFrame:
    single, repeat = F.col("total_orders") == 1, F.col("total_orders") >= 2
    spend = F.col("lifetime_revenue_cents")
    totals = ltv.agg(
        F.count_if(single).alias("single_order_customers"),
        mean_dollars(F.sum(F.when(single, spend)), F.count_if(single)).alias("avg_single_order_spend"),
        mean_dollars(F.sum(F.when(repeat, spend)), F.count_if(repeat)).alias("avg_repeat_buyer_spend"),
    )
    gap = F.greatest(F.lit(0.0), F.col("avg_repeat_buyer_spend") - F.col("avg_single_order_spend"))
    target = F.floor(F.col("single_order_customers") * F.lit(rate)).cast("bigint")
    return totals.withColumns(
        {"conversion_target": target, "spend_difference": rnd(gap), "spend_opportunity": rnd(target * gap)}
    )


def seasonality(mart_gmv: DataFrame) -> DataFrame:
    month = F.month("order_date").cast("bigint")
    return mart_gmv.groupBy(month.alias("month_num"), F.date_format("order_date", "MMMM").alias("month_name")).agg(
        whole_dollars(F.sum("gmv_cents")).alias("total_gmv"),
        F.sum("order_count").alias("total_orders"),
        _avg_margin().alias("avg_margin"),
    )


def seasonality_peak(months: DataFrame) -> DataFrame:
    ends = months.agg(
        F.max(F.struct("total_gmv", "month_num", "month_name")).alias("hi"),
        F.min(F.struct("total_gmv", "month_num", "month_name")).alias("lo"),
    )
    return ends.select(
        F.col("hi.month_name").alias("peak_month"),
        F.col("hi.total_gmv").alias("peak_gmv"),
        F.col("lo.month_name").alias("low_month"),
        F.col("lo.total_gmv").alias("low_gmv"),
        ratio(F.col("hi.total_gmv"), F.col("lo.total_gmv"), 1).alias("peak_to_trough"),
    )


def discount_rate_by_category(mart_gmv: DataFrame) -> DataFrame:
    return mart_gmv.groupBy("category").agg(
        whole_dollars(F.sum("gmv_cents")).alias("total_gmv"),
        whole_dollars(F.sum("total_discounts_cents")).alias("total_discounts"),
        pct(F.sum("total_discounts_cents"), F.sum("gmv_cents")).alias("discount_rate"),
        _avg_margin().alias("margin_after_discount"),
        whole_dollars(F.sum("gross_profit_cents")).alias("net_profit"),
    )


def avg_commission_pct(digits: int = 1) -> Column:
    points = F.floor(F.col("commission_rate") * F.lit(10000.0) + F.lit(0.5))
    return rnd(F.sum(points) / F.count("commission_rate") / F.lit(100.0), digits)


def commission_by_tier(seller_health: DataFrame) -> DataFrame:
    commission = F.sum("commission_revenue_cents")
    return seller_health.groupBy("tier").agg(
        F.count("*").alias("sellers"),
        whole_dollars(F.sum("total_gmv_cents")).alias("total_gmv"),
        avg_commission_pct().alias("avg_commission_pct"),
        whole_dollars(commission).alias("commission_revenue"),
        mean_dollars(commission, F.count("*"), 0).alias("revenue_per_seller"),
    )
