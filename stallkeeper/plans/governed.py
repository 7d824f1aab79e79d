"""Governed metrics: the numbers that may be published, each counted at its own grain."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import count_if, dollars, mean_dollars, pct, ratio, rnd, sum_if
from stallkeeper.operators.facts import eligible
from stallkeeper.operators.marts import item_measures
from stallkeeper.operators.shares import share_of_total
from stallkeeper.plans.business import avg_commission_pct

SPEND = "lifetime_customer_spend_cents"


def real_customers(ltv: DataFrame) -> DataFrame:
    return ltv.where(~F.col("is_unknown_customer"))


def eligible_order_counts(fact_orders: DataFrame, by: Column, name: str, customers: bool = False) -> DataFrame:
    """Distinct eligible orders (and customers) per key; the order step spreads hot keys."""
    per_order = eligible(fact_orders).groupBy(by.alias(name), "order_id").agg(F.min("customer_id").alias("c"))
    aggs = [F.count("order_id").alias("eligible_orders")]
    if customers:
        aggs.append(F.count_distinct("c").alias("customers"))
    return per_order.groupBy(name).agg(*aggs)


def gmv_totals(mart_gmv: DataFrame) -> DataFrame:
    return mart_gmv.agg(
        dollars(F.sum("gross_gmv_cents")).alias("gross_gmv"),
        dollars(F.sum("net_gmv_cents")).alias("net_gmv"),
        dollars(F.sum("total_discounts_cents")).alias("total_discounts"),
        dollars(F.sum("total_item_tax_cents")).alias("total_item_tax"),
        F.sum("invalid_gmv_item_count").alias("invalid_gmv_items"),
    )


def annual_gmv(mart_gmv: DataFrame, fact_orders: DataFrame) -> DataFrame:
    year = F.year("order_date").cast("bigint")
    money = mart_gmv.groupBy(year.alias("year")).agg(
        F.sum("gross_gmv_cents").alias("g"), F.sum("net_gmv_cents").alias("n")
    )
    orders = eligible_order_counts(fact_orders, year, "year")
    return money.join(orders, "year").select(
        "year",
        dollars("g").alias("gross_gmv"),
        dollars("n").alias("net_gmv"),
        "eligible_orders",
        mean_dollars(F.col("n"), F.col("eligible_orders")).alias("net_gmv_per_order"),
    )


def order_date_range(fact_orders: DataFrame) -> DataFrame:
    return eligible(fact_orders).agg(F.min("order_date").alias("earliest"), F.max("order_date").alias("latest"))


def customer_counts(ltv: DataFrame) -> DataFrame:
    real, ordered = ~F.col("is_unknown_customer"), F.col("total_orders") > 0
    return ltv.agg(
        count_if(real).alias("registered_customers"),
        count_if(~real).alias("unknown_dimension_members"),
        count_if(real & ordered).alias("customers_with_orders"),
        count_if(real & ~ordered).alias("never_ordered"),
    )


def _order_groups() -> list[Column]:
    n = F.col("total_orders")
    return [
        count_if(n == 0).alias("never_ordered"),
        count_if(n == 1).alias("one_order_only"),
        count_if(n >= 2).alias("repeat_buyers"),
        ratio(F.sum(n), F.count("*"), 1).alias("avg_orders"),
    ]


def persona_breakdown(ltv: DataFrame) -> DataFrame:
    grouped = real_customers(ltv).groupBy("segment").agg(
        F.count("*").alias("customers"),
        *_order_groups(),
        mean_dollars(F.sum(SPEND), F.count("*")).alias("avg_lifetime_spend"),
        F.sum(SPEND).alias("spend"),
    )
    shared = share_of_total(grouped, "customers", "pct_of_customers")
    shared = share_of_total(shared, "spend", "pct_of_real_customer_spend")
    return shared.withColumn("total_customer_spend", dollars("spend")).drop("spend")


def repeat_behaviour(ltv: DataFrame) -> DataFrame:
    n = F.col("total_orders")
    buyers = count_if(n > 0)
    return real_customers(ltv).agg(
        F.count("*").alias("registered_customers"),
        *_order_groups()[:3],
        buyers.alias("total_buyers"),
        pct(count_if(n >= 2), buyers).alias("repeat_rate_among_buyers_pct"),
        pct(count_if(n == 1), buyers).alias("one_order_rate_among_buyers_pct"),
    )


def persona_deep_look(ltv: DataFrame, segment: str = "low_frequency") -> DataFrame:
    chosen = real_customers(ltv).where(F.col("segment") == segment)
    return chosen.agg(F.count("*").alias("customers"), *_order_groups())


def whale_economics(ltv: DataFrame, share: float = 0.05, segment: str = "whale") -> DataFrame:
    whale, spend = F.col("segment") == segment, F.col(SPEND)
    mine = F.when(whale, spend)
    life = F.when(whale, F.col("customer_lifespan_days"))
    stats = real_customers(ltv).agg(
        count_if(whale).alias("whale_count"),
        dollars(F.sum(mine)).alias("total_whale_spend"),
        mean_dollars(F.sum(mine), F.count(mine)).alias("avg_whale_spend"),
        dollars(F.min(mine)).alias("min_whale_spend"),
        dollars(F.max(mine)).alias("max_whale_spend"),
        ratio(F.sum(F.when(whale, F.col("total_orders"))), count_if(whale), 1).alias("avg_orders"),
        ratio(F.sum(life), F.count(life), 0).alias("avg_lifespan_days"),
        dollars(F.sum(spend)).alias("total_real_customer_spend"),
    )
    five = F.floor(F.col("whale_count") * F.lit(share)).cast("bigint")
    years = F.col("avg_lifespan_days") / F.lit(365.0)
    annual = F.when(years > 0, F.col("avg_whale_spend") / years).otherwise(0.0)
    return stats.withColumns(
        {
            "whale_spend_pct": pct(F.col("total_whale_spend"), F.col("total_real_customer_spend")),
            "non_whale_spend": rnd(F.col("total_real_customer_spend") - F.col("total_whale_spend")),
            "annual_spend_per_whale": rnd(annual),
            "scenario_customers": five,
            "scenario_annual_spend": rnd(five * annual, 0),
            "scenario_lifetime_spend": rnd(five * F.col("avg_whale_spend"), 0),
        }
    )


def regional_performance(fact_items: DataFrame, fact_orders: DataFrame) -> DataFrame:
    money = item_measures(fact_items, ["region"], orders=False).withColumnRenamed("_k0", "region")
    orders = eligible_order_counts(fact_orders, F.col("region"), "region")
    joined = money.join(orders, "region")
    return share_of_total(joined, "net_gmv_cents", "net_gmv_share").select(
        "region",
        dollars("net_gmv_cents").alias("net_gmv"),
        "net_gmv_share",
        "eligible_orders",
        mean_dollars(F.col("net_gmv_cents"), F.col("eligible_orders")).alias("net_gmv_per_order"),
        pct("gross_profit_cents", "margin_net_gmv_cents").alias("merchandise_margin_pct"),
    )


def category_economics(fact_items: DataFrame) -> DataFrame:
    money = item_measures(fact_items, ["category"]).withColumnRenamed("_k0", "category")
    return share_of_total(money, "net_gmv_cents", "net_gmv_share").select(
        "category",
        dollars("gross_gmv_cents").alias("gross_gmv"),
        dollars("net_gmv_cents").alias("net_gmv"),
        "net_gmv_share",
        dollars("gross_profit_cents").alias("merchandise_profit"),
        pct("gross_profit_cents", "margin_net_gmv_cents").alias("merchandise_margin_pct"),
        F.col("financially_valid_order_count").alias("orders"),
        F.col("invalid_gmv_item_count").alias("invalid_financial_items"),
    )


def seller_tier_economics(seller_health: DataFrame) -> DataFrame:
    """One row per tier and a ``TOTAL`` row, from one pass over the sellers."""
    net, commission = F.sum("net_gmv_cents"), F.sum("commission_revenue_cents")
    both = seller_health.select("*", F.explode(F.array("tier", F.lit("TOTAL"))).alias("line"))
    return both.groupBy(F.col("line").alias("tier")).agg(
        F.count("*").alias("sellers"),
        dollars(F.sum("gross_gmv_cents")).alias("gross_gmv"),
        dollars(net).alias("net_gmv"),
        avg_commission_pct().alias("avg_commission_pct"),
        dollars(commission).alias("commission_revenue"),
        pct(commission, net, 2).alias("effective_take_rate_pct"),
        mean_dollars(net, F.count("*")).alias("avg_net_gmv_per_seller"),
    )


def activity_distribution(ltv: DataFrame) -> DataFrame:
    recency = F.col("days_since_last_order")
    grouped = real_customers(ltv).groupBy("activity_status").agg(
        F.count("*").alias("customers"),
        mean_dollars(F.sum(SPEND), F.count("*")).alias("avg_lifetime_spend"),
        ratio(F.sum(recency), F.count(recency), 0).alias("avg_days_since_last_order"),
    )
    return share_of_total(grouped, "customers", "pct")


def last_order_gap(fact_orders: DataFrame, as_of: dt.date) -> DataFrame:
    latest = F.max("order_date")
    return fact_orders.agg(
        F.lit(as_of).alias("reference_date"),
        latest.alias("latest_order_date"),
        F.datediff(F.lit(as_of), latest).cast("bigint").alias("gap_days"),
    )


def _sold_items(fact_items: DataFrame) -> DataFrame:
    return eligible(fact_items).where(~F.coalesce("_had_negative_quantity", F.lit(False)))


def return_rate_by_category(fact_items: DataFrame, returns: DataFrame) -> DataFrame:
    sold = _sold_items(fact_items).groupBy("category").agg(F.count_distinct("order_item_id").alias("eligible_items"))
    back = returns.groupBy("category").agg(F.count_distinct("return_id").alias("r"))
    returned = F.coalesce("r", F.lit(0))
    return sold.join(back, "category", "left").select(
        "category",
        "eligible_items",
        returned.alias("returned_items"),
        pct(returned, F.col("eligible_items"), 2).alias("return_rate_pct"),
    )


def return_rate_overall(fact_items: DataFrame, returns: DataFrame) -> DataFrame:
    sold = _sold_items(fact_items).select(F.col("order_item_id").alias("item"), F.lit(None).cast("string").alias("ret"))
    back = returns.select(F.lit(None).cast("string").alias("item"), F.col("return_id").alias("ret"))
    ids = sold.unionByName(back).groupBy("item", "ret").agg(F.lit(1).alias("_one"))
    return ids.agg(F.count("ret").alias("total_returns"), F.count("item").alias("eligible_items")).withColumn(
        "return_rate_pct", pct("total_returns", "eligible_items")
    )


def return_reasons(returns: DataFrame) -> DataFrame:
    grouped = returns.groupBy("return_reason").agg(F.count_distinct("return_id").alias("return_count"))
    return share_of_total(grouped, "return_count", "pct_of_returns")


def on_time_rate(shipments: DataFrame) -> DataFrame:
    delay = F.col("delay_days")
    return shipments.where("status = 'delivered'").agg(
        F.count("*").alias("total_shipments"),
        count_if(delay == 0).alias("on_time"),
        count_if(delay > 0).alias("late"),
        pct(count_if(delay == 0), F.count("*")).alias("on_time_pct"),
    )


def kpi_row(gold) -> DataFrame:
    """Eight headline numbers; each part is a one-row aggregate, stacked and folded without a cross join."""
    n = F.col("total_orders")
    parts = [
        gold.fact_order_items.transform(eligible).agg(
            sum_if(F.col("net_gmv_cents"), F.col("is_gmv_valid")).alias("net"),
            sum_if(F.col("net_gmv_cents") - F.col("merchandise_cost_cents"), F.col("is_margin_valid")).alias("profit"),
            sum_if(F.col("net_gmv_cents"), F.col("is_margin_valid")).alias("margin_net"),
        ),
        eligible(gold.fact_orders).groupBy("order_id").agg(F.sum("total_amount_cents").alias("t")).agg(
            F.sum("t").alias("charged"), F.count("order_id").alias("eligible_orders")
        ),
        real_customers(gold.mart_customer_ltv).agg(
            F.count("*").alias("real_customers"),
            count_if(n >= 2).alias("repeat"),
            count_if(n > 0).alias("buyers"),
        ),
        gold.mart_seller_health.agg(F.sum("commission_revenue_cents").alias("commission")),
    ]
    row = cross_combine(*parts)
    return row.select(
        dollars("net").alias("net_gmv"),
        dollars("charged").alias("customer_charged_amount"),
        "eligible_orders",
        "real_customers",
        dollars("commission").alias("commission_revenue"),
        mean_dollars(F.col("net"), F.col("eligible_orders")).alias("net_gmv_per_order"),
        pct("repeat", "buyers").alias("repeat_buyer_rate"),
        pct("profit", "margin_net").alias("weighted_margin"),
    )


def cross_combine(*parts: DataFrame) -> DataFrame:
    """Columns of several one-row frames in one row."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def customer_overview(customers: DataFrame) -> DataFrame:
    per_id = customers.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.min("signup_date").alias("a"), F.max("signup_date").alias("z")
    )
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_customers"),
        F.count("customer_id").alias("unique_customer_ids"),
        F.min("a").alias("earliest_signup"),
        F.max("z").alias("latest_signup"),
    )


def region_segment_mix(customers: DataFrame) -> DataFrame:
    grouped = customers.groupBy("region", "segment").agg(F.count("*").alias("customer_count"))
    return share_of_total(grouped, "customer_count", "pct_within_region", ["region"], 2)


def signups_by_month(customers: DataFrame, months: int = 12) -> DataFrame:
    """Sign-ups per month over the last months. Days are counted first, so the latest day costs no second scan."""
    daily = customers.where(F.col("signup_date").isNotNull()).groupBy("signup_date").agg(F.count("*").alias("n"))
    latest = daily.agg(F.max("signup_date").alias("latest")).scalar()
    recent = daily.where(F.col("signup_date") >= F.add_months(latest, -months))
    return recent.groupBy(F.trunc("signup_date", "month").alias("signup_month")).agg(F.sum("n").alias("new_customers"))


def country_mix(customers: DataFrame, region: str) -> DataFrame:
    grouped = customers.where(F.col("region") == region).groupBy("country_code").agg(F.count("*").alias("customers"))
    return share_of_total(grouped, "customers", "pct_of_region", digits=2)


def channel_whale_pct(customers: DataFrame, segment: str = "whale") -> DataFrame:
    whales = count_if(F.col("segment") == segment)
    return customers.groupBy("signup_channel").agg(
        F.count("*").alias("customer_count"), whales.alias("whales"), pct(whales, F.count("*"), 2).alias("whale_pct")
    )
