"""Marketing-channel analysis over customers that signed up early enough to be observed in full."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallkeeper.functions import count_if, dollars, mean_dollars, pct, ratio, rnd
from stallkeeper.operators.facts import eligible
from stallkeeper.operators.ranking import exact_quantile
from stallkeeper.operators.shares import share_of_total

UNKNOWN_CHANNEL = "unknown"


def observed_customers(dim_customers: DataFrame, cutoff: dt.date) -> DataFrame:
    return dim_customers.where(~F.col("is_unknown_customer") & (F.col("signup_date") <= F.lit(cutoff))).select(
        "customer_id",
        F.coalesce("signup_channel", F.lit(UNKNOWN_CHANNEL)).alias("signup_channel"),
        "signup_date",
        "segment",
    )


def orders_until(fact_orders: DataFrame, as_of: dt.date) -> DataFrame:
    return eligible(fact_orders).where(F.col("order_date") <= F.lit(as_of))


def orders_in_window(customers: DataFrame, orders: DataFrame, days: int) -> DataFrame:
    """Orders from the sign-up day through ``days`` later; customers without one keep an empty row.

    The orders drive an inner join, which may be split where one customer owns many of them; customers
    without a match are added afterwards.
    """
    per_order = orders.groupBy("customer_id", "order_id").agg(
        F.min("order_date").alias("order_date"), F.sum("total_amount_cents").alias("amount")
    )
    matched = _in_window(per_order, customers, days)
    seen = matched.groupBy("customer_id").agg(F.lit(1).alias("_seen"))
    empty = customers.join(seen, "customer_id", "left_anti")
    return matched.select(*customers.columns, "order_id", "order_date", "amount").unionByName(
        empty, allowMissingColumns=True
    )


def _in_window(rows: DataFrame, customers: DataFrame, days: int) -> DataFrame:
    inside = (F.col("order_date") >= F.col("signup_date")) & (
        F.col("order_date") <= F.date_add("signup_date", days)
    )
    return rows.join(customers, "customer_id").where(inside)


def window_spend(customers: DataFrame, orders: DataFrame, days: int) -> DataFrame:
    """Orders and spend inside the window per customer; orders are summed per day before the join."""
    per_order = orders.groupBy("customer_id", "order_id").agg(
        F.min("order_date").alias("order_date"), F.sum("total_amount_cents").alias("amount")
    )
    daily = per_order.groupBy("customer_id", "order_date").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))
    spent = _in_window(daily, customers, days).groupBy("customer_id").agg(
        F.sum("n").alias("n"), F.sum("amount").alias("amount")
    )
    return customers.join(spent, "customer_id", "left").select(
        "customer_id", "signup_channel", "segment",
        F.coalesce("n", F.lit(0)).alias("orders_in_window"), F.coalesce("amount", F.lit(0)).alias("spend_cents"),
    )


def channel_quality(
    dim_customers: DataFrame, fact_orders: DataFrame, cutoff: dt.date, as_of: dt.date, days: int = 90
) -> DataFrame:
    per_customer = window_spend(observed_customers(dim_customers, cutoff), orders_until(fact_orders, as_of), days)
    n, all_rows = F.col("orders_in_window"), F.count("*")
    grouped = per_customer.groupBy("signup_channel").agg(
        all_rows.alias("customers"),
        mean_dollars(F.sum("spend_cents"), all_rows).alias("avg_spend_90d"),
        ratio(F.sum(n), all_rows, 1).alias("avg_orders_90d"),
        pct(count_if(n == 0), all_rows).alias("no_order_within_90d_pct"),
        pct(count_if(n == 1), all_rows).alias("one_order_within_90d_pct"),
        pct(count_if(n >= 2), all_rows).alias("repeat_within_90d_pct"),
        pct(count_if(F.col("segment") == "whale"), all_rows).alias("whale_persona_pct"),
    )
    middle = exact_quantile(per_customer, "spend_cents", 0.5, ["signup_channel"], "m").select(
        "signup_channel", rnd(dollars("m")).alias("median_spend_90d")
    )
    return share_of_total(grouped, "customers", "pct_of_total").join(middle, "signup_channel")


def whale_share_by_channel(dim_customers: DataFrame, cutoff: dt.date) -> DataFrame:
    whales = count_if(F.col("segment") == "whale")
    return observed_customers(dim_customers, cutoff).groupBy("signup_channel").agg(
        F.count("*").alias("total_customers"),
        whales.alias("whale_persona_count"),
        pct(whales, F.count("*"), 2).alias("whale_persona_pct"),
        rnd(F.lit(1000.0) * whales / F.count("*"), 1).alias("whale_personas_per_1000_signups"),
    )


def lifetime_behaviour_by_channel(
    dim_customers: DataFrame, fact_orders: DataFrame, cutoff: dt.date, as_of: dt.date
) -> DataFrame:
    counts = orders_until(fact_orders, as_of).groupBy("customer_id").agg(F.count_distinct("order_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return observed_customers(dim_customers, cutoff).join(counts, "customer_id", "left").groupBy("signup_channel").agg(
        F.count("*").alias("total_customers"),
        count_if(n == 0).alias("never_ordered_lifetime"),
        count_if(n == 1).alias("one_order_only_lifetime"),
        count_if(n >= 2).alias("repeat_buyers_lifetime"),
        pct(count_if(n == 1), count_if(n >= 1)).alias("one_order_rate_among_buyers"),
    )


def first_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Each customer's earliest order, as an aggregate so that no customer's orders are sorted in one task."""
    first = orders.groupBy("customer_id").agg(F.min(F.struct("order_date", "order_id")).alias("f"))
    return customers.join(first, "customer_id").select(customers["*"], F.col("f.order_id").alias("order_id"))


def first_purchase_category(
    dim_customers: DataFrame, fact_orders: DataFrame, fact_items: DataFrame, cutoff: dt.date, as_of: dt.date
) -> DataFrame:
    """Category of the most valuable item in each customer's first order, counted per channel."""
    firsts = first_orders(observed_customers(dim_customers, cutoff), orders_until(fact_orders, as_of))
    value = F.col("unit_price_cents") * F.col("quantity") - F.coalesce("discount_amount_cents", F.lit(0))
    items = fact_items.where(
        (F.col("quantity") > 0) & F.col("unit_price_cents").isNotNull() & F.col("category").isNotNull()
    ).select("order_id", "category", F.struct((-value).alias("v"), "order_item_id").alias("place"))
    # only items of first orders are ranked
    best = firsts.select("customer_id", "signup_channel", "order_id").join(items, "order_id").groupBy(
        "order_id", "customer_id", "signup_channel").agg(F.min_by("category", "place").alias("first_purchase_category"))
    grouped = best.groupBy("signup_channel", "first_purchase_category").agg(
        F.count("*").alias("customers")
    )
    return share_of_total(grouped, "customers", "pct_of_channel_customers", ["signup_channel"])


def top_first_categories(first_purchases: DataFrame, k: int = 3) -> DataFrame:
    order = W.partitionBy("signup_channel").orderBy(F.desc("customers"), F.asc_nulls_last("first_purchase_category"))
    return first_purchases.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)


def repeat_within(
    dim_customers: DataFrame, fact_orders: DataFrame, cutoff: dt.date, as_of: dt.date, days: int = 90
) -> DataFrame:
    """Share of first-time buyers that ordered again within ``days``.

    Orders are counted per customer and day first, so a customer keeps at most one row per calendar day.
    """
    per_order = orders_until(fact_orders, as_of).groupBy("customer_id", "order_id").agg(
        F.min("order_date").alias("order_date")
    )
    daily = per_order.groupBy("customer_id", "order_date").agg(F.count("*").alias("n"))
    line = W.partitionBy("customer_id").orderBy("order_date")
    firsts = daily.select(
        "customer_id",
        F.col("order_date").alias("first_date"),
        F.when(F.col("n") > 1, F.col("order_date")).otherwise(F.lead("order_date").over(line)).alias("second_date"),
        F.lag("order_date").over(line).isNull().alias("is_first"),
    ).where("is_first")
    buyers = observed_customers(dim_customers, cutoff).join(firsts, "customer_id")
    gap = F.datediff("second_date", "first_date")
    back = F.coalesce(gap <= days, F.lit(False))
    return buyers.where(F.col("first_date") <= F.date_sub(F.lit(as_of), days)).groupBy("signup_channel").agg(
        F.count("*").alias("customers_with_first_order"),
        count_if(back).alias("returned_within_90d"),
        pct(count_if(back), F.count("*")).alias("repeat_rate_90d"),
        ratio(F.sum(F.when(back, gap)), count_if(back), 1).alias("avg_days_to_second_order"),
    )


def best_worst_channel(channels: DataFrame, metric: str) -> DataFrame:
    """Named channels with the highest and lowest metric, their ratio and their gap."""
    named = channels.where(F.coalesce("signup_channel", F.lit(UNKNOWN_CHANNEL)) != UNKNOWN_CHANNEL)
    ends = named.agg(
        F.min(F.struct((-F.col(metric)).alias("v"), "signup_channel")).alias("hi"),
        F.max(F.struct((-F.col(metric)).alias("v"), "signup_channel")).alias("lo"),
    )
    hi, lo = -F.col("hi.v"), -F.col("lo.v")
    return ends.select(
        F.col("hi.signup_channel").alias("best_channel"),
        hi.alias("best_value"),
        F.col("lo.signup_channel").alias("worst_channel"),
        lo.alias("worst_value"),
        F.when(lo > 0, rnd(hi / lo)).otherwise(0.0).alias("best_to_worst"),
        rnd(hi - lo).alias("gap"),
    )
