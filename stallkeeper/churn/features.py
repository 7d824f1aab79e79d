"""Point-in-time customer features.

``build_snapshots`` reads each source once: all become events of a customer (an order, an item, a category bought, a
return, a delivery, a review), events of one thing become a unit with its day, and units fan out to the few snapshot dates
that may see them (a literal list, no join) and are grouped by customer and snapshot. Every source is cut off by its own
event time. Windows are open at the start and closed at the end. The other functions give one part each.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.churn.config import CHURN_WINDOW_DAYS, ID, LABEL, SNAPSHOT, SNAPSHOT_COLUMNS, WINDOW_ORDERS
from stallkeeper.functions import blank_to_col, dollars, ratio
from stallkeeper.operators.dims import UNKNOWN_CUSTOMER_ID
from stallkeeper.operators.facts import eligible

KEYS = [ID, SNAPSHOT]
Dates = Sequence[dt.date]


def see(df: DataFrame, day: Column | str, dates: Dates, ahead: int = 0) -> DataFrame:
    """One row per snapshot that may see the row: ``day`` is at most ``ahead`` days after it."""
    day = F.col(day) if isinstance(day, str) else day
    all_dates = F.array(*[F.lit(d) for d in sorted(dates)])
    return df.select("*", F.explode(F.filter(all_dates, lambda s: day <= F.date_add(s, ahead))).alias(SNAPSHOT))


def known_orders(fact_orders: DataFrame) -> DataFrame:
    """Eligible orders of real customers, one row per order."""
    rows = eligible(fact_orders).where(F.col(ID) != UNKNOWN_CUSTOMER_ID)
    return rows.groupBy(ID, "order_id").agg(
        F.min("order_date").alias("order_date"),
        F.sum("total_amount_cents").alias("amount"),
        F.count("total_amount_cents").alias("paid"),
    )


def order_activity(fact_orders: DataFrame, dates: Dates, window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """Order features and the label count together, from one pass over the orders."""
    rows = see(known_orders(fact_orders), "order_date", dates, ahead=window_days)
    g = rows.groupBy(*KEYS).agg(*_order_sums(F.lit(True), F.col("order_date"), F.col("amount"), F.col("paid")))
    return g.where("total_orders >= 1").select(*KEYS, *_order_columns())


def _order_sums(mine: Column, day: Column, amount: Column, paid: Column) -> list[Column]:
    """Aggregates over orders (rows that are ``mine``) as a snapshot sees them."""
    sd = F.col(SNAPSHOT)
    past = mine & (day <= sd)

    def recent(days: int) -> Column:
        return past & (day > F.date_sub(sd, days))

    return [
        F.max(F.when(past, day)).alias("last"),
        F.min(F.when(past, day)).alias("first"),
        F.count_if(past).alias("total_orders"),
        F.count_if(recent(30)).alias("orders_last_30d"),
        F.count_if(recent(90)).alias("orders_last_90d"),
        F.sum(F.when(past, amount)).alias("spend"),
        F.sum(F.when(past, paid)).alias("paid"),
        # an order without a total inside the window stays unknown, one outside counts as zero
        F.sum(F.when(past, F.when(recent(90), amount).otherwise(0))).alias("spend_90"),
        F.count_if(mine & (day > sd)).alias(WINDOW_ORDERS),
    ]


def _order_columns() -> list[Column]:
    tenure = F.datediff(SNAPSHOT, "first")
    span = F.datediff("last", "first")
    several = F.col("total_orders") > 1
    per_period = F.col("spend") / (tenure / F.lit(90.0))
    trend = F.when(
        (F.col("spend") > 0) & (tenure > 90), F.col("spend_90") / F.nullif(per_period, F.lit(0.0))
    ).otherwise(1.0)
    return [
        F.datediff(SNAPSHOT, "last").cast("bigint").alias("days_since_last_order"),
        tenure.cast("bigint").alias("days_since_first_order"),
        F.col("total_orders"),
        F.col("orders_last_30d"),
        F.col("orders_last_90d"),
        F.when(several, span / (F.col("total_orders") - F.lit(1.0))).alias("avg_days_between_orders"),
        dollars("spend").alias("lifetime_spend"),
        (F.col("spend") / F.nullif("paid", F.lit(0)) / F.lit(100.0)).alias("avg_order_value"),
        dollars("spend_90").alias("spend_last_90d"),
        trend.alias("spend_trend"),
        F.when(F.col("total_orders") == 1, 1).otherwise(0).cast("bigint").alias("is_single_order_customer"),
        F.col(WINDOW_ORDERS),
    ]


def order_features(fact_orders: DataFrame, dates: Dates) -> DataFrame:
    return order_activity(fact_orders, dates).drop(WINDOW_ORDERS)


def item_features(fact_items: DataFrame, dates: Dates) -> DataFrame:
    """Categories bought, items bought and the share of discounted orders."""
    rows = eligible(fact_items).where(F.col(ID) != UNKNOWN_CUSTOMER_ID)
    sold, valid = F.col("quantity") > 0, F.coalesce("is_gmv_valid", F.lit(False))
    discounted = valid & (F.coalesce("discount_amount_cents", F.lit(0)) > 0)
    per_order = rows.groupBy(ID, "order_id").agg(
        F.min("order_date").alias("order_date"),
        F.count_if(sold).alias("items"),
        F.max(valid.cast("int")).alias("valid"),
        F.max(discounted.cast("int")).alias("discounted"),
    )
    orders = see(per_order, "order_date", dates).groupBy(*KEYS).agg(
        F.sum("items").alias("historical_item_count"),
        (F.sum("discounted") / F.nullif(F.sum("valid"), F.lit(0))).alias("discount_order_rate"),
    )
    # the first purchase day per category says for every snapshot whether it counts
    first_seen = rows.where(sold & F.col("category").isNotNull()).groupBy(ID, "category").agg(
        F.min("order_date").alias("first_day")
    )
    categories = see(first_seen, "first_day", dates).groupBy(*KEYS).agg(F.count("*").alias("category_count"))
    return orders.join(categories, KEYS, "left").select(
        *KEYS,
        F.coalesce("category_count", F.lit(0)).alias("category_count"),
        "historical_item_count",
        "discount_order_rate",
    )


def _order_days(fact_orders: DataFrame) -> DataFrame:
    rows = eligible(fact_orders).where(F.col(ID) != UNKNOWN_CUSTOMER_ID)
    return rows.select(F.col("order_id").alias("_order"), F.col(ID), "order_date")


def return_counts(fact_orders: DataFrame, returns: DataFrame, dates: Dates) -> DataFrame:
    named = returns.select("return_id", "order_id", F.to_date("initiated_at").alias("day"))
    joined = named.join(_order_days(fact_orders), F.col("order_id") == F.col("_order"))
    known = joined.groupBy(ID, "order_id", "return_id").agg(F.min(F.greatest("day", "order_date")).alias("known_from"))
    per_order = see(known, "known_from", dates).groupBy(*KEYS, "order_id").agg(F.count("*").alias("n"))
    return per_order.groupBy(*KEYS).agg(
        F.sum("n").alias("return_count"), F.count("order_id").alias("orders_with_returns")
    )


def return_features(fact_orders: DataFrame, fact_items: DataFrame, returns: DataFrame, dates: Dates) -> DataFrame:
    orders = order_features(fact_orders, dates).select(*KEYS, "total_orders")
    items = item_features(fact_items, dates).select(*KEYS, "historical_item_count")
    joined = orders.join(return_counts(fact_orders, returns, dates), KEYS, "left").join(items, KEYS, "left")
    return joined.select(*KEYS, *_return_columns())


def _return_columns() -> list[Column]:
    count, orders = F.coalesce("return_count", F.lit(0)), F.coalesce("orders_with_returns", F.lit(0))
    one = F.lit(1.0)
    # least skips NULL: a customer without item rows gets an item rate of 1
    return [
        count.alias("return_count"),
        F.when(count > 0, 1).otherwise(0).cast("bigint").alias("has_return"),
        F.least(orders / F.nullif("total_orders", F.lit(0)), one).alias("return_order_rate"),
        F.least(count / F.nullif("historical_item_count", F.lit(0)), one).alias("return_item_rate"),
    ]


def review_features(reviews: DataFrame, dates: Dates) -> DataFrame:
    rows = reviews.select(ID, "rating", F.to_date("submitted_at").alias("day"))
    return see(rows, "day", dates).groupBy(*KEYS).agg(
        F.count("*").alias("review_count"),
        ratio(F.sum("rating"), F.count("rating")).alias("avg_rating_given"),
        F.lit(1).cast("bigint").alias("has_review"),
    )


def delivery_features(fact_orders: DataFrame, shipments: DataFrame, dates: Dates) -> DataFrame:
    arrived = shipments.where("status = 'delivered'").select(
        "order_id", "delay_days", F.to_date("delivered_at").alias("day")
    )
    rows = arrived.join(_order_days(fact_orders), F.col("order_id") == F.col("_order"))
    seen = see(rows.where("day is not null"), F.greatest("day", "order_date"), dates)
    delay = F.col("delay_days")
    return seen.groupBy(*KEYS).agg(
        F.count_if(delay > 0).alias("late_delivery_count"),
        ratio(F.sum(delay), F.count(delay)).alias("avg_delivery_delay"),
        F.lit(1).cast("bigint").alias("has_completed_delivery"),
    )


def customer_attributes(dim_customers: DataFrame, dates: Dates) -> DataFrame:
    real = see(dim_customers.where("not is_unknown_customer"), "signup_date", dates)
    return real.select(
        *KEYS,
        *[blank_to_col(F.col(c)).alias(c) for c in ("signup_channel", "segment", "region")],
        "signup_date",
        F.datediff(SNAPSHOT, "signup_date").cast("bigint").alias("customer_tenure_days"),
    )


def churn_labels(
    dim_customers: DataFrame, fact_orders: DataFrame, dates: Dates, window_days: int = CHURN_WINDOW_DAYS
) -> DataFrame:
    """Orders after the snapshot and through its window for every customer signed up by then."""
    rows = see(known_orders(fact_orders), "order_date", dates, ahead=window_days)
    future = rows.where(F.col("order_date") > F.col(SNAPSHOT)).groupBy(*KEYS).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    people = customer_attributes(dim_customers, dates).select(*KEYS)
    return people.join(future, KEYS, "left").select(
        *KEYS, n.alias(WINDOW_ORDERS), F.when(n == 0, 1).otherwise(0).cast("bigint").alias(LABEL)
    )


def _event(kind: str, day: Column, key: Column | None = None, sub: Column | None = None, **measures: Column) -> Column:
    """A struct of one shape for all kinds; s1 to s4 add up over the events of a unit, m1 and m2 keep their largest."""
    text = lambda c: (F.lit(None) if c is None else c).cast("string")
    number = lambda n: measures.get(n, F.lit(None)).cast("bigint").alias(n)
    return F.struct(F.lit(kind).alias("kind"), day.cast("date").alias("day"), text(key).alias("key"), text(sub).alias("sub"),
                    *[number(n) for n in ("s1", "s2", "s3", "s4", "m1", "m2")])


def customer_units(gold) -> DataFrame:
    """customer, kind, key, sub, day and measures: everything a customer's features are made of, each source read once.

    What follows an order (its returns and deliveries, a bounded few) is gathered by order and joined to it, so that it
    has the order's customer; the rest knows its customer. Nothing here depends on a snapshot date.
    """
    delivered = gold.shipments.where("status = 'delivered' AND delivered_at IS NOT NULL")
    later = gold.returns.select("order_id", F.lit("return").alias("kind"), F.col("return_id").alias("id"),
                                F.to_date("initiated_at").alias("day"), F.lit(None).cast("bigint").alias("delay")).unionByName(
        delivered.select("order_id", F.lit("delivery").alias("kind"), F.lit(None).cast("string").alias("id"),
                         F.to_date("delivered_at").alias("day"), F.col("delay_days").cast("bigint").alias("delay")))
    later = later.where("order_id IS NOT NULL").groupBy("order_id").agg(F.collect_list(F.struct("kind", "id", "day", "delay")).alias("later"))
    orders = eligible(gold.fact_orders).where(F.col(ID) != UNKNOWN_CUSTOMER_ID).select(ID, "order_id", "order_date", "total_amount_cents")

    def one(n: Column) -> Column:
        return n.cast("int")

    def followed(x: Column) -> Column:
        day, is_return = F.greatest(x.day, F.col("order_date")), x.kind == "return"
        delivery = _event("delivery", day, day, s1=F.coalesce(one(x.delay > 0), F.lit(0)), s2=x.delay, s3=one(x.delay.isNotNull()), s4=F.lit(1))
        return F.when(is_return, F.array(_event("return", day, F.col("order_id"), F.array_position("ids", x.id)), _event("return_order", day, F.col("order_id")))).otherwise(
            F.array(delivery))

    placed = _event("order", F.col("order_date"), F.col("order_id"), s1=F.col("total_amount_cents"), s2=one(F.col("total_amount_cents").isNotNull()))
    # a return goes on by its place among the order's ids, which are wide
    numbered = orders.join(later, "order_id", "left").withColumn("ids", F.array_distinct(F.transform("later", lambda x: x.id)))
    events = numbered.select(ID, F.inline(F.concat(
        F.array(placed), F.flatten(F.transform(F.coalesce("later", F.array()), followed)))))

    items = eligible(gold.fact_order_items).where(F.col(ID) != UNKNOWN_CUSTOMER_ID)
    sold, valid = F.coalesce(F.col("quantity") > 0, F.lit(False)), F.coalesce("is_gmv_valid", F.lit(False))
    discounted = valid & (F.coalesce("discount_amount_cents", F.lit(0)) > 0)
    line = _event("item", F.col("order_date"), F.col("order_id"), s1=one(sold), m1=one(valid), m2=one(discounted))
    bought = F.when(sold & F.col("category").isNotNull(), F.array(line, _event("category", F.col("order_date"), F.col("category")))).otherwise(F.array(line))
    reviewed = F.to_date("submitted_at")
    reviews = gold.reviews.select(ID, F.inline(F.array(_event(
        "review", reviewed, reviewed, s2=F.col("rating"), s3=one(F.col("rating").isNotNull()), s4=F.lit(1)))))
    events = events.unionByName(items.select(ID, F.inline(bought))).unionByName(reviews)
    return events.groupBy(ID, "kind", "key", "sub").agg(
        F.min("day").alias("day"), *[F.sum(c).alias(c) for c in ("s1", "s2", "s3", "s4")], *[F.max(c).alias(c) for c in ("m1", "m2")])


def activity(units: DataFrame, dates: Dates, window_days: int = CHURN_WINDOW_DAYS) -> DataFrame:
    """All features that come from events, per customer and snapshot, in one aggregate over the units."""
    kind, past = F.col("kind"), F.col("day") <= F.col(SNAPSHOT)
    seen = see(units, "day", dates, ahead=window_days).where(past | (kind == "order"))

    def total(of: str, column: str) -> Column:
        return F.sum(F.when(kind == of, F.col(column)))

    g = seen.groupBy(*KEYS).agg(
        *_order_sums(kind == "order", F.col("day"), F.col("s1"), F.col("s2")),
        F.count_if(kind == "category").alias("category_count"),
        total("item", "s1").alias("historical_item_count"),
        (total("item", "m2") / F.nullif(total("item", "m1"), F.lit(0))).alias("discount_order_rate"),
        F.count_if(kind == "return").alias("return_count"),
        F.count_if(kind == "return_order").alias("orders_with_returns"),
        total("review", "s4").alias("review_count"),
        ratio(total("review", "s2"), total("review", "s3")).alias("avg_rating_given"),
        F.max(F.when(kind == "review", 1)).cast("bigint").alias("has_review"),
        total("delivery", "s1").alias("late_delivery_count"),
        ratio(total("delivery", "s2"), total("delivery", "s3")).alias("avg_delivery_delay"),
        F.max(F.when(kind == "delivery", 1)).cast("bigint").alias("has_completed_delivery"),
    )
    return g.where("total_orders >= 1").select(
        *KEYS, *_order_columns(), "category_count", "historical_item_count", "discount_order_rate", "return_count", "orders_with_returns",
        "review_count", "avg_rating_given", "has_review", "late_delivery_count", "avg_delivery_delay", "has_completed_delivery")


def build_snapshots(gold, dates: Dates, with_label: bool = True, units: DataFrame | None = None) -> DataFrame:
    """Features (and label) per customer and snapshot; each source is read once for all snapshots.

    ``units``: the stored ``customer_units`` of the layer, for callers that build snapshots more than once.
    """
    units = customer_units(gold) if units is None else units
    zero = F.lit(0).cast("bigint")
    joined = activity(units, dates).join(customer_attributes(gold.dim_customers, dates), KEYS, "inner")
    joined = joined.select("*", F.when(F.col(WINDOW_ORDERS) == 0, 1).otherwise(0).cast("bigint").alias(LABEL))
    returns = dict(zip(("return_count", "has_return", "return_order_rate", "return_item_rate"), _return_columns()))
    counts = ("category_count", "historical_item_count", "review_count", "late_delivery_count")
    flags = ("has_review", "has_completed_delivery")

    def column(name: str) -> Column:
        if name in returns:
            filled = returns[name]
        else:
            filled = F.col(name)
        if name in counts or name in flags or name in ("return_count", "has_return"):
            filled = F.coalesce(filled, zero)
        if name.endswith("_rate"):
            filled = F.least(F.greatest(F.coalesce(filled, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        return filled.alias(name)

    wanted = [c for c in SNAPSHOT_COLUMNS if with_label or c not in (WINDOW_ORDERS, LABEL)]
    return joined.select(*[column(c) for c in wanted])


def scoring_snapshot(gold, score_date: dt.date, units: DataFrame | None = None) -> DataFrame:
    return build_snapshots(gold, [score_date], with_label=False, units=units).withColumnRenamed(SNAPSHOT, "score_date")


def with_split(snapshots: DataFrame, train: Dates, validation: dt.date, test: dt.date) -> DataFrame:
    day = F.col(SNAPSHOT)
    split = (
        F.when(day.isin(*train), "train").when(day == validation, "validation").when(day == test, "test")
    )
    return snapshots.withColumn("split", split)
