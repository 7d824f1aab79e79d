"""Order and order-item facts.

Facts carry amounts as ``*_cents`` columns; ``functions.show_money`` turns them into currency columns.
The joins carry no broadcast hint: the optimizer broadcasts a dimension when its measured size allows
and otherwise splits skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import cents
from stallkeeper.operators.dims import UNKNOWN_CUSTOMER_ID

ORDER_MONEY = ("subtotal", "discount_amount", "tax_amount", "shipping_cost", "total_amount")
ITEM_MONEY = ("unit_price", "unit_cost", "discount_amount", "tax_amount", "line_total")
INELIGIBLE = ("cancelled", "refunded")


def is_eligible(status: Column | str = "order_status") -> Column:
    status = F.col(status) if isinstance(status, str) else status
    return ~status.isin(*INELIGIBLE)


def eligible(df: DataFrame, status: str = "order_status") -> DataFrame:
    """Rows that count for revenue; rows without a status drop out."""
    return df.where(is_eligible(status))


def lookup(dim: DataFrame, key: str, renamed: dict[str, str]) -> DataFrame:
    """One row per key with the wanted columns, and a hash of the key as ``_{key}_mark``; see ``look_up``.

    Grouping states the dimension's key to the optimizer: a left join to it disappears from every plan
    that uses none of its columns, which saves shuffling the whole fact.
    """
    row = F.max(F.struct(*[F.col(c).alias(name) for c, name in renamed.items()])).alias("_row")
    keyed = dim.groupBy(F.col(key).alias(f"_{key}")).agg(row)
    return keyed.select(f"_{key}", F.xxhash64(f"_{key}").alias(f"_{key}_mark"), "_row.*")


def look_up(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Left join to a ``lookup`` on its key and mark.

    The mark adds nothing to the match, but the grouped side is not partitioned by it and so gets an exchange of its
    own right below the join, without which adaptive execution cannot split a hot key of the fact.
    """
    same = (F.col(key) == F.col(f"_{key}")) & (F.xxhash64(key) == F.col(f"_{key}_mark"))
    return df.join(found, same, "left")


def fact_orders(orders: DataFrame, dim_customers: DataFrame) -> DataFrame:
    known = lookup(
        dim_customers.where(~F.col("is_unknown_customer")).withColumn("_id", F.col("customer_id")),
        "customer_id",
        {"_id": "_known_id", "segment": "_segment", "signup_cohort": "_cohort", "country_code": "_country"},
    )
    # whole cents move in fewer bytes than currency units
    counted = orders.select(*[c for c in orders.columns if c not in ORDER_MONEY], *[cents(c).alias(f"{c}_cents") for c in ORDER_MONEY])
    joined = look_up(counted, known, "customer_id")
    return joined.select(
        "order_id",
        "order_number",
        F.coalesce("_known_id", F.lit(UNKNOWN_CUSTOMER_ID)).alias("customer_id"),
        F.col("customer_id").alias("source_customer_id"),
        F.col("_known_id").isNull().alias("is_unknown_customer"),
        "region",
        "order_status",
        "order_channel",
        "device_type",
        "order_placed_at",
        F.to_date("order_placed_at").alias("order_date"),
        "currency",
        *[f"{c}_cents" for c in ORDER_MONEY],
        "item_count",
        "is_first_order",
        "ingestion_delay_days",
        "is_late_arrival",
        "_has_negative_shipping",
        "_has_impossible_discount",
        F.coalesce("_segment", F.lit("unknown")).alias("customer_segment"),
        F.coalesce("_cohort", F.lit("unknown")).alias("customer_signup_cohort"),
        F.coalesce("_country", F.lit("UNK")).alias("customer_country"),
        "created_at",
        "updated_at",
    )


def gmv_valid() -> Column:
    """Positive quantity, known non-negative price, discount between zero and the item's value."""
    price, discount, qty = F.col("unit_price_cents"), F.col("discount_amount_cents"), F.col("quantity")
    rule = (qty > 0) & (price >= 0) & (discount >= 0) & (discount <= price * qty)
    return F.coalesce(rule, F.lit(False))


def margin_valid() -> Column:
    return gmv_valid() & F.coalesce(F.col("unit_cost_cents") >= 0, F.lit(False))


def item_cents(items: DataFrame) -> DataFrame:
    """Whole cents and whether they are valid."""
    kept = [c for c in items.columns if c not in ITEM_MONEY]
    return items.select(*kept, *[cents(c).alias(f"{c}_cents") for c in ITEM_MONEY]).withColumn("is_gmv_valid", gmv_valid())


def item_money(items: DataFrame) -> DataFrame:
    """Validity flags and merchandise amounts; amounts of invalid items stay NULL."""
    return item_amounts(item_cents(items))


def item_amounts(base: DataFrame) -> DataFrame:
    """Merchandise amounts of ``item_cents``."""
    base = base.withColumn("is_margin_valid", margin_valid())
    gross = F.col("unit_price_cents") * F.col("quantity")
    net = gross - F.col("discount_amount_cents")
    return base.withColumns(
        {
            "gross_gmv_cents": F.when(F.col("is_gmv_valid"), gross),
            "net_gmv_cents": F.when(F.col("is_gmv_valid"), net),
            "merchandise_cost_cents": F.when(F.col("is_margin_valid"), F.col("unit_cost_cents") * F.col("quantity")),
            "expected_line_total_cents": F.when(F.col("is_gmv_valid"), net + F.col("tax_amount_cents")),
        }
    )


ORDER_COLUMNS = ("order_date", "region", "customer_segment", "order_status", "customer_id")


def joined_items(items: DataFrame, orders_fact: DataFrame) -> DataFrame:
    """Items as whole cents, with what they take from their order.

    Items move by order while they are narrow: as whole cents and a flag that spares the price where a query wants no
    amount. ``customer_id`` rides along so marts need no second join back to the orders.
    """
    orders = orders_fact.select(F.col("order_id").alias("_order_id"), *ORDER_COLUMNS)
    return item_cents(items).join(orders, F.col("order_id") == F.col("_order_id"), "left").drop("_order_id")


def with_amounts(rows: DataFrame, after: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """``item_amounts``, with the columns ``after`` behind the amounts."""
    whole = item_amounts(rows)
    return whole.select(*[c for c in whole.columns if c not in after], *after)


def ordered_items(items: DataFrame, orders_fact: DataFrame) -> DataFrame:
    """Items with their money and what they take from their order: all that a stored item needs."""
    return with_amounts(joined_items(items, orders_fact))


def named_items(ordered: DataFrame, dim_products: DataFrame, dim_sellers: DataFrame) -> DataFrame:
    """Items with names of their product and seller; a query that uses none of a dimension's columns does not join it.

    Items without amounts get them last: four numbers less to move by product and by seller.
    """
    names = {"product_name": "product_name", "subcategory": "subcategory", "brand": "brand", "price_tier": "price_tier",
             "gross_margin_pct": "product_margin_pct"}
    seller_names = {"business_name": "seller_name", "tier": "seller_tier", "commission_rate": "seller_commission_rate"}
    products, sellers = lookup(dim_products, "product_id", names), lookup(dim_sellers, "seller_id", seller_names)
    named = look_up(look_up(ordered, products, "product_id"), sellers, "seller_id")
    after = [*names.values(), *seller_names.values(), *ORDER_COLUMNS]
    plain = named.select(*[c for c in ordered.columns if c not in ORDER_COLUMNS], *after)
    return plain if "net_gmv_cents" in ordered.columns else with_amounts(plain, after)


def fact_order_items(
    items: DataFrame, dim_products: DataFrame, dim_sellers: DataFrame, orders_fact: DataFrame
) -> DataFrame:
    return named_items(joined_items(items, orders_fact), dim_products, dim_sellers)


def margin_cents() -> Column:
    return F.col("net_gmv_cents") - F.col("merchandise_cost_cents")
