"""Join shapes used around the marketplace tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.operators.dedupe import duplicate_keys


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """Child rows without a parent; rows with an empty foreign key count as orphans."""
    return child.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def with_params(df: DataFrame, **params: object) -> DataFrame:
    """Constant parameters as columns; no join is needed."""
    return df.withColumns({k: F.lit(v) for k, v in params.items()})


def sellable_products(products: DataFrame, sellers: DataFrame, until: dt.date | None = None) -> DataFrame:
    """Active products with the sales window of their unsuspended seller."""
    window = sellers.select(
        "seller_id",
        F.col("onboarding_date").alias("seller_start_date"),
        F.col("sales_end_date").alias("seller_end_date"),
        "sales_profile",
    )
    open_window = products.where("is_active").join(window, "seller_id")
    if until is not None:
        open_window = open_window.where(F.coalesce("seller_end_date", F.lit(until)) >= F.lit(until))
    return open_window.select(
        "product_id", "seller_id", "category", "price", "cost", "launch_date", "seller_start_date", "seller_end_date",
        "sales_profile",
    )


def delivered_items(items: DataFrame, orders: DataFrame, shipments: DataFrame) -> DataFrame:
    """Items of delivered orders with the delivery time of the order's latest shipment."""
    done = orders.where("order_status = 'delivered'").select("order_id", "customer_id")
    arrival = shipments.where("delivered_at is not null").groupBy("order_id").agg(
        F.max_by("delivered_at", F.struct("shipped_at", "shipment_id")).alias("delivered_at")
    )
    columns = ["order_id", "order_item_id", "product_id", "seller_id", "category", "line_total"]
    return items.select(*columns).join(done, "order_id").join(arrival, "order_id")


def join_one_to_one(left: DataFrame, right: DataFrame, key: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join that refuses repeated keys on either side when it runs; making the plan runs no job.

    The refusal is a branch of the plan that yields no row: it counts rows per key on each side and raises an error at a
    count above one. An action that stops before it has read every branch (``first``, ``take``) may miss it.
    """
    keys = [key] if isinstance(key, str) else list(key)
    joined = left.join(right, keys, how)
    for side, df in (("left", left), ("right", right)):
        found = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
        refuse = F.raise_error(F.concat(F.lit(f"repeated {keys} on the {side} side: "), found)).cast("boolean")
        repeated = duplicate_keys(df, keys).where(F.when(F.col("occurrences") > 1, refuse).otherwise(False))
        joined = joined.unionAll(repeated.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in joined.schema]))
    return joined
