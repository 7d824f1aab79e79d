"""The star schema and its marts over a set of cleaned tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame

from stallkeeper.operators import dims, facts, marts
from stallkeeper.operators.clean import conform_schema
from stallkeeper.session import cut_lineage
from stallkeeper.sources.buckets import bucket_count, write_bucketed

SILVER_ORDER_FLAGS = {
    "ingestion_delay_days": 0,
    "is_late_arrival": False,
    "_has_negative_shipping": False,
    "_has_impossible_discount": False,
}
ITEMS_PER_BUCKET = 500_000  # a task sorts a bucket's items, with all their columns, in memory


class Gold:
    """Lazy gold frames. ``tables`` maps entity names to cleaned frames.

    Plans that pass over the facts many times store both once (``with_bucketed_facts``) and start from them.
    """

    def __init__(self, tables: Mapping[str, DataFrame], as_of: dt.date, stored: dict[str, DataFrame] | None = None):
        self.tables = tables
        self.as_of = as_of
        for name, frame in (stored or {}).items():
            self.__dict__[name] = frame

    def with_stored_facts(self) -> Gold:
        """The same layer over facts that are written once; for plans that read them several times."""
        facts_once = {"fact_orders": cut_lineage(self.fact_orders)}
        through = Gold(self.tables, self.as_of, facts_once)
        return Gold(self.tables, self.as_of, {**facts_once, "fact_order_items": cut_lineage(through.fact_order_items)})

    def with_bucketed_facts(self, name: str, path: str, buckets: int | None = None) -> Gold:
        """The same layer over facts stored in buckets of order_id, as tables ``{name}_fact_orders`` and
        ``{name}_fact_order_items`` below ``path``; where the session knows the tables already, over those.

        Joins of the two facts, and groupings by order, then plan without an exchange. Names of products and sellers are not
        stored with each item; they are looked up by queries that use them.
        """
        spark = self.tables["orders"].sparkSession
        orders, items = (f"{name}_{fact}" for fact in ("fact_orders", "fact_order_items"))
        if not spark.catalog.tableExists(items):
            buckets = buckets or bucket_count(self.tables["order_items"].count(), spark, ITEMS_PER_BUCKET)
            stored = write_bucketed(self.fact_orders, orders, f"{path}/fact_orders", "order_id", buckets)
            through = Gold(self.tables, self.as_of, {"fact_orders": stored})
            write_bucketed(through.ordered_items, items, f"{path}/fact_order_items", "order_id", buckets)
        return Gold(self.tables, self.as_of, {"fact_orders": spark.table(orders), "ordered_items": spark.table(items)})

    @cached_property
    def dim_customers(self) -> DataFrame:
        return dims.dim_customers(self.tables["customers"])

    @cached_property
    def dim_sellers(self) -> DataFrame:
        return dims.dim_sellers(self.tables["sellers"])

    @cached_property
    def dim_products(self) -> DataFrame:
        return dims.dim_products(self.tables["products"])

    @cached_property
    def dim_dates(self) -> DataFrame:
        return dims.dim_dates(self.tables["orders"].sparkSession)

    @cached_property
    def fact_orders(self) -> DataFrame:
        orders = conform_schema(self.tables["orders"], added=SILVER_ORDER_FLAGS)
        return facts.fact_orders(orders, self.dim_customers)

    @property
    def _items(self) -> DataFrame:
        return conform_schema(self.tables["order_items"], added={"_had_negative_quantity": False})

    @cached_property
    def ordered_items(self) -> DataFrame:
        return facts.ordered_items(self._items, self.fact_orders)

    @cached_property
    def fact_order_items(self) -> DataFrame:
        if "ordered_items" in self.__dict__:  # stored
            return facts.named_items(self.ordered_items, self.dim_products, self.dim_sellers)
        return facts.fact_order_items(self._items, self.dim_products, self.dim_sellers, self.fact_orders)

    @cached_property
    def mart_gmv_daily(self) -> DataFrame:
        return marts.mart_gmv_daily(self.fact_order_items)

    @cached_property
    def mart_customer_ltv(self) -> DataFrame:
        return marts.mart_customer_ltv(self.dim_customers, self.fact_orders, self.as_of)

    @cached_property
    def mart_seller_health(self) -> DataFrame:
        return marts.mart_seller_health(self.dim_sellers, self.fact_order_items, self.as_of)

    @property
    def returns(self) -> DataFrame:
        return self.tables["returns"]

    @property
    def reviews(self) -> DataFrame:
        return self.tables["reviews"]

    @property
    def shipments(self) -> DataFrame:
        return self.tables["shipments"]
