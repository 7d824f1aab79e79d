"""Driver tables read as marketplace tables. ``sqlbase`` holds the same rules as SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from stallkeeper.session import tune

AS_OF = dt.date(2001, 8, 1)
CALENDAR = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))
TRAIN = (dt.date(2000, 6, 30), dt.date(2000, 9, 30))
VALIDATION = dt.date(2000, 12, 31)
TEST = dt.date(2001, 3, 31)
SCORE = dt.date(2001, 6, 30)


CHANNELS = ["organic", "paid_search", "social", "referral", "email"]
FIRST_NAMES = ["José", "María", "João", "Ana", "Zoë", "Günter", "Noémie", "Peter"]
LAST_NAMES = ["García", "Núñez", "Souza", "Öz", "Smith", "Gonçalves", "Brown"]
TITLES = ["Très bien", "Muy fácil", "Good", "Não é bom"]
OPINION = "Opinião "
TIERS = ["new", "bronze", "silver", "gold", "platinum"]
RATES = [0.165, 0.14, 0.12, 0.10, 0.08]
CATEGORIES = ["electronics", "home", "fashion", "beauty", "sports", "toys"]
STATUSES = ["cancelled", "cancelled", "refunded", "shipped", "in_transit", "paid", "placed"]
REASONS = ["defective", "wrong_item", "not_as_described", "changed_mind", "late", "size", "other"]


def pick(values: list, key: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"{v}D" for v in values)
    return f"element_at(array({items}), cast(({key}) % {len(values)} as int) + 1)"


ITEM_HASH = (
    "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(floor(l_extendedprice * 100D + 0.5D) as bigint)))"
)


def usd(cents: str) -> str:
    return f"({cents}) / 100D"


class Testbed:
    """Marketplace tables over one driver folder; every table is a lazy frame."""

    ENTITIES = (
        "customers", "sellers", "products", "orders", "order_items", "payments", "shipments", "returns", "reviews",
    )

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = tune(spark)
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def places(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return joined.selectExpr("n_nationkey", "n_name as country_code", "r_name as region")

    @cached_property
    def customers(self) -> DataFrame:
        base = self.read("customer")
        base = base.join(self.places, base.c_nationkey == self.places.n_nationkey, "left")
        return base.selectExpr(
            "*", "c_custkey as k", "date_add(date '1994-07-01', cast((c_custkey * 37) % 900 as int)) as signup"
        ).selectExpr(
            "concat('C', k) as customer_id",
            "c_name as customer_external_id",
            "concat(lower(replace(c_name, '#', '.')), '@mail.example') as email",
            f"{pick(FIRST_NAMES, 'k')} as first_name",
            f"{pick(LAST_NAMES, 'k')} as last_name",
            "region",
            "country_code",
            "case c_mktsegment when 'AUTOMOBILE' then 'whale' when 'FURNITURE' then 'bargain_hunter' "
            "when 'MACHINERY' then 'low_frequency' else 'regular' end as segment",
            "signup as signup_date",
            f"case when k % 40 <> 11 then {pick(CHANNELS, 'k')} end as signup_channel",
            "case k % 20 when 0 then 'suspended' when 1 then 'closed' else 'active' end as account_status",
            "cast(signup as timestamp_ntz) as created_at",
            "cast(signup as timestamp_ntz) + make_dt_interval(0, 0, 0, k % 1000) as updated_at",
        )

    @cached_property
    def sellers(self) -> DataFrame:
        base = self.read("supplier")
        base = base.join(self.places, base.s_nationkey == self.places.n_nationkey, "left")
        return base.selectExpr(
            "*", "s_suppkey as k", "date_add(date '1994-01-01', cast((s_suppkey * 53) % 900 as int)) as started"
        ).selectExpr(
            "concat('S', k) as seller_id",
            "concat('SEL-', k) as seller_external_id",
            "s_name as business_name",
            f"{pick(['individual', 'business', 'enterprise'], 'k')} as seller_type",
            f"{pick(TIERS, 'k')} as tier",
            "started as onboarding_date",
            f"{pick(['steady', 'seasonal', 'declining', 'stopped'], 'k')} as sales_profile",
            "case k % 10 when 3 then date '2001-04-02' when 5 then date '2001-06-16' end as sales_end_date",
            "region",
            "country_code",
            f"{pick(CATEGORIES, 'k')} as primary_category",
            "3D + (k % 20) / 10D as avg_rating",
            "k % 500 as total_reviews",
            "k % 2 = 0 as is_verified",
            "k % 25 = 0 as is_suspended",
            f"{pick(RATES, 'k')} as commission_rate",
            "cast(started as timestamp_ntz) as created_at",
            "cast(started as timestamp_ntz) as updated_at",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.read("part").selectExpr(
            "*",
            "p_partkey as k",
            "cast(floor(p_retailprice * 100D + 0.5D) as bigint) - 89500 as price_c",
            "date_add(date '1994-01-01', cast(p_partkey % 365 as int)) as launched",
        ).selectExpr(
            "concat('P', k) as product_id",
            "concat('SKU-', k) as product_sku",
            "concat('S', k % 10) as seller_id",
            "p_name as product_name",
            f"{pick(CATEGORIES, 'k')} as category",
            "p_type as subcategory",
            "p_brand as brand",
            f"{usd('price_c')} as price",
            "floor(price_c * (30 + p_size) / 100D + 0.5D) / 100D as cost",
            "p_size / 10D as weight_kg",
            "1D + (k % 40) / 10D as avg_rating",
            "k % 300 as review_count",
            "(k % 25) / 100D as return_rate",
            "k % 12 <> 0 as is_active",
            "launched as launch_date",
            "cast(launched as timestamp_ntz) as created_at",
            "cast(launched as timestamp_ntz) as updated_at",
        )

    @cached_property
    def _lines(self) -> DataFrame:
        return (
            self.read("lineitem")
            .selectExpr(
                "*",
                "cast(floor(l_extendedprice / l_quantity * 100D + 0.5D) as bigint) as price_c",
                "cast(l_quantity as int) as qty",
                f"{ITEM_HASH} as item_hash",
            )
            .selectExpr("*", "price_c * qty as gross_c")
            .selectExpr("*", "cast(floor(gross_c * l_discount + 0.5D) as bigint) as disc_c")
            .selectExpr("*", "cast(floor((gross_c - disc_c) * l_tax + 0.5D) as bigint) as tax_c")
        )

    @cached_property
    def orders(self) -> DataFrame:
        totals = self._lines.groupBy("l_orderkey").agg(
            {"gross_c": "sum", "disc_c": "sum", "tax_c": "sum", "l_orderkey": "count"}
        ).selectExpr(
            "l_orderkey", "`sum(gross_c)` as sub_c", "`sum(disc_c)` as dis_c", "`sum(tax_c)` as txs_c",
            "`count(l_orderkey)` as n_items",
        )
        # the grouped side has one row per key, so queries that use no total drop this join
        base = self.read("orders")
        return base.join(totals, base.o_orderkey == totals.l_orderkey, "left").selectExpr(
            "*", "o_orderkey as k", "399 + (o_orderkey % 13) * 100 as ship_c"
        ).selectExpr(
            "concat('O', k) as order_id",
            "concat('ORD-', k) as order_number",
            "concat(if(o_custkey % 50 = 7, 'X', 'C'), o_custkey) as customer_id",
            "case o_orderpriority when '1-URGENT' then 'AMERICA' when '2-HIGH' then 'EUROPE' "
            "when '3-MEDIUM' then 'ASIA' when '4-NOT SPECIFIED' then 'AFRICA' else 'MIDDLE EAST' end as region",
            f"case when k % 20 < 7 then {pick(STATUSES, 'least(k % 20, 6)')} else 'delivered' end as order_status",
            f"{pick(['web', 'mobile_app', 'marketplace_api'], 'k')} as order_channel",
            f"{pick(['desktop', 'phone', 'tablet'], 'k')} as device_type",
            "o_orderdate as order_placed_at",
            "'USD' as currency",
            f"{usd('sub_c')} as subtotal",
            f"{usd('dis_c')} as discount_amount",
            f"{usd('txs_c')} as tax_amount",
            f"{usd('ship_c')} as shipping_cost",
            "case when k % 50 = 11 then cast(floor(o_totalprice * 100D + 0.5D) as bigint) "
            "else sub_c - dis_c + txs_c + ship_c end / 100D as total_amount",
            "coalesce(n_items, 0L) as item_count",
            "k % 10 = 0 as is_first_order",
            "o_orderdate as created_at",
            "o_orderdate + make_dt_interval(0, 0, 0, k % 3600) as updated_at",
        )

    @cached_property
    def order_items(self) -> DataFrame:
        # one row per key on the right: the join goes away when seller_id is not used; its key is the one that items join
        # their orders on, so that the lines move once for both
        placed = self.read("orders").selectExpr("concat('O', o_orderkey) as placed_id", "o_orderdate").groupBy("placed_id").agg(
            {"o_orderdate": "min"}).selectExpr("placed_id", "`min(o_orderdate)` as o_orderdate")
        # the hash is wider than the keys that it is made of, so these move in its place
        lines = self._lines.drop("item_hash").selectExpr("*", "concat('O', l_orderkey) as order_id")
        return lines.join(placed, lines.order_id == placed.placed_id, "left").selectExpr(
            f"{ITEM_HASH} as order_item_id",
            "order_id",
            "concat('P', l_partkey) as product_id",
            "concat('S', if(l_suppkey % 20 = 0 "
            "or (l_suppkey % 10 = 3 and o_orderdate > timestamp_ntz '2001-04-02 00:00:00') "
            "or (l_suppkey % 10 = 5 and o_orderdate > timestamp_ntz '2001-06-16 00:00:00'), "
            "l_suppkey + 1, l_suppkey)) as seller_id",
            f"case when (l_orderkey * 7 + l_linenumber) % 500 <> 0 then {pick(CATEGORIES, 'l_partkey')} end as category",
            "qty as quantity",
            f"{usd('price_c')} as unit_price",
            "floor(price_c * (30 + l_partkey % 51) / 100D + 0.5D) / 100D as unit_cost",
            f"{usd('disc_c')} as discount_amount",
            f"{usd('tax_c')} as tax_amount",
            f"{usd('gross_c - disc_c + tax_c')} as line_total",
        )

    @cached_property
    def _shipping(self) -> DataFrame:
        return (
            self.read("orders")
            .where("o_orderkey % 20 > 1 and o_orderkey % 20 <> 6")
            .selectExpr(
                "o_orderkey",
                "o_custkey",
                "o_orderdate + make_dt_interval(cast(o_orderkey % 3 + 1 as int)) as shipped_at",
                "if(o_orderkey % 12 = 0, 1 + o_orderkey % 7, 0L) as delay_days",
            )
            .selectExpr(
                "*",
                "case when o_orderkey % 20 in (2, 5) or o_orderkey % 20 >= 7 "
                "then shipped_at + make_dt_interval(cast(delay_days + 4 as int)) end as delivered_at",
            )
        )

    @cached_property
    def shipments(self) -> DataFrame:
        return self._shipping.selectExpr(
            "concat('SHP', o_orderkey) as shipment_id",
            "concat('O', o_orderkey) as order_id",
            f"{pick(['UPS', 'FedEx', 'DHL', 'Correios'], 'o_orderkey')} as carrier",
            "concat('TRK', o_orderkey) as tracking_number",
            f"{pick(['standard', 'express', 'next_day', 'same_day', 'standard'], 'o_orderkey')} as shipping_method",
            "if(delivered_at is not null, 'delivered', 'in_transit') as status",
            "shipped_at",
            "shipped_at + make_dt_interval(4) as estimated_delivery_at",
            "delivered_at",
            "(o_orderkey % 50) / 10D as weight_kg",
            "(399 + (o_orderkey % 13) * 100) / 100D as shipping_cost",
            "o_orderkey % 9 = 0 as is_international",
            "delay_days",
            "if(o_orderkey % 11 = 0, 2, 1) as delivery_attempts",
            "shipped_at as created_at",
            "shipped_at as updated_at",
        )

    @cached_property
    def payments(self) -> DataFrame:
        methods = ["credit_card", "debit_card", "paypal", "apple_pay", "google_pay", "bank_transfer"]
        return (
            self.orders.selectExpr("*", "cast(substring(order_id, 2) as bigint) as k")
            .selectExpr("*", "explode(if(k % 20 = 9, array(1, 2), array(1))) as n")
            .selectExpr(
                "*",
                "(k % 20 = 9 and n = 1) or k % 20 < 2 as failed",
                "order_placed_at + make_dt_interval(0, 0, 0, 300 + (n - 1) * 3600) as att",
            )
            .selectExpr(
                "concat('PAY', k, '-', n) as payment_id",
                "order_id",
                f"{pick(methods, 'k')} as payment_method",
                f"case when k % 6 < 2 then {pick(['visa', 'mastercard', 'amex'], 'k')} end as card_brand",
                "case when failed then 'failed' when k % 20 = 2 then 'refunded' when k % 20 = 6 then 'pending' "
                "else 'captured' end as payment_status",
                "coalesce(total_amount, 0D) as amount",
                "currency",
                f"{pick(['stripe', 'adyen', 'paypal'], 'k')} as processor",
                "concat('TX', k, '-', n) as processor_transaction_id",
                "att as attempted_at",
                "case when not failed then att + make_dt_interval(0, 0, 1) end as completed_at",
                f"case when failed then {pick(['insufficient_funds', 'card_declined', 'processor_error'], 'k')} end "
                "as failure_reason",
                "n = 2 as is_retry",
                "case when n = 2 then concat('PAY', k, '-1') end as retry_of_payment_id",
                "att as created_at",
                "att as updated_at",
            )
        )

    @cached_property
    def _delivered_lines(self) -> DataFrame:
        done = self._shipping.where("delivered_at is not null and o_orderkey % 20 >= 7")
        # the rating moves in place of the keys that it is made of, and these in place of their hash, which is wider
        lines = self._lines.drop("item_hash").selectExpr("*", "cast(1 + (l_orderkey + l_linenumber + l_partkey) % 5 as int) as rating")
        return lines.join(done, lines.l_orderkey == done.o_orderkey).selectExpr(
            "*", "concat(if(o_custkey % 50 = 7, 'X', 'C'), o_custkey) as customer_id", f"{ITEM_HASH} as item_hash"
        )

    @cached_property
    def returns(self) -> DataFrame:
        lines = self._delivered_lines.where("l_returnflag = 'R'")
        return lines.selectExpr("*", "delivered_at + make_dt_interval(l_linenumber + 3) as at").selectExpr(
            "concat('R-', item_hash) as return_id",
            "concat('O', l_orderkey) as order_id",
            "item_hash as order_item_id",
            "customer_id",
            "concat('P', l_partkey) as product_id",
            f"{pick(CATEGORIES, 'l_partkey')} as category",
            f"{pick(REASONS, 'l_partkey')} as return_reason",
            f"{pick(['requested', 'refunded'], 'l_linenumber')} as return_status",
            "at as initiated_at",
            "at + make_dt_interval(5) as received_at",
            f"{usd('gross_c - disc_c')} as refund_amount",
            "l_linenumber % 3 = 0 as is_partial_refund",
            "at as created_at",
            "at as updated_at",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self._delivered_lines.selectExpr("*", "delivered_at + make_dt_interval(5) as at").selectExpr(
            "concat('V-', item_hash) as review_id",
            "concat('O', l_orderkey) as order_id",
            "item_hash as order_item_id",
            "concat('P', l_partkey) as product_id",
            "customer_id",
            "concat('S', l_suppkey) as seller_id",
            "rating",
            f"{pick(TITLES, 'l_partkey')} as title",
            f"concat('{OPINION}', l_orderkey) as review_text",
            "l_partkey % 4 <> 0 as is_verified_purchase",
            "l_partkey % 9 as helpful_votes",
            "l_partkey % 9 + 3 as total_votes",
            "at as submitted_at",
            "at as created_at",
            "at as updated_at",
        )


class LazyTables(Mapping):
    """Values by name, built when first asked for."""

    def __init__(self, names: tuple[str, ...], build: Callable[[str], object]):
        self._names, self._build, self._built = names, build, {}

    def __getitem__(self, name: str):
        if name not in self._names:
            raise KeyError(name)
        if name not in self._built:
            self._built[name] = self._build(name)
        return self._built[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)
