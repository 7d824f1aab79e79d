"""Loading raw folders in the old layout, the new one and both at once; written tables read back.

The old layout holds amounts as numbers and the external id under its first name; the new one holds amounts as text and
has more columns. Rows are dealt by their number, so that a mixed folder has both.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue.registry import Market, register
from catalogue.sqlbase import cte
from stallkeeper.session import scratch_folder
from stallkeeper.sources import io
from stallkeeper.sources.layouts import layout_report
from stallkeeper.sources.schemas import raw_columns

AMOUNTS = ("subtotal", "discount_amount", "shipping_cost", "total_amount")


def orders_layouts(m: Market) -> dict[str, DataFrame]:
    """The same orders in both layouts, and half in each."""
    old = m.clean["orders"]
    number = F.substring("order_id", 2, 30).cast("bigint")
    text = {c: F.concat(F.lit("$"), F.col(c).cast("string")) for c in AMOUNTS}
    new = old.withColumns({**text, "_ingestion_delay_days": (number % 9).cast("int")})
    return {"old": [old], "new": [new], "mixed": [old.where(number % 2 == 0), new.where(number % 2 != 0)]}


def customers_layouts(m: Market) -> dict[str, DataFrame]:
    old = m.clean["customers"]
    number = F.substring("customer_id", 2, 30).cast("bigint")
    new = old.withColumnRenamed("customer_external_id", "cust_ext_id").withColumns({
        "promo_code": F.concat(F.lit("P"), (number % 7).cast("string")), "loyalty_points": (number % 100).cast("string"),
        "referral_source": F.when(number % 3 == 0, F.lit("friend"))})
    return {"old": [old], "new": [new], "mixed": [old.where(number % 2 == 0), new.where(number % 2 != 0)]}


def written(m: Market, parts: dict[str, list[DataFrame]]) -> dict[str, str]:
    folders = {}
    for kind, frames in parts.items():
        folders[kind] = scratch_folder(m.spark, f"raw-{kind}")
        for frame in frames:
            io.write_table(frame, folders[kind], mode="append")
    return folders


def loaded(m: Market, entity: str, parts: dict[str, list[DataFrame]]) -> DataFrame:
    out = None
    for kind, folder in written(m, parts).items():
        rows = io.bronze(m.spark, folder, entity).drop("_loaded_at").withColumn("folder", F.lit(kind))
        out = rows if out is None else out.unionAll(rows)
    return out


def both_sql(table: str, number: str, old: dict[str, str], new: dict[str, str], entity: str) -> str:
    """Every row in both layouts, and by its number in one of them."""
    def cells(of):
        return ", ".join(f"{of.get(c, c)} AS {c}" for c in raw_columns(entity))
    return f"""SELECT 'old' AS folder, '{entity}' AS _source, {cells(old)} FROM {table}
UNION ALL SELECT 'new', '{entity}', {cells(new)} FROM {table}
UNION ALL SELECT 'mixed', '{entity}', {cells(old)} FROM {table} WHERE {number} % 2 = 0
UNION ALL SELECT 'mixed', '{entity}', {cells(new)} FROM {table} WHERE {number} % 2 <> 0"""


ORDER_NUMBER, CUSTOMER_NUMBER = "CAST(substr(order_id, 2) AS BIGINT)", "CAST(substr(customer_id, 2) AS BIGINT)"
register("bronze_orders", lambda m: loaded(m, "orders", orders_layouts(m)), both_sql(
    "raw_orders", ORDER_NUMBER,
    {**{c: f"CAST({c} AS VARCHAR)" for c in AMOUNTS}, "_ingestion_delay_days": "CAST(NULL AS INTEGER)"},
    {**{c: f"'$' || CAST({c} AS VARCHAR)" for c in AMOUNTS}, "_ingestion_delay_days": f"CAST({ORDER_NUMBER} % 9 AS INTEGER)"}, "orders"))
cte("raw_customers", "SELECT * RENAME (customer_external_id AS cust_ext_id) FROM customers")
LATER = ("promo_code", "loyalty_points", "referral_source")
register("bronze_customers", lambda m: loaded(m, "customers", customers_layouts(m)), both_sql(
    "raw_customers", CUSTOMER_NUMBER, {c: "CAST(NULL AS VARCHAR)" for c in LATER},
    {"promo_code": f"'P' || {CUSTOMER_NUMBER} % 7", "loyalty_points": f"CAST({CUSTOMER_NUMBER} % 100 AS VARCHAR)",
     "referral_source": f"CASE WHEN {CUSTOMER_NUMBER} % 3 = 0 THEN 'friend' END"}, "customers"))


def silver_of_mixed(m: Market) -> DataFrame:
    """Cleaned orders straight from the mixed folder."""
    from stallkeeper.plans.silver import silver_orders

    folder = written(m, {"mixed": orders_layouts(m)["mixed"]})["mixed"]
    return silver_orders(io.bronze(m.spark, folder, "orders"))


register("silver_from_mixed_layouts", silver_of_mixed, f"""
SELECT order_id, order_number, customer_id, region, order_status, order_channel, device_type, order_placed_at, currency,
  subtotal, discount_amount, tax_amount, shipping_cost, total_amount, item_count, is_first_order, created_at, updated_at,
  CAST(CASE WHEN {ORDER_NUMBER} % 2 = 0 THEN 0 ELSE {ORDER_NUMBER} % 9 END AS INTEGER) AS ingestion_delay_days,
  {ORDER_NUMBER} % 2 <> 0 AND {ORDER_NUMBER} % 9 > 0 AS is_late_arrival,
  coalesce(shipping_cost < 0, false) AS _has_negative_shipping, coalesce(discount_amount > subtotal, false) AS _has_impossible_discount
FROM raw_orders""")


def layout_types(m: Market) -> DataFrame:
    """Columns of the mixed orders folder and the types they come in."""
    folder = written(m, {"mixed": orders_layouts(m)["mixed"]})["mixed"]
    return layout_report(m.spark, folder).drop("files")


register("layout_types_orders", layout_types, " UNION ALL ".join(
    [f"SELECT '{c}' AS column_name, '{t}' AS column_type, {1 if c in (*AMOUNTS, '_ingestion_delay_days') else 2}::BIGINT AS layouts"
     for c, t in raw_columns("orders").items()] + [f"SELECT '{c}', 'double', 1" for c in AMOUNTS]))


def parquet_round_trip(m: Market) -> DataFrame:
    """Sellers written in folders by tier and read back."""
    folder = scratch_folder(m.spark, "sellers")
    io.write_table(m.clean["sellers"], folder, partition_by=["tier"])
    return m.spark.read.parquet(folder).select(m.clean["sellers"].columns)


register("parquet_round_trip", parquet_round_trip, "SELECT * FROM sellers")


def csv_round_trip(m: Market) -> DataFrame:
    """Products as CSV with a header, read back by their schema."""
    folder = scratch_folder(m.spark, "products")
    io.write_csv(m.clean["products"], folder)
    return m.spark.read.schema(m.clean["products"].schema).option("header", True).csv(folder)


register("csv_round_trip", csv_round_trip, "SELECT * FROM products")
