"""Distributions of the source tables."""

from catalogue.registry import register
from catalogue.sqlbase import cents, mean_usd, pct, ratio, rnd, usd
from stallkeeper.plans import mixes as x

T = cents("total_amount")
SQL_NAME = {"orders": "raw_orders"}


def counts(table: str, *columns: str) -> None:
    for column in columns:
        register(
            f"{table[:-1]}_mix_{column}",
            lambda m, c=column: x.mix(m.clean[table], c),
            f"SELECT {column}, count(*) AS count FROM {SQL_NAME.get(table, table)} GROUP BY {column}",
        )


counts("orders", "order_status", "order_channel")
counts("payments", "payment_status", "payment_method", "processor")
counts("shipments", "carrier", "shipping_method")
counts("returns", "category", "return_reason")
counts("reviews", "rating")
counts("products", "category")
counts("sellers", "seller_type", "sales_profile", "tier", "region", "primary_category")
counts("customers", "segment", "region")

register(
    "order_mix_region",
    lambda m: x.order_mix(m.clean["orders"], "region"),
    f"""SELECT region, count(*) AS orders, {usd(f'coalesce(sum({T}), 0)')} AS total_gmv,
  {mean_usd(f'sum({T})', 'count(total_amount)')} AS avg_order_value FROM raw_orders GROUP BY region""",
)
MONTHLY = f"""SELECT CAST(date_trunc('month', order_placed_at) AS DATE) AS month, count(*) AS orders,
  {usd(f'coalesce(sum({T}), 0)')} AS monthly_gmv FROM raw_orders GROUP BY 1"""
register("monthly_order_volume", lambda m: x.monthly_order_volume(m.clean["orders"]), MONTHLY)
register(
    "monthly_order_ends",
    lambda m: x.first_and_last_months(x.monthly_order_volume(m.clean["orders"])),
    f"""(SELECT *, 'first' AS end FROM ({MONTHLY}) ORDER BY month LIMIT 3) UNION ALL
  (SELECT *, 'last' AS end FROM ({MONTHLY}) ORDER BY month DESC LIMIT 3)""".replace(" AS end", ' AS "end"'),
)
register(
    "order_totals",
    lambda m: x.order_totals(m.clean["orders"], m.clean["order_items"]),
    f"""SELECT {ratio('(SELECT count(*) FROM order_items)', 'count(*)')} AS avg_items_per_order,
  {usd(f'sum({T})')} AS total_gmv, {mean_usd(f'sum({T})', 'count(total_amount)')} AS avg_order_value FROM raw_orders""",
)
register(
    "items_by_category",
    lambda m: x.items_by_category(m.clean["order_items"]),
    f"""SELECT category, count(*) AS items_sold, {usd(f"sum({cents('line_total')})")} AS category_revenue
  FROM order_items GROUP BY category""",
)
register(
    "payment_rates",
    lambda m: x.payment_rates(m.clean["payments"]),
    f"""SELECT retries, payments, {pct('retries', 'payments')} AS retry_pct, {pct('failed', 'payments')} AS failure_pct
  FROM (SELECT count(*) FILTER (is_retry) AS retries, count(*) AS payments,
    count(*) FILTER (payment_status = 'failed') AS failed FROM payments)""",
)
register(
    "failure_reasons",
    lambda m: x.failure_reasons(m.clean["payments"]),
    "SELECT failure_reason, count(*) AS count FROM payments WHERE failure_reason IS NOT NULL GROUP BY failure_reason",
)
register(
    "return_share",
    lambda m: x.share_of_items(m.clean["returns"], m.clean["order_items"], "returns"),
    f"""SELECT returns, items, {pct('returns', 'items')} AS returns_pct
  FROM (SELECT (SELECT count(*) FROM returns) AS returns, (SELECT count(*) FROM order_items) AS items)""",
)
register(
    "review_summary",
    lambda m: x.review_summary(m.clean["reviews"], m.clean["order_items"]),
    f"""SELECT count(*) AS reviews, {pct('count(*)', '(SELECT count(*) FROM order_items)')} AS review_rate_pct,
  {ratio('sum(rating)', 'count(rating)')} AS avg_rating FROM reviews""",
)
RATE = "sum(CAST(floor({0} * 1e4 + 0.5) AS BIGINT))"
register(
    "category_catalog",
    lambda m: x.category_catalog(m.clean["products"]),
    f"""SELECT category, count(*) AS products, {mean_usd(f"sum({cents('price')})", 'count(price)')} AS avg_price,
  {rnd(f"(CAST({RATE.format('return_rate')} AS DOUBLE) / count(return_rate) / 1e4)", 4)} AS avg_return_rate
  FROM products GROUP BY category""",
)
register(
    "sellers_by_product_count",
    lambda m: x.sellers_by_product_count(m.clean["products"]),
    "SELECT seller_id, count(*) AS product_count FROM products GROUP BY seller_id ORDER BY 2 DESC, 1 LIMIT 10",
)
register(
    "active_products",
    lambda m: x.active_share(m.clean["products"]),
    f"""SELECT active_products, products, {pct('active_products', 'products')} AS active_pct
  FROM (SELECT count(*) FILTER (is_active) AS active_products, count(*) AS products FROM products)""",
)
register(
    "commission_rate_by_tier",
    lambda m: x.commission_rate_by_tier(m.clean["sellers"]),
    f"""SELECT tier, {rnd(f"(CAST({RATE.format('commission_rate')} AS DOUBLE) / count(commission_rate) / 1e4)", 4)}
  AS avg_commission FROM sellers GROUP BY tier""",
)
