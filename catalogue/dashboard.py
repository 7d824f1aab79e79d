"""Compact report tables and page views."""

from catalogue.business import AVG_COMMISSION
from catalogue.governed import ITEM_MONEY, REAL
from catalogue.registry import register
from catalogue.sqlbase import big, cte, mean_usd, pct, ratio, rnd, usd
from stallkeeper.plans import dashboard as d

MONTH = "CAST(date_trunc('month', order_date) AS DATE)"
VALID_ORDERS = "count(DISTINCT order_id) FILTER (is_gmv_valid) AS orders"
ITEMS = f"{big('coalesce(sum(quantity) FILTER (is_gmv_valid), 0)')} AS items"
MARGIN = f"{usd('profit')} AS gross_margin_amount, {usd('margin_net')} AS margin_net_gmv"

cte("category_summary", f"""
SELECT category, {usd('gross')} AS gross_gmv, {usd('net')} AS net_gmv, orders, items, {MARGIN},
  {pct('profit', 'margin_net')} AS weighted_margin, {usd('disc')} AS item_discounts
FROM (SELECT category, {ITEM_MONEY}, {VALID_ORDERS}, {ITEMS}, sum(discount_amount_cents) FILTER (is_gmv_valid) AS disc
  FROM eligible_items WHERE category IS NOT NULL GROUP BY category)
""")
cte("category_monthly", f"""
SELECT month, category, {usd('net')} AS net_gmv, orders, items, {MARGIN}
FROM (SELECT {MONTH} AS month, category, {ITEM_MONEY}, {VALID_ORDERS}, {ITEMS} FROM eligible_items
  WHERE category IS NOT NULL GROUP BY 1, 2)
""")
cte("category_segment", f"""
SELECT category, coalesce(customer_segment, 'unknown') AS customer_segment, {usd('sum(net_gmv_cents)')} AS net_gmv,
  {VALID_ORDERS} FROM eligible_items WHERE category IS NOT NULL GROUP BY 1, 2
""")

register(
    "monthly_marketplace",
    lambda m: d.monthly_marketplace(m.gold.mart_gmv_daily, m.gold.fact_orders),
    f"""
SELECT month, net_gmv, eligible_orders
FROM (SELECT {MONTH} AS month, {usd('sum(net_gmv_cents)')} AS net_gmv FROM mart_gmv_daily GROUP BY 1)
JOIN (SELECT {MONTH} AS month, count(DISTINCT order_id) AS eligible_orders FROM eligible_orders GROUP BY 1) USING (month)
""",
)
register(
    "region_performance",
    lambda m: d.region_performance(m.gold.fact_order_items, m.gold.fact_orders),
    f"""
SELECT region, {usd('net')} AS net_gmv, eligible_orders, customers, {MARGIN}, {pct('profit', 'margin_net')} AS weighted_margin
FROM (SELECT region, {ITEM_MONEY} FROM eligible_items GROUP BY region)
JOIN (SELECT region, count(DISTINCT order_id) AS eligible_orders, count(DISTINCT customer_id) AS customers
  FROM eligible_orders GROUP BY region) USING (region)
""",
)
for name in ("category_summary", "category_monthly", "category_segment"):
    register(name, lambda m, f=getattr(d, name): f(m.gold.fact_order_items), f"SELECT * FROM {name}")
register(
    "customer_health",
    lambda m: d.customer_health(m.gold.mart_customer_ltv),
    f"""
SELECT activity_status, count(*) AS customers, {mean_usd('sum(lifetime_revenue_cents)', 'count(*)')} AS avg_lifetime_spend,
  {ratio('sum(total_orders)', 'count(*)', 1)} AS avg_orders FROM {REAL} GROUP BY activity_status
""",
)


def back(c: str) -> str:
    return f"sum(CAST(floor({c} * 1e2 + 0.5) AS BIGINT))"


for suffix, chosen in (("all", None), ("one", "toys")):
    where = "" if chosen is None else f"WHERE category = '{chosen}'"
    margin = f"{pct(back('gross_margin_amount'), back('margin_net_gmv'))} AS weighted_margin"
    register(
        f"category_kpis_{suffix}",
        lambda m, c=chosen: d.category_kpis(d.category_summary(m.gold.fact_order_items), c),
        f"""SELECT {usd(back('net_gmv'))} AS net_gmv, {big('sum(orders)')} AS orders, {big('sum(items)')} AS items, {margin}
        FROM category_summary {where}""",
    )
    register(
        f"category_trend_{suffix}",
        lambda m, c=chosen: d.category_trend(d.category_monthly(m.gold.fact_order_items), c),
        f"""SELECT month, {usd(back('net_gmv'))} AS net_gmv, {big('sum(orders)')} AS orders, {margin}
        FROM category_monthly {where} GROUP BY month""",
    )
    register(
        f"segment_mix_{suffix}",
        lambda m, c=chosen: d.segment_mix(d.category_segment(m.gold.fact_order_items), c),
        f"""SELECT customer_segment, {usd('n')} AS net_gmv, orders, {pct('n', 'sum(n) OVER ()')} AS net_gmv_share_pct
        FROM (SELECT customer_segment, {back('net_gmv')} AS n, {big('sum(orders)')} AS orders
          FROM category_segment {where} GROUP BY customer_segment)""",
    )
register(
    "category_comparison",
    lambda m: d.category_comparison(d.category_summary(m.gold.fact_order_items)),
    "SELECT category, gross_gmv, net_gmv, orders, items, weighted_margin, item_discounts FROM category_summary",
)
register(
    "seller_status_counts",
    lambda m: d.seller_status_counts(m.gold.mart_seller_health),
    "SELECT count(*) AS total_sellers, "
    + ", ".join(
        f"count(*) FILTER (health_status = '{s}') AS {s}_sellers" for s in ("active", "at_risk", "churned", "no_sales")
    )
    + " FROM mart_seller_health",
)
register(
    "health_by_tier",
    lambda m: d.health_by_tier(m.gold.mart_seller_health),
    f"""
SELECT health_status, tier, count(*) AS sellers, {usd('sum(net_gmv_cents)')} AS net_gmv,
  {mean_usd('sum(net_gmv_cents)', 'count(*)')} AS avg_net_gmv FROM mart_seller_health GROUP BY health_status, tier
""",
)
AVG_RATING = rnd("(CAST(sum(CAST(floor(avg_rating * 1e2 + 0.5) AS BIGINT)) AS DOUBLE) / count(avg_rating) / 1e2)")
register(
    "tier_summary",
    lambda m: d.tier_summary(m.gold.mart_seller_health),
    f"""
SELECT tier, count(*) AS sellers, {usd('sum(net_gmv_cents)')} AS net_gmv,
  {usd('sum(commission_revenue_cents)')} AS commission_revenue, {AVG_RATING} AS avg_rating,
  {AVG_COMMISSION} AS avg_commission_pct FROM mart_seller_health GROUP BY tier
""",
)
SELLER_COLS = f"""business_name, tier, region, primary_category, total_orders, total_items_sold,
  {usd('net_gmv_cents')} AS net_gmv, {usd('commission_revenue_cents')} AS commission_revenue, days_since_last_sale,
  avg_rating, health_status FROM mart_seller_health"""
register(
    "seller_top20",
    lambda m: d.seller_top(m.gold.mart_seller_health, 20),
    f"SELECT {SELLER_COLS} ORDER BY net_gmv_cents DESC, seller_id LIMIT 20",
)
register(
    "seller_at_risk_top15",
    lambda m: d.seller_top(m.gold.mart_seller_health, 15, "at_risk"),
    f"SELECT {SELLER_COLS} WHERE health_status = 'at_risk' ORDER BY net_gmv_cents DESC, seller_id LIMIT 15",
)
register(
    "filter_values",
    lambda m: d.filter_values(m.gold.fact_order_items, ["category", "region", "seller_tier"]),
    " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS filter, {c} AS value FROM fact_order_items WHERE {c} IS NOT NULL"
        for c in ("category", "region", "seller_tier")
    ),
)
