"""Governed metrics and customer exploration."""

from catalogue import testbed as tb
from catalogue.business import AVG_COMMISSION
from catalogue.registry import register
from catalogue.sqlbase import AS_OF, big, mean_usd, pct, ratio, rnd, usd
from stallkeeper.plans import governed as g

REAL = "(SELECT * FROM mart_customer_ltv WHERE NOT is_unknown_customer)"
GROUPS = """count(*) FILTER (total_orders = 0) AS never_ordered, count(*) FILTER (total_orders = 1) AS one_order_only,
  count(*) FILTER (total_orders >= 2) AS repeat_buyers"""
AVG_ORDERS = f"{ratio('sum(total_orders)', 'count(*)', 1)} AS avg_orders"
SPEND = "lifetime_customer_spend_cents"

register(
    "gmv_totals",
    lambda m: g.gmv_totals(m.gold.mart_gmv_daily),
    f"""
SELECT {usd('sum(gross_gmv_cents)')} AS gross_gmv, {usd('sum(net_gmv_cents)')} AS net_gmv,
  {usd('sum(total_discounts_cents)')} AS total_discounts, {usd('sum(total_item_tax_cents)')} AS total_item_tax,
  {big('sum(invalid_gmv_item_count)')} AS invalid_gmv_items FROM mart_gmv_daily
""",
)
register(
    "annual_gmv",
    lambda m: g.annual_gmv(m.gold.mart_gmv_daily, m.gold.fact_orders),
    f"""
SELECT m.year, {usd('gross')} AS gross_gmv, {usd('net')} AS net_gmv, eligible_orders,
  {mean_usd('net', 'eligible_orders')} AS net_gmv_per_order
FROM (SELECT year(order_date) AS year, sum(gross_gmv_cents) AS gross, sum(net_gmv_cents) AS net
  FROM mart_gmv_daily GROUP BY 1) m
JOIN (SELECT year(order_date) AS year, count(DISTINCT order_id) AS eligible_orders FROM eligible_orders GROUP BY 1) o
  ON m.year = o.year
""",
)
register(
    "order_date_range",
    lambda m: g.order_date_range(m.gold.fact_orders),
    "SELECT min(order_date) AS earliest, max(order_date) AS latest FROM eligible_orders",
)
register(
    "customer_counts",
    lambda m: g.customer_counts(m.gold.mart_customer_ltv),
    """
SELECT count(*) FILTER (NOT is_unknown_customer) AS registered_customers,
  count(*) FILTER (is_unknown_customer) AS unknown_dimension_members,
  count(*) FILTER (NOT is_unknown_customer AND total_orders > 0) AS customers_with_orders,
  count(*) FILTER (NOT is_unknown_customer AND total_orders = 0) AS never_ordered FROM mart_customer_ltv
""",
)
register(
    "persona_breakdown",
    lambda m: g.persona_breakdown(m.gold.mart_customer_ltv),
    f"""
SELECT * EXCLUDE (spend), {pct('customers', 'sum(customers) OVER ()')} AS pct_of_customers,
  {usd('spend')} AS total_customer_spend, {pct('spend', 'sum(spend) OVER ()')} AS pct_of_real_customer_spend
FROM (SELECT segment, count(*) AS customers, {GROUPS}, {AVG_ORDERS},
  {mean_usd(f'sum({SPEND})', 'count(*)')} AS avg_lifetime_spend, sum({SPEND}) AS spend FROM {REAL} GROUP BY segment)
""",
)
register(
    "repeat_behaviour",
    lambda m: g.repeat_behaviour(m.gold.mart_customer_ltv),
    f"""
SELECT *, {pct('repeat_buyers', 'total_buyers')} AS repeat_rate_among_buyers_pct,
  {pct('one_order_only', 'total_buyers')} AS one_order_rate_among_buyers_pct
FROM (SELECT count(*) AS registered_customers, {GROUPS}, count(*) FILTER (total_orders > 0) AS total_buyers FROM {REAL})
""",
)
register(
    "persona_deep_look",
    lambda m: g.persona_deep_look(m.gold.mart_customer_ltv),
    f"SELECT count(*) AS customers, {GROUPS}, {AVG_ORDERS} FROM {REAL} WHERE segment = 'low_frequency'",
)
register(
    "whale_economics",
    lambda m: g.whale_economics(m.gold.mart_customer_ltv),
    f"""
SELECT * EXCLUDE (annual), {pct('total_whale_spend', 'total_real_customer_spend')} AS whale_spend_pct,
  {rnd('(total_real_customer_spend - total_whale_spend)')} AS non_whale_spend,
  {rnd('annual')} AS annual_spend_per_whale, {rnd('(scenario_customers * annual)', 0)} AS scenario_annual_spend,
  {rnd('(scenario_customers * avg_whale_spend)', 0)} AS scenario_lifetime_spend
FROM (SELECT *, CAST(floor(whale_count * 5e-2) AS BIGINT) AS scenario_customers,
    CASE WHEN avg_lifespan_days > 0 THEN avg_whale_spend / (avg_lifespan_days / 365e0) ELSE 0e0 END AS annual
  FROM (SELECT (SELECT {usd(f'sum({SPEND})')} FROM {REAL}) AS total_real_customer_spend, count(*) AS whale_count,
      {usd(f'sum({SPEND})')} AS total_whale_spend, {mean_usd(f'sum({SPEND})', 'count(*)')} AS avg_whale_spend,
      {usd(f'min({SPEND})')} AS min_whale_spend, {usd(f'max({SPEND})')} AS max_whale_spend, {AVG_ORDERS},
      {ratio('sum(customer_lifespan_days)', 'count(customer_lifespan_days)', 0)} AS avg_lifespan_days
    FROM {REAL} WHERE segment = 'whale'))
""",
)
ITEM_MONEY = f"""{big('sum(gross_gmv_cents)')} AS gross, {big('sum(net_gmv_cents)')} AS net,
  {big('sum(net_gmv_cents - merchandise_cost_cents)')} AS profit,
  {big('sum(net_gmv_cents) FILTER (is_margin_valid)')} AS margin_net"""
register(
    "regional_performance",
    lambda m: g.regional_performance(m.gold.fact_order_items, m.gold.fact_orders),
    f"""
SELECT i.region, {usd('net')} AS net_gmv, {pct('net', 'sum(net) OVER ()')} AS net_gmv_share, eligible_orders,
  {mean_usd('net', 'eligible_orders')} AS net_gmv_per_order, {pct('profit', 'margin_net')} AS merchandise_margin_pct
FROM (SELECT region, {ITEM_MONEY} FROM eligible_items GROUP BY region) i
JOIN (SELECT region, count(DISTINCT order_id) AS eligible_orders FROM eligible_orders GROUP BY region) o
  ON i.region = o.region
""",
)
register(
    "category_economics",
    lambda m: g.category_economics(m.gold.fact_order_items),
    f"""
SELECT category, {usd('gross')} AS gross_gmv, {usd('net')} AS net_gmv, {pct('net', 'sum(net) OVER ()')} AS net_gmv_share,
  {usd('profit')} AS merchandise_profit, {pct('profit', 'margin_net')} AS merchandise_margin_pct, orders,
  invalid_financial_items
FROM (SELECT category, {ITEM_MONEY}, count(DISTINCT order_id) FILTER (is_gmv_valid) AS orders,
  count(*) FILTER (NOT is_gmv_valid) AS invalid_financial_items FROM eligible_items GROUP BY category)
""",
)
TIER_COLS = f"""count(*) AS sellers, {usd('sum(gross_gmv_cents)')} AS gross_gmv, {usd('sum(net_gmv_cents)')} AS net_gmv,
  {AVG_COMMISSION} AS avg_commission_pct, {usd('sum(commission_revenue_cents)')} AS commission_revenue,
  {pct('sum(commission_revenue_cents)', 'sum(net_gmv_cents)', 2)} AS effective_take_rate_pct,
  {mean_usd('sum(net_gmv_cents)', 'count(*)')} AS avg_net_gmv_per_seller FROM mart_seller_health"""
register(
    "seller_tier_economics",
    lambda m: g.seller_tier_economics(m.gold.mart_seller_health),
    f"SELECT tier, {TIER_COLS} GROUP BY tier UNION ALL SELECT 'TOTAL', {TIER_COLS}",
)
register(
    "activity_distribution",
    lambda m: g.activity_distribution(m.gold.mart_customer_ltv),
    f"""
SELECT *, {pct('customers', 'sum(customers) OVER ()')} AS pct
FROM (SELECT activity_status, count(*) AS customers, {mean_usd(f'sum({SPEND})', 'count(*)')} AS avg_lifetime_spend,
  {ratio('sum(days_since_last_order)', 'count(days_since_last_order)', 0)} AS avg_days_since_last_order
  FROM {REAL} GROUP BY activity_status)
""",
)
register(
    "last_order_gap",
    lambda m: g.last_order_gap(m.gold.fact_orders, tb.AS_OF),
    f"""SELECT {AS_OF} AS reference_date, max(order_date) AS latest_order_date,
  date_diff('day', max(order_date), {AS_OF}) AS gap_days FROM fact_orders""",
)
register(
    "return_rate_by_category",
    lambda m: g.return_rate_by_category(m.gold.fact_order_items, m.gold.returns),
    f"""
SELECT s.category, eligible_items, coalesce(r, 0) AS returned_items, {pct('coalesce(r, 0)', 'eligible_items', 2)} AS return_rate_pct
FROM (SELECT category, count(DISTINCT order_item_id) AS eligible_items FROM eligible_items
  WHERE NOT coalesce(_had_negative_quantity, FALSE) GROUP BY category) s
LEFT JOIN (SELECT category, count(DISTINCT return_id) AS r FROM returns GROUP BY category) b ON s.category = b.category
""",
)
register(
    "return_rate_overall",
    lambda m: g.return_rate_overall(m.gold.fact_order_items, m.gold.returns),
    f"""
SELECT *, {pct('total_returns', 'eligible_items')} AS return_rate_pct
FROM (SELECT (SELECT count(DISTINCT return_id) FROM returns) AS total_returns,
  (SELECT count(DISTINCT order_item_id) FROM eligible_items WHERE NOT coalesce(_had_negative_quantity, FALSE)) AS eligible_items)
""",
)
register(
    "return_reasons",
    lambda m: g.return_reasons(m.gold.returns),
    f"""
SELECT *, {pct('return_count', 'sum(return_count) OVER ()')} AS pct_of_returns
FROM (SELECT return_reason, count(DISTINCT return_id) AS return_count FROM returns GROUP BY return_reason)
""",
)
register(
    "on_time_rate",
    lambda m: g.on_time_rate(m.gold.shipments),
    f"""
SELECT *, {pct('on_time', 'total_shipments')} AS on_time_pct
FROM (SELECT count(*) AS total_shipments, count(*) FILTER (delay_days = 0) AS on_time,
  count(*) FILTER (delay_days > 0) AS late FROM shipments WHERE status = 'delivered')
""",
)
register(
    "kpi_row",
    lambda m: g.kpi_row(m.gold_stored),
    f"""
SELECT {usd('net')} AS net_gmv, charged AS customer_charged_amount, eligible_orders, real_customers,
  commission AS commission_revenue, {mean_usd('net', 'eligible_orders')} AS net_gmv_per_order, repeat_buyer_rate,
  weighted_margin
FROM (SELECT sum(net_gmv_cents) AS net,
    {pct('sum(net_gmv_cents - merchandise_cost_cents)', 'sum(net_gmv_cents) FILTER (is_margin_valid)')} AS weighted_margin
  FROM eligible_items)
CROSS JOIN (SELECT {usd('sum(total_amount_cents)')} AS charged, count(DISTINCT order_id) AS eligible_orders FROM eligible_orders)
CROSS JOIN (SELECT count(*) AS real_customers,
  {pct('count(*) FILTER (total_orders >= 2)', 'count(*) FILTER (total_orders > 0)')} AS repeat_buyer_rate FROM {REAL})
CROSS JOIN (SELECT {usd('sum(commission_revenue_cents)')} AS commission FROM mart_seller_health)
""",
)
register(
    "customer_overview",
    lambda m: g.customer_overview(m.clean["customers"]),
    """SELECT count(*) AS total_customers, count(DISTINCT customer_id) AS unique_customer_ids,
  min(signup_date) AS earliest_signup, max(signup_date) AS latest_signup FROM customers""",
)
register(
    "region_segment_mix",
    lambda m: g.region_segment_mix(m.clean["customers"]),
    f"""
SELECT *, {pct('customer_count', 'sum(customer_count) OVER (PARTITION BY region)', 2)} AS pct_within_region
FROM (SELECT region, segment, count(*) AS customer_count FROM customers GROUP BY region, segment)
""",
)
register(
    "signups_by_month",
    lambda m: g.signups_by_month(m.clean["customers"]),
    """
SELECT CAST(date_trunc('month', signup_date) AS DATE) AS signup_month, count(*) AS new_customers FROM customers
WHERE signup_date >= (SELECT max(signup_date) - INTERVAL 12 MONTH FROM customers) GROUP BY 1
""",
)
register(
    "country_mix",
    lambda m: g.country_mix(m.clean["customers"], "EUROPE"),
    f"""
SELECT *, {pct('customers', 'sum(customers) OVER ()', 2)} AS pct_of_region
FROM (SELECT country_code, count(*) AS customers FROM customers WHERE region = 'EUROPE' GROUP BY country_code)
""",
)
register(
    "channel_whale_pct",
    lambda m: g.channel_whale_pct(m.clean["customers"]),
    f"""
SELECT *, {pct('whales', 'customer_count', 2)} AS whale_pct
FROM (SELECT signup_channel, count(*) AS customer_count, count(*) FILTER (segment = 'whale') AS whales
  FROM customers GROUP BY signup_channel)
""",
)
