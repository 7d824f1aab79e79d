"""Business reports."""

from catalogue.registry import register
from catalogue.sqlbase import big, cents, mean_usd, pct, ratio, rnd, usd
from stallkeeper.plans import business as b

AVG_MARGIN = rnd(f"(CAST(sum({cents('gross_margin_pct')}) AS DOUBLE) / count(gross_margin_pct) / 1e2)", 1)
AVG_COMMISSION = rnd(
    "(CAST(sum(CAST(floor(commission_rate * 1e4 + 0.5) AS BIGINT)) AS DOUBLE) / count(commission_rate) / 1e2)", 1
)


def whole(x: str) -> str:
    return rnd(f"(CAST({x} AS BIGINT) / 1e2)", 0)


register(
    "monthly_gmv_growth",
    lambda m: b.monthly_gmv_growth(m.gold.mart_gmv_daily),
    f"""
SELECT *, {pct('gmv - prev', 'prev')} AS mom_growth_pct, {pct('gmv - gmv_year_ago', 'gmv_year_ago')} AS yoy_growth_pct
FROM (SELECT *, lag(gmv, 12) OVER (ORDER BY month) AS gmv_year_ago, lag(gmv) OVER (ORDER BY month) AS prev
  FROM (SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, {whole('sum(gmv_cents)')} AS gmv,
    {big('sum(order_count)')} AS orders, {big('sum(customer_count)')} AS customers,
    {mean_usd('sum(gmv_cents)', 'sum(order_count)')} AS aov FROM mart_gmv_daily GROUP BY 1))
""".replace("SELECT *, (CAST(sign", "SELECT * EXCLUDE (prev), (CAST(sign", 1),
)

register(
    "segment_economics",
    lambda m: b.segment_economics(m.gold.mart_customer_ltv),
    f"""
SELECT segment, customers, avg_ltv, avg_orders, {pct('customers', 'sum(customers) OVER ()')} AS pct_of_customers,
  {whole('revenue')} AS total_revenue, {pct('revenue', 'sum(revenue) OVER ()')} AS pct_of_revenue
FROM (SELECT segment, count(*) AS customers, {mean_usd('sum(lifetime_revenue_cents)', 'count(*)')} AS avg_ltv,
  {ratio('sum(total_orders)', 'count(*)', 1)} AS avg_orders, {big('sum(lifetime_revenue_cents)')} AS revenue
  FROM mart_customer_ltv GROUP BY segment)
""",
)

register(
    "whale_profile",
    lambda m: b.whale_profile(m.gold.mart_customer_ltv),
    f"""
SELECT *, {rnd('(total_revenue * 0.05)')} AS revenue_at_risk, CAST(floor(customers * 5e-2) AS BIGINT) AS customers_at_risk
FROM (SELECT segment, count(*) AS customers, {whole('sum(lifetime_revenue_cents)')} AS total_revenue,
  {mean_usd('sum(lifetime_revenue_cents)', 'count(*)')} AS avg_ltv, {usd('min(lifetime_revenue_cents)')} AS min_ltv,
  {usd('max(lifetime_revenue_cents)')} AS max_ltv, {ratio('sum(total_orders)', 'count(*)', 1)} AS avg_orders
  FROM mart_customer_ltv WHERE segment = 'whale' GROUP BY segment)
""",
)

REGIONS = f"""
SELECT region, {whole('gmv')} AS total_gmv, {pct('gmv', 'sum(gmv) OVER ()')} AS gmv_share_pct, total_orders,
  aov, avg_margin, total_customers
FROM (SELECT region, {big('sum(gmv_cents)')} AS gmv, {big('sum(order_count)')} AS total_orders,
  {mean_usd('sum(gmv_cents)', 'sum(order_count)')} AS aov, {AVG_MARGIN} AS avg_margin,
  {big('sum(customer_count)')} AS total_customers FROM mart_gmv_daily GROUP BY region)
"""
register("regional_comparison", lambda m: b.regional_comparison(m.gold.mart_gmv_daily), REGIONS)
register(
    "regional_aov_gap",
    lambda m: b.aov_gap(b.regional_comparison(m.gold.mart_gmv_daily)),
    f"""
SELECT h.region AS highest_region, h.aov AS highest_aov, l.region AS lowest_region, l.aov AS lowest_aov,
  {rnd('(h.aov - l.aov)')} AS aov_gap
FROM (SELECT * FROM ({REGIONS}) ORDER BY aov DESC, region DESC LIMIT 1) h,
  (SELECT * FROM ({REGIONS}) ORDER BY aov, region LIMIT 1) l
""",
)

CATEGORY_PROFIT = f"""
SELECT category, {whole('gmv')} AS total_gmv, {pct('gmv', 'sum(gmv) OVER ()')} AS gmv_share_pct, total_profit,
  avg_margin, total_orders, total_items, total_discounts, discount_rate_pct
FROM (SELECT category, {big('sum(gmv_cents)')} AS gmv, {whole('sum(gross_profit_cents)')} AS total_profit,
  {AVG_MARGIN} AS avg_margin, {big('sum(order_count)')} AS total_orders, {big('sum(items_sold)')} AS total_items,
  {whole('sum(total_discounts_cents)')} AS total_discounts,
  {pct('sum(total_discounts_cents)', 'sum(gmv_cents)')} AS discount_rate_pct
  FROM mart_gmv_daily GROUP BY category)
"""
register("category_profitability", lambda m: b.category_profitability(m.gold.mart_gmv_daily), CATEGORY_PROFIT)
register(
    "category_leaders",
    lambda m: b.category_leaders(b.category_profitability(m.gold.mart_gmv_daily)),
    f"""
SELECT g.category AS revenue_leader, g.total_gmv AS leader_gmv, p.category AS profit_leader,
  p.total_profit AS leader_profit, g.category IS DISTINCT FROM p.category AS leaders_differ
FROM (SELECT * FROM ({CATEGORY_PROFIT}) ORDER BY total_gmv DESC, category DESC LIMIT 1) g,
  (SELECT * FROM ({CATEGORY_PROFIT}) ORDER BY total_profit DESC, category DESC LIMIT 1) p
""",
)

register(
    "top_sellers",
    lambda m: b.top_sellers(m.gold.mart_seller_health),
    f"""
SELECT business_name, tier, region, primary_category, total_orders, {whole('total_gmv_cents')} AS total_gmv,
  {whole('commission_revenue_cents')} AS commission_revenue, avg_rating, health_status
FROM mart_seller_health ORDER BY total_gmv_cents DESC, seller_id LIMIT 10
""",
)
register(
    "seller_concentration",
    lambda m: b.seller_concentration(m.gold.mart_seller_health),
    f"""
SELECT decile, sellers, {whole('gmv')} AS total_gmv, {pct('gmv', 'sum(gmv) OVER ()')} AS gmv_share_pct
FROM (SELECT decile, count(*) AS sellers, {big('sum(total_gmv_cents)')} AS gmv
  FROM (SELECT total_gmv_cents, ntile(10) OVER (ORDER BY total_gmv_cents DESC, md5(seller_id), seller_id) AS decile
    FROM mart_seller_health) GROUP BY decile)
""",
)
register(
    "single_order_status",
    lambda m: b.single_order_status(m.gold.mart_customer_ltv),
    f"""
SELECT activity_status, count(*) AS customers,
  {mean_usd('sum(lifetime_revenue_cents)', 'count(*)')} AS avg_lifetime_spend,
  {ratio('sum(total_orders)', 'count(*)', 1)} AS avg_orders
FROM mart_customer_ltv WHERE total_orders = 1 GROUP BY activity_status
""",
)
register(
    "single_order_opportunity",
    lambda m: b.single_order_opportunity(m.gold.mart_customer_ltv),
    f"""
SELECT * EXCLUDE (gap), {rnd('gap')} AS spend_difference, {rnd('(conversion_target * gap)')} AS spend_opportunity
FROM (SELECT *, CAST(floor(single_order_customers * 1e-1) AS BIGINT) AS conversion_target,
    greatest(0e0, avg_repeat_buyer_spend - avg_single_order_spend) AS gap
  FROM (SELECT count(*) FILTER (total_orders = 1) AS single_order_customers,
    {mean_usd('sum(lifetime_revenue_cents) FILTER (total_orders = 1)', 'count(*) FILTER (total_orders = 1)')}
      AS avg_single_order_spend,
    {mean_usd('sum(lifetime_revenue_cents) FILTER (total_orders >= 2)', 'count(*) FILTER (total_orders >= 2)')}
      AS avg_repeat_buyer_spend
    FROM mart_customer_ltv))
""",
)

SEASONS = f"""
SELECT month(order_date) AS month_num, strftime(order_date, '%B') AS month_name, {whole('sum(gmv_cents)')} AS total_gmv,
  {big('sum(order_count)')} AS total_orders, {AVG_MARGIN} AS avg_margin
FROM mart_gmv_daily GROUP BY 1, 2
"""
register("seasonality", lambda m: b.seasonality(m.gold.mart_gmv_daily), SEASONS)
register(
    "seasonality_peak",
    lambda m: b.seasonality_peak(b.seasonality(m.gold.mart_gmv_daily)),
    f"""
SELECT h.month_name AS peak_month, h.total_gmv AS peak_gmv, l.month_name AS low_month, l.total_gmv AS low_gmv,
  {ratio('h.total_gmv', 'l.total_gmv', 1)} AS peak_to_trough
FROM (SELECT * FROM ({SEASONS}) ORDER BY total_gmv DESC, month_num DESC LIMIT 1) h,
  (SELECT * FROM ({SEASONS}) ORDER BY total_gmv, month_num LIMIT 1) l
""",
)
register(
    "discount_rate_by_category",
    lambda m: b.discount_rate_by_category(m.gold.mart_gmv_daily),
    f"""
SELECT category, {whole('sum(gmv_cents)')} AS total_gmv, {whole('sum(total_discounts_cents)')} AS total_discounts,
  {pct('sum(total_discounts_cents)', 'sum(gmv_cents)')} AS discount_rate, {AVG_MARGIN} AS margin_after_discount,
  {whole('sum(gross_profit_cents)')} AS net_profit
FROM mart_gmv_daily GROUP BY category
""",
)
register(
    "commission_by_tier",
    lambda m: b.commission_by_tier(m.gold.mart_seller_health),
    f"""
SELECT tier, count(*) AS sellers, {whole('sum(total_gmv_cents)')} AS total_gmv, {AVG_COMMISSION} AS avg_commission_pct,
  {whole('sum(commission_revenue_cents)')} AS commission_revenue,
  {mean_usd('sum(commission_revenue_cents)', 'count(*)', 0)} AS revenue_per_seller
FROM mart_seller_health GROUP BY tier
""",
)
