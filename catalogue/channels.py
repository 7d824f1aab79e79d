"""Marketing-channel analysis."""

import datetime as dt

from catalogue import testbed as tb
from catalogue.registry import Market, register
from catalogue.sqlbase import AS_OF, mean_usd, pct, ratio, rnd, cte
from stallkeeper.plans import channels as c

CUTOFF = tb.AS_OF - dt.timedelta(days=90)

cte("observed", f"""
SELECT customer_id, coalesce(signup_channel, 'unknown') AS signup_channel, signup_date, segment FROM dim_customers
WHERE NOT is_unknown_customer AND signup_date <= DATE '{CUTOFF}'
""")
cte("orders_until", f"SELECT * FROM eligible_orders WHERE order_date <= {AS_OF}")
cte("window_spend", """
SELECT c.customer_id, signup_channel, segment, count(DISTINCT order_id) AS orders_in_window,
  CAST(coalesce(sum(total_amount_cents), 0) AS BIGINT) AS spend_cents
FROM observed c LEFT JOIN orders_until o ON c.customer_id = o.customer_id
  AND o.order_date BETWEEN c.signup_date AND c.signup_date + 90
GROUP BY ALL
""")
cte("channel_quality", f"""
SELECT *, {pct('customers', 'sum(customers) OVER ()')} AS pct_of_total
FROM (SELECT signup_channel, count(*) AS customers, {mean_usd('sum(spend_cents)', 'count(*)')} AS avg_spend_90d,
  {rnd('(median(spend_cents) / 1e2)')} AS median_spend_90d, {ratio('sum(orders_in_window)', 'count(*)', 1)} AS avg_orders_90d,
  {pct('count(*) FILTER (orders_in_window = 0)', 'count(*)')} AS no_order_within_90d_pct,
  {pct('count(*) FILTER (orders_in_window = 1)', 'count(*)')} AS one_order_within_90d_pct,
  {pct('count(*) FILTER (orders_in_window >= 2)', 'count(*)')} AS repeat_within_90d_pct,
  {pct("count(*) FILTER (segment = 'whale')", 'count(*)')} AS whale_persona_pct
  FROM window_spend GROUP BY signup_channel)
""")
cte("repeat_within", f"""
SELECT signup_channel, count(*) AS customers_with_first_order, count(*) FILTER (gap <= 90) AS returned_within_90d,
  {pct('count(*) FILTER (gap <= 90)', 'count(*)')} AS repeat_rate_90d,
  {ratio('sum(gap) FILTER (gap <= 90)', 'count(*) FILTER (gap <= 90)', 1)} AS avg_days_to_second_order
FROM (SELECT customer_id, signup_channel, min(order_date) FILTER (place = 1) AS first_date,
    date_diff('day', min(order_date) FILTER (place = 1), min(order_date) FILTER (place = 2)) AS gap
  FROM (SELECT c.customer_id, signup_channel, order_date,
      row_number() OVER (PARTITION BY c.customer_id ORDER BY order_date, order_id) AS place
    FROM observed c JOIN orders_until o ON c.customer_id = o.customer_id) GROUP BY 1, 2)
WHERE first_date <= {AS_OF} - 90 GROUP BY signup_channel
""")
cte("first_category", f"""
SELECT *, {pct('customers', 'sum(customers) OVER (PARTITION BY signup_channel)')} AS pct_of_channel_customers
FROM (SELECT signup_channel, category AS first_purchase_category, count(*) AS customers
  FROM (SELECT f.signup_channel, i.category, row_number() OVER (PARTITION BY f.customer_id
      ORDER BY unit_price_cents * quantity - coalesce(discount_amount_cents, 0) DESC, order_item_id) AS place
    FROM (SELECT c.customer_id, signup_channel, order_id,
        row_number() OVER (PARTITION BY c.customer_id ORDER BY order_date, order_id) AS n
      FROM observed c JOIN orders_until o ON c.customer_id = o.customer_id) f
    JOIN fact_order_items i ON f.order_id = i.order_id
    WHERE f.n = 1 AND i.quantity > 0 AND i.unit_price_cents IS NOT NULL AND i.category IS NOT NULL)
  WHERE place = 1 GROUP BY 1, 2)
""")


def quality(m: Market):
    return c.channel_quality(m.gold.dim_customers, m.gold.fact_orders, CUTOFF, tb.AS_OF)


def repeats(m: Market):
    return c.repeat_within(m.gold.dim_customers, m.gold.fact_orders, CUTOFF, tb.AS_OF)


def first_categories(m: Market):
    g = m.gold
    return c.first_purchase_category(g.dim_customers, g.fact_orders, g.fact_order_items, CUTOFF, tb.AS_OF)


register(
    "orders_in_window",
    lambda m: c.orders_in_window(
        c.observed_customers(m.gold.dim_customers, CUTOFF), c.orders_until(m.gold.fact_orders, tb.AS_OF), 90
    ),
    """
SELECT c.*, o.order_id, o.order_date, o.total_amount_cents AS amount
FROM observed c LEFT JOIN orders_until o ON c.customer_id = o.customer_id
  AND o.order_date BETWEEN c.signup_date AND c.signup_date + 90
""",
)
register("channel_quality", quality, "SELECT * FROM channel_quality")
register(
    "whale_share_by_channel",
    lambda m: c.whale_share_by_channel(m.gold.dim_customers, CUTOFF),
    f"""
SELECT *, {pct('whale_persona_count', 'total_customers', 2)} AS whale_persona_pct,
  {rnd('(1e3 * whale_persona_count / total_customers)', 1)} AS whale_personas_per_1000_signups
FROM (SELECT signup_channel, count(*) AS total_customers, count(*) FILTER (segment = 'whale') AS whale_persona_count
  FROM observed GROUP BY signup_channel)
""",
)
register(
    "lifetime_behaviour_by_channel",
    lambda m: c.lifetime_behaviour_by_channel(m.gold.dim_customers, m.gold.fact_orders, CUTOFF, tb.AS_OF),
    f"""
SELECT signup_channel, count(*) AS total_customers, count(*) FILTER (n = 0) AS never_ordered_lifetime,
  count(*) FILTER (n = 1) AS one_order_only_lifetime, count(*) FILTER (n >= 2) AS repeat_buyers_lifetime,
  {pct('count(*) FILTER (n = 1)', 'count(*) FILTER (n >= 1)')} AS one_order_rate_among_buyers
FROM (SELECT c.customer_id, signup_channel, count(DISTINCT order_id) AS n
  FROM observed c LEFT JOIN orders_until o ON c.customer_id = o.customer_id GROUP BY 1, 2) GROUP BY signup_channel
""",
)
register("first_purchase_category", first_categories, "SELECT * FROM first_category")
register(
    "first_purchase_top3",
    lambda m: c.top_first_categories(first_categories(m)),
    """
SELECT *, row_number() OVER (PARTITION BY signup_channel ORDER BY customers DESC, first_purchase_category) AS place
FROM first_category QUALIFY place <= 3
""",
)
register("repeat_within_90d", repeats, "SELECT * FROM repeat_within")
for name, table, metric, run in (
    ("best_worst_spend_channel", "channel_quality", "avg_spend_90d", quality),
    ("best_worst_repeat_channel", "repeat_within", "repeat_rate_90d", repeats),
):
    named = f"(SELECT * FROM {table} WHERE signup_channel <> 'unknown')"
    register(
        name,
        lambda m, run=run, metric=metric: c.best_worst_channel(run(m), metric),
        f"""
SELECT h.signup_channel AS best_channel, h.{metric} AS best_value, l.signup_channel AS worst_channel,
  l.{metric} AS worst_value, CASE WHEN l.{metric} > 0 THEN {rnd(f'(h.{metric} / l.{metric})')} ELSE 0e0 END AS best_to_worst,
  {rnd(f'(h.{metric} - l.{metric})')} AS gap
FROM (SELECT * FROM {named} ORDER BY {metric} DESC, signup_channel LIMIT 1) h,
  (SELECT * FROM {named} ORDER BY {metric}, signup_channel DESC LIMIT 1) l
""",
    )
