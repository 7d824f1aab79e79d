"""Point-in-time features, labels, their validation and summaries."""

from catalogue import testbed as tb
from catalogue.registry import Market, register
from catalogue.sqlbase import UNKNOWN_ID, big, cte, pct, ratio, rnd
from stallkeeper.churn import features as ft
from stallkeeper.churn import validate as v
from stallkeeper.churn.config import NUMERIC_FEATURES, SNAPSHOT_COLUMNS

DATES = (*tb.TRAIN, tb.VALIDATION, tb.TEST)


def feature_ctes(p: str, dates) -> None:
    days = ", ".join(f"(DATE '{d}')" for d in dates)
    cte(f"{p}snaps", f"SELECT * FROM (VALUES {days}) AS t(snapshot_date)")
    cte(f"{p}order_features", f"""
SELECT customer_id, snapshot_date, date_diff('day', max(order_date), snapshot_date) AS days_since_last_order,
  date_diff('day', min(order_date), snapshot_date) AS days_since_first_order, count(DISTINCT order_id) AS total_orders,
  count(DISTINCT order_id) FILTER (order_date > snapshot_date - 30) AS orders_last_30d,
  count(DISTINCT order_id) FILTER (order_date > snapshot_date - 90) AS orders_last_90d,
  CASE WHEN count(DISTINCT order_id) > 1 THEN date_diff('day', min(order_date), max(order_date))
    / (count(DISTINCT order_id) - 1e0) END AS avg_days_between_orders,
  {big('sum(total_amount_cents)')} / 1e2 AS lifetime_spend,
  CAST(sum(total_amount_cents) AS DOUBLE) / nullif(count(total_amount_cents), 0) / 1e2 AS avg_order_value,
  {big('sum(CASE WHEN order_date > snapshot_date - 90 THEN total_amount_cents ELSE 0 END)')} / 1e2 AS spend_last_90d,
  CASE WHEN sum(total_amount_cents) > 0 AND date_diff('day', min(order_date), snapshot_date) > 90 THEN
    CAST(sum(CASE WHEN order_date > snapshot_date - 90 THEN total_amount_cents ELSE 0 END) AS DOUBLE)
    / nullif(CAST(sum(total_amount_cents) AS DOUBLE) / (date_diff('day', min(order_date), snapshot_date) / 90e0), 0)
    ELSE 1e0 END AS spend_trend,
  {big('CASE WHEN count(DISTINCT order_id) = 1 THEN 1 ELSE 0 END')} AS is_single_order_customer
FROM eligible_orders JOIN {p}snaps ON order_date <= snapshot_date WHERE customer_id <> '{UNKNOWN_ID}'
GROUP BY customer_id, snapshot_date
""")
    cte(f"{p}item_features", f"""
SELECT customer_id, snapshot_date, count(DISTINCT category) FILTER (quantity > 0) AS category_count,
  count(DISTINCT order_item_id) FILTER (quantity > 0) AS historical_item_count,
  CAST(count(DISTINCT order_id) FILTER (is_gmv_valid AND discount_amount_cents > 0) AS DOUBLE)
    / nullif(count(DISTINCT order_id) FILTER (is_gmv_valid), 0) AS discount_order_rate
FROM eligible_items JOIN {p}snaps ON order_date <= snapshot_date WHERE customer_id <> '{UNKNOWN_ID}'
GROUP BY customer_id, snapshot_date
""")
    cte(f"{p}return_features", f"""
SELECT customer_id, snapshot_date, coalesce(n, 0) AS return_count,
  {big('CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END')} AS has_return,
  least(CAST(coalesce(o, 0) AS DOUBLE) / nullif(total_orders, 0), 1e0) AS return_order_rate,
  least(CAST(coalesce(n, 0) AS DOUBLE) / nullif(historical_item_count, 0), 1e0) AS return_item_rate
FROM {p}order_features
LEFT JOIN (SELECT o.customer_id, snapshot_date, count(DISTINCT return_id) AS n, count(DISTINCT r.order_id) AS o
  FROM returns r JOIN eligible_orders o ON r.order_id = o.order_id
  JOIN {p}snaps ON CAST(initiated_at AS DATE) <= snapshot_date AND order_date <= snapshot_date GROUP BY 1, 2)
  USING (customer_id, snapshot_date)
LEFT JOIN {p}item_features USING (customer_id, snapshot_date)
""")
    cte(f"{p}review_features", f"""
SELECT customer_id, snapshot_date, count(*) AS review_count, {ratio('sum(rating)', 'count(rating)')} AS avg_rating_given,
  {big('1')} AS has_review
FROM reviews JOIN {p}snaps ON CAST(submitted_at AS DATE) <= snapshot_date GROUP BY customer_id, snapshot_date
""")
    cte(f"{p}delivery_features", f"""
SELECT customer_id, snapshot_date, count(*) FILTER (delay_days > 0) AS late_delivery_count,
  {ratio('sum(delay_days)', 'count(delay_days)')} AS avg_delivery_delay, {big('1')} AS has_completed_delivery
FROM shipments s JOIN eligible_orders o ON s.order_id = o.order_id
JOIN {p}snaps ON CAST(delivered_at AS DATE) <= snapshot_date AND order_date <= snapshot_date
WHERE status = 'delivered' AND customer_id <> '{UNKNOWN_ID}' GROUP BY customer_id, snapshot_date
""")
    cte(f"{p}customer_attributes", f"""
SELECT customer_id, snapshot_date, coalesce(nullif(trim(signup_channel), ''), 'missing') AS signup_channel,
  coalesce(nullif(trim(segment), ''), 'missing') AS segment, coalesce(nullif(trim(region), ''), 'missing') AS region,
  signup_date, date_diff('day', signup_date, snapshot_date) AS customer_tenure_days
FROM dim_customers JOIN {p}snaps ON signup_date <= snapshot_date WHERE NOT is_unknown_customer
""")
    cte(f"{p}churn_labels", f"""
SELECT c.customer_id, c.snapshot_date, count(DISTINCT order_id) AS orders_in_prediction_window,
  {big('CASE WHEN count(DISTINCT order_id) = 0 THEN 1 ELSE 0 END')} AS churned
FROM {p}customer_attributes c LEFT JOIN eligible_orders o ON c.customer_id = o.customer_id
  AND order_date > c.snapshot_date AND order_date <= c.snapshot_date + 90
GROUP BY c.customer_id, c.snapshot_date
""")
    filled = []
    for c in SNAPSHOT_COLUMNS:
        if c in ("category_count", "historical_item_count", "return_count", "review_count", "late_delivery_count",
                 "has_return", "has_review", "has_completed_delivery"):
            filled.append(f"{big(f'coalesce({c}, 0)')} AS {c}")
        elif c.endswith("_rate"):
            filled.append(f"least(greatest(coalesce({c}, 0e0), 0e0), 1e0) AS {c}")
        else:
            filled.append(c)
    cte(f"{p}snapshots", f"""
SELECT {', '.join(filled)}
FROM {p}order_features LEFT JOIN {p}item_features USING (customer_id, snapshot_date)
LEFT JOIN {p}return_features USING (customer_id, snapshot_date)
LEFT JOIN {p}review_features USING (customer_id, snapshot_date)
LEFT JOIN {p}delivery_features USING (customer_id, snapshot_date)
JOIN {p}customer_attributes USING (customer_id, snapshot_date)
JOIN {p}churn_labels USING (customer_id, snapshot_date)
""")


feature_ctes("model_", DATES)
feature_ctes("score_", [tb.SCORE])

PARTS = {
    "order_features": lambda g: ft.order_features(g.fact_orders, DATES),
    "item_features": lambda g: ft.item_features(g.fact_order_items, DATES),
    "return_features": lambda g: ft.return_features(g.fact_orders, g.fact_order_items, g.returns, DATES),
    "review_features": lambda g: ft.review_features(g.reviews, DATES),
    "delivery_features": lambda g: ft.delivery_features(g.fact_orders, g.shipments, DATES),
    "customer_attributes": lambda g: ft.customer_attributes(g.dim_customers, DATES),
    "churn_labels": lambda g: ft.churn_labels(g.dim_customers, g.fact_orders, DATES),
}
for part, build in PARTS.items():
    register(f"churn_{part}" if part != "churn_labels" else part, lambda m, b=build: b(m.gold),
             f"SELECT * FROM model_{part}")


def snapshots(m: Market):
    return ft.build_snapshots(m.gold_stored, DATES)


def split(m: Market):
    return ft.with_split(snapshots(m), tb.TRAIN, tb.VALIDATION, tb.TEST)


SPLIT = f"""SELECT *, CASE WHEN snapshot_date IN (DATE '{tb.TRAIN[0]}', DATE '{tb.TRAIN[1]}') THEN 'train'
  WHEN snapshot_date = DATE '{tb.VALIDATION}' THEN 'validation' ELSE 'test' END AS split FROM model_snapshots"""
register("churn_snapshots", split, SPLIT)
register(
    "scoring_snapshot",
    lambda m: ft.scoring_snapshot(m.gold_stored, tb.SCORE),
    """SELECT * EXCLUDE (orders_in_prediction_window, churned, snapshot_date), snapshot_date AS score_date
FROM score_snapshots""",
)
register(
    "snapshot_metadata",
    lambda m: v.snapshot_metadata(split(m)),
    f"""SELECT split, count(*) AS rows_, count(DISTINCT customer_id) AS unique_customers,
  {rnd('(CAST(sum(churned) AS DOUBLE) / count(*))', 6)} AS churn_rate FROM ({SPLIT}) GROUP BY split""".replace(
        "rows_", '"rows"'),
)
for by in ("segment", "signup_channel"):
    register(
        f"churn_by_{by}",
        lambda m, b=by: v.churn_by(snapshots(m), b),
        f"""SELECT {by}, count(*) AS customers, {pct('sum(churned)', 'count(*)')} AS churn_rate
FROM model_snapshots GROUP BY {by}""",
    )
register(
    "snapshot_overview",
    lambda m: v.snapshot_overview(snapshots(m)),
    f"""
SELECT n AS "rows", unique_customers, {pct('c', 'n')} AS churn_rate, single_order_rows,
  {pct('single_order_rows', 'n')} AS single_order_pct, {pct('sc', 'single_order_rows')} AS single_order_churn,
  n - single_order_rows AS multi_order_rows, {pct('c - sc', 'n - single_order_rows')} AS multi_order_churn
FROM (SELECT count(*) AS n, count(DISTINCT customer_id) AS unique_customers, sum(churned) AS c,
  count(*) FILTER (is_single_order_customer = 1) AS single_order_rows,
  count(*) FILTER (is_single_order_customer = 1 AND churned = 1) AS sc FROM model_snapshots)
""",
)
register(
    "feature_distribution",
    lambda m: v.feature_distribution(snapshots(m)),
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {rnd(f'avg(CAST({c} AS DOUBLE))')} AS mean, {rnd(f'CAST(min({c}) AS DOUBLE)')} AS min, "
        f"{rnd(f'CAST(max({c}) AS DOUBLE)')} AS max, count(*) FILTER ({c} IS NULL) AS nulls, "
        f"{rnd(f'CAST(median({c}) AS DOUBLE)')} AS median FROM model_snapshots" for c in NUMERIC_FEATURES
    ),
)


def test_rows(m: Market):
    return ft.build_snapshots(m.gold_stored, [tb.TEST])


def rule_sql(rules: dict[str, str], table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS rule, {big(f'({q})')} AS violations, ({q}) = 0 AS passed"
        for n, q in ((n, f"SELECT count(*) FROM {table} WHERE {c}") for n, c in rules.items())
    )


TEST_ROWS = f"(SELECT * FROM model_snapshots WHERE snapshot_date = DATE '{tb.TEST}')"
BASE = f"""SELECT 'empty' AS rule, CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS violations, count(*) > 0 AS passed
  FROM {{0}} UNION ALL SELECT 'duplicate_key', coalesce(sum(n - 1), 0)::BIGINT, coalesce(sum(n - 1), 0) = 0
  FROM (SELECT count(*) AS n FROM {{0}} GROUP BY {{1}})"""
register(
    "validate_snapshot",
    lambda m: v.validate_snapshot(test_rows(m), tb.TEST),
    BASE.format(TEST_ROWS, "customer_id, snapshot_date") + " UNION ALL " + rule_sql({
        "null_customer_id": "customer_id IS NULL",
        "unexpected_snapshot_date": f"snapshot_date <> DATE '{tb.TEST}'",
        "invalid_label": "churned NOT IN (0, 1)",
        "negative_tenure": "customer_tenure_days < 0",
        "negative_recency": "days_since_last_order < 0",
        "below_minimum_orders": "total_orders < 1",
        **{f"{r}_out_of_range": f"{r} NOT BETWEEN 0 AND 1" for r in v.RATES},
        "wrong_single_order_flag": "is_single_order_customer <> CASE WHEN total_orders = 1 THEN 1 ELSE 0 END",
        "missing_order_interval": "total_orders > 1 AND avg_days_between_orders IS NULL",
    }, TEST_ROWS),
)
register(
    "validate_split",
    lambda m: v.validate_split(test_rows(m)),
    BASE.format(TEST_ROWS, "customer_id, snapshot_date") + " UNION ALL " + rule_sql(
        {"invalid_label": "churned NOT IN (0, 1)"}, TEST_ROWS)
    + " UNION ALL SELECT 'missing_column', 0, TRUE UNION ALL SELECT 'forbidden_feature', 0, TRUE",
)
register(
    "label_window",
    lambda m: v.check_label_window(m.gold.fact_orders, DATES),
    f"""SELECT max(order_date) AS latest_order_date, DATE '{tb.TEST}' + 90 AS required_date,
  max(order_date) >= DATE '{tb.TEST}' + 90 AS covered FROM fact_orders""",
)
