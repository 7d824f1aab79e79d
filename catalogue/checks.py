"""Reconciliation, profiles, data checks and join operators."""

from functools import reduce

from pyspark.sql import DataFrame

from catalogue import testbed as tb
from catalogue.registry import Market, register
from catalogue.sqlbase import big, cte, pct, ratio, usd
from stallkeeper.functions.text import NULL_TOKENS
from stallkeeper.operators import clean, dims, joins, profile, reconcile
from stallkeeper.operators.checks import check_accepted, check_fk, check_not_null, check_unique, run_checks
from stallkeeper.operators.dedupe import duplicate_keys, duplicate_summary
from stallkeeper.plans import suite
from stallkeeper.sources import io

REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")

# --- reconciliation, on clean and on repaired tables ---
PART = ["subtotal", "discount_amount", "tax_amount", "shipping_cost"]
REBUILT = "(subtotal_cents - discount_amount_cents + tax_amount_cents + shipping_cost_cents)"
COMPLETE = f"({REBUILT} IS NOT NULL AND total_amount_cents IS NOT NULL)"
for prefix, suffix, pick in (("", "", "gold"), ("fixed_", "_repaired", "repaired")):
    totals = f"market_totals{suffix}"
    cte(totals, f"""
SELECT * FROM (SELECT sum(gross_gmv_cents) AS gross, sum(net_gmv_cents) AS net, sum(total_discounts_cents) AS discounts,
    sum(invalid_gmv_item_count) AS mart_invalid FROM {prefix}mart_gmv_daily)
  CROSS JOIN (SELECT count(*) FILTER (NOT is_gmv_valid) AS fact_invalid FROM {prefix}eligible_items)
  CROSS JOIN (SELECT sum(gross_gmv_cents) AS s_gross, sum(net_gmv_cents) AS s_net FROM {prefix}mart_seller_health)
  CROSS JOIN (SELECT sum(total_amount_cents) AS charged, count(*) FILTER (total_amount_cents IS NULL) AS null_totals,
    count(*) FILTER (is_unknown_customer) AS unknown_orders,
    coalesce(sum(total_amount_cents) FILTER (is_unknown_customer), 0) AS unknown_spend FROM {prefix}eligible_orders)
  CROSS JOIN (SELECT sum(lifetime_customer_spend_cents) FILTER (NOT is_unknown_customer) AS real_spend,
    sum(lifetime_customer_spend_cents) FILTER (is_unknown_customer) AS orphan_spend,
    sum(lifetime_customer_spend_cents) AS platform, sum(invalid_financial_orders) AS bad_orders
    FROM {prefix}mart_customer_ltv)
  CROSS JOIN (SELECT count(*) AS unmatched FROM {prefix}eligible_orders
    WHERE customer_id NOT IN (SELECT customer_id FROM {prefix}dim_customers))
""")
    lines = [
        ("gross minus discounts is net", "gross - discounts", "net", 1),
        ("invalid items: fact and mart", "fact_invalid", "mart_invalid", 0),
        ("gross: marketplace and sellers", "gross", "s_gross", 1),
        ("net: marketplace and sellers", "net", "s_net", 1),
        ("charged amount and lifetime spend", "charged", "platform", 1),
        ("real plus orphan is platform spend", "real_spend + orphan_spend", "platform", 1),
        ("orders without total: fact and mart", "null_totals", "bad_orders", 0),
        ("orders without a customer row", "unmatched", "0", 0),
        ("unknown-member spend and orphan spend", "unknown_spend", "orphan_spend", 1),
    ]
    register(
        f"reconcile_market{suffix}",
        lambda m, p=pick: reconcile.reconcile_market(getattr(m, f"{p}_stored")),
        " UNION ALL ".join(
            f"SELECT '{label}' AS label, {big(a)} AS left_value, {big(b)} AS right_value, "
            f"{big(f'abs(({a}) - ({b}))')} AS difference, abs(({a}) - ({b})) <= {tol} AS passed FROM {totals}"
            for label, a, b, tol in lines
        ),
    )
    register(
        f"spend_gap{suffix}",
        lambda m, p=pick: reconcile.spend_gap(getattr(m, f"{p}_stored")),
        f"""
SELECT {usd('real_spend')} AS real_customer_spend, {usd('orphan_spend')} AS orphan_reconciliation_spend,
  {usd('platform')} AS platform_customer_spend, {usd('charged')} AS fact_order_customer_spend,
  {usd('charged - platform')} AS reconciliation_gap, null_totals AS null_total_amount_orders,
  {big('bad_orders')} AS invalid_financial_orders, unknown_orders AS orders_mapped_to_unknown FROM {totals}
""",
    )
    register(
        f"component_quality{suffix}",
        lambda m, p=pick: reconcile.component_quality(getattr(m, p).fact_orders),
        f"""
SELECT count(*) AS eligible_orders, count(*) FILTER (NOT {COMPLETE}) AS orders_with_missing_components,
  count(*) FILTER ({COMPLETE} AND abs(total_amount_cents - {REBUILT}) > 1) AS complete_orders_with_mismatch,
  {usd(f'sum(total_amount_cents) FILTER ({COMPLETE})')} AS complete_order_actual_total,
  {usd(f'sum({REBUILT}) FILTER ({COMPLETE})')} AS complete_order_reconstructed_total,
  {usd(f'sum(total_amount_cents - {REBUILT}) FILTER ({COMPLETE})')} AS reconstruction_gap
FROM {prefix}eligible_orders
""",
    )
    register(
        f"component_mismatch_top{suffix}",
        lambda m, p=pick: reconcile.component_mismatch_top(getattr(m, p).fact_orders),
        f"""
SELECT order_id, {usd('subtotal_cents')} AS subtotal, {usd('discount_amount_cents')} AS discount,
  {usd('tax_amount_cents')} AS tax, {usd('shipping_cost_cents')} AS shipping, {usd('total_amount_cents')} AS total_amount,
  {usd(f'(total_amount_cents - {REBUILT})')} AS difference
FROM {prefix}eligible_orders WHERE {COMPLETE} AND abs(total_amount_cents - {REBUILT}) > 1
ORDER BY abs(total_amount_cents - {REBUILT}) DESC, order_id LIMIT 5
""",
    )
    register(
        f"line_total_diagnostic{suffix}",
        lambda m, p=pick: reconcile.line_total_diagnostic(getattr(m, p).fact_order_items),
        f"""
SELECT {usd('sum(line_total_cents) FILTER (is_gmv_valid)')} AS line_total,
  {usd('sum(expected_line_total_cents)')} AS expected_line_total,
  count(*) FILTER (abs(line_total_cents - expected_line_total_cents) > 1) AS mismatched_items FROM {prefix}eligible_items
""",
    )

# --- profiles of the raw tables ---
TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def token_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, count(*) AS occurrences FROM {table} "
        f"WHERE {c} IN ({TOKENS}) OR {c} IS NULL GROUP BY {c}"
        for c in columns
    )


PROFILED = {
    "customers": ["email", "first_name", "signup_channel"],
    "orders": ["order_number"],
    "payments": ["card_brand"],
    "shipments": ["tracking_number"],
}
for table, columns in PROFILED.items():
    register(
        f"null_tokens_{table}",
        lambda m, t=table, c=columns: profile.null_token_profile(m.raw[t], c),
        token_sql(f"dirty_{table}", columns),
    )
for table, key in (
    ("customers", "customer_id"), ("orders", "order_id"), ("payments", "payment_id"), ("shipments", "shipment_id"),
):
    register(
        f"duplicates_{table}",
        lambda m, t=table, k=key: duplicate_summary(m.raw[t], k),
        f"""SELECT count(*) AS total_rows, count(DISTINCT {key}) AS unique_ids,
  count(*) - count(DISTINCT {key}) AS duplicate_count FROM dirty_{table}""",
    )
register(
    "duplicates_customers_external_id",
    lambda m: duplicate_summary(m.raw["customers"], "cust_ext_id"),
    """SELECT count(*) AS total_rows, count(DISTINCT cust_ext_id) AS unique_ids,
  count(*) - count(DISTINCT cust_ext_id) AS duplicate_count FROM dirty_customers""",
)
register(
    "duplicate_line_keys",
    lambda m: duplicate_keys(m.bed.read("lineitem"), ["l_orderkey", "l_linenumber"]),
    """SELECT l_orderkey, l_linenumber, count(*) AS occurrences FROM lineitem GROUP BY l_orderkey, l_linenumber
  HAVING count(*) > 1""",
)
register(
    "find_zombies",
    lambda m: profile.find_zombies(m.raw["customers"]),
    """SELECT customer_id, first_name, last_name, email FROM dirty_customers
WHERE customer_id LIKE 'TEST%' OR email LIKE '%test@test%' OR email LIKE '%@localhost%' OR email LIKE '%asdf%'
  OR first_name IN ('TEST USER', 'test test', 'ASDF ASDF', 'QA Test', 'DELETE ME', 'xxxxx', 'DO NOT USE')
ORDER BY customer_id LIMIT 10""",
)
EVOLVED = ["promo_code", "loyalty_points", "referral_source", "cust_ext_id"]
register(
    "fill_rate_customers",
    lambda m: profile.fill_rate(m.raw["customers"], [*EVOLVED, "customer_external_id"]),
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TRUE AS present, count(*) AS total, count({c}) AS non_null, "
        f"{pct(f'count({c})', 'count(*)')} AS fill_rate_pct FROM dirty_customers" for c in EVOLVED
    ) + " UNION ALL SELECT 'customer_external_id', FALSE, count(*), NULL, NULL FROM dirty_customers",
)
DRIFTED = {
    "orders": ["total_amount", "subtotal", "discount_amount", "shipping_cost"],
    "order_items": ["unit_price", "unit_cost", "line_total"],
}
for table, columns in DRIFTED.items():
    register(
        f"type_drift_{table}",
        lambda m, t=table, c=columns: profile.type_drift(m.raw[t], c),
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", 'string' AS type, count(*) FILTER ({c} NOT GLOB '[0-9]*' AND "
            f"{c} NOT GLOB '-[0-9]*') AS drifted_values FROM dirty_{table}" for c in columns
        ),
    )
register(
    "type_drift_samples",
    lambda m: reduce(DataFrame.union, [profile.type_drift_samples(m.raw[t], c) for t, c in DRIFTED.items()]),
    'SELECT "column", sample, occurrences FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY sample) AS place FROM ('
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS sample, count(*) AS occurrences FROM dirty_{t} "
        f"WHERE {c} NOT GLOB '[0-9]*' AND {c} NOT GLOB '-[0-9]*' GROUP BY {c}"
        for t, columns in DRIFTED.items() for c in columns
    ) + ")) WHERE place <= 5",
)
register(
    "late_arrivals",
    lambda m: profile.late_arrival_profile(m.raw["orders"]),
    f"""SELECT count(*) AS total_late, min(_ingestion_delay_days) AS min_delay, max(_ingestion_delay_days) AS max_delay,
  {ratio('sum(_ingestion_delay_days)', 'count(*)', 1)} AS avg_delay FROM dirty_orders WHERE _ingestion_delay_days > 0""",
)
register(
    "negative_shipping",
    lambda m: profile.negative_counts(m.raw["orders"], ["shipping_cost"]),
    "SELECT count(*) FILTER (TRY_CAST(shipping_cost AS DOUBLE) < 0) AS negative_shipping_cost FROM dirty_orders",
)
register(
    "negative_quantity",
    lambda m: profile.negative_counts(m.raw["order_items"], ["quantity"]),
    "SELECT count(*) FILTER (quantity < 0) AS negative_quantity FROM dirty_order_items",
)
for table, fk in (("order_items", "order_id"), ("payments", "order_id"), ("reviews", "product_id")):
    register(
        f"orphan_keys_{table}",
        lambda m, t=table, k=fk: profile.orphan_prefix_profile(m.raw[t], k),
        f"""SELECT {fk} AS key, count(*) AS rows,
  (SELECT count(*) FROM dirty_{table} WHERE {fk} LIKE 'ORPHAN%') AS broken_rows
FROM dirty_{table} WHERE {fk} LIKE 'ORPHAN%' GROUP BY {fk} ORDER BY {fk} LIMIT 5""".replace("AS rows", 'AS "rows"'),
    )
register(
    "rating_distribution",
    lambda m: profile.rating_distribution(m.raw["reviews"]),
    f"""SELECT *, {pct('cnt', 'sum(cnt) OVER ()')} AS pct
FROM (SELECT rating, count(*) AS cnt FROM dirty_reviews GROUP BY rating)""",
)
register("describe_orders", lambda m: io.describe_schema(m.raw["orders"]))
register(
    "table_row_counts",
    lambda m: io.table_row_counts({n: m.raw[n] for n in m.raw}),
    " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t}" for n, t in (
            ("customers", "dirty_customers"), ("sellers", "sellers"), ("products", "products"),
            ("orders", "dirty_orders"), ("order_items", "dirty_order_items"), ("payments", "dirty_payments"),
            ("shipments", "dirty_shipments"), ("returns", "returns"), ("reviews", "dirty_reviews"))
    ),
)

# --- joins ---
register(
    "orphan_items",
    lambda m: joins.orphans(m.raw["order_items"], m.raw["orders"], "order_id", "order_id").select(
        "order_item_id", "order_id", "product_id"),
    """SELECT i.order_item_id, i.order_id, i.product_id FROM dirty_order_items i
LEFT JOIN dirty_orders o ON i.order_id = o.order_id WHERE o.order_id IS NULL""",
)
register(
    "with_params",
    lambda m: joins.with_params(m.clean["customers"].select("customer_id", "signup_date"), as_of=tb.AS_OF, days=90),
    f"""SELECT customer_id, signup_date, as_of, days FROM customers
CROSS JOIN (SELECT DATE '{tb.AS_OF}' AS as_of, 90 AS days)""",
)
register(
    "sellable_products",
    lambda m: joins.sellable_products(m.clean["products"], m.clean["sellers"]),
    """SELECT p.product_id, p.seller_id, p.category, p.price, p.cost, p.launch_date,
  s.onboarding_date AS seller_start_date, s.sales_end_date AS seller_end_date, s.sales_profile
FROM products p JOIN sellers s ON p.seller_id = s.seller_id WHERE p.is_active""",
)
register(
    "delivered_items",
    lambda m: joins.delivered_items(m.clean["order_items"], m.clean["orders"], m.clean["shipments"]),
    """SELECT i.order_id, i.order_item_id, i.product_id, i.seller_id, i.category, i.line_total, o.customer_id, s.delivered_at
FROM order_items i JOIN raw_orders o ON i.order_id = o.order_id
JOIN shipments s ON s.order_id = o.order_id WHERE o.order_status = 'delivered' AND s.delivered_at IS NOT NULL""",
)
register(
    "join_one_to_one",
    lambda m: joins.join_one_to_one(
        m.clean["orders"].select("order_id", "order_status"), m.clean["shipments"].select("order_id", "status"),
        "order_id", "left"),
    "SELECT o.order_id, order_status, status FROM raw_orders o LEFT JOIN shipments s ON o.order_id = s.order_id",
)
def dim_dates(m: Market):
    """The calendar of the years in which orders were placed."""
    return dims.dim_dates(
        m.spark, *m.bed.read("orders").selectExpr(
            "cast(date_trunc('year', min(o_orderdate)) as date)",
            "last_day(add_months(cast(date_trunc('year', max(o_orderdate)) as date), 11))").first())


cte("dim_dates", """
SELECT d AS date_day, year(d) AS year, quarter(d) AS quarter, month(d) AS month, weekofyear(d) AS week_of_year,
  dayofweek(d) AS day_of_week, dayofyear(d) AS day_of_year, strftime(d, '%B') AS month_name,
  strftime(d, '%A') AS day_name, strftime(d, '%Y-%m') AS year_month,
  strftime(d, '%Y') || '-Q' || quarter(d) AS year_quarter, dayofweek(d) IN (0, 6) AS is_weekend,
  CASE WHEN month(d) >= 2 THEN year(d) ELSE year(d) - 1 END AS fiscal_year,
  CASE WHEN month(d) >= 10 THEN 'Q4_peak' WHEN month(d) = 1 THEN 'post_holiday'
    WHEN month(d) IN (7, 8) THEN 'summer_dip' ELSE 'normal' END AS season_label
FROM (SELECT CAST(unnest(generate_series(date_trunc('year', min(o_orderdate)),
    date_trunc('year', max(o_orderdate)) + INTERVAL 1 YEAR - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS d FROM orders)
""")
register("dim_dates", dim_dates, "SELECT * FROM dim_dates")

# --- checks ---
LAYERS = {
    **{f"bronze_{t}": f"dirty_{t}" for t in ("customers", "orders", "order_items", "payments", "shipments", "reviews")},
    "bronze_sellers": "sellers", "bronze_products": "products", "bronze_returns": "returns",
    **{f"silver_{t}": f"silver_{t}" for t in ("customers", "orders", "order_items", "payments", "shipments", "reviews")},
    "silver_sellers": "sellers", "silver_products": "products", "silver_returns": "returns",
    "dim_dates": "dim_dates",
    **{t: f"fixed_{t}" for t in ("dim_customers", "dim_sellers", "dim_products", "fact_orders", "fact_order_items",
                                 "mart_gmv_daily", "mart_customer_ltv", "mart_seller_health")},
}


def checked_tables(m: Market) -> tb.LazyTables:
    def build(name: str):
        layer, _, rest = name.partition("_")
        if layer in ("bronze", "silver"):
            return (m.arrived if layer == "bronze" else m.silver_stored)[rest]
        if name == "dim_dates":
            return dim_dates(m)
        return getattr(m.repaired_stored, name)
    return tb.LazyTables(tuple(LAYERS), build)


def violations(c, layers: dict[str, str] = LAYERS) -> str:
    t = layers[c.table]
    if c.kind == "not_null":
        return f"SELECT count(*) AS n FROM {t} WHERE {c.column} IS NULL"
    if c.kind == "accepted":
        return f"SELECT count(*) AS n FROM {t} WHERE {c.column} NOT IN ({', '.join(repr(v) for v in c.values)})"
    if c.kind == "unique":
        return f"SELECT count(*) AS n FROM (SELECT {c.column} FROM {t} WHERE {c.column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1)"
    return (f"SELECT count(*) AS n FROM {t} a WHERE a.{c.column} IS NOT NULL AND NOT EXISTS "
            f"(SELECT 1 FROM {layers[c.to[0]]} b WHERE b.{c.to[1]} = a.{c.column})")


def result_sql(name: str, table: str, severity: str, counted: str) -> str:
    return (f"SELECT '{name}' AS check_name, '{table}' AS table_name, '{severity}' AS severity, n AS violations, "
            f"CASE WHEN n = 0 THEN 'pass' ELSE '{severity}' END AS status FROM ({counted})")


def rule_sql_for(checks, layers: dict[str, str], extra: list[str]) -> str:
    return " UNION ALL ".join([result_sql(c.name, c.table, c.severity, violations(c, layers)) for c in checks] + extra)


def suite_sql(checks, extra: list[str] | None = None) -> str:
    return rule_sql_for(checks, LAYERS, extra or [])


SPECIAL = [
    result_sql("non_negative_mart_gmv_daily_gmv", "mart_gmv_daily", "error",
               "SELECT count(*) AS n FROM fixed_mart_gmv_daily WHERE gmv_cents < 0"),
    result_sql("no_orphans_silver_order_items_order_id", "silver_order_items", "error",
               "SELECT count(*) AS n FROM silver_order_items WHERE order_id LIKE 'ORPHAN-%'"),
    result_sql("no_zombies_silver_customers_customer_id", "silver_customers", "error",
               "SELECT count(*) AS n FROM silver_customers WHERE customer_id LIKE 'TEST-%' OR email LIKE '%test@test%' "
               "OR email LIKE '%@localhost%'"),
    result_sql("after_signup_fact_orders_order_date", "fact_orders", "warn",
               "SELECT count(*) AS n FROM fixed_fact_orders o JOIN fixed_dim_customers c "
               "ON o.customer_id = c.customer_id WHERE o.order_date < c.signup_date"),
]


def special(m: Market):
    g = m.repaired_stored
    return suite.special_checks(
        g.mart_gmv_daily, g.tables["order_items"], g.tables["customers"], g.fact_orders, g.dim_customers)


register("checks_raw", lambda m: run_checks(checked_tables(m), suite.raw_suite()), suite_sql(suite.raw_suite()))
register(
    "checks_silver",
    lambda m: run_checks(checked_tables(m), suite.silver_suite(REGIONS)),
    suite_sql(suite.silver_suite(REGIONS)),
)
register(
    "checks_gold",
    lambda m: run_checks(checked_tables(m), suite.gold_suite(), special(m)),
    suite_sql(suite.gold_suite(), SPECIAL),
)
EVERY_LAYER = suite.raw_suite() + suite.silver_suite(REGIONS) + suite.gold_suite()
register(
    "check_not_null_total",
    lambda m: check_not_null(m.silver["orders"], "total_amount").select("order_id", "order_number"),
    "SELECT order_id, order_number FROM silver_orders WHERE total_amount IS NULL",
)
register(
    "check_unique_external_id",
    lambda m: check_unique(m.raw["customers"], "cust_ext_id"),
    "SELECT cust_ext_id, count(*) AS occurrences FROM dirty_customers GROUP BY 1 HAVING count(*) > 1",
)
register(
    "check_accepted_channel",
    lambda m: check_accepted(m.raw["customers"], "signup_channel", tb.CHANNELS),
    f"""SELECT signup_channel, count(*) AS occurrences FROM dirty_customers
WHERE signup_channel NOT IN ({', '.join(repr(c) for c in tb.CHANNELS)}) GROUP BY 1""",
)
register(
    "check_fk_items",
    lambda m: check_fk(m.silver["order_items"], "order_id", m.silver["orders"], "order_id").select("order_item_id"),
    """SELECT order_item_id FROM silver_order_items i WHERE NOT EXISTS
  (SELECT 1 FROM silver_orders o WHERE o.order_id = i.order_id)""",
)
register(
    "orders_before_signup",
    lambda m: suite.orders_before_signup(m.gold.fact_orders, m.gold.dim_customers),
    """SELECT order_id, order_date, signup_date FROM fact_orders o JOIN dim_customers c
ON o.customer_id = c.customer_id WHERE order_date < signup_date""",
)
register("negative_gmv", lambda m: suite.negative_gmv(m.repaired.mart_gmv_daily),
         """SELECT order_date, region, category, customer_segment, gmv_cents FROM fixed_mart_gmv_daily
WHERE gmv_cents < 0""")
register("blank_to_missing",
         lambda m: clean.blank_to(m.raw["customers"], ["signup_channel", "segment", "region"]).select(
             "customer_id", "signup_channel", "segment", "region"),
         "SELECT customer_id, " + ", ".join(
             f"coalesce(nullif(trim({c}), ''), 'missing') AS {c}" for c in ("signup_channel", "segment", "region")
         ) + " FROM dirty_customers")
