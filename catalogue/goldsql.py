"""SQL of the star schema, as a template so that it can sit on clean or on repaired tables."""

from catalogue.sqlbase import AS_OF, ELIGIBLE, UNKNOWN_ID, big, cents, cte, mean_usd, pct, usd

ORDER_MONEY = ["subtotal", "discount_amount", "tax_amount", "shipping_cost", "total_amount"]


def gold_ctes(p: str, customers: str, sellers: str, products: str, orders: str, items: str) -> None:
    cte(f"{p}dim_customers", f"""
SELECT customer_id, customer_external_id, email, first_name, last_name, region, country_code, segment, signup_date,
  signup_channel, account_status, {big('year(signup_date)')} AS signup_year,
  strftime(signup_date, '%Y-%m') AS signup_cohort, created_at, updated_at, FALSE AS is_unknown_customer
FROM {customers}
UNION ALL
SELECT '{UNKNOWN_ID}', 'UNKNOWN-CUSTOMER', 'unknown@customer.invalid', 'Unknown', 'Customer', 'UNKNOWN', 'UNK',
  'unknown', DATE '1900-01-01', 'unknown', 'closed', 1900, 'unknown', TIMESTAMP '1900-01-01', TIMESTAMP '1900-01-01', TRUE
""")
    cte(f"{p}dim_sellers", f"""
SELECT seller_id, seller_external_id, business_name, seller_type, tier, onboarding_date, region, country_code,
  primary_category, avg_rating, total_reviews, is_verified, is_suspended, commission_rate,
  {big('year(onboarding_date)')} AS onboarding_year, strftime(onboarding_date, '%Y-%m') AS onboarding_cohort,
  created_at, updated_at
FROM {sellers}
""")
    cte(f"{p}dim_products", f"""
SELECT product_id, product_sku, seller_id, product_name, category, subcategory, brand, price, cost, weight_kg,
  avg_rating, review_count, return_rate, is_active, launch_date, (pc - cc) / 1e2 AS gross_margin,
  CASE WHEN price > 0 THEN {pct('pc - cc', 'pc', 2)} ELSE 0e0 END AS gross_margin_pct,
  CASE WHEN price < 20 THEN 'budget' WHEN price < 50 THEN 'mid_range' WHEN price < 150 THEN 'premium'
    ELSE 'luxury' END AS price_tier, created_at, updated_at
FROM (SELECT *, {cents('price')} AS pc, {cents('cost')} AS cc FROM {products})
""")
    money = ", ".join(f"{cents('o.' + c)} AS {c}_cents" for c in ORDER_MONEY)
    cte(f"{p}fact_orders", f"""
SELECT o.order_id, o.order_number, coalesce(c.customer_id, '{UNKNOWN_ID}') AS customer_id,
  o.customer_id AS source_customer_id, c.customer_id IS NULL AS is_unknown_customer, o.region, o.order_status,
  o.order_channel, o.device_type, o.order_placed_at, CAST(o.order_placed_at AS DATE) AS order_date, o.currency, {money},
  o.item_count, o.is_first_order, o.ingestion_delay_days, o.is_late_arrival, o._has_negative_shipping,
  o._has_impossible_discount, coalesce(c.segment, 'unknown') AS customer_segment,
  coalesce(c.signup_cohort, 'unknown') AS customer_signup_cohort, coalesce(c.country_code, 'UNK') AS customer_country,
  o.created_at, o.updated_at
FROM {orders} o
LEFT JOIN (SELECT * FROM {p}dim_customers WHERE NOT is_unknown_customer) c ON o.customer_id = c.customer_id
""")
    cte(f"{p}item_base", f"""
SELECT *, is_gmv_valid AND coalesce(unit_cost_cents >= 0, FALSE) AS is_margin_valid,
  CASE WHEN is_gmv_valid THEN unit_price_cents * quantity END AS gross_gmv_cents,
  CASE WHEN is_gmv_valid THEN unit_price_cents * quantity - discount_amount_cents END AS net_gmv_cents,
  CASE WHEN is_gmv_valid AND unit_cost_cents >= 0 THEN unit_cost_cents * quantity END AS merchandise_cost_cents,
  CASE WHEN is_gmv_valid THEN unit_price_cents * quantity - discount_amount_cents + tax_amount_cents END
    AS expected_line_total_cents
FROM (SELECT *, coalesce(quantity > 0 AND unit_price_cents >= 0 AND discount_amount_cents >= 0
    AND discount_amount_cents <= unit_price_cents * quantity, FALSE) AS is_gmv_valid
FROM (SELECT order_item_id, order_id, product_id, seller_id, category, quantity, _had_negative_quantity,
  {cents('unit_price')} AS unit_price_cents, {cents('unit_cost')} AS unit_cost_cents,
  {cents('discount_amount')} AS discount_amount_cents, {cents('tax_amount')} AS tax_amount_cents,
  {cents('line_total')} AS line_total_cents FROM {items}))
""")
    cte(f"{p}fact_order_items", f"""
SELECT i.*,
  pr.product_name, pr.subcategory, pr.brand, pr.price_tier, pr.gross_margin_pct AS product_margin_pct,
  s.business_name AS seller_name, s.tier AS seller_tier, s.commission_rate AS seller_commission_rate,
  o.order_date, o.region, o.customer_segment, o.order_status, o.customer_id
FROM {p}item_base i
LEFT JOIN {p}dim_products pr ON i.product_id = pr.product_id
LEFT JOIN {p}dim_sellers s ON i.seller_id = s.seller_id
LEFT JOIN {p}fact_orders o ON i.order_id = o.order_id
""")
    cte(f"{p}eligible_orders", f"SELECT * FROM {p}fact_orders WHERE {ELIGIBLE}")
    cte(f"{p}eligible_items", f"SELECT * FROM {p}fact_order_items WHERE {ELIGIBLE}")
    cte(f"{p}mart_gmv_daily", f"""
SELECT order_date, region, category, customer_segment,
  count(DISTINCT order_id) AS order_count,
  count(DISTINCT order_id) FILTER (is_gmv_valid) AS financially_valid_order_count,
  count(DISTINCT customer_id) AS customer_count,
  {big('coalesce(sum(quantity) FILTER (is_gmv_valid), 0)')} AS items_sold,
  count(*) FILTER (NOT is_gmv_valid) AS invalid_gmv_item_count,
  count(*) FILTER (NOT is_margin_valid) AS invalid_margin_item_count,
  {big('coalesce(sum(gross_gmv_cents), 0)')} AS gross_gmv_cents,
  {big('coalesce(sum(net_gmv_cents), 0)')} AS net_gmv_cents,
  {big('coalesce(sum(net_gmv_cents), 0)')} AS gmv_cents,
  {big('coalesce(sum(discount_amount_cents) FILTER (is_gmv_valid), 0)')} AS total_discounts_cents,
  {big('coalesce(sum(tax_amount_cents) FILTER (is_gmv_valid), 0)')} AS total_item_tax_cents,
  {big('coalesce(sum(merchandise_cost_cents), 0)')} AS total_cost_cents,
  {big('coalesce(sum(net_gmv_cents - merchandise_cost_cents), 0)')} AS gross_profit_cents,
  {mean_usd('sum(net_gmv_cents)', 'count(net_gmv_cents)')} AS avg_item_value,
  CASE WHEN sum(net_gmv_cents) FILTER (is_margin_valid) > 0 THEN
    {pct('sum(net_gmv_cents - merchandise_cost_cents)', 'sum(net_gmv_cents) FILTER (is_margin_valid)', 2)}
    ELSE 0e0 END AS gross_margin_pct
FROM {p}eligible_items
GROUP BY order_date, region, category, customer_segment
""")
    cte(f"{p}mart_customer_ltv", f"""
SELECT *, CASE WHEN days_since_last_order IS NULL THEN 'never_ordered' WHEN days_since_last_order <= 30 THEN 'active'
    WHEN days_since_last_order <= 90 THEN 'at_risk' WHEN days_since_last_order <= 180 THEN 'dormant'
    ELSE 'churned' END AS activity_status
FROM (
  SELECT c.customer_id, c.customer_external_id, c.region, c.segment, c.signup_cohort, c.signup_channel,
    c.is_unknown_customer, count(DISTINCT o.order_id) AS total_orders,
    count(DISTINCT o.order_id) FILTER (o.total_amount_cents IS NOT NULL) AS financially_valid_orders,
    count(DISTINCT o.order_id) FILTER (o.total_amount_cents IS NULL) AS invalid_financial_orders,
    min(o.order_date) AS first_order_date, max(o.order_date) AS last_order_date,
    {big('coalesce(sum(o.total_amount_cents), 0)')} AS lifetime_customer_spend_cents,
    {big('coalesce(sum(o.total_amount_cents), 0)')} AS lifetime_revenue_cents,
    {mean_usd('sum(o.total_amount_cents)', 'count(o.total_amount_cents)')} AS avg_order_value,
    count(DISTINCT o.order_id) > 1 AS is_repeat_customer,
    date_diff('day', min(o.order_date), max(o.order_date)) AS customer_lifespan_days,
    date_diff('day', max(o.order_date), {AS_OF}) AS days_since_last_order
  FROM {p}dim_customers c LEFT JOIN {p}eligible_orders o ON c.customer_id = o.customer_id
  GROUP BY ALL)
""")
    cte(f"{p}mart_seller_health", f"""
SELECT *, (net_gmv_cents * CAST(floor(coalesce(commission_rate, 0) * 1e4 + 0.5) AS BIGINT) + 5000) // 10000
    AS commission_revenue_cents,
  CASE WHEN days_since_last_sale IS NULL THEN 'no_sales' WHEN days_since_last_sale <= 30 THEN 'active'
    WHEN days_since_last_sale <= 90 THEN 'at_risk' ELSE 'churned' END AS health_status
FROM (
  SELECT s.seller_id, s.seller_external_id, s.business_name, s.tier, s.seller_type, s.region, s.primary_category,
    s.commission_rate, s.avg_rating, s.onboarding_cohort, count(DISTINCT i.order_id) AS total_orders,
    {big('coalesce(sum(i.quantity) FILTER (i.is_gmv_valid), 0)')} AS total_items_sold,
    {big('coalesce(sum(i.net_gmv_cents), 0)')} AS total_gmv_cents,
    {big('coalesce(sum(i.gross_gmv_cents), 0)')} AS gross_gmv_cents,
    {big('coalesce(sum(i.net_gmv_cents), 0)')} AS net_gmv_cents,
    count(*) FILTER (i.order_item_id IS NOT NULL AND NOT i.is_gmv_valid) AS invalid_financial_item_count,
    count(DISTINCT i.product_id) FILTER (i.is_gmv_valid) AS active_products_sold,
    {mean_usd('sum(i.net_gmv_cents)', 'count(i.net_gmv_cents)')} AS avg_item_value,
    min(i.order_date) AS first_sale_date, max(i.order_date) AS last_sale_date,
    date_diff('day', max(i.order_date), {AS_OF}) AS days_since_last_sale
  FROM {p}dim_sellers s LEFT JOIN {p}eligible_items i ON s.seller_id = i.seller_id
  GROUP BY ALL)
""")


cte("plain_orders", """
SELECT *, 0 AS ingestion_delay_days, FALSE AS is_late_arrival, FALSE AS _has_negative_shipping,
  FALSE AS _has_impossible_discount FROM raw_orders
""")
cte("plain_items", "SELECT *, FALSE AS _had_negative_quantity FROM order_items")
gold_ctes("", "customers", "sellers", "products", "plain_orders", "plain_items")

MONEY_GMV = ["gross_gmv", "net_gmv", "gmv", "total_discounts", "total_item_tax", "total_cost", "gross_profit"]
MONEY_LTV = ["lifetime_customer_spend", "lifetime_revenue"]
MONEY_SELLER = ["total_gmv", "gross_gmv", "net_gmv", "commission_revenue"]
MONEY_ITEM = [
    "unit_price", "unit_cost", "discount_amount", "tax_amount", "line_total", "gross_gmv", "net_gmv",
    "merchandise_cost", "expected_line_total",
]


def show(table: str, money: list[str], drop: tuple[str, ...] = ()) -> str:
    cut = ", ".join([f"{m}_cents" for m in money] + list(drop))
    shown = ", ".join(f"{usd(m + '_cents')} AS {m}" for m in money)
    return f"SELECT * EXCLUDE ({cut}), {shown} FROM {table}"
