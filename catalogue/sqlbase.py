"""SQL side of the catalogue: named CTEs, assembled on demand into one statement per query."""

from __future__ import annotations

import re

from catalogue import testbed as tb

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    if name in CTES:
        raise ValueError(f"CTE {name} is defined twice")
    CTES[name] = body.strip()


def _needed(text: str, seen: list[str]) -> None:
    for name in dict.fromkeys(re.findall(r"[a-z_][a-z_0-9]*", text)):
        if name in CTES and name not in seen:
            body = CTES[name]
            # a CTE may share its name with the driver table it reads
            _needed(re.sub(rf"\b{name}\b", "", body), seen)
            if name not in seen:
                seen.append(name)


def sql(final: str) -> str:
    seen: list[str] = []
    _needed(final, seen)
    head = ",\n".join(f"{n} AS (\n{CTES[n]}\n)" for n in seen)
    return f"WITH {head}\n{final}" if head else final


def pick(values: list, key: str) -> str:
    items = ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" for v in values)
    return f"list_extract([{items}], CAST(({key}) % {len(values)} AS INTEGER) + 1)"


def rnd(x: str, k: int = 2) -> str:
    return f"(CAST(sign({x}) * floor(abs({x}) * 1e{k} + 0.5) AS BIGINT) / 1e{k})"


def cents(x: str) -> str:
    return f"CAST(sign({x}) * floor(abs({x}) * 1e2 + 0.5) AS BIGINT)"


def pct(a: str, b: str, k: int = 1) -> str:
    return rnd(f"(1e2 * ({a}) / NULLIF({b}, 0))", k)


def ratio(a: str, b: str, k: int = 2) -> str:
    return rnd(f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0))", k)


def mean_usd(a: str, b: str, k: int = 2) -> str:
    return rnd(f"(CAST({a} AS DOUBLE) / NULLIF({b}, 0) / 1e2)", k)


def usd(x: str) -> str:
    return f"(CAST({x} AS BIGINT) / 1e2)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def hash_bucket(salt: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{salt}|' || CAST({key} AS VARCHAR)), 1, 7) AS BIGINT)"


ELIGIBLE = "order_status NOT IN ('cancelled', 'refunded')"
AS_OF = f"DATE '{tb.AS_OF}'"
UNKNOWN_ID = "00000000-0000-0000-0000-000000000000"

cte("places", """
SELECT n_nationkey, n_name AS country_code, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey
""")

cte("customers", f"""
SELECT 'C' || c_custkey AS customer_id, c_name AS customer_external_id,
  lower(replace(c_name, '#', '.')) || '@mail.example' AS email,
  {pick(tb.FIRST_NAMES, 'c_custkey')} AS first_name, {pick(tb.LAST_NAMES, 'c_custkey')} AS last_name,
  p.region, p.country_code,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'whale' WHEN 'FURNITURE' THEN 'bargain_hunter'
    WHEN 'MACHINERY' THEN 'low_frequency' ELSE 'regular' END AS segment,
  DATE '1994-07-01' + CAST((c_custkey * 37) % 900 AS INTEGER) AS signup_date,
  CASE WHEN c_custkey % 40 <> 11 THEN {pick(tb.CHANNELS, 'c_custkey')} END AS signup_channel,
  CASE c_custkey % 20 WHEN 0 THEN 'suspended' WHEN 1 THEN 'closed' ELSE 'active' END AS account_status,
  CAST(DATE '1994-07-01' + CAST((c_custkey * 37) % 900 AS INTEGER) AS TIMESTAMP) AS created_at,
  CAST(DATE '1994-07-01' + CAST((c_custkey * 37) % 900 AS INTEGER) AS TIMESTAMP)
    + to_seconds(c_custkey % 1000) AS updated_at
FROM customer LEFT JOIN places p ON c_nationkey = p.n_nationkey
""")

cte("sellers", f"""
SELECT 'S' || s_suppkey AS seller_id, 'SEL-' || s_suppkey AS seller_external_id, s_name AS business_name,
  {pick(['individual', 'business', 'enterprise'], 's_suppkey')} AS seller_type,
  {pick(tb.TIERS, 's_suppkey')} AS tier,
  DATE '1994-01-01' + CAST((s_suppkey * 53) % 900 AS INTEGER) AS onboarding_date,
  {pick(['steady', 'seasonal', 'declining', 'stopped'], 's_suppkey')} AS sales_profile,
  CASE s_suppkey % 10 WHEN 3 THEN DATE '2001-04-02' WHEN 5 THEN DATE '2001-06-16' END AS sales_end_date,
  p.region, p.country_code, {pick(tb.CATEGORIES, 's_suppkey')} AS primary_category,
  3e0 + (s_suppkey % 20) / 1e1 AS avg_rating, s_suppkey % 500 AS total_reviews,
  s_suppkey % 2 = 0 AS is_verified, s_suppkey % 25 = 0 AS is_suspended,
  {pick(tb.RATES, 's_suppkey')} AS commission_rate,
  CAST(DATE '1994-01-01' + CAST((s_suppkey * 53) % 900 AS INTEGER) AS TIMESTAMP) AS created_at,
  CAST(DATE '1994-01-01' + CAST((s_suppkey * 53) % 900 AS INTEGER) AS TIMESTAMP) AS updated_at
FROM supplier LEFT JOIN places p ON s_nationkey = p.n_nationkey
""")

cte("products", f"""
SELECT 'P' || p_partkey AS product_id, 'SKU-' || p_partkey AS product_sku, 'S' || (p_partkey % 10) AS seller_id,
  p_name AS product_name, {pick(tb.CATEGORIES, 'p_partkey')} AS category, p_type AS subcategory, p_brand AS brand,
  pc / 1e2 AS price,
  floor(pc * (30 + p_size) / 1e2 + 0.5) / 1e2 AS cost, p_size / 1e1 AS weight_kg,
  1e0 + (p_partkey % 40) / 1e1 AS avg_rating, p_partkey % 300 AS review_count, (p_partkey % 25) / 1e2 AS return_rate,
  p_partkey % 12 <> 0 AS is_active, DATE '1994-01-01' + CAST(p_partkey % 365 AS INTEGER) AS launch_date,
  CAST(DATE '1994-01-01' + CAST(p_partkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
  CAST(DATE '1994-01-01' + CAST(p_partkey % 365 AS INTEGER) AS TIMESTAMP) AS updated_at
FROM (SELECT *, CAST(floor(p_retailprice * 1e2 + 0.5) AS BIGINT) - 89500 AS pc FROM part)
""")

cte("lines", """
SELECT *, CAST(floor((gross_c - disc_c) * l_tax + 0.5) AS BIGINT) AS tax_c,
  md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey,
      CAST(floor(l_extendedprice * 1e2 + 0.5) AS BIGINT))) AS item_hash
FROM (SELECT *, CAST(floor(gross_c * l_discount + 0.5) AS BIGINT) AS disc_c
  FROM (SELECT *, price_c * qty AS gross_c
    FROM (SELECT *, CAST(floor(l_extendedprice / l_quantity * 1e2 + 0.5) AS BIGINT) AS price_c,
            CAST(l_quantity AS INTEGER) AS qty FROM lineitem)))
""")

cte("order_totals", """
SELECT l_orderkey AS ok, CAST(sum(gross_c) AS BIGINT) AS sub_c, CAST(sum(disc_c) AS BIGINT) AS dis_c,
  CAST(sum(tax_c) AS BIGINT) AS txs_c, count(*) AS n_items
FROM lines GROUP BY l_orderkey
""")

cte("raw_orders", f"""
SELECT 'O' || o_orderkey AS order_id, 'ORD-' || o_orderkey AS order_number,
  CASE WHEN o_custkey % 50 = 7 THEN 'X' ELSE 'C' END || o_custkey AS customer_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'AMERICA' WHEN '2-HIGH' THEN 'EUROPE' WHEN '3-MEDIUM' THEN 'ASIA'
    WHEN '4-NOT SPECIFIED' THEN 'AFRICA' ELSE 'MIDDLE EAST' END AS region,
  CASE o_orderkey % 20 WHEN 0 THEN 'cancelled' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'refunded' WHEN 3 THEN 'shipped'
    WHEN 4 THEN 'in_transit' WHEN 5 THEN 'paid' WHEN 6 THEN 'placed' ELSE 'delivered' END AS order_status,
  {pick(['web', 'mobile_app', 'marketplace_api'], 'o_orderkey')} AS order_channel,
  {pick(['desktop', 'phone', 'tablet'], 'o_orderkey')} AS device_type,
  o_orderdate AS order_placed_at, 'USD' AS currency,
  sub_c / 1e2 AS subtotal, dis_c / 1e2 AS discount_amount, txs_c / 1e2 AS tax_amount,
  (399 + (o_orderkey % 13) * 100) / 1e2 AS shipping_cost,
  CASE WHEN o_orderkey % 50 = 11 THEN CAST(floor(o_totalprice * 1e2 + 0.5) AS BIGINT)
    ELSE sub_c - dis_c + txs_c + 399 + (o_orderkey % 13) * 100 END / 1e2 AS total_amount,
  coalesce(n_items, 0) AS item_count, o_orderkey % 10 = 0 AS is_first_order,
  o_orderdate AS created_at, o_orderdate + to_seconds(o_orderkey % 3600) AS updated_at
FROM orders LEFT JOIN order_totals ON ok = o_orderkey
""")

cte("order_items", f"""
SELECT item_hash AS order_item_id, 'O' || l_orderkey AS order_id, 'P' || l_partkey AS product_id,
  'S' || CASE WHEN l_suppkey % 20 = 0 OR (l_suppkey % 10 = 3 AND o_orderdate > TIMESTAMP '2001-04-02')
      OR (l_suppkey % 10 = 5 AND o_orderdate > TIMESTAMP '2001-06-16') THEN l_suppkey + 1 ELSE l_suppkey END AS seller_id,
  CASE WHEN (l_orderkey * 7 + l_linenumber) % 500 <> 0 THEN {pick(tb.CATEGORIES, 'l_partkey')} END AS category,
  qty AS quantity, price_c / 1e2 AS unit_price,
  floor(price_c * (30 + l_partkey % 51) / 1e2 + 0.5) / 1e2 AS unit_cost,
  disc_c / 1e2 AS discount_amount, tax_c / 1e2 AS tax_amount, (gross_c - disc_c + tax_c) / 1e2 AS line_total
FROM lines LEFT JOIN orders ON l_orderkey = o_orderkey
""")

cte("shipping", """
SELECT o_orderkey, o_custkey, shipped_at, delay_days,
  CASE WHEN n = 2 OR n = 5 OR n >= 7 THEN shipped_at + to_days(CAST(delay_days + 4 AS INTEGER)) END AS delivered_at
FROM (SELECT o_orderkey, o_custkey, o_orderkey % 20 AS n,
        o_orderdate + to_days(CAST(o_orderkey % 3 + 1 AS INTEGER)) AS shipped_at,
        CASE WHEN o_orderkey % 12 = 0 THEN 1 + o_orderkey % 7 ELSE 0 END AS delay_days FROM orders)
WHERE n > 1 AND n <> 6
""")

cte("shipments", f"""
SELECT 'SHP' || o_orderkey AS shipment_id, 'O' || o_orderkey AS order_id,
  {pick(['UPS', 'FedEx', 'DHL', 'Correios'], 'o_orderkey')} AS carrier, 'TRK' || o_orderkey AS tracking_number,
  {pick(['standard', 'express', 'next_day', 'same_day', 'standard'], 'o_orderkey')} AS shipping_method,
  CASE WHEN delivered_at IS NOT NULL THEN 'delivered' ELSE 'in_transit' END AS status,
  shipped_at, shipped_at + to_days(4) AS estimated_delivery_at, delivered_at,
  (o_orderkey % 50) / 1e1 AS weight_kg, (399 + (o_orderkey % 13) * 100) / 1e2 AS shipping_cost,
  o_orderkey % 9 = 0 AS is_international, delay_days,
  CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 1 END AS delivery_attempts, shipped_at AS created_at, shipped_at AS updated_at
FROM shipping
""")

cte("payments", f"""
SELECT 'PAY' || k || '-' || n AS payment_id, order_id,
  {pick(['credit_card', 'debit_card', 'paypal', 'apple_pay', 'google_pay', 'bank_transfer'], 'k')} AS payment_method,
  CASE WHEN k % 6 < 2 THEN {pick(['visa', 'mastercard', 'amex'], 'k')} END AS card_brand,
  CASE WHEN failed THEN 'failed' WHEN k % 20 = 2 THEN 'refunded' WHEN k % 20 = 6 THEN 'pending' ELSE 'captured' END
    AS payment_status,
  coalesce(total_amount, 0e0) AS amount, currency, {pick(['stripe', 'adyen', 'paypal'], 'k')} AS processor,
  'TX' || k || '-' || n AS processor_transaction_id, att AS attempted_at,
  CASE WHEN NOT failed THEN att + to_seconds(60) END AS completed_at,
  CASE WHEN failed THEN {pick(['insufficient_funds', 'card_declined', 'processor_error'], 'k')} END AS failure_reason,
  n = 2 AS is_retry, CASE WHEN n = 2 THEN 'PAY' || k || '-1' END AS retry_of_payment_id,
  att AS created_at, att AS updated_at
FROM (SELECT *, order_placed_at + to_seconds(300 + (n - 1) * 3600) AS att,
        (k % 20 = 9 AND n = 1) OR k % 20 < 2 AS failed
      FROM (SELECT *, CAST(substr(order_id, 2) AS BIGINT) AS k FROM raw_orders)
      JOIN (VALUES (1), (2)) AS t(n) ON n = 1 OR k % 20 = 9)
""")

cte("delivered_lines", """
SELECT lines.*, delivered_at, CASE WHEN o_custkey % 50 = 7 THEN 'X' ELSE 'C' END || o_custkey AS customer_id
FROM lines JOIN shipping ON l_orderkey = o_orderkey WHERE delivered_at IS NOT NULL AND o_orderkey % 20 >= 7
""")

cte("returns", f"""
SELECT 'R-' || item_hash AS return_id, 'O' || l_orderkey AS order_id, item_hash AS order_item_id, customer_id,
  'P' || l_partkey AS product_id, {pick(tb.CATEGORIES, 'l_partkey')} AS category,
  {pick(tb.REASONS, 'l_partkey')} AS return_reason, {pick(['requested', 'refunded'], 'l_linenumber')} AS return_status,
  delivered_at + to_days(l_linenumber + 3) AS initiated_at, delivered_at + to_days(l_linenumber + 8) AS received_at,
  (gross_c - disc_c) / 1e2 AS refund_amount, l_linenumber % 3 = 0 AS is_partial_refund,
  delivered_at + to_days(l_linenumber + 3) AS created_at, delivered_at + to_days(l_linenumber + 3) AS updated_at
FROM delivered_lines WHERE l_returnflag = 'R'
""")

cte("reviews", f"""
SELECT 'V-' || item_hash AS review_id, 'O' || l_orderkey AS order_id, item_hash AS order_item_id,
  'P' || l_partkey AS product_id, customer_id, 'S' || l_suppkey AS seller_id,
  CAST(1 + (l_orderkey + l_linenumber + l_partkey) % 5 AS INTEGER) AS rating,
  {pick(['Très bien', 'Muy fácil', 'Good', 'Não é bom'], 'l_partkey')} AS title, 'Opinião ' || l_orderkey AS review_text,
  l_partkey % 4 <> 0 AS is_verified_purchase, l_partkey % 9 AS helpful_votes, l_partkey % 9 + 3 AS total_votes,
  delivered_at + to_days(5) AS submitted_at, delivered_at + to_days(5) AS created_at, delivered_at + to_days(5) AS updated_at
FROM delivered_lines
""")
