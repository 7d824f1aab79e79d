"""Fault injection, the silver layer over the faulty tables, and gold over the repaired ones."""

from catalogue import testbed as tb
from catalogue.goldsql import MONEY_GMV, MONEY_ITEM, MONEY_LTV, MONEY_SELLER, ORDER_MONEY, gold_ctes, show
from catalogue.registry import register
from catalogue.sqlbase import cte, hash_bucket, rnd
from stallkeeper.functions import show_money
from stallkeeper.functions.text import NULL_TOKENS, PLAIN_NUMBER
from catalogue import dirt as f
from stallkeeper.operators.dedupe import near_duplicates
from stallkeeper.plans import silver as s

COUNTS: list[str] = []
# every letter of the tables' texts that takes more than a byte
LETTERS = sorted({c for text in (*tb.FIRST_NAMES, *tb.LAST_NAMES, *tb.TITLES, tb.OPINION) for c in text if ord(c) > 127})
PLAN = f.FaultPlan()


def hit(salt: str, key: str, rate: float) -> str:
    return f"{hash_bucket(salt, key)} < {int(rate * f.HASH_RANGE)}"


def choose(options, salt: str, key: str) -> str:
    items = ", ".join("NULL" if o is None else f"'{o}'" for o in options)
    return f"list_extract([{items}], {hash_bucket(salt, key)} % {len(options)} + 1)"


def count(table: str, kind: str, column: str, source: str, where: str) -> None:
    COUNTS.append(f"SELECT '{table}' AS \"table\", '{kind}' AS chaos_type, '{column}' AS column_affected, "
                  f"count(*) AS changes FROM {source} WHERE {where} HAVING count(*) > 0")


class Chain:
    """One table's faults as a row of CTEs."""

    def __init__(self, table: str, source: str):
        self.table, self.at, self.n = table, source, 0

    def add(self, body: str) -> None:
        self.n += 1
        name = f"{self.table}_step{self.n}"
        cte(name, body)
        self.at = name

    def replace(self, kind: str, changes: dict[str, tuple[str, str]], pre: dict[str, str] | None = None) -> None:
        for column, (where, _) in changes.items():
            count(self.table, kind, column, self.at, where)
        cells = ", ".join(
            f"CASE WHEN {w} THEN {v} ELSE {(pre or {}).get(c, c)} END AS {c}" for c, (w, v) in changes.items()
        )
        self.add(f"SELECT * REPLACE ({cells}) FROM {self.at}")

    def duplicates(self, rate: float, key: str, stamps: list[str], salt: str, drift: int = 5) -> "Chain":
        where = hit(salt, key, rate)
        count(self.table, "duplicate", key, self.at, where)
        moved = ", ".join(
            f"{c} + to_seconds(CAST({hash_bucket(f'{salt}-{c}', key)} % {drift} + 1 AS INTEGER)) AS {c}" for c in stamps
        )
        self.add(f"""SELECT * FROM {self.at} UNION ALL
          SELECT * REPLACE (md5('{salt}|' || {key}) AS {key}, {moved}) FROM {self.at} WHERE {where}""")
        return self

    def nulls(self, rate: float, key: str, columns: list[str], salt: str) -> "Chain":
        self.replace("null_representation", {
            c: (hit(f"{salt}-{c}", key, rate), choose(NULL_TOKENS, f"{salt}-{c}-token", key)) for c in columns
        })
        return self

    def encoding(self, rate: float, key: str, columns: list[str], salt: str) -> "Chain":
        def broken(c: str) -> str:
            for letter in LETTERS:
                c = f"replace({c}, '{letter}', '{letter.encode('utf-8').decode('latin-1')}')"
            return c
        self.replace("encoding", {
            c: (f"{hit(f'{salt}-{c}', key, rate)} AND {broken(c)} <> {c}", broken(c)) for c in columns
        })
        return self

    def drift(self, rate: float, key: str, columns: list[str], salt: str) -> "Chain":
        changes, texts = {}, {}
        for c in columns:
            text = f"coalesce(CAST({c} AS VARCHAR), 'None')"
            kind = f"{hash_bucket(f'{salt}-{c}-kind', key)} % 4"
            prefix = choose(f.CURRENCY_PREFIXES, f"{salt}-{c}-prefix", key)
            changes[c] = (hit(f"{salt}-{c}", key, rate), f"""CASE {kind} WHEN 0 THEN {prefix} || {text}
              WHEN 1 THEN replace({text}, '.', ',') WHEN 2 THEN '  ' || {text} || '  '
              ELSE CASE WHEN {c} > 1000 THEN format('{{:,.2f}}', {c}) ELSE {text} END END""")
            texts[c] = text
        self.replace("type_drift", changes, texts)
        return self

    def late(self, rate: float, key: str, column: str, salt: str) -> "Chain":
        where = hit(salt, key, rate)
        count(self.table, "late_arrival", column, self.at, where)
        days = f"{hash_bucket(f'{salt}-days', key)} % 84 + 7"
        self.add(f"SELECT *, CAST(CASE WHEN {where} THEN {days} ELSE 0 END AS INTEGER) AS _ingestion_delay_days FROM {self.at}")
        return self

    def orphans(self, rate: float, key: str, fk: str, salt: str) -> "Chain":
        self.replace("orphan_record", {
            fk: (hit(salt, key, rate), f"'ORPHAN-' || substr(md5('{salt}|' || {key}), 1, 12)")})
        return self


chain = Chain("customers", "customers")
chain.duplicates(0.03, "customer_id", ["created_at", "updated_at"], "c-dup")
chain.nulls(0.08, "customer_id", ["email", "first_name", "last_name", "signup_channel"], "c-null")
chain.encoding(0.04, "customer_id", ["first_name", "last_name", "email"], "c-enc")
people = ", ".join(
    f"{choose(f.ZOMBIE_EMAILS if c == 'email' else f.ZOMBIE_NAMES, f'c-zom-{c}', 'customer_id')} AS {c}"
    for c in ("email", "first_name", "last_name")
)
chain.add(f"""SELECT * FROM {chain.at} UNION ALL (
  SELECT * REPLACE ('TEST-' || substr(md5('c-zom|' || customer_id), 1, 8) AS customer_id, {people})
  FROM {chain.at} ORDER BY md5('c-zom|' || {chain.at}.customer_id), {chain.at}.customer_id LIMIT {PLAN.zombies})""")
COUNTS.append(f"SELECT 'customers', 'zombie_test_data', 'multiple', {PLAN.zombies}")


def added(column: str, value: str) -> str:
    era, fill = hit("c-evo-era", "customer_id", 0.4), hit(f"c-evo-{column}", "customer_id", 0.3)
    return f"CASE WHEN NOT ({era}) AND {fill} THEN {value} END AS {column}"


chain.add(f"""SELECT * EXCLUDE (customer_external_id), customer_external_id AS cust_ext_id,
  {added('promo_code', choose(f.PROMO_CODES, 'c-evo-promo_code-value', 'customer_id'))},
  {added('loyalty_points', f"CAST({hash_bucket('c-evo-loyalty_points-value', 'customer_id')} % 5001 AS VARCHAR)")},
  {added('referral_source', f"'ref_' || ({hash_bucket('c-evo-referral_source-value', 'customer_id')} % 9000 + 1000)")}
FROM {chain.at}""")
COUNTS.extend(f"SELECT 'customers', 'schema_evolution', '{c}', 1" for c in (*PLAN.added, *PLAN.renamed))
cte("dirty_customers", f"SELECT * FROM {chain.at}")

chain = Chain("orders", "raw_orders")
chain.duplicates(0.03, "order_id", ["order_placed_at", "created_at", "updated_at"], "o-dup")
chain.nulls(0.08, "order_id", ["order_number", "currency"], "o-null")
chain.replace("business_logic_violation", {
    "shipping_cost": (hit("o-vio-shipping_cost", "order_id", 0.01),
                      f"-(({hash_bucket('o-vio-shipping_cost-size', 'order_id')} % 2000 + 1) / 1e2)"),
    "discount_amount": (hit("o-vio-discount_amount", "order_id", 0.01), rnd(
        f"(subtotal * (1.5e0 + ({hash_bucket('o-vio-discount_amount-size', 'order_id')} % 1501) / 1e3))")),
})
chain.drift(0.05, "order_id", ["total_amount", "subtotal", "discount_amount", "shipping_cost"], "o-drift")
chain.late(0.02, "order_id", "order_placed_at", "o-late")
cte("dirty_orders", f"SELECT * FROM {chain.at}")

chain = Chain("order_items", "order_items")
chain.orphans(0.01, "order_item_id", "order_id", "i-orph")
chain.replace("business_logic_violation", {
    "quantity": (hit("i-vio-quantity", "order_item_id", 0.02),
                 f"CAST(-({hash_bucket('i-vio-quantity-size', 'order_item_id')} % 5 + 1) AS INTEGER)")})
chain.drift(0.05, "order_item_id", ["unit_price", "unit_cost", "line_total"], "i-drift")
cte("dirty_order_items", f"SELECT * FROM {chain.at}")

chain = Chain("payments", "payments")
chain.duplicates(0.06, "payment_id", ["attempted_at", "created_at"], "p-dup", 3)
chain.nulls(0.08, "payment_id", ["card_brand", "failure_reason"], "p-null")
chain.orphans(0.01, "payment_id", "order_id", "p-orph")
cte("dirty_payments", f"SELECT * FROM {chain.at}")

chain = Chain("shipments", "shipments")
chain.duplicates(0.03, "shipment_id", ["shipped_at", "created_at"], "s-dup")
chain.nulls(0.08, "shipment_id", ["tracking_number", "carrier"], "s-null")
cte("dirty_shipments", f"SELECT * FROM {chain.at}")

chain = Chain("reviews", "reviews")
chain.encoding(0.04, "review_id", ["title", "review_text"], "r-enc")
chain.orphans(0.01, "review_id", "product_id", "r-orph")
cte("dirty_reviews", f"SELECT * FROM {chain.at}")

TOKENS = ", ".join(f"'{t}'" for t in NULL_TOKENS)


def no_token(c: str) -> str:
    return f"CASE WHEN {c} NOT IN ({TOKENS}) THEN {c} END AS {c}"


def number(c: str) -> str:
    bare = f"replace(replace(replace(replace(trim({c}), '$', ''), '€', ''), 'R$', ''), 'USD ', '')"
    text = f"trim(replace({bare}, ',', CASE WHEN contains({c}, '.') THEN '' ELSE '.' END))"
    return f"CASE WHEN regexp_matches({text}, '{PLAIN_NUMBER}') THEN TRY_CAST({text} AS DOUBLE) END AS {c}"


cte("silver_customers", f"""
SELECT {', '.join(s.CUSTOMER_COLUMNS)} FROM (
  SELECT * EXCLUDE (cust_ext_id) REPLACE ({', '.join(no_token(c) for c in ('email', 'first_name', 'last_name', 'signup_channel'))}),
    cust_ext_id AS customer_external_id
  FROM dirty_customers WHERE customer_id NOT LIKE 'TEST-%' AND email NOT LIKE '%@localhost%'
    AND email NOT LIKE '%test@test%' AND email NOT LIKE '%asdf@asdf%')
QUALIFY row_number() OVER (PARTITION BY customer_external_id ORDER BY updated_at, customer_id) = 1
""")
cte("silver_orders", f"""
SELECT {', '.join(s.ORDER_COLUMNS)} FROM (
  SELECT *, coalesce(shipping_cost < 0, FALSE) AS _has_negative_shipping,
    coalesce(discount_amount > subtotal, FALSE) AS _has_impossible_discount
  FROM (SELECT * REPLACE ({no_token('order_number')}, {no_token('currency')}, {number('subtotal')},
      {number('discount_amount')}, {number('shipping_cost')}, {number('total_amount')}),
      coalesce(_ingestion_delay_days, 0) AS ingestion_delay_days,
      coalesce(_ingestion_delay_days > 0, FALSE) AS is_late_arrival FROM dirty_orders))
WHERE order_number IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY order_number ORDER BY updated_at DESC, order_id DESC) = 1
""")
cte("silver_order_items", f"""
SELECT {', '.join(s.ITEM_COLUMNS)} FROM (
  SELECT * REPLACE (CASE WHEN quantity >= 0 THEN quantity END AS quantity, {number('unit_price')}, {number('unit_cost')},
    {number('line_total')}), coalesce(quantity < 0, FALSE) AS _had_negative_quantity
  FROM dirty_order_items WHERE order_id NOT LIKE 'ORPHAN-%')
""")
cte("silver_payments", f"""
SELECT {', '.join(s.PAYMENT_COLUMNS)}
FROM (SELECT * REPLACE ({no_token('card_brand')}, {no_token('failure_reason')}) FROM dirty_payments
  WHERE order_id NOT LIKE 'ORPHAN-%')
QUALIFY row_number() OVER (PARTITION BY payment_id ORDER BY updated_at DESC, processor_transaction_id DESC) = 1
""")
cte("silver_shipments", f"""
SELECT {', '.join(s.SHIPMENT_COLUMNS)}
FROM (SELECT * REPLACE ({no_token('carrier')}, {no_token('tracking_number')}) FROM dirty_shipments)
QUALIFY row_number() OVER (PARTITION BY shipment_id ORDER BY updated_at DESC, order_id DESC) = 1
""")
cte("silver_reviews", "SELECT * FROM dirty_reviews WHERE product_id NOT LIKE 'ORPHAN-%'")
gold_ctes("fixed_", "silver_customers", "sellers", "products", "silver_orders", "silver_order_items")

DIRTY = ("customers", "orders", "order_items", "payments", "shipments", "reviews")
for table in DIRTY:
    register(f"dirty_{table}", lambda m, t=table: m.faulty[t][0], f"SELECT * FROM dirty_{table}")
    register(f"silver_{table}", lambda m, t=table: m.silver[t], f"SELECT * FROM silver_{table}")
for table in ("sellers", "products", "returns"):
    register(f"silver_{table}", lambda m, t=table: m.silver[t], f"SELECT * FROM {table}")
register(
    "fault_manifest_counts",
    lambda m: f.manifest(m.faulty).groupBy("table", "chaos_type", "column_affected").count()
    .withColumnRenamed("count", "changes"),
    " UNION ALL ".join(COUNTS),
)
register("fault_manifest", lambda m: f.manifest(m.faulty))
register(
    "fact_orders_repaired", lambda m: show_money(m.repaired.fact_orders), show("fixed_fact_orders", ORDER_MONEY)
)
register(
    "fact_order_items_repaired",
    lambda m: show_money(m.repaired.fact_order_items).drop("customer_id"),
    show("fixed_fact_order_items", MONEY_ITEM, ("customer_id",)),
)
register(
    "mart_gmv_daily_repaired", lambda m: show_money(m.repaired.mart_gmv_daily), show("fixed_mart_gmv_daily", MONEY_GMV)
)
register(
    "mart_customer_ltv_repaired",
    lambda m: show_money(m.repaired.mart_customer_ltv),
    show("fixed_mart_customer_ltv", MONEY_LTV),
)
register(
    "mart_seller_health_repaired",
    lambda m: show_money(m.repaired.mart_seller_health),
    show("fixed_mart_seller_health", MONEY_SELLER),
)
register(
    "near_duplicate_payments",
    lambda m: near_duplicates(m.faulty["payments"][0], "payment_id", ["order_id", "amount"], "attempted_at", 5),
    """
SELECT * FROM dirty_payments p WHERE EXISTS (SELECT 1 FROM dirty_payments q WHERE q.order_id = p.order_id
  AND q.amount = p.amount AND (q.attempted_at, q.payment_id) < (p.attempted_at, p.payment_id)
  AND p.attempted_at - q.attempted_at <= INTERVAL 5 SECOND)
""",
)

CELLS = {
    "orders": ("order_id", ["order_number", "currency", "subtotal", "discount_amount", "shipping_cost", "total_amount"]),
    "customers": ("customer_id", ["email", "first_name", "last_name", "signup_channel"]),
}


def recall(m, table: str):
    key, columns = CELLS[table]
    return f.cleaning_recall(m.silver[table], m.faulty[table][1], key, columns)


register("cleaning_recall_orders", lambda m: recall(m, "orders"))
register("cleaning_recall_customers", lambda m: recall(m, "customers"))
