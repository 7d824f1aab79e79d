"""Features from one pass over all events against each part by itself."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from stallkeeper.churn import features as ft
from stallkeeper.churn.config import SNAPSHOT_COLUMNS
from stallkeeper.operators.dims import UNKNOWN_CUSTOMER_ID

DATES = [dt.date(2001, 3, 31), dt.date(2000, 12, 31)]


def drawn_gold(spark, seed):
    """Small random tables with absent totals, keys, days, categories and ratings, repeated rows, and ineligible orders."""
    rng = random.Random(seed)
    maybe = lambda v, p=0.1: None if rng.random() < p else v
    day = lambda: dt.date(2000, 6, 1) + dt.timedelta(days=rng.randrange(400))
    at = lambda: dt.datetime.combine(day(), dt.time(rng.randrange(24)))
    people = [f"c{i}" for i in range(12)]
    orders, items, returns, shipments, reviews = [], [], [], [], []
    for i in range(90):
        customer, when = rng.choice([*people, UNKNOWN_CUSTOMER_ID]), maybe(day(), 0.03)
        status = rng.choice(["paid", "delivered", "cancelled", None, "refunded", "delivered"])
        order = maybe(f"o{i}", 0.05)
        orders.append((order, customer, status, when, maybe(rng.randrange(5000))))
        if rng.random() < 0.1:
            orders.append(orders[-1])
        for j in range(rng.randrange(4)):
            items.append((f"i{i}-{j}", order, customer, status, when, maybe(rng.choice("xyz")), maybe(rng.randrange(-1, 3)), maybe(rng.random() < 0.8),
                          maybe(rng.choice([0, 5]))))
            if rng.random() < 0.3:
                returns.append((maybe(f"r{i}-{j}"), order, maybe(at(), 0.05)))
                if rng.random() < 0.2:
                    returns.append(returns[-1])
            if rng.random() < 0.5:
                reviews.append((customer, maybe(rng.randrange(1, 6)), maybe(at(), 0.05)))
        if rng.random() < 0.8:
            shipments.append((order, rng.choice(["delivered", "in_transit"]), maybe(at()), maybe(rng.randrange(4))))
    frame = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    return SimpleNamespace(
        fact_orders=frame(orders, "order_id string, customer_id string, order_status string, order_date date, total_amount_cents bigint"),
        fact_order_items=frame(items, "order_item_id string, order_id string, customer_id string, order_status string, order_date date, "
                                      "category string, quantity int, is_gmv_valid boolean, discount_amount_cents bigint"),
        returns=frame(returns, "return_id string, order_id string, initiated_at timestamp_ntz"),
        shipments=frame(shipments, "order_id string, status string, delivered_at timestamp_ntz, delay_days bigint"),
        reviews=frame(reviews, "customer_id string, rating int, submitted_at timestamp_ntz"),
        dim_customers=frame([(c, False, dt.date(2000, 1 + i % 12, 3), "email", "regular", "EU") for i, c in enumerate(people)],
                            "customer_id string, is_unknown_customer boolean, signup_date date, signup_channel string, segment string, region string"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_one_pass_equals_its_parts(spark, seed):
    gold = drawn_gold(spark, seed)
    whole = ft.activity(ft.customer_units(gold), DATES)
    rows = {(r["customer_id"], r["snapshot_date"]): r for r in whole.collect()}
    assert len(rows) > 10
    parts = [ft.order_activity(gold.fact_orders, DATES), ft.item_features(gold.fact_order_items, DATES),
             ft.return_counts(gold.fact_orders, gold.returns, DATES), ft.review_features(gold.reviews, DATES),
             ft.delivery_features(gold.fact_orders, gold.shipments, DATES)]
    for part in parts:
        found = {(r["customer_id"], r["snapshot_date"]): r for r in part.collect()}
        assert any(k in rows for k in found)
        for key, row in rows.items():
            for c in part.columns[2:]:
                want = found[key][c] if key in found else None
                assert row[c] == want or (key not in found and not row[c]), (key, c)
    built = ft.build_snapshots(gold, DATES)
    assert tuple(built.columns) == SNAPSHOT_COLUMNS and built.where("return_item_rate > 1 OR return_count IS NULL").count() == 0


def test_returns_travel_by_number(spark):
    gold = drawn_gold(spark, 5)
    returned = ft.customer_units(gold).where("kind = 'return'")
    assert returned.where("sub IS NOT NULL").count() > 5 < gold.returns.where("return_id LIKE 'r%'").count()
    assert returned.where("NOT sub RLIKE '^[0-9]+$'").count() == 0


def test_units_serve_every_snapshot(spark, tmp_path):
    gold = drawn_gold(spark, 6)
    ft.customer_units(gold).write.parquet(f"{tmp_path}/units")
    units = spark.read.parquet(f"{tmp_path}/units")
    for dates in (DATES, DATES[-1:]):
        found, want = ft.build_snapshots(gold, dates, units=units), ft.build_snapshots(gold, dates)
        assert found.exceptAll(want).count() == want.exceptAll(found).count() == 0 < want.count()
    # only the customers are read beside them
    assert ft.scoring_snapshot(gold, DATES[-1], units)._jdf.queryExecution().executedPlan().toString().count("Scan") == 2


def test_each_source_is_read_once(spark, tmp_path):
    gold = drawn_gold(spark, 4)
    for name, frame in list(vars(gold).items()):
        frame.write.parquet(f"{tmp_path}/{name}")
        setattr(gold, name, spark.read.parquet(f"{tmp_path}/{name}"))
    plan = ft.build_snapshots(gold, DATES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == len(vars(gold)) == 6
    empty = SimpleNamespace(**{name: frame.limit(0) for name, frame in vars(gold).items()})
    assert ft.build_snapshots(empty, DATES).count() == 0
    assert ft.build_snapshots(gold, DATES).where(F.col("customer_id") == UNKNOWN_CUSTOMER_ID).count() == 0
