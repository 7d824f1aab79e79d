"""Registered queries against their SQL on the smallest driver data, and branch coverage."""

import pytest

import __spark_entry__ as entry
import check

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "mart_gmv_daily", "mart_customer_ltv", "mart_seller_health", "fact_order_items_repaired", "silver_customers",
    "silver_orders", "fault_manifest_counts", "monthly_gmv_growth", "seller_concentration", "kpi_row", "channel_quality",
    "orders_in_window", "first_purchase_category", "repeat_within_90d", "reconcile_market_repaired", "checks_silver",
    "churn_snapshots", "evaluate", "churn_scores", "near_duplicate_payments", "category_trend_one", "return_rate_overall",
]


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    ok, note, n = check.compare(spark, con, name, FOLDER)
    assert ok, note
    assert n > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "net_gmv" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 200


def test_branches_are_hit(spark):
    q = entry.queries()
    status = {r["activity_status"] for r in q["activity_distribution"](spark, FOLDER).collect()}
    assert status == {"active", "at_risk", "dormant", "churned", "never_ordered"}
    health = {r["health_status"] for r in q["health_by_tier"](spark, FOLDER).collect()}
    assert health == {"active", "at_risk", "churned", "no_sales"}
    totals = q["gmv_totals"](spark, FOLDER).first()
    assert round(totals["gross_gmv"] - totals["total_discounts"], 2) == totals["net_gmv"]
    assert all(r["passed"] for r in q["reconcile_market"](spark, FOLDER).collect())
    checks = {r["check_name"]: r["status"] for r in q["checks_silver"](spark, FOLDER).collect()}
    assert "error" not in checks.values() and "warn" in checks.values()


def test_cleaning_restores_what_it_can(spark):
    rows = {
        (r["chaos_type"], r["column_affected"]): r
        for r in entry.queries()["cleaning_recall_orders"](spark, FOLDER).collect()
    }
    nulls = rows["null_representation", "currency"]
    assert nulls["kept"] == nulls["restored"] > 0
    drift = rows["type_drift", "total_amount"]
    assert drift["restored"] > 0.8 * drift["kept"]
