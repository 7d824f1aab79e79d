"""Scalar rules on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stallkeeper.functions import (
    blank_to_col, cents, clean_numeric, div_half_up, ladder, normalize_risk_label, null_token_col, pct, recency_band, rnd,
)
from stallkeeper.operators import dims, facts
from stallkeeper.operators.marts import ACTIVITY


def values(spark, kind, data, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(data)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_clean_numeric(spark):
    cases = {
        "$12.5": 12.5, "€12.5": 12.5, "R$12.5": None, "USD 12.5": 12.5, "  7  ": 7.0, "12,5": 12.5,
        "1,234.50": 1234.5, "1,234": 1.234, "None": None, "nan": None, "12.5d": None, "1_000": None, "": None,
        "-3.25": -3.25, "1e3": 1000.0,
    }
    assert values(spark, "string", list(cases), clean_numeric) == list(cases.values())
    assert values(spark, "string", ["R$12.5", "$3"], lambda c: clean_numeric(c, True)) == [12.5, 3.0]
    assert values(spark, "string", [None], clean_numeric) == [None]


def test_null_tokens(spark):
    tokens = ["N/A", "", "NULL", "null", "None", "-", "n/a", "NA", " ", "  "]
    assert values(spark, "string", tokens + [None], null_token_col) == [None] * 11
    assert values(spark, "string", ["n/a ", "none", "x"], null_token_col) == ["n/a ", "none", "x"]


def test_rounding_uses_the_binary_value(spark):
    assert values(spark, "double", [1.005, 2.675, 0.125, -0.125, -0.001], rnd) == [1.0, 2.68, 0.13, -0.13, 0.0]
    assert values(spark, "double", [12.34, -0.5, None], cents) == [1234, -50, None]
    assert values(spark, "bigint", [5, 14999, 15000], lambda c: div_half_up(c, 10000)) == [0, 1, 2]


def test_pct_of_zero_is_null(spark):
    assert values(spark, "bigint", [0, 3], lambda c: pct(F.lit(1), c)) == [None, 33.3]


@pytest.mark.parametrize(("days", "label"), [
    (30, "active"), (31, "at_risk"), (90, "at_risk"), (91, "dormant"), (180, "dormant"), (181, "churned"),
    (None, "never_ordered"),
])
def test_recency_bands(spark, days, label):
    assert values(spark, "bigint", [days], lambda c: recency_band(c, *ACTIVITY)) == [label]


def test_ladder_needs_matching_labels():
    with pytest.raises(ValueError):
        ladder(None, (1, 2), ("a", "b"))


def test_labels(spark):
    assert values(spark, "string", [" High_Risk", "low risk", "other"], normalize_risk_label) == ["high", "low", "other"]
    assert values(spark, "string", ["  ", None, "x"], blank_to_col) == ["missing", "missing", "x"]


def test_gmv_and_margin_rules(spark):
    data = [
        # quantity, price, cost, discount -> gmv valid, margin valid
        (0, 10.0, 1.0, 0.0, False, False), (-1, 10.0, 1.0, 0.0, False, False), (None, 10.0, 1.0, 0.0, False, False),
        (2, None, 1.0, 0.0, False, False), (2, 0.0, 1.0, 0.0, True, True), (2, 10.0, 1.0, 20.0, True, True),
        (2, 10.0, 1.0, 20.01, False, False), (2, 10.0, None, 0.0, True, False), (2, 10.0, -1.0, 0.0, True, False),
        (2, 10.0, 1.0, None, False, False), (2, 10.0, 1.0, -0.01, False, False), (2, -1.0, 1.0, 0.0, False, False),
    ]
    df = spark.createDataFrame(
        [(str(i), *d[:4], 0.5, 0.0) for i, d in enumerate(data)],
        "order_item_id string, quantity int, unit_price double, unit_cost double, discount_amount double, "
        "tax_amount double, line_total double",
    )
    out = {r["order_item_id"]: r for r in facts.item_money(df).collect()}
    for i, d in enumerate(data):
        assert (out[str(i)]["is_gmv_valid"], out[str(i)]["is_margin_valid"]) == d[4:], d
    assert out["5"]["net_gmv_cents"] == 0 and out["5"]["expected_line_total_cents"] == 50
    assert out["6"]["net_gmv_cents"] is None and out["7"]["merchandise_cost_cents"] is None


def test_date_dimension(spark):
    d = dims.dim_dates(spark)
    assert d.count() == 1826
    first = d.where(F.col("date_day") == dt.date(2023, 1, 1)).first()
    assert (first["week_of_year"], first["day_of_week"], first["is_weekend"]) == (52, 0, True)
    assert (first["fiscal_year"], first["season_label"], first["year_quarter"]) == (2022, "post_holiday", "2023-Q1")


def test_unknown_customer_member(spark):
    orders = spark.createDataFrame(
        [("o1", "C1"), ("o2", "nobody"), ("o3", None)], "order_id string, customer_id string"
    )
    extra = {c: F.lit(None).cast("string") for c in (
        "order_number", "region", "order_status", "order_channel", "device_type", "currency", "item_count",
        "is_first_order", "ingestion_delay_days", "is_late_arrival", "_has_negative_shipping", "_has_impossible_discount",
    )}
    money = {c: F.lit(1.0) for c in facts.ORDER_MONEY}
    stamps = {c: F.lit(dt.datetime(2001, 1, 1)) for c in ("order_placed_at", "created_at", "updated_at")}
    people = spark.createDataFrame(
        [("C1", False, "whale", "2001-01", "US"), (dims.UNKNOWN_CUSTOMER_ID, True, "unknown", "unknown", "UNK")],
        "customer_id string, is_unknown_customer boolean, segment string, signup_cohort string, country_code string",
    )
    out = {r["order_id"]: r for r in facts.fact_orders(orders.withColumns({**extra, **money, **stamps}), people).collect()}
    assert out["o1"]["customer_id"] == "C1" and not out["o1"]["is_unknown_customer"]
    for o in ("o2", "o3"):
        assert out[o]["customer_id"] == dims.UNKNOWN_CUSTOMER_ID and out[o]["customer_segment"] == "unknown"
    assert out["o2"]["source_customer_id"] == "nobody"
