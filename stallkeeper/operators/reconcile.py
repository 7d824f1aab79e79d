"""Cross-model reconciliation: totals that must agree within a cent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import count_if, dollars
from stallkeeper.operators.facts import ORDER_MONEY, eligible
from stallkeeper.plans.governed import cross_combine

Spec = tuple[str, Column, Column, int]


def reconcile(totals: DataFrame, specs: Sequence[Spec]) -> DataFrame:
    """One line per spec (label, left, right, tolerance) from a one-row frame of totals."""
    lines = F.array(*[
        F.struct(
            F.lit(label).alias("label"),
            left.cast("bigint").alias("left_value"),
            right.cast("bigint").alias("right_value"),
            F.abs(left - right).cast("bigint").alias("difference"),
            F.coalesce(F.abs(left - right) <= tolerance, F.lit(False)).alias("passed"),
        )
        for label, left, right, tolerance in specs
    ])
    return totals.select(F.inline(lines))


def market_totals(gold) -> DataFrame:
    """Every total the reconciliation needs, in cents, as one row."""
    unknown, spend = F.col("is_unknown_customer"), F.col("lifetime_customer_spend_cents")
    known = gold.dim_customers.select(F.col("customer_id").alias("_id"))
    eligible_orders = eligible(gold.fact_orders)
    return cross_combine(
        gold.mart_gmv_daily.agg(
            F.sum("gross_gmv_cents").alias("gross"),
            F.sum("net_gmv_cents").alias("net"),
            F.sum("total_discounts_cents").alias("discounts"),
            F.sum("invalid_gmv_item_count").alias("mart_invalid_items"),
        ),
        eligible(gold.fact_order_items).agg(count_if(~F.col("is_gmv_valid")).alias("fact_invalid_items")),
        gold.mart_seller_health.agg(
            F.sum("gross_gmv_cents").alias("seller_gross"), F.sum("net_gmv_cents").alias("seller_net")
        ),
        eligible_orders.agg(
            F.sum("total_amount_cents").alias("charged"),
            count_if(F.col("total_amount_cents").isNull()).alias("null_totals"),
            count_if(unknown).alias("unknown_orders"),
            F.coalesce(F.sum(F.when(unknown, F.col("total_amount_cents"))), F.lit(0)).alias("unknown_spend"),
        ),
        gold.mart_customer_ltv.agg(
            F.sum(F.when(~unknown, spend).otherwise(0)).alias("real_spend"),
            F.sum(F.when(unknown, spend).otherwise(0)).alias("orphan_spend"),
            F.sum(spend).alias("platform_spend"),
            F.sum("invalid_financial_orders").alias("invalid_orders"),
        ),
        eligible_orders.join(known, F.col("customer_id") == F.col("_id"), "left_anti").agg(
            F.count("*").alias("unmatched_orders")
        ),
    )


def reconcile_market(gold) -> DataFrame:
    c = F.col
    return reconcile(
        market_totals(gold),
        [
            ("gross minus discounts is net", c("gross") - c("discounts"), c("net"), 1),
            ("invalid items: fact and mart", c("fact_invalid_items"), c("mart_invalid_items"), 0),
            ("gross: marketplace and sellers", c("gross"), c("seller_gross"), 1),
            ("net: marketplace and sellers", c("net"), c("seller_net"), 1),
            ("charged amount and lifetime spend", c("charged"), c("platform_spend"), 1),
            ("real plus orphan is platform spend", c("real_spend") + c("orphan_spend"), c("platform_spend"), 1),
            ("orders without total: fact and mart", c("null_totals"), c("invalid_orders"), 0),
            ("orders without a customer row", c("unmatched_orders"), F.lit(0), 0),
            ("unknown-member spend and orphan spend", c("unknown_spend"), c("orphan_spend"), 1),
        ],
    )


def spend_gap(gold) -> DataFrame:
    t = market_totals(gold)
    return t.select(
        dollars("real_spend").alias("real_customer_spend"),
        dollars("orphan_spend").alias("orphan_reconciliation_spend"),
        dollars("platform_spend").alias("platform_customer_spend"),
        dollars("charged").alias("fact_order_customer_spend"),
        dollars(F.col("charged") - F.col("platform_spend")).alias("reconciliation_gap"),
        F.col("null_totals").alias("null_total_amount_orders"),
        F.col("invalid_orders").alias("invalid_financial_orders"),
        F.col("unknown_orders").alias("orders_mapped_to_unknown"),
    )


def _components() -> tuple[Column, Column]:
    """Amount rebuilt from its parts, and whether every part is known."""
    part = {m: F.col(f"{m}_cents") for m in ORDER_MONEY}
    rebuilt = part["subtotal"] - part["discount_amount"] + part["tax_amount"] + part["shipping_cost"]
    return rebuilt, rebuilt.isNotNull() & part["total_amount"].isNotNull()


def component_quality(fact_orders: DataFrame) -> DataFrame:
    rebuilt, complete = _components()
    total = F.col("total_amount_cents")
    actual, again = F.sum(F.when(complete, total)), F.sum(F.when(complete, rebuilt))
    return eligible(fact_orders).agg(
        F.count("*").alias("eligible_orders"),
        count_if(~complete).alias("orders_with_missing_components"),
        count_if(complete & (F.abs(total - rebuilt) > 1)).alias("complete_orders_with_mismatch"),
        dollars(actual).alias("complete_order_actual_total"),
        dollars(again).alias("complete_order_reconstructed_total"),
        dollars(actual - again).alias("reconstruction_gap"),
    )


def component_mismatch_top(fact_orders: DataFrame, k: int = 5) -> DataFrame:
    rebuilt, complete = _components()
    gap = F.col("total_amount_cents") - rebuilt
    wrong = eligible(fact_orders).where(complete & (F.abs(gap) > 1)).withColumn("_gap", gap)
    return wrong.orderBy(F.abs("_gap").desc(), F.asc("order_id")).limit(k).select(
        "order_id",
        dollars("subtotal_cents").alias("subtotal"),
        dollars("discount_amount_cents").alias("discount"),
        dollars("tax_amount_cents").alias("tax"),
        dollars("shipping_cost_cents").alias("shipping"),
        dollars("total_amount_cents").alias("total_amount"),
        dollars("_gap").alias("difference"),
    )


def line_total_diagnostic(fact_items: DataFrame) -> DataFrame:
    """Tax-inclusive line totals beside what they should be; not a merchandise metric."""
    valid = F.col("is_gmv_valid")
    return eligible(fact_items).agg(
        dollars(F.sum(F.when(valid, F.col("line_total_cents")))).alias("line_total"),
        dollars(F.sum("expected_line_total_cents")).alias("expected_line_total"),
        count_if(F.abs(F.col("line_total_cents") - F.col("expected_line_total_cents")) > 1).alias("mismatched_items"),
    )
