"""Validation and summaries of feature frames and scores."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.churn.config import (
    BINARY_FEATURES,
    CHANNEL_FEATURES,
    FORBIDDEN_FEATURES,
    ID,
    LABEL,
    NUMERIC_FEATURES,
    SNAPSHOT,
)
from stallkeeper.functions import pct, rnd
from stallkeeper.operators.dedupe import duplicate_keys
from stallkeeper.operators.ranking import exact_quantile
from stallkeeper.plans.governed import cross_combine
from stallkeeper.plans.suite import RISK_SEGMENTS
from stallkeeper.session import cut_lineage, free_shuffles

RATES = ("return_order_rate", "return_item_rate", "discount_order_rate")


def _report(counts: DataFrame, rules: Sequence[str]) -> DataFrame:
    lines = F.array(*[
        F.struct(
            F.lit(r).alias("rule"), F.coalesce(F.col(r), F.lit(0)).alias("violations"),
            (F.coalesce(F.col(r), F.lit(0)) == 0).alias("passed"),
        )
        for r in rules
    ])
    return counts.select(F.inline(lines))


def _count_rules(df: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    row_counts = df.agg(
        (F.count("*") == 0).cast("bigint").alias("empty"), *[F.count_if(c).alias(n) for n, c in rules.items()]
    )
    if not keys:
        return _report(row_counts.withColumn("duplicate_key", F.lit(0).cast("bigint")), ["empty", "duplicate_key", *rules])
    repeated = duplicate_keys(df, keys).agg(F.sum(F.col("occurrences") - 1).alias("duplicate_key"))
    return _report(cross_combine(row_counts, repeated), ["empty", "duplicate_key", *rules])


def validate_snapshot(df: DataFrame, expected: dt.date, min_orders: int = 1) -> DataFrame:
    """Violations per rule of one snapshot."""
    rules = {
        "null_customer_id": F.col(ID).isNull(),
        "unexpected_snapshot_date": ~F.col(SNAPSHOT).eqNullSafe(F.lit(expected)),
        "invalid_label": ~F.coalesce(F.col(LABEL).isin(0, 1), F.lit(False)),
        "negative_tenure": F.col("customer_tenure_days") < 0,
        "negative_recency": F.col("days_since_last_order") < 0,
        "below_minimum_orders": F.col("total_orders") < min_orders,
        **{f"{r}_out_of_range": ~F.coalesce(F.col(r).between(0, 1), F.lit(False)) for r in RATES},
        "wrong_single_order_flag": F.col("is_single_order_customer") != (F.col("total_orders") == 1).cast("bigint"),
        "missing_order_interval": (F.col("total_orders") > 1) & F.col("avg_days_between_orders").isNull(),
    }
    return _count_rules(df, [ID, SNAPSHOT], rules)


def validate_scores(df: DataFrame) -> DataFrame:
    p = F.col("churn_probability")
    rules = {
        "null_customer_id": F.col(ID).isNull(),
        "null_probability": p.isNull() | F.isnan(p),
        "invalid_predicted_flag": ~F.coalesce(F.col("predicted_churn_flag").isin(0, 1), F.lit(False)),
        "invalid_missing_spend_flag": ~F.coalesce(F.col("lifetime_spend_missing_flag").isin(0, 1), F.lit(False)),
        "probability_out_of_range": ~F.coalesce(p.between(0, 1), F.lit(False)),
        "unexpected_risk_segment": ~F.coalesce(F.col("risk_segment").isin(*RISK_SEGMENTS), F.lit(False)),
        "decile_out_of_range": ~F.coalesce(F.col("risk_decile").between(1, 10), F.lit(False)),
    }
    return _count_rules(df, [ID], rules)


def validate_split(df: DataFrame, features: Sequence[str] | None = None) -> DataFrame:
    """Contract of a modelling split: columns, labels, keys, and no column that knows the future."""
    used = list(features or (*NUMERIC_FEATURES, *BINARY_FEATURES, *CHANNEL_FEATURES))
    required = {ID, SNAPSHOT, LABEL, *used}
    static = {
        "missing_column": len(required - set(df.columns)),
        "forbidden_feature": len(set(used) & set(FORBIDDEN_FEATURES)),
    }
    # a missing label or key column is reported as such, and what needs it counts nothing
    bad_label = ~F.coalesce(F.col(LABEL).isin(0, 1), F.lit(False)) if LABEL in df.columns else F.lit(False)
    keys = [ID, SNAPSHOT] if {ID, SNAPSHOT} <= set(df.columns) else []
    checked = _count_rules(df, keys, {"invalid_label": bad_label})
    lines = F.array(*[
        F.struct(F.lit(n).alias("rule"), F.lit(v).cast("bigint").alias("violations"), F.lit(v == 0).alias("passed"))
        for n, v in static.items()
    ])
    return checked.unionByName(df.sparkSession.range(1).select(F.inline(lines)))


def require(report: DataFrame, what: str) -> None:
    """Raise when a validation report (a handful of rows) lists a violation."""
    failed = [f"{r['rule']}={r['violations']}" for r in report.where("not passed").collect()]
    if failed:
        raise ValueError(f"{what}: {', '.join(failed)}")


def check_label_window(fact_orders: DataFrame, snapshots: Sequence[dt.date], days: int = 90) -> DataFrame:
    """Whether the data reach the end of the latest snapshot's prediction window."""
    needed = max(snapshots) + dt.timedelta(days=days)
    latest = F.max("order_date")
    return fact_orders.agg(
        latest.alias("latest_order_date"), F.lit(needed).alias("required_date"),
        F.coalesce(latest >= F.lit(needed), F.lit(False)).alias("covered"),
    )


def churn_by(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("customers"), pct(F.sum(LABEL), F.count("*")).alias("churn_rate"))


def snapshot_overview(df: DataFrame) -> DataFrame:
    """Rows, customers and churn, also for customers with one and with several orders."""
    single = F.col("is_single_order_customer") == 1
    per_customer = df.groupBy(ID).agg(
        F.count("*").alias("rows"), F.sum(LABEL).alias("churned"), F.count_if(single).alias("single"),
        F.count_if(single & (F.col(LABEL) == 1)).alias("single_churned"),
    )
    totals = per_customer.agg(
        F.sum("rows").alias("rows"), F.count(ID).alias("unique_customers"), F.sum("churned").alias("c"),
        F.sum("single").alias("single_order_rows"), F.sum("single_churned").alias("sc"),
    )
    multi = F.col("rows") - F.col("single_order_rows")
    return totals.select(
        "rows", "unique_customers", pct("c", "rows").alias("churn_rate"), "single_order_rows",
        pct("single_order_rows", "rows").alias("single_order_pct"), pct("sc", "single_order_rows").alias("single_order_churn"),
        multi.alias("multi_order_rows"), pct(F.col("c") - F.col("sc"), multi).alias("multi_order_churn"),
    )


def feature_distribution(df: DataFrame, features: Sequence[str] = NUMERIC_FEATURES) -> DataFrame:
    """Mean, median, extremes and missing values of every feature.

    The features are read twice, for the sums and for the medians, so they are stored first: what makes them runs once.
    """
    df = cut_lineage(df.select(*features))
    free_shuffles(df.sparkSession)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features])
    long = df.select(F.inline(cells))
    stats = long.groupBy("feature").agg(
        rnd(F.avg("value")).alias("mean"), rnd(F.min("value")).alias("min"), rnd(F.max("value")).alias("max"),
        F.count_if(F.col("value").isNull()).alias("nulls"),
    )
    middle = exact_quantile(long, "value", 0.5, ["feature"], "m").select("feature", rnd("m").alias("median"))
    return stats.join(middle, "feature", "left")


def snapshot_metadata(df: DataFrame) -> DataFrame:
    """Rows, customers and churn rate per split."""
    per_customer = df.groupBy("split", ID).agg(F.count("*").alias("rows"), F.sum(LABEL).alias("churned"))
    return per_customer.groupBy("split").agg(
        F.sum("rows").alias("rows"), F.count(ID).alias("unique_customers"),
        rnd(F.sum("churned") / F.sum("rows"), 6).alias("churn_rate"),
    )
