"""Views over the churn score table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.functions import cents, count_if, dollars, mean_dollars, normalize_risk_label, pct, rnd
from stallkeeper.operators.shares import share_of_total

RISK_ORDER = ("high", "medium", "low")


def micro(c: str) -> Column:
    """Probabilities in millionths, so that means do not depend on row order."""
    return F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5)).cast("bigint")


def mean_probability(digits: int) -> Column:
    return rnd(F.sum(micro("churn_probability")) / F.count("churn_probability") / F.lit(1e6), digits)


def with_labels(scores: DataFrame) -> DataFrame:
    return scores.withColumn("risk_segment", normalize_risk_label(F.col("risk_segment")))


def filter_scores(
    scores: DataFrame, risk: Sequence[str] = (), region: Sequence[str] = (), channel: Sequence[str] = (),
    action: Sequence[str] = (),
) -> DataFrame:
    """Keep the chosen values; an empty choice keeps everything."""
    chosen = {"risk_segment": risk, "region": region, "signup_channel": channel, "recommended_action": action}
    for column, values in chosen.items():
        if values:
            scores = scores.where(F.col(column).isin(*values))
    return scores


def churn_kpis(scores: DataFrame) -> DataFrame:
    high = F.col("risk_segment") == "high"
    return scores.agg(
        F.count("*").alias("customers_scored"),
        count_if(high).alias("high_risk_customers"),
        count_if(F.col("predicted_churn_flag") == 1).alias("threshold_positive"),
        F.coalesce(mean_probability(6), F.lit(0.0)).alias("average_probability"),
        dollars(F.coalesce(F.sum(F.when(high, cents("lifetime_spend"))), F.lit(0))).alias("high_risk_spend"),
    )


def risk_distribution(scores: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(r) for r in RISK_ORDER]), F.col("risk_segment"))
    grouped = scores.groupBy("risk_segment").agg(F.count("customer_id").alias("customers"))
    label = F.concat(F.initcap("risk_segment"), F.lit(" Risk"))
    return grouped.withColumns({"risk_label": label, "place": place}).orderBy("place")


def probability_histogram(scores: DataFrame, bins: int = 40) -> DataFrame:
    """Customers per equal-width bin of [0, 1]; the last bin includes 1."""
    bucket = F.least(F.floor(F.col("churn_probability") * F.lit(float(bins))), F.lit(bins - 1)).cast("bigint")
    return scores.where(F.col("churn_probability").between(0, 1)).groupBy(bucket.alias("bin")).agg(
        F.count("*").alias("customers")
    ).withColumns({"bin_start": F.col("bin") / F.lit(float(bins)), "bin_end": (F.col("bin") + 1) / F.lit(float(bins))})


def decile_profile(scores: DataFrame) -> DataFrame:
    return scores.groupBy("risk_decile").agg(
        F.count("customer_id").alias("customers"),
        mean_probability(6).alias("avg_probability"),
        dollars(F.coalesce(F.sum(cents("lifetime_spend")), F.lit(0))).alias("lifetime_spend"),
    )


def action_counts(scores: DataFrame) -> DataFrame:
    label = F.initcap(F.replace(F.col("recommended_action"), F.lit("_"), F.lit(" ")))
    grouped = scores.groupBy("recommended_action").agg(F.count("customer_id").alias("customers"))
    return grouped.withColumn("action_label", label)


def intervention_queue(scores: DataFrame, k: int | None = 100) -> DataFrame:
    """High-risk customers by spend, then probability; shares as percentages."""
    high = scores.where("risk_segment = 'high'").orderBy(
        F.desc_nulls_last("lifetime_spend"), F.desc("churn_probability"), F.asc("customer_id")
    )
    shown = high if k is None else high.limit(k)
    percent = {c: F.col(c) * F.lit(100.0) for c in ("churn_probability", "return_order_rate", "discount_order_rate")}
    columns = [
        "customer_id", "churn_probability", "risk_decile", "lifetime_spend", "days_since_last_order", "total_orders",
        "orders_last_90d", "return_order_rate", "discount_order_rate", "signup_channel", "region", "recommended_action",
    ]
    return shown.select(*[percent.get(c, F.col(c)).alias(c) for c in columns])


def score_summary_by_risk(scores: DataFrame) -> DataFrame:
    spend = cents("lifetime_spend")
    grouped = scores.groupBy("risk_segment").agg(
        F.count("customer_id").alias("customers"),
        mean_probability(3).alias("avg_probability"),
        mean_dollars(F.sum(spend), F.count(spend)).alias("avg_lifetime_spend"),
    )
    return share_of_total(grouped, "customers", "share_pct")


def score_summary_by_action(scores: DataFrame) -> DataFrame:
    grouped = scores.groupBy("recommended_action").agg(F.count("*").alias("customers"))
    return share_of_total(grouped, "customers", "share_pct")


def score_headline(scores: DataFrame) -> DataFrame:
    positive = F.sum("predicted_churn_flag").cast("bigint")
    return scores.agg(
        F.max("score_date").alias("score_date"),
        F.count("*").alias("customers_scored"),
        mean_probability(3).alias("average_probability"),
        positive.alias("threshold_positive"),
        pct(positive, F.count("*")).alias("threshold_positive_pct"),
        missing_spend().alias("missing_spend_values"),
    )


def missing_spend() -> Column:
    return F.coalesce(F.sum("lifetime_spend_missing_flag"), F.lit(0)).cast("bigint")


def missing_spend_count(scores: DataFrame) -> DataFrame:
    return scores.agg(missing_spend().alias("missing_spend_values"))


def top_customers(scores: DataFrame, k: int = 10) -> DataFrame:
    best = scores.orderBy(
        F.desc("churn_probability"), F.desc_nulls_last("lifetime_spend"), F.asc("customer_id")
    ).limit(k)
    return best.select(
        "customer_id", rnd("churn_probability", 4).alias("churn_probability"), "risk_decile",
        rnd("lifetime_spend", 2).alias("lifetime_spend"), "days_since_last_order", "recommended_action",
    )
