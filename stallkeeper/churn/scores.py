"""Operational score table: deciles, segments and recommended actions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallkeeper.churn.config import ID, MODEL_NAMES, MODEL_VERSION, SCORE_THRESHOLD
from stallkeeper.functions import ladder
from stallkeeper.operators.ranking import exact_quantile, global_rank, qcut_decile
from stallkeeper.sources.io import conform_scores

HIGH_RETURN_RATE = 0.25
HIGH_DISCOUNT_RATE = 0.50
HIGH_VALUE_QUANTILE = 0.80


def qcut_deciles(
    df: DataFrame, score: str, id_col: str, out: str = "risk_decile", n: int = 10, descending: bool = True
) -> DataFrame:
    """Evenly cut risk deciles of a stored frame; 1 is the highest score when ``descending``."""
    ranked = global_rank(df, score, id_col, "_r", descending=descending, stored=True)
    return ranked.withColumn(out, qcut_decile(F.col("_r"), F.col("_r_n"), n)).drop("_r", "_r_n")


def risk_segment(decile: Column) -> Column:
    return F.when(decile.isNotNull(), ladder(decile, (2, 5), ("high_risk", "medium_risk", "low_risk")))


def recommended_action(segment: Column, spend: Column, returns: Column, discounts: Column, cutoff: Column) -> Column:
    high = segment == "high_risk"
    return (
        F.when(high & (F.coalesce(spend, F.lit(0.0)) >= cutoff), "priority_retention_outreach")
        .when(high & (returns >= HIGH_RETURN_RATE), "service_recovery_review")
        .when(high & (discounts >= HIGH_DISCOUNT_RATE), "targeted_retention_incentive")
        .when(high, "standard_retention_campaign")
        .when(segment == "medium_risk", "low_cost_reengagement")
        .otherwise("no_immediate_action")
    )


def score_output(
    scored: DataFrame,
    scored_at: dt.datetime,
    threshold: float = SCORE_THRESHOLD,
    model_name: str = MODEL_NAMES["behavioral"],
    model_version: str = MODEL_VERSION,
) -> DataFrame:
    """The 22-column score table of a scored snapshot (a stored frame with ``churn_probability``).

    Every customer stays: one without a score has no decile, segment or flag, which ``validate_scores`` reports.
    """
    cutoff = exact_quantile(scored, "lifetime_spend", HIGH_VALUE_QUANTILE, out="cutoff").scalar()
    cut = qcut_deciles(scored, "churn_probability", ID)
    cut = cut.withColumns({"risk_segment": risk_segment(F.col("risk_decile")), "_cutoff": cutoff})
    action = recommended_action(
        F.col("risk_segment"), F.col("lifetime_spend"), F.col("return_order_rate"), F.col("discount_order_rate"),
        F.col("_cutoff"),
    )
    full = cut.withColumns({
        "predicted_churn_flag": F.when(F.col("churn_probability") >= threshold, 1).when(
            F.col("churn_probability") < threshold, 0),
        "lifetime_spend_missing_flag": F.when(F.col("lifetime_spend").isNull(), 1).otherwise(0),
        "recommended_action": action,
        "probability_threshold": F.lit(threshold),
        "model_name": F.lit(model_name),
        "model_version": F.lit(model_version),
        "scored_at_utc": F.lit(scored_at).cast("timestamp_ntz"),
    })
    return conform_scores(full)


def in_score_order(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.desc("churn_probability"), F.desc_nulls_last("lifetime_spend"), F.asc(ID))
