"""Evaluation of scored customers: every metric is a small aggregate over score groups.

Frames need ``churned`` (0/1) and ``churn_probability``. Pass a stored frame (``session.cut_lineage`` or a
table) where the score comes from a model, since rank-based metrics read it more than once.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stallkeeper.churn.config import ID, LABEL, SNAPSHOT
from stallkeeper.operators.ranking import global_rank, pct_rank_decile, running_sums
from stallkeeper.plans.governed import cross_combine

PROBABILITY = "churn_probability"


def sound(scored: DataFrame) -> DataFrame:
    """The same rows; a NULL or NaN score stops the job, so that all metrics speak of one population."""
    p = F.col(PROBABILITY)
    refuse = F.raise_error(F.lit("a scored row has no churn_probability")).cast("double")
    return scored.withColumn(PROBABILITY, F.when(p.isNull() | F.isnan(p), refuse).otherwise(p))


def threshold_grid(start: float = 0.05, stop: float = 0.951, step: float = 0.01) -> list[float]:
    """Evenly stepped floats; the increment is the difference of the first two, as in array ranges."""
    increment = (start + step) - start
    return [start + i * increment for i in range(math.ceil((stop - start) / step))]


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def threshold_table(scored: DataFrame, model_name: str, grid: list[float] | None = None) -> DataFrame:
    """Precision, recall and F1 at every threshold from one pass: rows are counted between neighbouring
    thresholds, then summed from the top over at most ``len(grid) + 1`` groups."""
    grid = grid or threshold_grid()
    cut = Bucketizer(
        splits=[float("-inf"), *grid, float("inf")], inputCol=PROBABILITY, outputCol="_b", handleInvalid="skip"
    )
    counted = cut.transform(sound(scored)).groupBy(F.col("_b").cast("int").alias("k")).agg(
        F.count("*").alias("n"), F.sum(LABEL).alias("pos")
    )
    slots = scored.sparkSession.range(len(grid) + 1).select(F.col("id").cast("int").alias("k"))
    filled = slots.join(counted, "k", "left").fillna(0, ["n", "pos"])
    above, everything = W.orderBy(F.desc("k")), W.partitionBy()
    sums = filled.select(
        "k",
        F.sum("n").over(above).alias("pp"),
        F.sum("pos").over(above).alias("tp"),
        F.sum("n").over(everything).alias("rows"),
        F.sum("pos").over(everything).alias("positives"),
    ).where("k > 0")
    names = F.array(*[F.lit(round(t, 2)) for t in grid])
    return sums.select(
        F.lit(model_name).alias("model_name"),
        F.element_at(names, F.col("k")).alias("threshold"),
        _ratio(F.col("tp"), F.col("pp")).alias("precision"),
        _ratio(F.col("tp"), F.col("positives")).alias("recall"),
        _ratio(F.lit(2.0) * F.col("tp"), F.col("pp") + F.col("positives")).alias("f1"),
        _ratio(F.col("pp"), F.col("rows")).alias("predicted_positive_rate"),
        F.col("pp").alias("predicted_positive_customers"),
    )


def choose_threshold(table: DataFrame) -> DataFrame:
    """The row with the best F1, then recall, then precision, then the lowest threshold."""
    return table.orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), F.asc("threshold")).limit(1)


def confusion(scored: DataFrame, threshold: float) -> DataFrame:
    y, hit = F.col(LABEL) == 1, F.col(PROBABILITY) >= F.lit(threshold)
    c = sound(scored).agg(
        F.count("*").alias("rows"),
        F.sum(LABEL).alias("churners"),
        F.count_if(~y & ~hit).alias("true_negative"),
        F.count_if(~y & hit).alias("false_positive"),
        F.count_if(y & ~hit).alias("false_negative"),
        F.count_if(y & hit).alias("true_positive"),
    )
    tp, pp = F.col("true_positive"), F.col("true_positive") + F.col("false_positive")
    return c.select(
        "*",
        _ratio(F.col("churners"), F.col("rows")).alias("churn_rate"),
        F.lit(threshold).alias("threshold"),
        _ratio(tp, pp).alias("precision"),
        _ratio(tp, F.col("churners")).alias("recall"),
        _ratio(F.lit(2.0) * tp, pp + F.col("churners")).alias("f1"),
        _ratio(pp, F.col("rows")).alias("predicted_positive_rate"),
        pp.alias("predicted_positive_customers"),
    )


def _score_groups(scored: DataFrame) -> DataFrame:
    """Customers and churners per distinct score, with running sums from the highest score down."""
    groups = sound(scored).groupBy(PROBABILITY).agg(F.count("*").alias("n"), F.sum(LABEL).alias("pos"))
    return running_sums(groups, PROBABILITY, ["n", "pos"], descending=True)


def ranking_metrics(scored: DataFrame) -> DataFrame:
    """ROC-AUC by rank sum (ties count half) and average precision by steps, in one pass over score groups."""
    neg = F.col("n") - F.col("pos")
    above = F.col("run_pos") - F.col("pos")
    wins = (neg.cast("decimal(18,0)") * (above * 2 + F.col("pos")).cast("decimal(19,0)")).cast("decimal(38,0)")
    step = F.col("pos") / F.col("all_pos") * (F.col("run_pos") / F.col("run_n"))
    sums = _score_groups(scored).agg(
        F.sum(wins).cast("double").alias("w"),
        F.max("all_n").alias("n"),
        F.max("all_pos").alias("p"),
        F.sum(step).alias("pr_auc"),
    )
    pairs = F.lit(2.0) * F.col("p") * (F.col("n") - F.col("p"))
    return sums.select((F.col("w") / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"), "pr_auc")


def roc_auc(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("roc_auc")


def average_precision(scored: DataFrame) -> DataFrame:
    return ranking_metrics(scored).select("pr_auc")


def brier(scored: DataFrame) -> DataFrame:
    gap = F.col(PROBABILITY) - F.col(LABEL)
    return sound(scored).agg(F.avg(gap * gap).alias("brier_score"))


def top_fractions(scored: DataFrame, fractions: list[float], id_col: str = ID) -> DataFrame:
    """Precision, recall and lift of the highest-risk share of customers, one row per share."""
    ranked = global_rank(sound(scored).select(id_col, LABEL, PROBABILITY), PROBABILITY, id_col, "r", stored=True)
    quota = [F.greatest(F.lit(1), F.ceil(F.col("r_n") * F.lit(f))) for f in fractions]
    sums = ranked.agg(
        F.count("*").alias("rows"),
        F.sum(LABEL).alias("churners"),
        *[F.count_if(F.col("r") <= q).alias(f"n{i}") for i, q in enumerate(quota)],
        *[F.sum(F.when(F.col("r") <= q, F.col(LABEL)).otherwise(0)).alias(f"c{i}") for i, q in enumerate(quota)],
    )
    overall = F.col("churners") / F.col("rows")
    lines = []
    for i, f in enumerate(fractions):
        precision = _ratio(F.col(f"c{i}"), F.col(f"n{i}"))
        lines.append(F.struct(
            F.lit(f).alias("fraction"),
            F.col(f"n{i}").alias("customers"),
            F.col(f"c{i}").alias("captured_churners"),
            precision.alias("precision"),
            _ratio(F.col(f"c{i}"), F.col("churners")).alias("recall"),
            F.coalesce(precision / F.nullif(overall, F.lit(0.0)), F.lit(0.0)).alias("lift"),
        ))
    return sums.select(F.inline(F.array(*lines)))


def top_fraction(scored: DataFrame, fraction: float) -> DataFrame:
    return top_fractions(scored, [fraction])


def evaluate(scored: DataFrame, threshold: float) -> DataFrame:
    """One row with every metric of a scored split."""
    tops = top_fractions(scored, [0.10, 0.20])
    wide = [
        tops.where(F.round(F.col("fraction"), 2) == f).select(
            *[F.col(c).alias(f"top_{name}_{c}") for c in ("customers", "captured_churners", "precision", "recall", "lift")]
        )
        for f, name in ((0.1, "10_pct"), (0.2, "20_pct"))
    ]
    return cross_combine(confusion(scored, threshold), ranking_metrics(scored), brier(scored), *wide)


def prediction_frame(scored: DataFrame, model_name: str, threshold: float) -> DataFrame:
    """Auditable predictions; decile 10 holds the highest risk."""
    ranked = global_rank(sound(scored), PROBABILITY, ID, "r", descending=False, stored=True)
    return ranked.select(
        ID,
        SNAPSHOT,
        LABEL,
        F.lit(model_name).alias("model_name"),
        PROBABILITY,
        F.lit(threshold).alias("selected_threshold"),
        F.when(F.col(PROBABILITY) >= F.lit(threshold), 1).otherwise(0).cast("bigint").alias("predicted_churn"),
        pct_rank_decile(F.col("r"), F.col("r_n")).alias("risk_decile"),
    )


def compare_models(base: DataFrame, other: DataFrame, metrics: tuple[str, ...] = (
    "roc_auc", "pr_auc", "precision", "recall", "f1", "top_10_pct_lift", "top_20_pct_recall",
)) -> DataFrame:
    """What the other model adds over the base: one row of differences between two one-row metric frames."""
    left = base.select(*[F.col(m).alias(f"base_{m}") for m in metrics])
    right = other.select(*[F.col(m).alias(f"other_{m}") for m in metrics])
    both = cross_combine(left, right)
    return both.select("*", *[(F.col(f"other_{m}") - F.col(f"base_{m}")).alias(f"{m}_delta") for m in metrics])


def select_model(metrics: DataFrame) -> DataFrame:
    """Best of several one-row metric frames stacked with a ``model_name`` column."""
    return metrics.orderBy(F.desc("pr_auc"), F.desc("top_20_pct_recall"), F.desc("roc_auc"), "model_name").limit(1)
