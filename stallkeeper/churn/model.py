"""Logistic churn model on Spark ML.

The fitted preprocessing is written as one SQL projection (impute, flag missing, standardise, one-hot),
so scoring stays inside generated code and the whole pipeline saves and loads as a ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.churn.config import BINARY_FEATURES, LABEL, NUMERIC_FEATURES
from stallkeeper.churn.evaluate import choose_threshold, evaluate, ranking_metrics, threshold_table, top_fraction
from stallkeeper.operators.ranking import exact_quantile
from stallkeeper.session import cut_lineage

VECTOR = "_features"
SCRATCH = ("_features", "rawPrediction", "probability", "prediction")


@dataclass
class Trained:
    model_name: str
    class_weight: str
    features: list[str]
    pipeline: PipelineModel
    candidates: list[dict]
    threshold: float | None = None
    thresholds: DataFrame | None = None  # precision, recall and F1 on validation at every threshold


def _medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact medians of all columns from one long pass; one value per column reaches the driver."""
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in columns])
    rows = exact_quantile(train.select(F.inline(cells)), "v", 0.5, ["c"], "m").collect()
    return {r["c"]: r["m"] for r in rows}


@dataclass(frozen=True)
class Input:
    """A model input as fitted on the training rows: what fills a missing value, and what it is centred and divided by."""

    name: str
    kind: str  # numeric, missing, binary or channel
    expression: str  # SQL of the value before centring
    fill: float | None = None
    mean: float | None = None
    deviation: float | None = None

    @property
    def sql(self) -> str:
        if self.mean is None:
            return self.expression
        # a constant column keeps scale 1
        return f"({self.expression} - {self.mean!r}D) / {self.deviation or 1.0!r}D"


def fit_inputs(train: DataFrame, include_channel: bool = False) -> list[Input]:
    """Medians, modes, means, deviations and channels of the training rows, in the order of the model's inputs."""
    medians = _medians(train, NUMERIC_FEATURES)
    nulls = train.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in NUMERIC_FEATURES]).first()
    scaled = [Input(f"num_{c}", "numeric", f"coalesce(cast({c} as double), {medians.get(c, 0.0)!r}D)", medians.get(c, 0.0))
              for c in NUMERIC_FEATURES]
    scaled += [Input(f"missing_{c}", "missing", f"cast({c} is null as double)") for c in NUMERIC_FEATURES if nulls[c]]
    stats = train.agg(
        *[F.avg(F.expr(x.expression)).alias(f"m_{x.name}") for x in scaled],
        *[F.stddev_pop(F.expr(x.expression)).alias(f"s_{x.name}") for x in scaled],
        *[F.mode(c, deterministic=True).alias(f"b_{c}") for c in BINARY_FEATURES],
    ).first()
    inputs = [replace(x, mean=stats[f"m_{x.name}"], deviation=stats[f"s_{x.name}"]) for x in scaled]
    inputs += [Input(f"bin_{c}", "binary", f"cast(coalesce({c}, {stats[f'b_{c}']}) as double)", float(stats[f"b_{c}"])) for c in BINARY_FEATURES]
    if include_channel:
        # every channel of the training rows is a category; the list is as long as the channels are many
        channels = sorted(r[0] for r in train.where("signup_channel is not null").select("signup_channel").distinct().collect())
        for ch in channels:
            quoted = ch.replace("\\", "\\\\").replace("'", "\\'")
            inputs.append(Input(f"channel_{ch}", "channel", f"cast(coalesce(signup_channel, '') = '{quoted}' as double)"))
    return inputs


def preprocessing_table(train: DataFrame, include_channel: bool = False) -> DataFrame:
    """place, input, kind, fill, mean and deviation of every model input."""
    rows = [(i, x.name, x.kind, x.fill, x.mean, x.deviation) for i, x in enumerate(fit_inputs(train, include_channel))]
    return train.sparkSession.createDataFrame(rows, "place long, input string, kind string, fill double, mean double, deviation double")


def prepared(rows: DataFrame, inputs: Sequence[Input]) -> DataFrame:
    """Label, class and every input as a column x0, x1, ..."""
    return rows.select(LABEL, *[F.expr(x.sql).alias(f"x{i}") for i, x in enumerate(inputs)])


def gradient_table(rows: DataFrame, names: Sequence[str], weights: Sequence[float], intercept: float, balanced: bool = False,
                   penalty: float = 1.0, tolerance: float = 1e-4) -> DataFrame:
    """How far given weights are from the optimum: the gradient of the penalised loss for each input, in one aggregate.

    ``rows`` has the label and the inputs as x0, x1, ...; the loss is summed over rows, the intercept is not penalised.
    ``within_tolerance``: the gradient is at most ``tolerance`` a row. At the optimum all of them are.
    """
    odds = sum((F.lit(float(w)) * F.col(f"x{i}") for i, w in enumerate(weights)), F.lit(float(intercept)))
    totals = rows.agg(F.count("*").alias("n"), F.sum(LABEL).alias("p")).first()
    n, positives = totals["n"], totals["p"]
    share = F.when(F.col(LABEL) == 1, F.lit(positives)).otherwise(F.lit(n - positives))
    weight = F.lit(n) / (F.lit(2.0) * share) if balanced else F.lit(1.0)
    gaps = rows.withColumn("_gap", weight * (F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)) - F.col(LABEL)))
    sums = gaps.agg(*[F.sum(F.col("_gap") * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(names))], F.sum("_gap").alias("g"))
    lines = [(name, F.col(f"g{i}") + F.lit(penalty * float(w)), float(w)) for i, (name, w) in enumerate(zip(names, weights, strict=True))]
    lines.append(("intercept", F.col("g"), float(intercept)))
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("input"), F.lit(w).alias("weight"), g.alias("gradient"), (F.abs(g) <= tolerance * n).alias("within_tolerance"))
        for name, g, w in lines])))


def certificate(trained: Trained, train: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """``gradient_table`` of a fitted model on the rows that it was fitted on."""
    project, _, fitted = trained.pipeline.stages
    return gradient_table(project.transform(train), trained.features, fitted.coefficients.toArray(), fitted.intercept,
                          trained.class_weight == "balanced", tolerance=tolerance)


def fit_pipeline(
    train: DataFrame, include_channel: bool = False, balanced: bool = False, max_iter: int = 1500
) -> tuple[PipelineModel, list[str], list[str]]:
    """Fit preprocessing and an L2 logistic regression with unit penalty on the summed loss."""
    inputs = fit_inputs(train, include_channel)
    used = [*NUMERIC_FEATURES, *BINARY_FEATURES, *(["signup_channel"] if include_channel else [])]
    names = [x.name for x in inputs]
    columns = [f"x{i}" for i in range(len(names))]
    lines = ", ".join(f"{e} AS {c}" for c, e in zip(columns, (x.sql for x in inputs)))
    project = SQLTransformer(statement=f"SELECT *, {lines} FROM __THIS__")
    assemble = VectorAssembler(inputCols=columns, outputCol=VECTOR)
    totals = train.agg(F.count("*").alias("n"), F.sum(LABEL).alias("p")).first()
    n, positives = totals["n"], totals["p"]
    ready = assemble.transform(project.transform(train)).select(LABEL, VECTOR)
    share = F.when(F.col(LABEL) == 1, F.lit(positives)).otherwise(F.lit(n - positives))
    ready = ready.withColumn("_w", F.lit(n) / (F.lit(2.0) * share) if balanced else F.lit(1.0))
    # the loss is averaged over the weight sum (n either way), so a unit penalty becomes 1/n
    regression = LogisticRegression(
        featuresCol=VECTOR, labelCol=LABEL, weightCol="_w", regParam=1.0 / n, elasticNetParam=0.0,
        standardization=False, maxIter=max_iter,
    )
    fitted = regression.fit(cut_lineage(ready))
    return PipelineModel(stages=[project, assemble, fitted]), names, used


def score(pipeline: PipelineModel, df: DataFrame) -> DataFrame:
    out = pipeline.transform(df)
    probability = vector_to_array(F.col("probability"))[1]
    added = [c for c in out.columns if c not in df.columns]
    return out.withColumn("churn_probability", probability).drop(*added)


def probability_violations(scored: DataFrame) -> DataFrame:
    p = F.col("churn_probability")
    return scored.where(p.isNull() | F.isnan(p) | (p < 0) | (p > 1))


def train(train_df: DataFrame, validation_df: DataFrame, model_name: str, include_channel: bool = False) -> Trained:
    """Fit with and without balanced weights, keep the better one on validation, pick its threshold."""
    best, best_key, candidates = None, None, []
    for weight in ("none", "balanced"):
        pipeline, names, _ = fit_pipeline(train_df, include_channel, weight == "balanced")
        scored = cut_lineage(score(pipeline, validation_df).select("customer_id", LABEL, "churn_probability"))
        ranks = ranking_metrics(scored).first()
        recall = top_fraction(scored, 0.20).first()["recall"]
        key = (ranks["pr_auc"], recall, ranks["roc_auc"])
        candidates.append({"class_weight": weight, "pr_auc": key[0], "top_20_recall": key[1], "roc_auc": key[2]})
        if best_key is None or key > best_key:
            best_key = key
            best = Trained(model_name, weight, names, pipeline, candidates)
            table = threshold_table(scored, model_name)
    best.threshold, best.thresholds = choose_threshold(table).first()["threshold"], table
    return best


def coefficients(trained: Trained, spark) -> DataFrame:
    """Standardised coefficients, one row per model input, strongest first."""
    weights = trained.pipeline.stages[-1].coefficients.toArray()
    rows = [(trained.model_name, n, float(w)) for n, w in zip(trained.features, weights, strict=True)]
    return with_direction(spark.createDataFrame(rows, "model_name string, feature string, coefficient double"))


def with_direction(df: DataFrame) -> DataFrame:
    """Strength and direction of each coefficient."""
    direction = F.when(F.col("coefficient") >= 0, "increases_churn_risk").otherwise("decreases_churn_risk")
    return df.withColumns({"absolute_coefficient": F.abs("coefficient"), "direction": direction}).orderBy(
        F.desc("absolute_coefficient")
    )


def metrics_row(trained: Trained, scored: DataFrame) -> DataFrame:
    """Evaluation of a scored split with the model's name and chosen settings."""
    row = evaluate(scored, trained.threshold)
    return row.select(
        F.lit(trained.model_name).alias("model_name"), F.lit(trained.class_weight).alias("class_weight"), "*"
    )
