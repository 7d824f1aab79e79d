"""The scoring job: predict, build the score table, look at it, and publish it only if every rule holds."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stallkeeper.churn.config import ID, MODEL_VERSION
from stallkeeper.churn.scores import score_output
from stallkeeper.churn.validate import validate_scores
from stallkeeper.session import cut_lineage
from stallkeeper.sources.schemas import score_schema
from stallkeeper.sources.versions import Versions


class Refused(ValueError):
    """A run whose score table broke a rule; ``violations`` holds the rules and how many rows broke each."""

    def __init__(self, violations: dict[str, int]):
        super().__init__("scores are not published: " + ", ".join(f"{r}={n}" for r, n in violations.items()))
        self.violations = violations


def population_gaps(scores: DataFrame, population: DataFrame) -> DataFrame:
    """Customers that should have a score and have none, and scores of customers who should have none; one row per rule."""
    sides = population.select(ID, F.lit(1).alias("wanted"), F.lit(0).alias("scored")).unionAll(
        scores.select(ID, F.lit(0), F.lit(1))).groupBy(ID).agg(F.sum("wanted").alias("wanted"), F.sum("scored").alias("scored"))
    counts = sides.agg(F.count_if(F.col("scored") == 0).alias("unscored_customer"), F.count_if(F.col("wanted") == 0).alias("unknown_customer"))
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations"), (F.col(r) == 0).alias("passed"))
        for r in ("unscored_customer", "unknown_customer")])))


def schema_gaps(df: DataFrame, declared: StructType) -> int:
    """Columns that are missing, not declared, or of another type."""
    return len(set(df.dtypes) ^ {(f.name, f.dataType.simpleString()) for f in declared})


def audit(scores: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """rule, violations, passed: the rules of the score table, its contract, and that it covers the population."""
    gaps = schema_gaps(scores, score_schema())
    contract = scores.sparkSession.createDataFrame([("schema_mismatch", gaps, gaps == 0)], "rule string, violations long, passed boolean")
    report = validate_scores(scores).unionByName(contract)
    return report if population is None else report.unionByName(population_gaps(scores, population))


def log_run(store: Versions, version: str, status: str, report: list, at: dt.datetime) -> None:
    rows = [(version, status, r["rule"], r["violations"], at) for r in report]
    store.spark.createDataFrame(rows, "version string, status string, rule string, violations long, run_at timestamp_ntz").write.mode(
        "append").parquet(f"{store.path}/runs")


def runs(store: Versions) -> DataFrame:
    """version, status, rule, violations and run_at of every run, refused ones too."""
    return store.spark.read.parquet(f"{store.path}/runs")


def publish_scores(store: Versions, scores: DataFrame, at: dt.datetime, population: DataFrame | None = None) -> str:
    """Write the table as a new version, audit what was written, and publish it; on a broken rule the last one stays and
    ``Refused`` is raised. The refused version is kept for looking at, under the name in ``runs``."""
    version = store.write(scores)
    report = audit(store.table(version), population).collect()  # a row for each rule
    failed = {r["rule"]: r["violations"] for r in report if not r["passed"]}
    log_run(store, version, "refused" if failed else "published", report, at)
    if failed:
        raise Refused(failed)
    store.publish(version, run_at=at.isoformat())
    return version


def run_scoring(store: Versions, snapshot: DataFrame, predict: Callable[[DataFrame], DataFrame], at: dt.datetime, threshold: float,
                model_name: str, model_version: str = MODEL_VERSION) -> str:
    """Score a snapshot (``features.scoring_snapshot``) and publish the result.

    ``predict`` adds ``churn_probability``; it may lose no customer and add none.
    """
    snapshot = cut_lineage(snapshot)
    scored = cut_lineage(predict(snapshot))
    return publish_scores(store, score_output(scored, at, threshold, model_name, model_version), at, snapshot)


def scores_of(spark: SparkSession, path: str) -> DataFrame:
    """The published score table of a store."""
    return Versions(spark, path).read()
