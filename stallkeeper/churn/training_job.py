"""The training job: both model families, the choice between them, and all that scoring needs, saved as one unit.

A bundle is a version of a folder: the fitted pipelines, the tables of the run (coefficients, thresholds, predictions) and,
written last, ``bundle.json`` with names, thresholds, candidates and metrics. It becomes readable by publication only, so a
run that dies leaves the last bundle in place, and a later session loads what this one saved.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from stallkeeper.churn.config import MODEL_NAMES, MODEL_VERSION
from stallkeeper.churn.evaluate import prediction_frame
from stallkeeper.churn.model import Trained, coefficients, metrics_row, score, train
from stallkeeper.churn.validate import require, validate_split
from stallkeeper.session import cut_lineage
from stallkeeper.sources.versions import Versions, read_text, write_text

#: what decides between the families, on validation
CHOICE = ("pr_auc", "top_20_pct_recall", "roc_auc")
#: what the channel family adds: split and metric
DELTAS = (("validation", "pr_auc"), ("test", "pr_auc"), ("test", "roc_auc"), ("test", "top_10_pct_lift"))
TABLES = ("coefficients", "thresholds", "predictions")


@dataclass
class Bundle:
    """Fitted families by name, metrics by family and split, the chosen family, and the run's stored tables."""

    models: dict[str, Trained]
    metrics: dict[str, dict[str, dict]]
    selected: str
    deltas: dict[str, float]
    tables: dict[str, DataFrame]
    model_version: str = MODEL_VERSION

    @property
    def best(self) -> Trained:
        return self.models[self.selected]

    def predict(self, snapshot: DataFrame, family: str | None = None) -> DataFrame:
        return score(self.models[family or self.selected].pipeline, snapshot)


def choose_family(metrics: Mapping[str, Mapping[str, dict]]) -> str:
    """The family with the best validation metrics; ties go to the first."""
    return max(metrics, key=lambda name: tuple(metrics[name]["validation"][m] for m in CHOICE))


def family_deltas(metrics: Mapping[str, Mapping[str, dict]], base: str, other: str) -> dict[str, float]:
    return {f"{split}_{m}_delta": metrics[other][split][m] - metrics[base][split][m] for split, m in DELTAS}


def run_training(store: Versions, train_rows: DataFrame, validation_rows: DataFrame, test_rows: DataFrame) -> Bundle:
    """Check the splits, fit both families, choose on validation, evaluate on test, save, publish and load again."""
    spark = train_rows.sparkSession
    splits = {"train": train_rows, "validation": validation_rows, "test": test_rows}
    splits = {name: cut_lineage(rows) for name, rows in splits.items()}
    for name, rows in splits.items():
        require(validate_split(rows), name)
    models, metrics, parts = {}, {}, {t: [] for t in TABLES}
    for family, name in MODEL_NAMES.items():
        fitted = train(splits["train"], splits["validation"], name, include_channel=family == "channel")
        models[name] = fitted
        scored = {s: cut_lineage(score(fitted.pipeline, splits[s])) for s in ("validation", "test")}
        metrics[name] = {s: metrics_row(fitted, rows).first().asDict() for s, rows in scored.items()}
        parts["coefficients"].append(coefficients(fitted, spark))
        parts["thresholds"].append(fitted.thresholds)
        parts["predictions"].append(prediction_frame(scored["test"], name, fitted.threshold))
    base, other = MODEL_NAMES["behavioral"], MODEL_NAMES["channel"]
    version = store.new()
    folder = store.folder(version)
    for name, fitted in models.items():
        fitted.pipeline.save(f"{folder}/models/{name}")
    for table, frames in parts.items():
        frames[0].unionByName(frames[1]).write.parquet(f"{folder}/{table}")
    write_text(spark, f"{folder}/bundle.json", json.dumps({
        "model_version": MODEL_VERSION, "selected": choose_family(metrics), "metrics": metrics,
        "deltas": family_deltas(metrics, base, other),
        "models": {n: {"class_weight": m.class_weight, "features": m.features, "candidates": m.candidates, "threshold": m.threshold}
                   for n, m in models.items()}}))
    store.publish(version, model_version=MODEL_VERSION)
    return load_bundle(store, version)


def load_bundle(store: Versions, version: str | None = None) -> Bundle:
    """The published bundle, or the named one."""
    if version is None:
        current = store.current()
        if current is None:
            raise LookupError(f"no trained model in {store.path}")
        version = current["version"]
    spark: SparkSession = store.spark
    folder = store.folder(version)
    notes = json.loads(read_text(spark, f"{folder}/bundle.json"))
    models = {
        name: Trained(name, m["class_weight"], m["features"], PipelineModel.load(f"{folder}/models/{name}"), m["candidates"], m["threshold"])
        for name, m in notes["models"].items()}
    tables = {t: spark.read.parquet(f"{folder}/{t}") for t in TABLES}
    return Bundle(models, notes["metrics"], notes["selected"], notes["deltas"], tables, notes["model_version"])
