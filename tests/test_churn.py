"""Point-in-time rules, metrics and the model."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.churn import evaluate as ev
from stallkeeper.churn import features as ft
from stallkeeper.churn import model as ml
from stallkeeper.churn import scores as sc
from stallkeeper.churn import validate as v
from stallkeeper.churn.config import BINARY_FEATURES, LABEL, NUMERIC_FEATURES

SD = dt.date(2001, 3, 31)


def orders(spark, shifts, status="paid"):
    data = [(f"o{i}", "c", status, SD + dt.timedelta(days=d), amount) for i, (d, amount) in enumerate(shifts)]
    return spark.createDataFrame(
        data, "order_id string, customer_id string, order_status string, order_date date, total_amount_cents bigint"
    )


def test_windows_are_open_at_the_start(spark):
    df = orders(spark, [(0, 100), (1, 100), (-30, 100), (-29, 100), (-90, 100), (-89, 100), (90, 100), (91, 100)])
    row = ft.order_activity(df, [SD]).first()
    assert (row["total_orders"], row["orders_last_30d"], row["orders_last_90d"]) == (5, 2, 4)
    assert row["orders_in_prediction_window"] == 2
    assert (row["days_since_last_order"], row["days_since_first_order"]) == (0, 90)
    assert row["lifetime_spend"] == 5.0 and row["spend_last_90d"] == 4.0
    assert row["spend_trend"] == 1.0  # 90 days are not more than 90


def test_missing_totals_and_single_orders(spark):
    row = ft.order_features(orders(spark, [(-10, None)]), [SD]).first()
    assert row["lifetime_spend"] is None and row["spend_last_90d"] is None and row["avg_days_between_orders"] is None
    assert row["is_single_order_customer"] == 1
    assert ft.order_features(orders(spark, [(-10, 1)], "cancelled"), [SD]).count() == 0
    assert ft.order_features(orders(spark, [(5, 1)]), [SD]).count() == 0


def test_spend_trend(spark):
    row = ft.order_features(orders(spark, [(-180, 300), (-10, 100)]), [SD]).first()
    assert row["spend_trend"] == pytest.approx(100 / (400 / (180 / 90)))
    assert row["avg_days_between_orders"] == 170.0


def scored(spark, seed=5, n=400):
    rng = np.random.default_rng(seed)
    p = np.round(rng.random(n), 2)
    y = (rng.random(n) < p).astype(int)
    df = spark.createDataFrame(
        [(f"c{i}", SD, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))],
        "customer_id string, snapshot_date date, churned bigint, churn_probability double",
    )
    return df, y, p


def test_ranking_metrics_against_pairs(spark):
    df, y, p = scored(spark)
    row = ev.ranking_metrics(df).first()
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    assert row["roc_auc"] == pytest.approx(wins / (len(pos) * len(neg)))
    ap, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = y[hit].sum() / y.sum()
        ap += (recall - before) * y[hit].mean()
        before = recall
    assert row["pr_auc"] == pytest.approx(ap)
    assert ev.brier(df).first()[0] == pytest.approx(((p - y) ** 2).mean())


def test_threshold_table_against_direct_count(spark):
    df, y, p = scored(spark)
    table = ev.threshold_table(df, "m").orderBy("threshold").collect()
    grid = np.arange(0.05, 0.951, 0.01)
    assert len(table) == len(grid) == 91 and list(grid) == ev.threshold_grid()
    for row, t in zip(table, grid):
        hit = p >= t
        tp = int(y[hit].sum())
        assert row["predicted_positive_customers"] == hit.sum()
        assert row["precision"] == pytest.approx(tp / hit.sum() if hit.sum() else 0.0)
        assert row["recall"] == pytest.approx(tp / y.sum())
    best = max(table, key=lambda r: (r["f1"], r["recall"], r["precision"], -r["threshold"]))
    assert ev.choose_threshold(ev.threshold_table(df, "m")).first() == best


def test_evaluate_row(spark):
    df, y, p = scored(spark)
    row = ev.evaluate(df, 0.3).first()
    assert row["true_positive"] + row["false_negative"] == y.sum() and row["rows"] == len(y)
    assert row["top_10_pct_customers"] == 40 and row["top_20_pct_customers"] == 80
    delta = ev.compare_models(ev.evaluate(df, 0.3), ev.evaluate(df, 0.5)).first()
    assert delta["roc_auc_delta"] == 0.0 and delta["recall_delta"] < 0


def test_risk_rules(spark):
    df = spark.createDataFrame(
        [(1, "high_risk", 900.0, 0.0, 0.0), (2, "high_risk", 1.0, 0.25, 0.9), (3, "high_risk", None, 0.1, 0.5),
         (4, "high_risk", 1.0, 0.2, 0.4), (5, "medium_risk", 900.0, 1.0, 1.0), (6, "low_risk", 900.0, 1.0, 1.0)],
        "i int, s string, spend double, r double, d double",
    )
    act = sc.recommended_action(F.col("s"), F.col("spend"), F.col("r"), F.col("d"), F.lit(500.0))
    assert [r[0] for r in df.orderBy("i").select(act).collect()] == [
        "priority_retention_outreach", "service_recovery_review", "targeted_retention_incentive",
        "standard_retention_campaign", "low_cost_reengagement", "no_immediate_action",
    ]


def model_rows(spark, n=600, seed=7):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(n):
        x = rng.normal(size=len(NUMERIC_FEATURES))
        y = int(rng.random() < 1 / (1 + np.exp(-(1.5 * x[0] - x[2]))))
        numeric = [None if (j == 5 and i % 4 == 0) else float(a) for j, a in enumerate(x)]
        data.append((f"c{i}", SD, y, ["email", "social"][i % 2], *numeric, *[int(i % (k + 2) == 0) for k in range(4)]))
    schema = "customer_id string, snapshot_date date, churned bigint, signup_channel string, " + ", ".join(
        [f"{c} double" for c in NUMERIC_FEATURES] + [f"{c} bigint" for c in BINARY_FEATURES])
    return spark.createDataFrame(data, schema)


def reference_fit(x, y, penalty=1.0):
    """Newton steps for the summed logistic loss with an L2 penalty that leaves the intercept out."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    reg = np.diag([penalty] * x.shape[1] + [0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-a @ w))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + reg, a.T @ (p - y) + reg @ w)
    return w[:-1]


def test_model_matches_direct_optimisation(spark, tmp_path):
    df = model_rows(spark)
    pipeline, names, used = ml.fit_pipeline(df)
    assert "missing_avg_days_between_orders" in names and len(names) == 26 and "signup_channel" not in used
    pdf = df.toPandas()
    num = pdf[list(NUMERIC_FEATURES)].astype(float)
    miss = num["avg_days_between_orders"].isna().to_numpy(float)[:, None]
    num = num.fillna(num.median()).to_numpy()
    wide = np.hstack([num, miss])
    wide = (wide - wide.mean(0)) / wide.std(0)
    x = np.hstack([wide, pdf[list(BINARY_FEATURES)].to_numpy(float)])
    want = reference_fit(x, pdf[LABEL].to_numpy(float))
    assert np.allclose(pipeline.stages[-1].coefficients.toArray(), want, atol=2e-3)
    pipeline.write().overwrite().save(f"{tmp_path}/m")
    from pyspark.ml import PipelineModel

    again = ml.score(PipelineModel.load(f"{tmp_path}/m"), df)
    assert again.columns == [*df.columns, "churn_probability"]
    assert ml.probability_violations(again).count() == 0
    assert ev.roc_auc(again).first()[0] > 0.8


def test_training_and_unknown_channels(spark):
    df = model_rows(spark)
    trained = ml.train(df.where("customer_id < 'c5'"), df.where("customer_id >= 'c5'"), "m", include_channel=True)
    assert {c["class_weight"] for c in trained.candidates} == {"none", "balanced"}
    assert 0.05 <= trained.threshold <= 0.95
    odd = df.limit(5).withColumn("signup_channel", F.lit("it's new"))
    assert ml.probability_violations(ml.score(trained.pipeline, odd)).count() == 0
    names = {r["feature"] for r in ml.coefficients(trained, spark).collect()}
    assert {"channel_email", "channel_social"} <= names


def test_validation_reports(spark):
    df = model_rows(spark, 20)
    report = {r["rule"]: r["violations"] for r in v.validate_split(df.union(df)).collect()}
    assert report["duplicate_key"] == 20 and report["missing_column"] == 0
    with pytest.raises(ValueError, match="duplicate_key"):
        v.require(v.validate_split(df.union(df)), "split")
    leaking = {r["rule"]: r["violations"] for r in v.validate_split(df, ["segment", "total_orders"]).collect()}
    assert leaking["forbidden_feature"] == 1 and leaking["missing_column"] == 1


def test_feature_distribution_makes_its_rows_once(spark):
    rows = spark.range(40).selectExpr("cast(id as double) as a", "if(id % 4 = 0, null, id % 3) as b")
    out = v.feature_distribution(rows, ["a", "b"])
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()  # sums and medians read the stored features
    got = {r["feature"]: (r["mean"], r["min"], r["max"], r["nulls"], r["median"]) for r in out.collect()}
    b = [i % 3 for i in range(40) if i % 4]
    assert got == {"a": (19.5, 0.0, 39.0, 0, 19.5), "b": (round(sum(b) / 30, 2), 0.0, 2.0, 10, float(sorted(b)[15]))}
