"""Published versions, the scoring job and the training job."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_churn import SD, model_rows

from stallkeeper.churn import evaluate as ev
from stallkeeper.churn import model as ml
from stallkeeper.churn import scoring_job as job
from stallkeeper.churn import training_job as tj
from stallkeeper.churn.config import MODEL_NAMES
from stallkeeper.sources.versions import Versions, write_text

AT = dt.datetime(2001, 7, 1, 6)


def test_only_whole_pointers_are_read(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/store")
    assert store.current() is None and store.published() == []
    with pytest.raises(LookupError, match="nothing is published"):
        store.read()
    first, unseen = store.write(spark.range(3)), store.write(spark.range(9))
    assert store.publish(first) == 1 and store.read().count() == 3
    handed_out = store.read()
    # another publisher has taken number 2 and not finished
    assert write_text(spark, f"{store.path}/pointers/{2:012d}", '{"vers', new=True)
    assert not write_text(spark, f"{store.path}/pointers/{2:012d}", "{}", new=True)
    assert store.read().count() == 3
    assert store.publish(unseen, by="me") == 3 and store.read().count() == 9
    assert [(p["number"], p.get("by")) for p in store.published()] == [(1, None), (3, "me")]
    assert handed_out.count() == 3
    assert store.drop_before(1) == [first] and store.read().count() == 9
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.table(first)


def snapshot(spark, n=40):
    rows = [(f"c{i}", SD, "email", "EU", "regular", i, 1 + i % 3, i % 2, None if i % 9 == 0 else 10.0 * i, 0.1 * (i % 4), 0.2 * (i % 4), int(i % 3 == 0))
            for i in range(n)]
    return spark.createDataFrame(rows, """customer_id string, score_date date, signup_channel string, region string, segment string,
        days_since_last_order bigint, total_orders bigint, orders_last_90d bigint, lifetime_spend double, return_order_rate double,
        discount_order_rate double, is_single_order_customer bigint""")


def by_recency(df):
    return df.withColumn("churn_probability", F.col("days_since_last_order") / 100)


def test_a_refused_run_leaves_the_last_table(spark, tmp_path):
    store, people = Versions(spark, f"{tmp_path}/scores"), snapshot(spark)
    score = lambda predict, day=0: job.run_scoring(store, people, predict, AT + dt.timedelta(days=day), 0.3, "m")
    broken = {
        "null_probability": lambda df: by_recency(df).withColumn("churn_probability", F.expr("if(customer_id = 'c7', null, churn_probability)")),
        "probability_out_of_range": lambda df: by_recency(df).withColumn("churn_probability", F.expr("if(customer_id = 'c7', 1.5, churn_probability)")),
        "unscored_customer": lambda df: by_recency(df).where("customer_id <> 'c7'"),
        "unknown_customer": lambda df: by_recency(df).withColumn("customer_id", F.expr("if(customer_id = 'c7', 'other', customer_id)")),
        "duplicate_key": lambda df: by_recency(df).union(by_recency(df).where("customer_id = 'c7'")),
        "empty": lambda df: by_recency(df).limit(0),
    }
    with pytest.raises(job.Refused):
        score(broken["empty"])
    with pytest.raises(LookupError):
        store.read()
    first = score(by_recency)
    for day, (rule, predict) in enumerate(broken.items(), 1):
        with pytest.raises(job.Refused, match=rule) as refused:
            score(predict, day)
        assert refused.value.violations[rule] == 1 or rule == "empty"
        assert store.current()["version"] == first
        assert {r["scored_at_utc"] for r in store.read().select("scored_at_utc").distinct().collect()} == {AT}
    second = score(by_recency, 9)
    assert store.current()["version"] == second and store.read().count() == 40
    status = {r["version"]: r["status"] for r in job.runs(store).select("version", "status").distinct().collect()}
    assert sorted(status.values()) == ["published"] * 2 + ["refused"] * 7 and status[first] == status[second] == "published"
    assert job.scores_of(spark, store.path).where("risk_decile = 1").count() == 4


def test_a_table_off_its_contract_is_refused(spark, tmp_path):
    from stallkeeper.churn.scores import score_output
    from stallkeeper.session import cut_lineage

    store = Versions(spark, f"{tmp_path}/scores")
    scores = score_output(cut_lineage(by_recency(snapshot(spark))), AT)
    with pytest.raises(job.Refused, match="schema_mismatch=2"):
        job.publish_scores(store, scores.withColumn("risk_decile", F.col("risk_decile").cast("long")), AT)
    job.publish_scores(store, scores, AT)


@pytest.fixture(scope="module")
def splits(spark):
    return [model_rows(spark, 500, seed) for seed in (7, 8, 9)]


def test_a_bundle_survives_its_session(spark, tmp_path, splits):
    store = Versions(spark, f"{tmp_path}/bundles")
    with pytest.raises(LookupError, match="no trained model"):
        tj.load_bundle(store)
    made = tj.run_training(store, *splits)
    assert made.selected in MODEL_NAMES.values() and set(made.metrics) == set(MODEL_NAMES.values())
    again = tj.load_bundle(Versions(spark.newSession(), store.path))
    for name in MODEL_NAMES.values():
        one, other = made.models[name], again.models[name]
        assert (one.threshold, one.class_weight, one.features, one.candidates) == (other.threshold, other.class_weight, other.features, other.candidates)
        want = {r[0]: r[1] for r in made.predict(splits[2], name).select("customer_id", "churn_probability").collect()}
        rows = again.predict(again.tables["predictions"].sparkSession.createDataFrame(splits[2].toArrow()), name)
        assert {r[0]: r[1] for r in rows.select("customer_id", "churn_probability").collect()} == want
        stored = {r[0]: r[1] for r in again.tables["predictions"].where(F.col("model_name") == name).select("customer_id", "churn_probability").collect()}
        assert stored == want
        table = again.tables["thresholds"].where(F.col("model_name") == name)
        assert table.count() == 91 and ev.choose_threshold(table).first()["threshold"] == one.threshold
    assert again.metrics == made.metrics and again.best.model_name == made.selected
    names = list(MODEL_NAMES.values())
    assert made.deltas["validation_pr_auc_delta"] == made.metrics[names[1]]["validation"]["pr_auc"] - made.metrics[names[0]]["validation"]["pr_auc"]
    # a run that fails leaves the bundle before it
    with pytest.raises(ValueError, match="duplicate_key"):
        tj.run_training(store, splits[0].union(splits[0]), *splits[1:])
    assert tj.load_bundle(store).metrics == made.metrics and len(store.published()) == 1


def test_the_better_family_on_validation_is_chosen():
    metrics = lambda *v: {"validation": dict(zip(tj.CHOICE, v))}
    assert tj.choose_family({"a": metrics(0.5, 0.9, 0.9), "b": metrics(0.6, 0.1, 0.1)}) == "b"
    assert tj.choose_family({"a": metrics(0.5, 0.2, 0.1), "b": metrics(0.5, 0.3, 0.0)}) == "b"
    assert tj.choose_family({"a": metrics(0.5, 0.2, 0.1), "b": metrics(0.5, 0.2, 0.1)}) == "a"


@pytest.mark.parametrize("balanced", [False, True])
def test_a_fit_has_no_gradient_left(spark, splits, balanced):
    pipeline, names, _ = ml.fit_pipeline(splits[0], True, balanced)
    trained = ml.Trained("m", "balanced" if balanced else "none", names, pipeline, [])
    rows = ml.certificate(trained, splits[0]).collect()
    assert [r["input"] for r in rows] == [*names, "intercept"] and all(r["within_tolerance"] for r in rows)
    # moved weights are told apart, and the gradient is that of the summed loss
    table = pipeline.stages[0].transform(splits[0])
    moved = pipeline.stages[-1].coefficients.toArray() + 0.1
    away = ml.gradient_table(table, names, moved, 0.0).collect()
    assert not all(r["within_tolerance"] for r in away)
    x = np.array([[r[f"x{i}"] for i in range(len(names))] for r in table.collect()])
    y = np.array([r["churned"] for r in table.collect()])
    gap = 1 / (1 + np.exp(-x @ moved)) - y
    assert np.allclose([r["gradient"] for r in away], [*(x.T @ gap + moved), gap.sum()])


def test_preprocessing_table(spark, splits):
    rows = {r["input"]: r for r in ml.preprocessing_table(splits[0], True).collect()}
    frame = splits[0].toPandas()
    spend = frame["lifetime_spend"]
    assert rows["num_lifetime_spend"]["fill"] == pytest.approx(spend.median()) and rows["num_lifetime_spend"]["mean"] == pytest.approx(spend.mean())
    assert rows["num_lifetime_spend"]["deviation"] == pytest.approx(spend.std(ddof=0))
    assert rows["missing_avg_days_between_orders"]["mean"] == pytest.approx(frame["avg_days_between_orders"].isna().mean())
    assert rows["bin_has_return"]["fill"] == frame["has_return"].mode()[0] and rows["channel_email"]["mean"] is None
    assert "missing_lifetime_spend" not in rows
