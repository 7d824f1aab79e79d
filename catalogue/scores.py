"""Evaluation, score table and model queries.

Operators that take a score are compared with SQL on a stand-in score made from recency and an id hash;
queries named ``model_*`` train the real model and have no SQL counterpart.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogue import testbed as tb
from catalogue.checks import EVERY_LAYER, LAYERS, SPECIAL, checked_tables, result_sql, rule_sql_for, special, suite_sql
from catalogue.churn import BASE, DATES, rule_sql
from catalogue.registry import Market, register
from catalogue.sqlbase import CTES, big, cents, cte, hash_bucket, mean_usd, pct, rnd, usd
from stallkeeper.churn import evaluate as ev
from stallkeeper.churn import features as ft
from stallkeeper.churn import model as ml
from stallkeeper.churn import scores as sc
from stallkeeper.churn import scoring_job as job
from stallkeeper.churn import training_job as tj
from stallkeeper.churn import validate as v
from stallkeeper.churn.config import BINARY_FEATURES, MODEL_NAMES, NUMERIC_FEATURES, SCORE_THRESHOLD
from stallkeeper.functions import hash_bucket as bucket
from stallkeeper.functions import rnd as round_to
from stallkeeper.operators.checks import check_summary, run_checks
from stallkeeper.operators.ranking import exact_quantile, global_rank
from stallkeeper.plans import retention as r
from stallkeeper.plans import suite
from stallkeeper.plans.dashboard import filter_values
from stallkeeper.session import cut_lineage, delete_at_exit, scratch_folder, shared_folder
from stallkeeper.sources.versions import Versions

SCORED_AT = dt.datetime(2001, 7, 1, 6, 0)
GRID = ev.threshold_grid()


def stand_in(df: DataFrame) -> DataFrame:
    level = F.col("days_since_last_order") + bucket("score", F.col("customer_id")) % 30
    return df.withColumn("_l", level).withColumn(
        "churn_probability", F.expr("((1000000L * _l) div (_l + 120L)) / 1000000D")
    ).drop("_l")


LEVEL = f"(days_since_last_order + {hash_bucket('score', 'customer_id')} % 30)"
PROB = f"((1000000 * {LEVEL}) // ({LEVEL} + 120)) / 1e6 AS churn_probability"
cte("scored_test", f"SELECT *, {PROB} FROM model_snapshots WHERE snapshot_date = DATE '{tb.TEST}'")
cte("scored_now", f"SELECT * EXCLUDE (snapshot_date), snapshot_date AS score_date, {PROB} FROM score_snapshots")
cte("ranked_test", """
SELECT *, row_number() OVER (ORDER BY churn_probability DESC, md5(customer_id), customer_id) AS r,
  row_number() OVER (ORDER BY churn_probability, md5(customer_id), customer_id) AS up, count(*) OVER () AS n
FROM scored_test
""")


def scored_test(m: Market) -> DataFrame:
    return cut_lineage(stand_in(ft.build_snapshots(m.gold_stored, [tb.TEST])))


def scored_now(m: Market) -> DataFrame:
    return cut_lineage(stand_in(ft.scoring_snapshot(m.gold_stored, tb.SCORE)))


def score_table(m: Market) -> DataFrame:
    return sc.score_output(scored_now(m), SCORED_AT)


# --- evaluation ---
THRESHOLDS = ", ".join(f"({t!r}::DOUBLE, {round(t, 2)!r}::DOUBLE)" for t in GRID)


def safe(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0e0)"


cte("threshold_rows", f"""
SELECT 'stand_in' AS model_name, name AS threshold, {safe('tp', 'pp')} AS precision, {safe('tp', 'p')} AS recall,
  {safe('2e0 * tp', 'pp + p')} AS f1, {safe('pp', 'n')} AS predicted_positive_rate, pp AS predicted_positive_customers
FROM (SELECT name, count(*) FILTER (churn_probability >= t) AS pp,
    count(*) FILTER (churn_probability >= t AND churned = 1) AS tp, count(*) AS n, {big('sum(churned)')} AS p
  FROM scored_test CROSS JOIN (VALUES {THRESHOLDS}) AS g(t, name) GROUP BY t, name)
""")
register("threshold_table", lambda m: ev.threshold_table(scored_test(m), "stand_in"), "SELECT * FROM threshold_rows")
register(
    "choose_threshold",
    lambda m: ev.choose_threshold(ev.threshold_table(scored_test(m), "stand_in")),
    "SELECT * FROM threshold_rows ORDER BY f1 DESC, recall DESC, precision DESC, threshold LIMIT 1",
)
T = SCORE_THRESHOLD
cte("confusion", f"""
SELECT *, {safe('churners', '"rows"')} AS churn_rate, {T}::DOUBLE AS threshold, {safe('tp', 'pp')} AS precision,
  {safe('tp', 'churners')} AS recall, {safe('2e0 * tp', 'pp + churners')} AS f1,
  {safe('pp', '"rows"')} AS predicted_positive_rate, pp AS predicted_positive_customers
FROM (SELECT *, true_positive AS tp, true_positive + false_positive AS pp
  FROM (SELECT count(*) AS "rows", {big('sum(churned)')} AS churners,
    count(*) FILTER (churned = 0 AND churn_probability < {T}) AS true_negative,
    count(*) FILTER (churned = 0 AND churn_probability >= {T}) AS false_positive,
    count(*) FILTER (churned = 1 AND churn_probability < {T}) AS false_negative,
    count(*) FILTER (churned = 1 AND churn_probability >= {T}) AS true_positive FROM scored_test))
""")
register("confusion", lambda m: ev.confusion(scored_test(m), T), "SELECT * EXCLUDE (tp, pp) FROM confusion")
cte("score_groups", """
SELECT *, sum(n) OVER (ORDER BY churn_probability DESC) AS run_n, sum(pos) OVER (ORDER BY churn_probability DESC) AS run_pos,
  sum(pos) OVER () AS p, sum(n) OVER () AS total
FROM (SELECT churn_probability, count(*) AS n, sum(churned) AS pos FROM scored_test GROUP BY 1)
""")
AUC = """CAST(sum((n - pos) * (2 * (run_pos - pos) + pos)) AS DOUBLE) / (2e0 * max(p) * (max(total) - max(p)))"""
AP = rnd("sum(CAST(pos AS DOUBLE) / p * (CAST(run_pos AS DOUBLE) / run_n))", 9)
BRIER = rnd("avg((churn_probability - churned) * (churn_probability - churned))", 9)
register("roc_auc", lambda m: ev.roc_auc(scored_test(m)), f"SELECT {AUC} AS roc_auc FROM score_groups")
register(
    "average_precision",
    lambda m: ev.average_precision(scored_test(m)).select(round_to("pr_auc", 9).alias("pr_auc")),
    f"SELECT {AP} AS pr_auc FROM score_groups",
)
register(
    "brier",
    lambda m: ev.brier(scored_test(m)).select(round_to("brier_score", 9).alias("brier_score")),
    f"SELECT {BRIER} AS brier_score FROM scored_test",
)


def top_sql(f: float) -> str:
    return f"""SELECT {f}::DOUBLE AS fraction, k AS customers, c AS captured_churners, {safe('c', 'k')} AS precision,
  {safe('c', 'p')} AS recall, {safe(safe('c', 'k'), '(CAST(p AS DOUBLE) / n)')} AS lift
FROM (SELECT count(*) FILTER (r <= greatest(1, ceil(n * {f}::DOUBLE))) AS k,
    {big(f'coalesce(sum(churned) FILTER (r <= greatest(1, ceil(n * {f}::DOUBLE))), 0)')} AS c,
    {big('sum(churned)')} AS p, count(*) AS n FROM ranked_test)"""


register(
    "top_fractions",
    lambda m: ev.top_fractions(scored_test(m), [0.1, 0.2]),
    f"{top_sql(0.1)} UNION ALL {top_sql(0.2)}",
)
tops = " CROSS JOIN ".join(
    f"(SELECT customers AS top_{n}_customers, captured_churners AS top_{n}_captured_churners, "
    f"precision AS top_{n}_precision, recall AS top_{n}_recall, lift AS top_{n}_lift FROM ({top_sql(f)}))"
    for f, n in ((0.1, "10_pct"), (0.2, "20_pct"))
)
EVALUATE_SQL = f"""SELECT * EXCLUDE (tp, pp) FROM confusion CROSS JOIN (SELECT {AUC} AS roc_auc, {AP} AS pr_auc FROM score_groups)
CROSS JOIN (SELECT {BRIER} AS brier_score FROM scored_test) CROSS JOIN {tops}"""
register(
    "evaluate",
    lambda m: ev.evaluate(scored_test(m), T).withColumns(
        {"pr_auc": round_to("pr_auc", 9), "brier_score": round_to("brier_score", 9)}),
    EVALUATE_SQL,
)
register(
    "prediction_frame",
    lambda m: ev.prediction_frame(scored_test(m), "stand_in", T),
    f"""SELECT customer_id, snapshot_date, churned, 'stand_in' AS model_name, churn_probability,
  {T}::DOUBLE AS selected_threshold, {big(f'CASE WHEN churn_probability >= {T} THEN 1 ELSE 0 END')} AS predicted_churn,
  {big("least(greatest(ceil(CAST(up AS DOUBLE) / n * 1e1), 1), 10)")} AS risk_decile FROM ranked_test""",
)
register(
    "global_rank",
    lambda m: global_rank(m.gold.mart_customer_ltv.select("customer_id", "total_orders"), "total_orders", "customer_id"),
    """SELECT customer_id, total_orders, row_number() OVER (ORDER BY total_orders DESC, md5(customer_id), customer_id) AS rank,
  count(*) OVER () AS rank_n FROM mart_customer_ltv""",
)
register(
    "spend_quantile",
    lambda m: exact_quantile(m.gold.mart_customer_ltv, "lifetime_revenue_cents", 0.8, ["segment"], "p80"),
    "SELECT segment, quantile_cont(lifetime_revenue_cents, 0.8) AS p80 FROM mart_customer_ltv GROUP BY segment",
)

# --- score table and its views ---
cte("score_rows", f"""
SELECT customer_id, score_date, signup_channel, region, segment, CAST(days_since_last_order AS INTEGER) AS days_since_last_order,
  CAST(total_orders AS INTEGER) AS total_orders, CAST(orders_last_90d AS INTEGER) AS orders_last_90d, lifetime_spend,
  return_order_rate, discount_order_rate, CAST(is_single_order_customer AS INTEGER) AS is_single_order_customer,
  churn_probability, CASE WHEN churn_probability >= {T} THEN 1 ELSE 0 END AS predicted_churn_flag, risk_decile,
  risk_segment, CASE WHEN risk_segment = 'high_risk' AND coalesce(lifetime_spend, 0) >= cutoff
      THEN 'priority_retention_outreach'
    WHEN risk_segment = 'high_risk' AND return_order_rate >= 0.25 THEN 'service_recovery_review'
    WHEN risk_segment = 'high_risk' AND discount_order_rate >= 0.5 THEN 'targeted_retention_incentive'
    WHEN risk_segment = 'high_risk' THEN 'standard_retention_campaign'
    WHEN risk_segment = 'medium_risk' THEN 'low_cost_reengagement' ELSE 'no_immediate_action' END AS recommended_action,
  CASE WHEN lifetime_spend IS NULL THEN 1 ELSE 0 END AS lifetime_spend_missing_flag, {T}::DOUBLE AS probability_threshold,
  'behavioral_only' AS model_name, 'churn_v1' AS model_version, TIMESTAMP '{SCORED_AT}' AS scored_at_utc
FROM (SELECT *, CASE WHEN risk_decile <= 2 THEN 'high_risk' WHEN risk_decile <= 5 THEN 'medium_risk' ELSE 'low_risk' END
    AS risk_segment
  FROM (SELECT *, CAST(greatest(1, ceil((place - 1) * 1e1 / (n - 1))) AS INTEGER) AS risk_decile
    FROM (SELECT *, count(*) OVER () AS n, (SELECT quantile_cont(lifetime_spend, 0.8) FROM scored_now) AS cutoff,
        row_number() OVER (ORDER BY churn_probability DESC, md5(customer_id), customer_id) AS place FROM scored_now)))
""")
register("churn_scores", score_table, "SELECT * FROM score_rows")
cte("score_view", "SELECT * REPLACE (replace(risk_segment, '_risk', '') AS risk_segment) FROM score_rows")


def view(m: Market) -> DataFrame:
    return r.with_labels(score_table(m))


MEAN_P = "(CAST(sum(CAST(floor(churn_probability * 1e6 + 0.5) AS BIGINT)) AS DOUBLE) / count(churn_probability) / 1e6)"
SPEND = cents("lifetime_spend")
register(
    "filter_scores",
    lambda m: r.filter_scores(view(m), risk=["high", "medium"], region=["ASIA"], action=[]),
    "SELECT * FROM score_view WHERE risk_segment IN ('high', 'medium') AND region = 'ASIA'",
)
register(
    "churn_kpis",
    lambda m: r.churn_kpis(view(m)),
    f"""SELECT count(*) AS customers_scored, count(*) FILTER (risk_segment = 'high') AS high_risk_customers,
  count(*) FILTER (predicted_churn_flag = 1) AS threshold_positive, {rnd(MEAN_P, 6)} AS average_probability,
  {usd(f"coalesce(sum({SPEND}) FILTER (risk_segment = 'high'), 0)")} AS high_risk_spend FROM score_view""",
)
register(
    "risk_distribution",
    lambda m: r.risk_distribution(view(m)),
    """SELECT risk_segment, count(*) AS customers, upper(risk_segment[1]) || risk_segment[2:] || ' Risk' AS risk_label,
  CAST(list_position(['high', 'medium', 'low'], risk_segment) AS BIGINT) AS place FROM score_view GROUP BY risk_segment""",
)
register(
    "probability_histogram",
    lambda m: r.probability_histogram(view(m)),
    f"""SELECT bin, count(*) AS customers, bin / 4e1 AS bin_start, (bin + 1) / 4e1 AS bin_end
FROM (SELECT {big('least(floor(churn_probability * 4e1), 39)')} AS bin FROM score_view) GROUP BY bin""",
)
register(
    "decile_profile",
    lambda m: r.decile_profile(view(m)),
    f"""SELECT risk_decile, count(*) AS customers, {rnd(MEAN_P, 6)} AS avg_probability,
  {usd(f'coalesce(sum({SPEND}), 0)')} AS lifetime_spend FROM score_view GROUP BY risk_decile""",
)
WORDS = "array_to_string(list_transform(string_split(recommended_action, '_'), lambda w: upper(w[1]) || w[2:]), ' ')"
register(
    "action_counts",
    lambda m: r.action_counts(view(m)),
    f"""SELECT recommended_action, count(*) AS customers, {WORDS} AS action_label FROM score_view GROUP BY recommended_action""",
)
register(
    "intervention_queue",
    lambda m: r.intervention_queue(view(m)),
    """SELECT customer_id, churn_probability * 1e2 AS churn_probability, risk_decile, lifetime_spend, days_since_last_order,
  total_orders, orders_last_90d, return_order_rate * 1e2 AS return_order_rate,
  discount_order_rate * 1e2 AS discount_order_rate, signup_channel, region, recommended_action
FROM score_view v WHERE risk_segment = 'high'
ORDER BY v.lifetime_spend DESC NULLS LAST, v.churn_probability DESC, customer_id LIMIT 100""",
)
register(
    "score_summary_by_risk",
    lambda m: r.score_summary_by_risk(score_table(m)),
    f"""SELECT *, {pct('customers', 'sum(customers) OVER ()')} AS share_pct
FROM (SELECT risk_segment, count(*) AS customers, {rnd(MEAN_P, 3)} AS avg_probability,
  {mean_usd(f'sum({SPEND})', f'count({SPEND})')} AS avg_lifetime_spend FROM score_rows GROUP BY risk_segment)""",
)
register(
    "score_summary_by_action",
    lambda m: r.score_summary_by_action(score_table(m)),
    f"""SELECT *, {pct('customers', 'sum(customers) OVER ()')} AS share_pct
FROM (SELECT recommended_action, count(*) AS customers FROM score_rows GROUP BY recommended_action)""",
)
register(
    "score_headline",
    lambda m: r.score_headline(score_table(m)),
    f"""SELECT max(score_date) AS score_date, count(*) AS customers_scored, {rnd(MEAN_P, 3)} AS average_probability,
  {big('sum(predicted_churn_flag)')} AS threshold_positive, {pct('sum(predicted_churn_flag)', 'count(*)')} AS threshold_positive_pct,
  {big('sum(lifetime_spend_missing_flag)')} AS missing_spend_values FROM score_rows""",
)
register(
    "missing_spend_count",
    lambda m: r.missing_spend_count(score_table(m)),
    f"SELECT {big('sum(lifetime_spend_missing_flag)')} AS missing_spend_values FROM score_rows",
)
register(
    "top_risk_customers",
    lambda m: r.top_customers(score_table(m)),
    f"""SELECT customer_id, {rnd('churn_probability', 4)} AS churn_probability, risk_decile,
  {rnd('lifetime_spend')} AS lifetime_spend, days_since_last_order, recommended_action
FROM score_rows s ORDER BY s.churn_probability DESC, s.lifetime_spend DESC NULLS LAST, customer_id LIMIT 10""",
)
register(
    "score_filter_values",
    lambda m: filter_values(
        view(m), ["risk_segment", "region", "signup_channel", "recommended_action"]),
    " UNION ALL ".join(
        f"SELECT DISTINCT '{c}' AS filter, {c} AS value FROM score_view WHERE {c} IS NOT NULL"
        for c in ("risk_segment", "region", "signup_channel", "recommended_action")
    ),
)
register(
    "validate_scores",
    lambda m: v.validate_scores(score_table(m)),
    BASE.format("score_rows", "customer_id") + " UNION ALL " + rule_sql({
        "null_customer_id": "customer_id IS NULL",
        "null_probability": "churn_probability IS NULL",
        "invalid_predicted_flag": "predicted_churn_flag NOT IN (0, 1)",
        "invalid_missing_spend_flag": "lifetime_spend_missing_flag NOT IN (0, 1)",
        "probability_out_of_range": "churn_probability NOT BETWEEN 0 AND 1",
        "unexpected_risk_segment": "risk_segment NOT IN ('high_risk', 'medium_risk', 'low_risk')",
        "decile_out_of_range": "risk_decile NOT BETWEEN 1 AND 10",
    }, "score_rows"),
)


NO_SCORE = f"{hash_bucket('broken', 'customer_id')} % 10 = 0"
cte("broken_rows", "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {NO_SCORE} THEN NULL ELSE {c} END AS {c}"
    for c in ("churn_probability", "predicted_churn_flag", "risk_segment", "risk_decile")) + ") FROM score_rows")


def broken_scores(m: Market) -> DataFrame:
    """The score table of a snapshot in which one customer in ten has no score."""
    p = F.when(bucket("broken", F.col("customer_id")) % 10 != 0, F.col("churn_probability"))
    return sc.score_output(cut_lineage(scored_now(m).withColumn("churn_probability", p)), SCORED_AT)


register(
    "validate_scores_broken",
    lambda m: v.validate_scores(broken_scores(m)),
    BASE.format("broken_rows", "customer_id") + " UNION ALL " + rule_sql({
        "null_customer_id": "customer_id IS NULL",
        "null_probability": "churn_probability IS NULL",
        "invalid_predicted_flag": "coalesce(predicted_churn_flag NOT IN (0, 1), true)",
        "invalid_missing_spend_flag": "lifetime_spend_missing_flag NOT IN (0, 1)",
        "probability_out_of_range": "coalesce(churn_probability NOT BETWEEN 0 AND 1, true)",
        "unexpected_risk_segment": "coalesce(risk_segment NOT IN ('high_risk', 'medium_risk', 'low_risk'), true)",
        "decile_out_of_range": "coalesce(risk_decile NOT BETWEEN 1 AND 10, true)",
    }, "broken_rows"),
)


def score_checks(m: Market) -> DataFrame:
    scores = cut_lineage(score_table(m))
    tables = {"scores": scores, "dim_customers": m.gold.dim_customers}
    return run_checks(tables, suite.score_suite(), suite.score_checks(scores))


LAYERS_SCORED = {**LAYERS, "scores": "score_rows", "dim_customers": "dim_customers"}
SCORE_CHECKS_SQL = rule_sql_for(suite.score_suite(), LAYERS_SCORED, [
    result_sql("flag_matches_scores_lifetime_spend_missing_flag", "scores", "error",
               "SELECT count(*) AS n FROM score_rows WHERE (lifetime_spend IS NULL) <> (lifetime_spend_missing_flag = 1)"),
    result_sql("in_unit_range_scores_churn_probability", "scores", "error",
               "SELECT count(*) AS n FROM score_rows WHERE churn_probability IS NULL OR churn_probability NOT BETWEEN 0 AND 1"),
    result_sql("matches_decile_scores_risk_segment", "scores", "error",
               "SELECT count(*) AS n FROM score_rows WHERE risk_segment <> CASE WHEN risk_decile <= 2 THEN 'high_risk' "
               "WHEN risk_decile <= 5 THEN 'medium_risk' ELSE 'low_risk' END"),
])
register("checks_scores", score_checks, SCORE_CHECKS_SQL)


def all_checks(m: Market) -> DataFrame:
    """Every check of every layer."""
    return run_checks(checked_tables(m), EVERY_LAYER, special(m)).unionByName(score_checks(m))


register(
    "checks_summary",
    lambda m: check_summary(all_checks(m)),
    f"SELECT status, count(*) AS checks FROM ({suite_sql(EVERY_LAYER, SPECIAL)} UNION ALL {SCORE_CHECKS_SQL}) GROUP BY status",
)

# --- the trained model ---
def bundle(m: Market) -> tj.Bundle:
    """The saved training run of this application over this folder; the first query that asks for it trains."""
    spark = m.spark
    name = hashlib.md5(m.folder.encode()).hexdigest()
    path = f"{shared_folder(spark)}/churn-{spark.sparkContext.applicationId}-{name}"
    store = Versions(spark, path)
    if store.current() is None:
        delete_at_exit(spark, path)
        day, rows = F.col("snapshot_date"), cut_lineage(ft.build_snapshots(m.gold_stored, DATES, units=m.customer_units))
        tj.run_training(store, rows.where(day.isin(*tb.TRAIN)), rows.where(day == tb.VALIDATION), rows.where(day == tb.TEST))
    return tj.load_bundle(store)


def metric_rows(m: Market, split: str) -> DataFrame:
    rows = [bundle(m).metrics[name][split] for name in MODEL_NAMES.values()]
    order = list(rows[0])
    kinds = {str: "string", int: "long", float: "double"}
    return m.spark.createDataFrame([tuple(r[c] for c in order) for r in rows], ", ".join(f"{c} {kinds[type(rows[0][c])]}" for c in order))


def family_row(m: Market, split: str, family: str) -> DataFrame:
    return metric_rows(m, split).where(F.col("model_name") == MODEL_NAMES[family])


def certified(m: Market) -> DataFrame:
    """The gradient at the fitted weights of both families; all of it is within tolerance where the fit is done."""
    rows = cut_lineage(ft.build_snapshots(m.gold_stored, tb.TRAIN, units=m.customer_units))
    parts = [ml.certificate(bundle(m).models[name], rows).withColumn("model_name", F.lit(name)) for name in MODEL_NAMES.values()]
    return parts[0].unionByName(parts[1])


register("model_coefficients", lambda m: bundle(m).tables["coefficients"])
register("model_candidates", lambda m: m.spark.createDataFrame(
    [(f, c["class_weight"], c["pr_auc"], c["top_20_recall"], c["roc_auc"])
     for f, name in MODEL_NAMES.items() for c in bundle(m).models[name].candidates],
    "family string, class_weight string, pr_auc double, top_20_recall double, roc_auc double"))
register("model_test_metrics", lambda m: metric_rows(m, "test"))
register("model_comparison", lambda m: ev.compare_models(family_row(m, "test", "behavioral"), family_row(m, "test", "channel")))
register("model_deltas", lambda m: m.spark.createDataFrame(list(bundle(m).deltas.items()), "metric string, delta double"))
# the family is chosen before the test split is looked at
register("model_selection", lambda m: ev.select_model(metric_rows(m, "validation")))
register("model_certificate", certified)
register("model_predictions", lambda m: bundle(m).tables["predictions"])
register("model_probability_violations", lambda m: ml.probability_violations(bundle(m).tables["predictions"]))


def model_scores(m: Market) -> DataFrame:
    """The scoring job with the chosen family, and the table that it published."""
    b = bundle(m)
    store = Versions(m.spark, scratch_folder(m.spark, "scores"))
    job.run_scoring(store, ft.scoring_snapshot(m.gold_stored, tb.SCORE, m.customer_units), b.predict, SCORED_AT, T, b.selected, b.model_version)
    return store.read()


register("model_scores", model_scores)


# --- guarded publication ---
def guarded(m: Market) -> Versions:
    """Three runs of the scoring job: a sound one, one in which customers lack a score, one that loses customers."""
    snapshot = cut_lineage(ft.scoring_snapshot(m.gold_stored, tb.SCORE))
    lacking = F.when(bucket("broken", F.col("customer_id")) % 10 != 0, F.col("churn_probability"))
    runs = [stand_in, lambda df: stand_in(df).withColumn("churn_probability", lacking),
            lambda df: stand_in(df).where(bucket("broken", F.col("customer_id")) % 10 != 1)]
    store = Versions(m.spark, scratch_folder(m.spark, "scores"))
    for day, predict in enumerate(runs):
        try:
            job.run_scoring(store, snapshot, predict, SCORED_AT + dt.timedelta(days=day), T, MODEL_NAMES["behavioral"])
        except job.Refused:
            pass  # the table of the run before stays readable; ``runs`` has the reasons
    return store


# what readers see after a refused run is the last sound table
register("published_scores", lambda m: guarded(m).read(), "SELECT * FROM score_rows")
NO_CUSTOMER = f"{hash_bucket('broken', 'customer_id')} % 10 = 1"
RULES = ("empty", "duplicate_key", "null_customer_id", "null_probability", "invalid_predicted_flag", "invalid_missing_spend_flag",
         "probability_out_of_range", "unexpected_risk_segment", "decile_out_of_range", "schema_mismatch", "unscored_customer", "unknown_customer")
BY_LACK = ("null_probability", "invalid_predicted_flag", "probability_out_of_range", "unexpected_risk_segment", "decile_out_of_range")


def runs_sql() -> str:
    lines = []
    for day, (status, broken) in enumerate((("published", {}), ("refused", dict.fromkeys(BY_LACK, NO_SCORE)), ("refused", {"unscored_customer": NO_CUSTOMER}))):
        for rule in RULES:
            n = f"(SELECT count(*) FROM score_rows WHERE {broken[rule]})" if rule in broken else "CAST(0 AS BIGINT)"
            lines.append(f"SELECT '{status}' AS status, '{rule}' AS rule, {n} AS violations, TIMESTAMP '{SCORED_AT + dt.timedelta(days=day)}' AS run_at")
    return " UNION ALL ".join(lines)


register("scoring_runs", lambda m: job.runs(guarded(m)).drop("version"), runs_sql())


# --- preprocessing, gradient and choice against SQL ---
def train_rows(m: Market) -> DataFrame:
    return cut_lineage(ft.build_snapshots(m.gold_stored, tb.TRAIN))


TRAIN_DAYS = ", ".join(f"DATE '{d}'" for d in tb.TRAIN)
cte("train_rows", f"SELECT *, row_number() OVER () AS rid FROM model_snapshots WHERE snapshot_date IN ({TRAIN_DAYS})")


def inputs_sql() -> str:
    """rid, churned, place, input, kind, fill and value before centring, of every training row."""
    parts, at = [], 0

    def add(name, kind, fill, value, where="true"):
        nonlocal at
        parts.append(f"SELECT rid, churned, {at} AS place, '{name}' AS input, '{kind}' AS kind, {fill} AS fill, CAST({value} AS DOUBLE) AS v "
                     f"FROM train_rows WHERE {where}")
        at += 1

    for c in NUMERIC_FEATURES:
        middle = f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM train_rows)"
        add(f"num_{c}", "numeric", f"coalesce({middle}, 0e0)", f"coalesce({c}, {middle}, 0e0)")
    for c in NUMERIC_FEATURES:
        add(f"missing_{c}", "missing", "NULL", f"{c} IS NULL", f"(SELECT count(*) FROM train_rows WHERE {c} IS NULL) > 0")
    for c in BINARY_FEATURES:
        often = f"(SELECT {c} FROM train_rows WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        add(f"bin_{c}", "binary", f"CAST({often} AS DOUBLE)", f"coalesce({c}, {often})")
    channels = (f"SELECT rid, churned, {at} AS place, 'channel_' || ch AS input, 'channel' AS kind, NULL AS fill, "
                "CAST(coalesce(signup_channel, '') = ch AS DOUBLE) AS v "
                "FROM train_rows JOIN (SELECT DISTINCT signup_channel AS ch FROM train_rows WHERE signup_channel IS NOT NULL) ON true")
    return " UNION ALL ".join([*parts, channels])


cte("model_inputs", inputs_sql())
cte("input_table", """
SELECT row_number() OVER (ORDER BY place, input) - 1 AS place, input, kind, max(fill) AS fill,
  CASE WHEN kind IN ('numeric', 'missing') THEN avg(v) END AS mean,
  CASE WHEN kind IN ('numeric', 'missing') THEN stddev_pop(v) END AS deviation
FROM model_inputs GROUP BY place, input, kind
""")
register(
    "model_preprocessing",
    lambda m: ml.preprocessing_table(train_rows(m), include_channel=True).withColumns(
        {c: round_to(c, 6) for c in ("fill", "mean", "deviation")}),
    f"SELECT place, input, kind, {', '.join(f'{rnd(c, 6)} AS {c}' for c in ('fill', 'mean', 'deviation'))} FROM input_table",
)


def stand_in_weight(name: str) -> float:
    """A weight for every input, made from its name."""
    return (int(hashlib.md5(f"weight|{name}".encode()).hexdigest()[:7], 16) % 21 - 10) / 20


def gradient_at_stand_in(m: Market) -> DataFrame:
    rows = train_rows(m)
    inputs = ml.fit_inputs(rows, include_channel=True)
    names = [x.name for x in inputs]
    out = ml.gradient_table(cut_lineage(ml.prepared(rows, inputs)), names, [stand_in_weight(n) for n in names], 0.25)
    return out.withColumn("gradient", round_to("gradient", 6))


cte("weighted_inputs", f"""
SELECT rid, churned, m.input, ({hash_bucket('weight', 'm.input')} % 21 - 10) / 2e1 AS w,
  CASE WHEN t.mean IS NULL THEN v WHEN t.deviation = 0 THEN v - t.mean ELSE (v - t.mean) / t.deviation END AS x
FROM model_inputs m JOIN input_table t ON m.input = t.input
""")
cte("row_gaps", """
SELECT rid, 1e0 / (1e0 + exp(-(sum(w * x) + 25e-2))) - max(churned) AS gap FROM weighted_inputs GROUP BY rid
""")
cte("gradient_rows", """
SELECT input, max(w) AS weight, sum(gap * x) + max(w) AS gradient FROM weighted_inputs JOIN row_gaps USING (rid) GROUP BY input
UNION ALL SELECT 'intercept', 25e-2, sum(gap) FROM row_gaps
""")
register("gradient_at_stand_in", gradient_at_stand_in, f"""
SELECT input, weight, {rnd('gradient', 6)} AS gradient, abs(gradient) <= 1e-4 * (SELECT count(*) FROM train_rows) AS within_tolerance
FROM gradient_rows""")
register(
    "stand_in_coefficients",
    lambda m: ml.with_direction(m.spark.createDataFrame(
        [("stand_in", x.name, stand_in_weight(x.name)) for x in ml.fit_inputs(train_rows(m), include_channel=True)],
        "model_name string, feature string, coefficient double")),
    """SELECT 'stand_in' AS model_name, input AS feature, weight AS coefficient, abs(weight) AS absolute_coefficient,
  CASE WHEN weight >= 0 THEN 'increases_churn_risk' ELSE 'decreases_churn_risk' END AS direction
FROM gradient_rows WHERE input <> 'intercept'""",
)


def other_score(df: DataFrame) -> DataFrame:
    """A second stand-in, worse than the first."""
    noise = bucket("other", F.col("customer_id")) % 500
    return df.withColumn("_l", F.col("days_since_last_order") + noise).withColumn(
        "churn_probability", F.expr("((1000000L * _l) div (_l + 120L)) / 1000000D")).drop("_l")


OTHER = f"(days_since_last_order + {hash_bucket('other', 'customer_id')} % 500)"
cte("other_test", f"""SELECT *, ((1000000 * {OTHER}) // ({OTHER} + 120)) / 1e6 AS churn_probability
FROM model_snapshots WHERE snapshot_date = DATE '{tb.TEST}'""")


def for_other(text: str) -> str:
    for name, other in (("scored_test", "other_test"), ("ranked_test", "other_ranked"), ("score_groups", "other_groups"), ("confusion", "other_confusion")):
        text = re.sub(rf"\b{name}\b", other, text)
    return text


for name, other in (("ranked_test", "other_ranked"), ("score_groups", "other_groups"), ("confusion", "other_confusion")):
    cte(other, for_other(CTES[name]))
METRICS_SQL = (f"SELECT 'behavioral_only' AS model_name, 'none' AS class_weight, * FROM ({EVALUATE_SQL}) UNION ALL "
               f"SELECT 'behavioral_plus_channel', 'none', * FROM ({for_other(EVALUATE_SQL)})")


def stand_in_metrics(m: Market) -> DataFrame:
    """Evaluation rows of two stand-in scores under the names of the two families."""
    snapshot = cut_lineage(ft.build_snapshots(m.gold_stored, [tb.TEST]))
    parts = []
    for name, score in ((MODEL_NAMES["behavioral"], stand_in), (MODEL_NAMES["channel"], other_score)):
        parts.append(ml.metrics_row(ml.Trained(name, "none", [], None, [], T), cut_lineage(score(snapshot))))
    rows = parts[0].unionByName(parts[1])
    return cut_lineage(rows.withColumns({"pr_auc": round_to("pr_auc", 9), "brier_score": round_to("brier_score", 9)}))


register("stand_in_metrics", stand_in_metrics, METRICS_SQL)
register("stand_in_selection", lambda m: ev.select_model(stand_in_metrics(m)),
         f"SELECT * FROM ({METRICS_SQL}) ORDER BY pr_auc DESC, top_20_pct_recall DESC, roc_auc DESC, model_name LIMIT 1")


def stand_in_comparison(m: Market) -> DataFrame:
    rows = stand_in_metrics(m)
    return ev.compare_models(*[rows.where(F.col("model_name") == name) for name in MODEL_NAMES.values()])


COMPARED = ("roc_auc", "pr_auc", "precision", "recall", "f1", "top_10_pct_lift", "top_20_pct_recall")
register("stand_in_comparison", stand_in_comparison, "SELECT " + ", ".join(
    f"a.{c} AS base_{c}, b.{c} AS other_{c}, b.{c} - a.{c} AS {c}_delta" for c in COMPARED) +
    f" FROM ({METRICS_SQL}) a, ({METRICS_SQL}) b WHERE a.model_name = 'behavioral_only' AND b.model_name = 'behavioral_plus_channel'")
