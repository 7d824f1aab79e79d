"""Table operators on small frames, compared with brute force."""

import datetime as dt
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallkeeper.operators import checks, clean, facts, joins, profile
from stallkeeper.operators.dedupe import dedupe, duplicate_summary, near_duplicates
from stallkeeper.operators.ranking import (exact_quantile, global_rank, ntile, ordered_blocks, pct_rank_decile, qcut_decile,
                                            running_sums)
from stallkeeper.sources import io
from stallkeeper.sources.schemas import ENTITIES, raw_schema, score_schema

T = dt.datetime


def test_dedupe_ties_nulls_and_keep(spark, rows):
    df = spark.createDataFrame(
        [("k", "b", T(2001, 1, 1), 1), ("k", "a", T(2001, 1, 1), 2), ("k", "c", None, 3), ("j", "d", None, 4),
         (None, "e", T(2001, 1, 1), 5)],
        "key string, id string, at timestamp_ntz, v int",
    )
    first = {r["key"]: r["v"] for r in dedupe(df, "key", "at", "id", "first").collect()}
    assert first == {"k": 2, "j": 4, None: 5}
    last = {r["key"]: r["v"] for r in dedupe(df, "key", "at", "id", "last", drop_null_key=True).collect()}
    assert last == {"k": 1, "j": 4}
    assert dedupe(df, "key", "at", "id").columns == df.columns
    assert rows(duplicate_summary(df, "key")) == [(5, 2, 3)]
    with pytest.raises(ValueError):
        dedupe(df, "key", "at", "id", "middle")


def test_near_duplicates_against_pairs(spark):
    rng = random.Random(1)
    base = T(2001, 1, 1)
    data = [(f"p{i:03d}", f"o{rng.randrange(4)}", float(rng.randrange(2)), base + dt.timedelta(seconds=rng.randrange(400)))
            for i in range(120)]
    df = spark.createDataFrame(data, "id string, order_id string, amount double, at timestamp_ntz")
    got = {r["id"] for r in near_duplicates(df, "id", ["order_id", "amount"], "at", 5).collect()}
    want = {
        a[0] for a in data for b in data
        if a[1:3] == b[1:3] and (b[3], b[0]) < (a[3], a[0]) and (a[3] - b[3]).total_seconds() <= 5
    }
    assert got == want and want


def brute_rank(data, descending=True):
    key = (lambda r: (-r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0])) if descending else (
        lambda r: (r[1], hashlib.md5(r[0].encode()).hexdigest(), r[0]))
    return {r[0]: i + 1 for i, r in enumerate(sorted(data, key=key))}


@pytest.mark.parametrize("descending", [True, False])
def test_global_rank_with_a_hot_value(spark, descending):
    rng = random.Random(2)
    # a third of the rows share one score
    data = [(f"c{i}", 0.25 if i % 3 == 0 else round(rng.random(), 3)) for i in range(3000)]
    df = spark.createDataFrame(data, "id string, score double")
    got = {r["id"]: r["rank"] for r in global_rank(df, "score", "id", descending=descending, most=40).collect()}
    assert got == brute_rank(data, descending)


@pytest.mark.parametrize("n", [1, 2, 10, 11, 19])
def test_global_rank_all_equal_and_small(spark, n):
    data = [(f"c{i}", 1.0) for i in range(n)]
    df = spark.createDataFrame(data, "id string, score double")
    got = {r["id"]: (r["rank"], r["rank_n"]) for r in global_rank(df, "score", "id").collect()}
    assert got == {k: (v, n) for k, v in brute_rank(data).items()}


def test_hot_value_is_spread(spark):
    df = spark.range(20000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, 0.5).otherwise(
        F.rand(1)).alias("score"))
    ranked = global_rank(df, "score", "id", most=50)
    largest = ranked.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < 20000 / 4
    assert ranked.agg(F.count_distinct("rank")).first()[0] == 20000


def test_deciles(spark):
    for n in (10, 11, 19, 100):
        df = spark.range(1, n + 1).select(F.col("id").alias("r"), F.lit(n).cast("bigint").alias("n"))
        got = [tuple(r) for r in df.orderBy("r").select(
            qcut_decile(F.col("r"), F.col("n")), pct_rank_decile(F.col("r"), F.col("n")), ntile(F.col("r"), F.col("n"), 10)
        ).collect()]
        edges = np.quantile(np.arange(1, n + 1), np.linspace(0, 1, 11))
        for i, (q, p, t) in enumerate(got):
            r = i + 1
            assert q == max(1, int(np.searchsorted(edges, r, side="left"))), (n, r)
            assert p == min(10, max(1, int(np.ceil(round(r / n * 10, 9))))), (n, r)
        sizes = np.bincount([t for _, _, t in got], minlength=11)[1:]
        assert max(sizes) - min(sizes) <= 1 and list(sizes) == sorted(sizes, reverse=True)


def test_quantiles_and_running_sums(spark):
    rng = np.random.default_rng(3)
    data = [(g, float(v)) for g in "ab" for v in np.round(rng.normal(size=501 if g == "a" else 500), 1)]
    data += [("c", 7.0), ("d", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for q in (0.0, 0.5, 0.8, 1.0):
        got = {r["g"]: r["quantile"] for r in exact_quantile(df, "v", q, ["g"], most=9).collect()}
        for g in "abc":
            assert got[g] == pytest.approx(np.quantile([v for k, v in data if k == g], q), abs=1e-12)
        assert "d" not in got
    one = df.where("g = 'a'").groupBy("v").agg(F.count("*").alias("n"))
    run = {r["v"]: (r["run_n"], r["all_n"]) for r in running_sums(one, "v", ["n"], descending=True, most=11).collect()}
    a = [v for k, v in data if k == "a"]
    assert run == {v: (sum(x >= v for x in a), len(a)) for v in a}


def test_cleaning_steps(spark, rows):
    df = spark.createDataFrame(
        [("C1", "a@x", "1"), ("TEST-1", "b@x", "2"), ("C2", "t@localhost", "3"), ("C3", None, "4"), ("C4", "test@test.com", "5")],
        "customer_id string, email string, cust_ext_id string",
    )
    assert [r[0] for r in clean.remove_zombies(df).collect()] == ["C1"]
    fixed = clean.conform_schema(df, {"cust_ext_id": "customer_external_id"}, ["promo_code"])
    assert {"customer_external_id", "promo_code"} <= set(fixed.columns) and "cust_ext_id" not in fixed.columns
    q = spark.createDataFrame([(1, -2), (2, 0), (3, None)], "id int, q int")
    assert rows(clean.null_negative(q, "q", "bad")) == [(1, None, True), (2, 0, False), (3, None, False)]
    late = spark.createDataFrame([(1, None), (2, 0), (3, 9)], "id int, _ingestion_delay_days int")
    assert rows(clean.flag_late_arrivals(late)) == [(1, 0, False), (2, 0, False), (3, 9, True)]


def test_joins(spark, rows):
    orders = spark.createDataFrame([("o1", "delivered", "c"), ("o2", "paid", "c")], "order_id string, order_status string, customer_id string")
    items = spark.createDataFrame(
        [("o1", "i1", "p", "s", "x", 1.0), ("o2", "i2", "p", "s", "x", 1.0), ("o9", "i3", "p", "s", "x", 1.0)],
        "order_id string, order_item_id string, product_id string, seller_id string, category string, line_total double",
    )
    ships = spark.createDataFrame(
        [("o1", "s1", T(2001, 1, 1), T(2001, 1, 9)), ("o1", "s2", T(2001, 1, 2), T(2001, 1, 5))],
        "order_id string, shipment_id string, shipped_at timestamp_ntz, delivered_at timestamp_ntz",
    )
    assert [r["order_item_id"] for r in joins.orphans(items, orders, "order_id", "order_id").collect()] == ["i3"]
    got = joins.delivered_items(items, orders, ships).collect()
    assert [(r["order_item_id"], r["delivered_at"]) for r in got] == [("i1", T(2001, 1, 5))]
    assert joins.join_one_to_one(orders, items.limit(2), "order_id").count() == 2
    assert joins.join_one_to_one(orders, items.limit(2), "order_id", "left").columns == ["order_id", *orders.columns[1:], *items.columns[1:]]


def test_repeated_keys_stop_a_one_to_one_join_when_it_runs(spark):
    left = spark.range(4).selectExpr("id as k", "id * 2 as a")
    right = spark.range(3).selectExpr("id as k", "id * 3 as b")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-to-one", "planning")
    try:
        plans = [joins.join_one_to_one(left, right.union(right), "k"), joins.join_one_to_one(left.union(left.limit(1)), right, "k", "left")]
        assert not tracker.getJobIdsForGroup("one-to-one")
        for plan, side in zip(plans, ("right", "left")):
            for act in (lambda p: p.collect(), lambda p: p.count(), lambda p: p.write.format("noop").mode("overwrite").save()):
                with pytest.raises(Exception, match=f"repeated .* on the {side} side"):
                    act(plan)
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert sorted(tuple(r) for r in joins.join_one_to_one(left, right, "k", "left").collect()) == [(0, 0, 0), (1, 2, 3), (2, 4, 6), (3, 6, None)]
    empty = spark.range(0).selectExpr("id as k", "id as b")
    assert joins.join_one_to_one(left, empty, "k").count() == 0


def test_dedupe_sorts_repeated_rows_only_and_splits_a_hot_key(spark):
    rows = spark.range(0, 20000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', if(id % 3 = 1, null, concat('k', id div 4))) as key", "id % 5000 as at", "id", "repeat(cast(id as string), 40) as wide")
    kept = dedupe(rows, "key", "at", "id")
    want = {}
    for r in rows.collect():
        if r["key"] not in want or (r["at"], r["id"]) > want[r["key"]]:
            want[r["key"]] = (r["at"], r["id"])
    assert {r["key"]: (r["at"], r["id"]) for r in kept.collect()} == want and kept.count() == len(want)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    # each task hands on one row of a key; nothing is aggregated over whole rows
    assert "SortAggregate" not in plan and "WindowGroupLimit" in plan and "Partial" in plan
    two = dedupe(rows.withColumn("part", F.col("id") % 2), ["key", "part"], "at", "id", "first", drop_null_key=True)
    assert two.count() == rows.where("key is not null").selectExpr("key", "id % 2 as part").distinct().count()


def test_references_and_repeats_of_a_table_in_one_shuffle(spark):
    child = spark.createDataFrame([(1, 10, "a"), (2, 10, None), (2, 99, "b"), (None, None, "zz"), (5, 98, "a"), (6, 98, "zz")], "id int, p int, q string")
    one, other = spark.createDataFrame([(10,), (11,), (None,)], "k int"), spark.createDataFrame([("a",), ("a",), ("b",)], "k string")
    suite = [checks.Check("t", "unique", "id"), checks.Check("t", "relationship", "p", to=("one", "k")),
             checks.Check("t", "relationship", "q", to=("other", "k"), severity="warn"), checks.Check("t", "unique", "q")]
    got = checks.run_checks({"t": child, "one": one, "other": other}, suite)
    assert {r["check_name"]: (r["violations"], r["status"]) for r in got.collect()} == {
        "unique_t_id": (1, "error"), "relationship_t_p": (3, "error"), "relationship_t_q": (2, "warn"), "unique_t_q": (2, "error")}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    nothing = checks.run_checks({"t": child.limit(0), "one": one, "other": other.limit(0)}, suite)
    assert {r["violations"] for r in nothing.collect()} == {0}


def drawn_market(spark, folder):
    """Driver tables of a few rows: orders without items, items without an order, repeated order keys, unknown customers."""
    from catalogue.registry import Market

    rows = {
        "region": ("1", "cast(id as int) as r_regionkey, 'ASIA' as r_name"),
        "nation": ("2", "cast(id as int) as n_nationkey, concat('N', id) as n_name, 0 as n_regionkey"),
        "customer": ("8", "id as c_custkey, concat('Customer#', id) as c_name, cast(id % 2 as int) as c_nationkey, 'FURNITURE' as c_mktsegment"),
        "supplier": ("12", "id as s_suppkey, concat('Supplier#', id) as s_name, 0 as s_nationkey"),
        "part": ("15", "id as p_partkey, concat('part ', id) as p_name, 'b' as p_brand, 't' as p_type, 5 as p_size, 900D + id as p_retailprice"),
        "orders": ("40", "id % 38 as o_orderkey, id % 11 as o_custkey, 100D + id as o_totalprice, '2-HIGH' as o_orderpriority, "
                         "timestamp_ntz '2001-03-01 00:00:00' + make_dt_interval(cast(id * 4 as int)) as o_orderdate"),
        "lineitem": ("120", "(id * 7) % 45 as l_orderkey, id % 15 as l_partkey, id % 13 as l_suppkey, cast(id as int) as l_linenumber, "
                            "cast(id % 5 + 1 as double) as l_quantity, 90D + id as l_extendedprice, 0.05D as l_discount, 0.02D as l_tax, "
                            "'R' as l_returnflag"),
    }
    for name, (count, columns) in rows.items():
        spark.sql(f"SELECT {columns} FROM range({count})").write.parquet(f"{folder}/{name}.parquet")
    return Market(spark, folder)


def test_gold_moves_lines_once_and_stores_nothing(spark, tmp_path):
    m = drawn_market(spark, f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        narrow = m.gold.fact_order_items.select("order_id", "seller_id", "order_date")
        plan = narrow._jdf.queryExecution().executedPlan().toString()
        # lines, the dates that name their sellers, and their orders: one exchange each, all by order
        assert plan.count("Exchange hashpartitioning") == 3 and "hashpartitioning(l_orderkey" not in plan
        assert m.gold.fact_order_items.count() == narrow.count() > 120
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert m.gold.mart_seller_health.count() == 12
    assert not spark.catalog.tableExists(f"{m._name('gold')}_fact_orders")


def test_lines_move_narrow(spark, tmp_path):
    m = drawn_market(spark, f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def below(df, exchange):
            return df._jdf.queryExecution().executedPlan().toString().partition(f"Exchange hashpartitioning({exchange}")

        items = below(m.gold.fact_order_items.select("net_gmv_cents", "customer_id"), "order_id")
        assert "AS unit_price_cents" in items[2] and "AS unit_price_cents" not in items[0]
        orders = below(m.gold.fact_orders.select("total_amount_cents", "customer_segment"), "customer_id")
        assert "AS total_amount_cents" in orders[2] and "AS total_amount_cents" not in orders[0]
        returns = below(m.clean["returns"].select("return_id", "order_id"), "l_orderkey")
        assert "md5(" in returns[0] and "md5(" not in returns[2]
        reviews = below(m.clean["reviews"].select("rating", "customer_id"), "l_orderkey")
        assert "AS rating" in reviews[2] and "AS rating" not in reviews[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("layer", ["gold", "repaired"])
def test_items_move_without_hash_and_amounts(spark, tmp_path, layer):
    m = drawn_market(spark, f"{tmp_path}/t")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        def around(df, exchange):
            return df._jdf.queryExecution().executedPlan().toString().partition(f"Exchange hashpartitioning({exchange}")

        raw = around(m.clean["order_items"], "order_id")
        assert "md5(" in raw[0] and raw[1] and "md5(" not in raw[2]
        items = getattr(m, layer).fact_order_items
        for key in ("product_id", "seller_id"):
            named = around(items, key)
            assert "AS net_gmv_cents" in named[0] and named[1] and "AS net_gmv_cents" not in named[2]
        gold = getattr(m, layer)
        whole = facts.named_items(gold.ordered_items, gold.dim_products, gold.dim_sellers)
        assert whole.columns == items.columns
        assert whole.exceptAll(items).count() == items.exceptAll(whole).count() == 0 < items.where("net_gmv_cents IS NOT NULL").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_model_queries_share_stored_units(spark, tmp_path):
    from stallkeeper.churn import features as ft

    m = drawn_market(spark, f"{tmp_path}/t")
    assert m.customer_units.inputFiles()
    units = ft.customer_units(m.gold)
    assert m.customer_units.exceptAll(units).count() == units.exceptAll(m.customer_units).count() == 0 < units.count()


def test_filtered_reviews_are_not_stored_again(spark, tmp_path, monkeypatch):
    from catalogue import registry

    freed = []
    monkeypatch.setattr(registry, "free_shuffles", freed.append)
    m = drawn_market(spark, f"{tmp_path}/t")
    kept = m.silver_stored["reviews"]
    assert [p.rsplit("/", 2)[-2].rsplit("-", 1)[-1].rsplit("_", 1)[0] for p in kept.inputFiles()[:1]] == ["raw_reviews"]
    assert freed == [spark]  # after the raw table; the filter stores nothing
    assert kept.exceptAll(m.silver["reviews"]).count() == 0 < kept.count() <= m.arrived["reviews"].count()


def test_stored_items_carry_no_names(spark, tmp_path):
    m = drawn_market(spark, f"{tmp_path}/t")
    stored = m.gold.with_bucketed_facts("named", f"{tmp_path}/facts")
    assert not {"product_name", "seller_tier"} & set(spark.table("named_fact_order_items").columns)
    plain = m.gold.fact_order_items
    assert stored.fact_order_items.columns == plain.columns
    assert stored.fact_order_items.exceptAll(plain).count() == plain.exceptAll(stored.fact_order_items).count() == 0
    assert plain.where("product_name IS NOT NULL AND seller_tier IS NOT NULL").count() > 0
    for table in ("named_fact_orders", "named_fact_order_items"):
        spark.sql(f"DROP TABLE {table}")


def test_bucketed_facts_join_without_an_exchange(spark, tmp_path):
    from stallkeeper.sources.buckets import bucket_count, write_bucketed

    assert bucket_count(0, spark) == 1 and bucket_count(10**10, spark) == 5000 and bucket_count(10**14, spark) == 100_000
    left = write_bucketed(spark.range(3000).selectExpr("concat('o', id) as order_id", "id as a"), "left_facts", f"{tmp_path}/l", "order_id", 6)
    right = write_bucketed(spark.range(9000).selectExpr("concat('o', id % 3000) as order_id", "id as b", "id % 7 as seller"), "right_facts",
                           f"{tmp_path}/r", "order_id", 6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, "order_id")
        assert joined.count() == 9000
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        per_order = right.groupBy("seller", "order_id").count()
        assert per_order.count() and "Exchange" not in per_order._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert left.where("order_id = 'o5'").count() == 1 and spark.read.parquet(f"{tmp_path}/l").count() == 3000
    for table in ("left_facts", "right_facts"):
        spark.sql(f"DROP TABLE {table}")


def test_checks_find_planted_failures(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    bad = spark.createDataFrame([("a", 1), ("a", 9), (None, 2)], "id string, v int")
    suite = [
        checks.Check("t", "not_null", "id"), checks.Check("t", "unique", "id"), checks.Check("t", "accepted", "v", (1, 2)),
        checks.Check("t", "relationship", "id", to=("p", "id"), severity="warn"),
    ]
    parent = spark.createDataFrame([("b", 0)], "id string, v int")
    passed = checks.run_checks({"t": good, "p": good}, suite)
    assert {r["status"] for r in passed.collect()} == {"pass"}
    failed = {r["check_name"]: (r["violations"], r["status"]) for r in checks.run_checks({"t": bad, "p": parent}, suite).collect()}
    assert failed == {
        "not_null_t_id": (1, "error"), "unique_t_id": (1, "error"), "accepted_t_v": (1, "error"),
        "relationship_t_id": (2, "warn"),
    }
    summary = {r["status"]: r["checks"] for r in checks.check_summary(checks.run_checks({"t": bad, "p": parent}, suite)).collect()}
    assert summary == {"error": 3, "warn": 1}


def test_profile_of_absent_column(spark, rows):
    df = spark.createDataFrame([("x", None), ("y", "z")], "a string, b string")
    assert rows(profile.fill_rate(df, ["b", "c"])) == [("b", True, 2, 1, 50.0), ("c", False, 2, None, None)]


def test_sources_and_sinks(spark, tmp_path):
    for entity in ENTITIES:
        df = spark.createDataFrame([], raw_schema(entity))
        io.write_table(df, f"{tmp_path}/{entity}")
        raw = io.bronze(spark, f"{tmp_path}/{entity}", entity)
        assert raw.columns[-2:] == ["_loaded_at", "_source"]
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    stored = io.publish({"one": df, "two": df.limit(1)}, f"{tmp_path}/pub")
    counts = {r["table_name"]: r["row_count"] for r in io.table_row_counts(stored).collect()}
    assert counts == {"one": 2, "two": 1}
    io.write_table(df, f"{tmp_path}/parts", partition_by=["k"])
    assert spark.read.parquet(f"{tmp_path}/parts").where("k = 'b'").count() == 1
    io.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 2
    described = {r["column_name"]: (r["column_type"], r["filled_rows"]) for r in io.describe_schema(df).collect()}
    assert described == {"k": ("string", 2), "v": ("int", 2)}
    loose = spark.createDataFrame([], score_schema()).withColumn("total_orders", F.lit(1).cast("bigint"))
    assert io.conform_scores(loose).dtypes == [(f.name, f.dataType.simpleString()) for f in score_schema()]


def test_hot_customer_is_split_and_unused_dimensions_are_not_joined(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, value in settings.items():
        spark.conf.set(k, value)
    try:
        facts_in = spark.range(0, 20000, 1, 16).selectExpr("id", "if(id % 2 = 0, 7L, id) as customer_id", "md5(string(id)) as filler")
        dim = spark.range(0, 20000, 1, 4).selectExpr("id as customer_id", "concat('n', id) as name")
        joined = facts.look_up(facts_in, facts.lookup(dim, "customer_id", {"name": "name"}), "customer_id")
        kept = joined.selectExpr("id", "filler", "name")
        assert kept.where("name is null").count() == 0
        kept.collect()
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
        unused = joined.groupBy().sum("id")
        assert "Join" not in unused._jdf.queryExecution().optimizedPlan().toString()
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


@pytest.mark.parametrize("kind", ["one value", "one value and a crowd", "two values", "steps", "spread", "endless", "few"])
def test_ranks_come_from_blocks_of_bounded_size(spark, kind):
    rng = random.Random(kind)
    n, most = (9000, 300) if kind != "few" else (5, 300)
    draw = {
        "one value": lambda i: 1.5 if i % 10 else rng.random() * 3, "one value and a crowd": lambda i: 0.0 if i % 3 == 0 else 1e-300 * rng.randrange(5),
        "two values": lambda i: float(i % 2), "steps": lambda i: float(min(i % 40, 7)), "spread": lambda i: rng.gauss(0, 1e9),
        "endless": lambda i: rng.choice([math.inf, -math.inf, -0.0, 5e-324]), "few": lambda i: float(i)}[kind]
    values = {f"c{i}": draw(i) for i in range(n)}
    df = spark.createDataFrame([*values.items(), ("none", None), ("nan", math.nan)], "id string, score double").repartition(4)
    ranked = {r["id"]: (r["rank"], r["rank_n"]) for r in global_rank(df, "score", "id", most=most).collect()}
    order = sorted(values, key=lambda c: (-values[c], hashlib.md5(c.encode()).hexdigest(), c))
    assert ranked.pop("none") == ranked.pop("nan") == (None, None)
    assert ranked == {c: (k, n) for k, c in enumerate(order, 1)}
    blocks = ordered_blocks(df.where("score is not null and not isnan(score)").withColumn("h", F.md5("id")), "score", "h", most)
    sizes = [r["n"] for r in blocks.groupBy("_b", "_t").agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == n and max(sizes) <= most and len(sizes) <= 40 * n / most + 2
