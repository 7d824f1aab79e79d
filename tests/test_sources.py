"""Raw folders of several layouts."""

import pytest
from pyspark.sql import functions as F

from stallkeeper.sources import io
from stallkeeper.sources.layouts import layout_report, layouts
from stallkeeper.sources.schemas import raw_columns, raw_schema


def put(spark, folder, ddl, *rows):
    spark.createDataFrame(list(rows), ddl).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def mixed(spark, tmp_path):
    folder = f"{tmp_path}/orders"
    put(spark, folder, "order_id string, subtotal double, item_count int", ("a", 12.5, 3), ("b", None, None))
    put(spark, folder, "order_id string, subtotal string, _ingestion_delay_days int", ("c", "$7", 4))
    put(spark, folder, "order_id string, subtotal string, _ingestion_delay_days int", ("d", "USD 8", None))
    put(spark, folder, "subtotal decimal(9,2), order_id string, item_count bigint, more string", (None, "e", 2**40, "x"))
    return folder


def test_files_are_grouped_by_their_footers(spark, mixed):
    found = layouts(spark, mixed)
    assert sorted(len(x.files) for x in found) == [1, 1, 2]
    kinds = {(r["column_name"], r["column_type"]): (r["layouts"], r["files"]) for r in layout_report(spark, mixed).collect()}
    assert kinds["subtotal", "string"] == (1, 2) and kinds["subtotal", "double"] == (1, 1) and kinds["order_id", "string"] == (3, 4)


def test_mixed_layouts_are_loaded_as_declared(spark, mixed):
    rows = io.bronze(spark, mixed, "orders")
    assert dict(rows.drop("_loaded_at", "_source").dtypes) == {
        f.name: f.dataType.simpleString() for f in raw_schema("orders")} == raw_columns("orders")
    got = {r["order_id"]: (r["subtotal"], r["item_count"], r["_ingestion_delay_days"], r["_source"]) for r in rows.collect()}
    assert got == {"a": ("12.5", 3, None, "orders"), "b": (None, None, None, "orders"), "c": ("$7", None, 4, "orders"),
                   "d": ("USD 8", None, None, "orders"), "e": (None, 2**40, None, "orders")}
    # each layout's scan reads what is asked for and no more
    plan = rows.where("order_id = 'c'").select("order_id")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<order_id:string>") == plan.count("PushedFilters: [IsNotNull(order_id), EqualTo(order_id,c)]") == 3


def test_a_renamed_column_under_either_name(spark, tmp_path):
    folder = f"{tmp_path}/customers"
    put(spark, folder, "customer_id string, customer_external_id string", ("1", "old"))
    put(spark, folder, "customer_id string, cust_ext_id string, promo_code string", ("2", "new", "p"))
    put(spark, folder, "customer_id string, customer_external_id string, cust_ext_id string", ("3", "before", None), ("4", "before", "after"))
    got = {r["customer_id"]: (r["cust_ext_id"], r["promo_code"]) for r in io.bronze(spark, folder, "customers").collect()}
    assert got == {"1": ("old", None), "2": ("new", "p"), "3": ("before", None), "4": ("after", None)}


def test_one_layout_one_file_folders_of_days_and_none(spark, tmp_path):
    one = f"{tmp_path}/one"
    put(spark, one, "order_id string, subtotal string", ("a", "1"))
    assert io.bronze(spark, one, "orders").first()["subtotal"] == "1"
    assert io.bronze(spark, layouts(spark, one)[0].files[0], "orders").count() == 1
    days = f"{tmp_path}/days"
    put(spark, f"{days}/region=EU", "order_id string, subtotal string", ("a", "1"))
    put(spark, f"{days}/region=US", "order_id string, subtotal double", ("b", 2.0))
    assert {(r["order_id"], r["region"]) for r in io.bronze(spark, days, "orders").collect()} == {("a", "EU"), ("b", "US")}
    empty = f"{tmp_path}/empty"
    (tmp_path / "empty").mkdir()
    assert io.bronze(spark, empty, "orders").count() == 0
    put(spark, empty, "order_id string, subtotal double")
    assert io.bronze(spark, empty, "orders").count() == 0


def test_a_value_that_does_not_fit_stops_the_load(spark, tmp_path):
    folder = f"{tmp_path}/orders"
    put(spark, folder, "order_id string, item_count string", ("a", "3"), ("b", "many"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        io.bronze(spark, folder, "orders").agg(F.sum("item_count")).collect()
