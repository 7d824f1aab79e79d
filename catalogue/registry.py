"""Query registry: a Spark callable over a ``Market`` and, where SQL can say it, the matching SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from catalogue import testbed as tb
from catalogue.sqlbase import sql as assemble
from catalogue.dirt import DIRTY_TABLES, dirty_table
from stallkeeper.churn.features import customer_units
from stallkeeper.plans.gold import Gold
from stallkeeper.plans.silver import BUILDERS
from stallkeeper.session import delete_at_exit, free_shuffles, shared_folder
from stallkeeper.sources.io import write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Market:
    """Clean and fault-injected tables of one folder with the gold layer over each."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.bed = tb.Testbed(spark, folder)

    @cached_property
    def clean(self) -> Mapping[str, DataFrame]:
        return tb.LazyTables(self.bed.ENTITIES, lambda n: getattr(self.bed, n))

    @cached_property
    def gold(self) -> Gold:
        """Gold as one plan from the driver tables on: a query that passes over a fact once moves only the columns it uses."""
        return Gold(self.clean, tb.AS_OF)

    @property
    def gold_unstored(self) -> Gold:
        return self.gold

    @property
    def gold_stored(self) -> Gold:
        """Not stored: the clean tables are cheaper to join again, with a pass's own columns, than to write with all."""
        return self.gold

    def _loaded(self, layer: str, gold: Gold) -> Gold:
        place = self._place(layer)
        new = not self.spark.catalog.tableExists(f"{self._name(layer)}_fact_order_items")
        if new:
            delete_at_exit(self.spark, place)
        stored = gold.with_bucketed_facts(self._name(layer), place)
        if new:
            free_shuffles(self.spark)
        return stored

    def _name(self, layer: str) -> str:
        return f"{layer}_{hashlib.md5(self.folder.encode()).hexdigest()[:16]}"

    def _place(self, layer: str) -> str:
        return f"{shared_folder(self.spark)}/{self.spark.sparkContext.applicationId}-{self._name(layer)}"

    def _once(self, layer: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A table of this session that the first query which needs it writes."""
        path = self._place(layer)
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            delete_at_exit(self.spark, path)
            write_table(build(), path)
            free_shuffles(self.spark)
        return self.spark.read.parquet(path)

    @cached_property
    def customer_units(self) -> DataFrame:
        """Stored once, for queries that build snapshots of several date lists."""
        return self._once("units", lambda: customer_units(self.gold))

    @cached_property
    def faulty(self) -> Mapping:
        return tb.LazyTables(DIRTY_TABLES, lambda n: dirty_table(n, self.clean[n]))

    @cached_property
    def raw(self) -> Mapping[str, DataFrame]:
        """What arrives: faulty copies of six tables, the rest as they are."""
        return tb.LazyTables(self.bed.ENTITIES, lambda n: self.faulty[n][0] if n in DIRTY_TABLES else self.clean[n])

    @cached_property
    def arrived(self) -> Mapping[str, DataFrame]:
        """The raw tables as files, which is how cleaning meets them."""
        return tb.LazyTables(
            self.bed.ENTITIES,
            lambda n: self._once(f"raw_{n}", lambda: self.raw[n]) if n in DIRTY_TABLES else self.raw[n]
        )

    @cached_property
    def silver(self) -> Mapping[str, DataFrame]:
        return tb.LazyTables(self.bed.ENTITIES, lambda n: BUILDERS[n](self.arrived[n]))

    @cached_property
    def silver_stored(self) -> Mapping[str, DataFrame]:
        return tb.LazyTables(
            self.bed.ENTITIES,
            # silver reviews are a filter of the stored raw ones
            lambda n: self._once(f"silver_{n}", lambda: self.silver[n]) if n in DIRTY_TABLES and n != "reviews" else self.silver[n]
        )

    @cached_property
    def repaired(self) -> Gold:
        return Gold(self.silver, tb.AS_OF)

    @cached_property
    def repaired_stored(self) -> Gold:
        return self._loaded("repaired", Gold(self.silver_stored, tb.AS_OF))


def register(name: str, run: Callable[[Market], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, folder: run(Market(spark, folder))
    if sql is not None:
        ORACLE[name] = assemble(sql)
