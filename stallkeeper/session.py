"""Session settings and lineage cutting."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # naive source timestamps must not shift when they become dates
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a customer, seller or order may own a third of the rows: let the join split that
    # partition even where the split costs another exchange further up
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; leaves cluster sizing alone."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "stallkeeper", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where it is unset, one beside the session's tables.

    Both are reached by every executor; no machine-local temporary folder is ever used.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/stallkeeper-scratch"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of one's own in the shared one, removed when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` once as a table in the shared folder and go on from the stored rows.

    Later steps read only the columns they use, know the size for join planning, and survive lost
    executors without recomputing what came before.
    """
    path = scratch_folder(df.sparkSession, "stored")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the folder removed when the driver ends, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now; it does so only when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Give Python workers this package, as ``--py-files`` would, so that they need not have it installed."""
    if any(f.endswith("/stallkeeper.zip") for f in spark.sparkContext.listFiles):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="stallkeeper-code-")  # on the driver alone; Spark serves it to the executors
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "stallkeeper"), "zip", root, "stallkeeper"))
