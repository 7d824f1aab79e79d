"""Folders whose files do not agree: files are grouped by the columns and types in their own footers.

``mergeSchema`` gives up where one file has a number and another a text in the same column. Here every group of equal
files is read by its own schema, renamed and cast, and the groups are put together afterwards, so that filters and
column choices still reach the scan of each group.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stallkeeper.operators.clean import conform_schema

THREADS = 32


@dataclass(frozen=True)
class Layout:
    """Files of one schema."""

    schema: StructType
    files: tuple[str, ...]


def _is_folder(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


def _footer(spark: SparkSession, file: str) -> str:
    """The schema in a file's footer, as text; no row is read."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    parquet = jvm.org.apache.parquet.hadoop
    reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
    try:
        return reader.getFileMetaData().getSchema().toString()
    finally:
        reader.close()


def _reader(spark: SparkSession, path: str):
    """Folder names such as day=2001-08-01 stay columns when single files are named."""
    return spark.read.option("basePath", path) if _is_folder(spark, path) else spark.read


def layouts(spark: SparkSession, path: str, threads: int = THREADS) -> list[Layout]:
    """The layouts in a folder, by their first file's name. One footer of each file is read, by threads of the driver,
    which lists the files for the scan anyway; rows stay where they are."""
    jvm = spark.sparkContext._jvm
    listed = spark.read.schema("_ int").parquet(path).inputFiles()  # a stated schema: no footer is read to list
    files = sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in listed)
    groups: dict[str, list[str]] = {}
    with ThreadPoolExecutor(threads) as pool:
        for file, footer in zip(files, pool.map(lambda f: _footer(spark, f), files)):
            groups.setdefault(footer, []).append(file)
    reader = _reader(spark, path)
    return [Layout(reader.parquet(group[0]).schema, tuple(group)) for group in groups.values()]


def read_layouts(spark: SparkSession, path: str, declared: StructType, renames: Mapping[str, str] | None = None) -> DataFrame:
    """All rows of a folder as ``declared``: renamed columns under their new name, types cast, absent columns NULL.

    A value that its declared type cannot hold stops the read. An empty folder has no rows.
    """
    found = layouts(spark, path)
    parts = []
    for layout in found:
        reader = _reader(spark, path).schema(layout.schema)
        # one layout only: the folder itself is named, so that a scan of many files has a short plan
        rows = conform_schema(reader.parquet(path) if len(found) == 1 else reader.parquet(*layout.files), renames)
        parts.append(rows.select(*[
            (F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in declared]))
    if not parts:
        return spark.createDataFrame([], declared)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def layout_report(spark: SparkSession, path: str) -> DataFrame:
    """column_name, column_type, layouts and files that have the column in this type; columns in several types come in several rows."""
    rows = [(f.name, f.dataType.simpleString(), len(layout.files)) for layout in layouts(spark, path) for f in layout.schema]
    cells = spark.createDataFrame(rows, "column_name string, column_type string, files long")
    return cells.groupBy("column_name", "column_type").agg(F.count("*").alias("layouts"), F.sum("files").alias("files"))
