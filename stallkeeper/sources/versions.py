"""Versions of a result in one folder: written first, looked at, and only then made the one that readers see.

``versions/<name>`` holds what was written, ``pointers/<number>`` the name of each version that was published, in order.
A pointer is made by an exclusive create, so of two publishers one gets the number and the other the next; a reader takes
the last pointer that is whole, so a version that is half written, refused or being published is never read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Works on any file system that Spark reaches; the driver touches only names and pointers."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, below: str):
        return self._hadoop.fs.Path(f"{self.path}/{below}".rstrip("/"))

    def new(self) -> str:
        return uuid.uuid4().hex

    def folder(self, version: str) -> str:
        return f"{self.path}/versions/{version}"

    def write(self, df: DataFrame) -> str:
        """Write a table as a new version that nobody reads yet."""
        version = self.new()
        df.write.option("compression", "zstd").parquet(self.folder(version))
        return version

    def table(self, version: str) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._at("pointers")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("pointers"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _pointer(self, number: int) -> dict | None:
        text = read_text(self.spark, f"{self.path}/pointers/{number:012d}")
        try:
            return json.loads(text)
        except ValueError:  # its writer has not finished, or died
            return None

    def publish(self, version: str, **notes) -> int:
        """Make a version the one that is read; what was published before stays on disk."""
        number = max(self._numbers(), default=0) + 1
        while not write_text(self.spark, f"{self.path}/pointers/{number:012d}", json.dumps({"version": version, **notes}), new=True):
            number += 1
        return number

    def published(self) -> list[dict]:
        """Pointers from the first to the last."""
        found = [(n, self._pointer(n)) for n in self._numbers()]
        return [{"number": n, **p} for n, p in found if p is not None]

    def current(self) -> dict | None:
        for number in reversed(self._numbers()):
            pointer = self._pointer(number)
            if pointer is not None:
                return {"number": number, **pointer}
        return None

    def read(self) -> DataFrame:
        """The published table; later publications do not change a frame that was handed out."""
        current = self.current()
        if current is None:
            raise LookupError(f"nothing is published in {self.path}")
        return self.table(current["version"])

    def drop_before(self, keep: int) -> list[str]:
        """Delete all but the last ``keep`` published versions, and their pointers."""
        old = self.published()[:-keep] if keep > 0 else []
        held = {p["version"] for p in self.published()[-keep:]}
        for p in old:
            self._fs.delete(self._at(f"pointers/{p['number']:012d}"), False)
            if p["version"] not in held:
                self._fs.delete(self._hadoop.fs.Path(self.folder(p["version"])), True)
        return [p["version"] for p in old]


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str, new: bool = False) -> bool:
    """A small text file; with ``new`` False is returned, and nothing written, where the file is there already."""
    from py4j.protocol import Py4JJavaError

    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        stream = system.create(place, not new)
    except Py4JJavaError:
        if new and system.exists(place):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True
