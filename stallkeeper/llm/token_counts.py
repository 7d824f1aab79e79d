"""Token counts kept up to date by signed changes.

A batch of changes is a table of rows with a sign: +1 for a document that comes in, -1 for one that goes, and both, with
the old and the new row, for one whose count is revised. Its totals by source, language and tokenizer version are
written to a folder named after the batch, so that committing a batch again replaces nothing and adds nothing. The
rollup is the sum over all batches: totals are additive, whatever order batches come in. ``compact`` folds batches into
one base table that names the batches it holds. Counting combines before the shuffle, so any source may be hot.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallkeeper.llm.texts import text_of
from stallkeeper.llm.tokenize import TOKENIZER, byte_bpe

KEYS = ["source", "lang", "tokenizer"]
TOTALS = ["documents", "tokens", "chars"]


def token_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
                 lang_column: str = "lang", tokenizer: str = TOKENIZER, folder: str | None = None) -> DataFrame:
    """``id, source, lang, tokenizer, tokens, chars`` of every row. A null text is empty and has no tokens."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"),
                       F.col(lang_column).cast("string").alias("lang"), text_of(text_column).alias("text"))

    def count(batches):
        encoder = byte_bpe(tokenizer, folder)
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("source"), batch.column("lang"), pa.array([tokenizer] * len(texts), pa.string()),
                 pa.array([len(encoder.ids(t)) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64())],
                names=["id", "source", "lang", "tokenizer", "tokens", "chars"])

    fields = [T.StructField("tokenizer", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("chars", T.LongType())]
    return rows.mapInArrow(count, T.StructType([*rows.schema.fields[:3], *fields]))


class TokenRollup:
    """Totals in a folder that all executors reach.

    Null sources and languages are groups of their own. Rows count as often as they occur. A rollup without batches is an
    empty table, an empty table of changes is a batch that changes nothing, and a group whose totals are all back to zero
    is left out. Texts are counted whole, however long.
    """

    SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long, chars long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _finished(self, kind: str) -> list[str]:
        fs, root = self._fs(f"{self.path}/{kind}")
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(n for n in names if self._done(f"{self.path}/{kind}/{n}"))

    def _done(self, path: str) -> bool:
        fs, place = self._fs(f"{path}/_SUCCESS")
        return fs.exists(place)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the signed rows ``source, lang, tokenizer, tokens, chars, sign``; False if the batch was in already.

        A batch that failed half-way has no success mark and is written anew.
        """
        if batch in self.batches():
            return False
        signed = lambda c: F.sum(F.col(c) * F.col("sign")).cast("long").alias(c)
        changes.groupBy(*KEYS).agg(F.sum("sign").cast("long").alias("documents"), signed("tokens"), signed("chars")).write.mode(
            "overwrite").parquet(f"{self.path}/batches/{batch}")
        return True

    def _state(self) -> tuple[str | None, list[str], list[str]]:
        """The newest base, the batches that it holds, and those beside it; listed once, so that all three agree.

        Batches are listed before bases: one that is committed in between is in neither list, and read the next time.
        """
        batches, bases = self._finished("batches"), self._finished("bases")
        if not bases:
            return None, [], batches
        held = [r["batch"] for r in self.spark.read.parquet(f"{self.path}/bases/{bases[-1]}/held").collect()]
        return bases[-1], held, [b for b in batches if b not in held]

    def batches(self) -> list[str]:
        _, held, beside = self._state()
        return sorted({*held, *beside})

    def totals(self) -> DataFrame:
        base, _, beside = self._state()
        return self._sum(base, beside)

    def _sum(self, base: str | None, beside: list[str]) -> DataFrame:
        """Base and batches as one scan over a list of folders."""
        parts = [f"{self.path}/bases/{base}/totals"] * (base is not None) + [f"{self.path}/batches/{b}" for b in beside]
        rows = self.spark.read.schema(self.SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], self.SCHEMA)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS)).where(" OR ".join(f"{c} <> 0" for c in TOTALS))

    def compact(self) -> None:
        """Fold all batches into a new base; readers use the newest base that is whole.

        The base names the batches that it was made of. A batch committed meanwhile is not among them and counts beside it.
        """
        base, held, beside = self._state()
        number = len(self._finished("bases"))
        path = f"{self.path}/bases/{number:08d}-{uuid.uuid4().hex}"
        self._sum(base, beside).write.parquet(f"{path}/totals")
        self.spark.createDataFrame([(b,) for b in (*held, *beside)], "batch string").write.parquet(f"{path}/held")
        self.spark.createDataFrame([], "done string").write.mode("append").parquet(path)


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """Signed rows that take ``old`` counts out and put ``new`` ones in; either may be empty."""
    return old.withColumn("sign", F.lit(-1)).unionByName(new.withColumn("sign", F.lit(1)))
