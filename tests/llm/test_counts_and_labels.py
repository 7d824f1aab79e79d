"""Token rollups against a plain count, and the quality stage without usable labels."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from stallkeeper.llm import queries, token_counts
from stallkeeper.llm.line_crf import is_held_out
from stallkeeper.llm.tokenize import byte_bpe
from stallkeeper.session import ship_package

DOCS = "doc_id long, text string, lang string, source string"
ROWS = [(1, "one two three", "en", "b"), (2, "héé \U0001f600 <|endoftext|>", "en", "a"), (2, "twice", "en", "a"), (None, "no id", None, "a"),
        (4, None, "de", None), (5, "", "de", None), (6, "word " * 300_000, "de", "c"), (7, "three", "en", "b")]


def by_hand(rows):
    """documents, tokens and chars of each source and language."""
    out, encoder = {}, byte_bpe()
    for _, text, lang, source in rows:
        n = out.setdefault((source, lang), Counter())
        n.update(documents=1, tokens=len(encoder.ids(text or "")), chars=len(text or ""))
    return {k: (n["documents"], n["tokens"], n["chars"]) for k, n in out.items()}


def found(df):
    return {(r["source"], r["lang"]): (r["documents"], r["tokens"], r["chars"]) for r in df.collect()}


def test_query_ends_with_the_true_counts(spark, tmp_path):
    spark.createDataFrame(ROWS, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert found(queries.QUERIES["op5_token_counts"](spark, str(tmp_path))) == by_hand(ROWS)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert found(queries.QUERIES["op5_token_counts"](spark, f"{tmp_path}/none")) == {}


def test_each_batch_moves_the_totals(spark, tmp_path):
    ship_package(spark)
    counts = token_counts.token_counts(spark.createDataFrame(ROWS, DOCS)).cache()
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    true, rough = by_hand(ROWS), counts.withColumn("tokens", F.lit(1).cast("long"))
    rollup.commit("load", rough.withColumn("sign", F.lit(1)))
    assert found(rollup.totals()) == {k: (n, n, c) for k, (n, _, c) in true.items()}
    rollup.commit("revise", token_counts.revised(rough, counts))
    assert found(rollup.totals()) == true
    rollup.commit("delete", counts.where("source = 'b'").withColumn("sign", F.lit(-1)))
    left = {k: v for k, v in true.items() if k[0] != "b"}
    assert found(rollup.totals()) == left
    rollup.compact()
    assert not rollup.commit("delete", counts.withColumn("sign", F.lit(-1))) and found(rollup.totals()) == left
    rollup.commit("nothing", counts.limit(0).withColumn("sign", F.lit(1)))
    assert found(rollup.totals()) == left and rollup.batches() == ["delete", "load", "nothing", "revise"]


def test_a_batch_committed_while_another_folds_counts_once(spark, tmp_path, monkeypatch):
    ship_package(spark)
    counts = token_counts.token_counts(spark.createDataFrame(ROWS, DOCS)).withColumn("sign", F.lit(1)).cache()
    rollup = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    rollup.commit("one", counts)
    real = rollup._sum

    def late(base, beside):
        monkeypatch.setattr(rollup, "_sum", real)
        rollup.commit("two", counts)
        return real(base, beside)

    monkeypatch.setattr(rollup, "_sum", late)
    rollup.compact()
    assert found(rollup.totals()) == {k: (2 * n, 2 * t, 2 * c) for k, (n, t, c) in by_hand(ROWS).items()}
    rollup.compact()
    assert found(rollup.totals()) == {k: (2 * n, 2 * t, 2 * c) for k, (n, t, c) in by_hand(ROWS).items()}


@pytest.mark.parametrize("kind", ["none", "one class", "held out only", "null only", "other documents"])
def test_unusable_labels_do_not_empty_the_corpus(spark, tmp_path, kind):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, "Some words of text.\nAnd more of them.", "en", "a", 10) for i in range(40)], f"{DOCS}, n_chars long")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    held = is_held_out("doc_id")
    labels = {"none": labels.limit(0), "one class": labels.where("quality = 0"), "held out only": labels.where(held),
              "null only": labels.withColumn("quality", F.lit(None).cast("int")), "other documents": labels.withColumn("doc_id", F.col("doc_id") + 1000)}[kind]
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.raises(ValueError, match="both classes"):
        corpus_pipeline.keep_good(spark, docs, str(tmp_path))
    assert corpus_pipeline.keep_good(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], f"{DOCS}, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
