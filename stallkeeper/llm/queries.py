"""The numbered queries over the given tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stallkeeper.llm import (conversation_trie, exact_dedup, gru_lm, jaccard_join, line_crf, line_dedup, mixing, packing, quality_rules,
                             source_audit, token_counts, toxicity, warc)
from stallkeeper.session import cut_lineage, delete_at_exit, shared_folder, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(run):
        def ready(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return run(spark, folder)

        QUERIES[name] = ready
        if sql is not None:
            ORACLE[name] = sql
        return run
    return put


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


SPACE = r"\x20\x09-\x0D"
WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"

RULES_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
f AS (SELECT * FROM l WHERE regexp_matches(line, '[^{SPACE}]')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM f GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
        FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
norm AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(line), '[{SPACE}]+', ' ', 'g'), '[0-9]', '0', 'g'), ' ') AS h,
                len(regexp_extract_all(line, '[^{SPACE}]+')) AS n FROM f),
often AS (SELECT n.source, h FROM norm n JOIN d USING (doc_id) GROUP BY n.source, h
          HAVING count(DISTINCT text) > {quality_rules.MAX_DOCS_PER_HOST}),
lost AS (SELECT doc_id, sum(n)::BIGINT AS removed FROM norm n
         JOIN often o ON n.h = o.h AND n.source IS NOT DISTINCT FROM o.source GROUP BY doc_id),
base AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(words) - coalesce(removed, 0) AS rest
         FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words)
       AND NOT (rest < {quality_rules.MIN_WORDS} OR 100 * rest < {quality_rules.MIN_KEPT_PERCENT} * n_words) AS kept
FROM base
"""


@query("op7_quality_rules", RULES_SQL)
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, folder, "documents")).selectExpr(
        "id AS doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


EXACT_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[{SPACE}]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW g AS (PARTITION BY t)
"""


@query("op8_exact_dedup", EXACT_SQL)
def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).selectExpr(
        "id AS doc_id", "keep_id", "group_size", "kept", "sha256 AS text_sha256")


def _pass_sql(k: int, nearest: bool) -> str:
    """One hash-threshold pass: rows above ``lower`` no larger than ``most``, up to ``budget``."""
    take = "CASE WHEN s - rest < rest THEN 1 ELSE 0 END" if nearest else "0"
    return f"""
c{k} AS (SELECT w.source, h, sum(size) AS s FROM w JOIN b{k} b ON w.source IS NOT DISTINCT FROM b.source
         WHERE size > 0 AND h >= lower AND size <= most GROUP BY w.source, h),
u{k} AS (SELECT c.source, h, s, budget, sum(s) OVER (PARTITION BY c.source ORDER BY h) AS cum
         FROM c{k} c JOIN b{k} b ON c.source IS NOT DISTINCT FROM b.source),
t{k} AS (SELECT source, h + {take} AS below, h AS edge, rest FROM (
         SELECT source, h, s, budget - cum + s AS rest, row_number() OVER (PARTITION BY source ORDER BY h) AS n
         FROM u{k} WHERE cum > budget) WHERE n = 1),
p{k} AS (SELECT b.source, lower, most, coalesce(below, 4611686018427387904) AS below
         FROM b{k} b LEFT JOIN t{k} t ON b.source IS NOT DISTINCT FROM t.source),
b{k + 1} AS (SELECT source, edge + 1 AS lower, floor(rest)::BIGINT AS most, rest AS budget FROM t{k} WHERE floor(rest) > 0)"""


def mix_sql(documents: str = "documents") -> str:
    passes = ",".join(_pass_sql(k, k == mixing.PASSES - 1) for k in range(mixing.PASSES))
    bars = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(mixing.PASSES))
    return rf"""
WITH w AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM w GROUP BY source),
r AS (SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight,
      source_size * {mixing.MAX_REPEAT} AS top FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(top) OVER f, 0))::DOUBLE
             / (sum(weight) OVER () - coalesce(sum(weight) OVER f, 0))::DOUBLE AS level
      FROM r WINDOW f AS (ORDER BY top::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size,
      (CASE WHEN top >= weight * level THEN weight * max(CASE WHEN top >= weight * level THEN level END) OVER () ELSE top END)::DOUBLE AS target FROM l),
q AS (SELECT *, CASE WHEN target >= source_size * {mixing.MAX_REPEAT} THEN {mixing.MAX_REPEAT} ELSE floor(target / source_size) END::BIGINT AS times FROM g),
b0 AS (SELECT source, 0::BIGINT AS lower, 4611686018427387904 AS most, target - times * source_size AS budget FROM q
       WHERE source_size > 0 AND times < {mixing.MAX_REPEAT} AND target - times * source_size > 0),{passes},
bars AS ({bars}),
hit AS (SELECT DISTINCT w.source, w.h, w.size FROM w JOIN bars ON w.source IS NOT DISTINCT FROM bars.source
        WHERE w.h >= lower AND w.size <= most AND w.h < below)
SELECT w.doc_id, w.size, q.source_size, q.target,
       (CASE WHEN w.size = 0 THEN 0 ELSE w.size * (q.times + CASE WHEN hit.h IS NULL THEN 0 ELSE 1 END) END)::BIGINT AS taken
FROM w JOIN q ON w.source IS NOT DISTINCT FROM q.source
LEFT JOIN hit ON w.source IS NOT DISTINCT FROM hit.source AND w.h = hit.h AND w.size = hit.size
"""


@query("op10_mix_sources", mix_sql())
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).selectExpr("id AS doc_id", "size", "source_size", "target", "taken")


@query("op4_pack_sequences")
def op4_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents")).selectExpr(
        "id AS doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _own_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_at_exit(spark, path)
    return path


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in with tokens estimated from their length; every one is then revised to its true count, one
    source is deleted and comes in again. The revision arrives before the load, all is sent twice, and folded in between."""
    counts = cut_lineage(token_counts.token_counts(table(spark, folder, "documents")))
    rough = counts.withColumn("tokens", F.expr("chars div 4"))
    moved = counts.where(F.col("source").eqNullSafe(F.lit(counts.agg(F.min("source").alias("source")).first()["source"])))
    batches = {
        "revise": token_counts.revised(rough, counts), "load": rough.withColumn("sign", F.lit(1)),
        "delete": moved.withColumn("sign", F.lit(-1)), "again": moved.withColumn("sign", F.lit(1))}
    rollup = token_counts.TokenRollup(spark, _own_folder(spark, "rollup"))
    for turn in range(2):
        for name, changes in batches.items():
            rollup.commit(name, changes)
            if name == "load":
                rollup.compact()
    return rollup.totals()


PAGES_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, coalesce(html, '') AS h FROM pages),
r AS (SELECT *, octet_length(b)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.REVISIT_BYTES} AND page_id <> top THEN top END AS refers_to
FROM r
"""


@query("op9_warc_archives", PAGES_SQL)
def op9_warc_archives(spark: SparkSession, folder: str) -> DataFrame:
    path = _own_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).selectExpr("page AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.near_duplicate_groups(table(spark, folder, "documents")).selectExpr(
        "id AS doc_id", "n_shingles", "component_id")


@query("op2_line_crf")
def op2_line_crf(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    seen = table(spark, folder, "labels").select("doc_id", "quality").where(~line_crf.is_held_out("doc_id"))
    scored = line_crf.score(docs, line_crf.train(docs, seen))
    return scored.select(
        "doc_id", line_crf.is_held_out("doc_id").alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


LINES_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
f AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, trim(regexp_replace(line, '[{SPACE}]+', ' ', 'g')) AS line,
             len(regexp_extract_all(line, '[^{SPACE}]+')) AS n FROM l WHERE regexp_matches(line, '[^{SPACE}]')),
s AS (SELECT a.doc_id, a.pos, min(b.pos) - a.pos + 1 AS reach FROM f a JOIN (
        SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) AS upto, n FROM f) b USING (doc_id)
      JOIN (SELECT doc_id, pos, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS base FROM f) c ON c.doc_id = a.doc_id AND c.pos = a.pos
      WHERE b.pos BETWEEN a.pos AND a.pos + {line_dedup.MIN_WORDS} AND b.upto - c.base >= {line_dedup.MIN_WORDS} GROUP BY a.doc_id, a.pos),
w AS (SELECT s.doc_id, s.pos, reach, string_agg(line, chr(10) ORDER BY f.pos) AS run FROM s JOIN f ON f.doc_id = s.doc_id
      AND f.pos BETWEEN s.pos AND s.pos + reach - 1 GROUP BY s.doc_id, s.pos, reach),
r AS (SELECT *, first_value(doc_id) OVER g AS fd, first_value(pos) OVER g AS fp FROM w WINDOW g AS (PARTITION BY run ORDER BY doc_id, pos)),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + reach)) AS pos FROM r WHERE doc_id <> fd OR pos >= fp + reach),
isle AS (SELECT doc_id, g.pos, n, g.pos - row_number() OVER (PARTITION BY doc_id ORDER BY g.pos) AS run FROM gone g JOIN f USING (doc_id, pos)),
sums AS (SELECT doc_id, count(*) AS lines, sum(n) AS words, count(DISTINCT run) AS runs FROM isle GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_lines FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(lines, 0)::BIGINT AS n_deleted_lines,
       coalesce(words, 0)::BIGINT AS n_deleted_words, coalesce(runs, 0)::BIGINT AS n_runs
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sums s ON s.doc_id = d.doc_id
"""


@query("op3_line_runs", LINES_SQL)
def op3_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_report(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op6_gru_language_model")
def op6_gru_language_model(spark: SparkSession, folder: str) -> DataFrame:
    return gru_lm.score(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


AUDIT_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {source_audit.MIN_DOCS}),
s AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM t GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c JOIN k USING (lang, term) GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c,
             1 + ({source_audit.SCALE}::HUGEINT * (coalesce(c, 0) + {source_audit.SMOOTH})) // (coalesce(n.n, 0) + {source_audit.SMOOTH} * v)::HUGEINT AS p,
             1 + ({source_audit.SCALE}::HUGEINT * (total + {source_audit.SMOOTH})) // (s.n + {source_audit.SMOOTH} * v)::HUGEINT AS q
      FROM g JOIN k ON k.lang = g.lang JOIN s ON s.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE c > 0 AND p > q),
z AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r)
SELECT * FROM z WHERE part = 'pair' OR rank <= {source_audit.TOP_TERMS}
"""


@query("op11_source_audit", AUDIT_SQL)
def op11_source_audit(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.source_audit(table(spark, folder, "documents"))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    seen = table(spark, folder, "labels").select("doc_id", "toxic").where(~line_crf.is_held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, seen))
    return scored.select(
        "doc_id", line_crf.is_held_out("doc_id").alias("held_out"), F.col("toxicity").alias("score"),
        (F.col("toxicity") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


# crc32 of a decimal number, bit by bit
CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""

TRIE_SQL = rf"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
             md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS r,
             [coalesce(role, ''), coalesce(text, '')] AS step FROM conversations WHERE conv_id IS NOT NULL),
w AS (SELECT conv_id, list(step ORDER BY r) AS steps FROM o GROUP BY conv_id),
h AS (SELECT conv_id, steps, {CRC_SQL} % {conversation_trie.HEAD + 1} AS h FROM w),
p AS (SELECT h.conv_id, list_concat(coalesce(b.steps[1:h.h], []), h.steps[h.h + 1:]) AS path FROM h
      LEFT JOIN w b ON b.conv_id = h.conv_id - h.conv_id % {conversation_trie.FAMILY}),
m AS (SELECT conv_id, len(path) AS n, path[1:d] AS node, d FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM p)),
n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY node, d),
u AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
a AS (SELECT n.*, coalesce(n_children, 0) AS n_children,
             CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node[d][2], '[^{SPACE}]+')) END AS saved
      FROM n LEFT JOIN u USING (node)),
s AS (SELECT top, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
      FROM (SELECT saved, n_children, node[1:e] AS top FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM a)) GROUP BY top)
SELECT a.conv_id, a.d AS depth, q.conv_id AS parent_conv_id, a.n_convs, a.n_children, n_leaves::BIGINT AS n_leaves,
       saved_tokens::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM a JOIN s ON s.top = a.node LEFT JOIN n q ON a.d > 0 AND q.node = a.node[1:a.d - 1]
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie.prefix_trie(table(spark, folder, "conversations"))
