"""The queries ``opN_<name>`` and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.llm import bpe, chat_format, chat_queries, embedding_dedup, html_extract, mixing, quality_classifier, quality_rules, sharding, simhash_dedup, url_filter

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_chats(table(spark, sf_dir, "conversations"), chat_queries.TOOLS)


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), path=None)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("stratum", "text_hash").withColumn("rejected_by", F.array_join(F.array_sort("rejected_by"), " "))


QUERIES: dict[str, Query] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_dedup": op3_simhash_dedup,
    "op4_chat_format": op4_chat_format,
    "op5_html_extract": op5_html_extract,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_url_filter": op8_url_filter,
    "op9_bpe": op9_bpe,
    "op10_quality_rules": op10_quality_rules,
}

#: Every pair of equal labels is compared, and reached ids are found by recursion.
OP1_SQL = """
WITH RECURSIVE unit AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.93
),
reached AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
),
least AS (SELECT a, min(b) AS component_id FROM reached GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN least m ON m.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

_MEASURES_SQL = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
}
#: Counts, the exact binomial bound of each stratum and rule, the walk down its grid on one half of the labels, the test of
#: a stratum's rules together on the other half, and the verdicts.
OP10_SQL = f"""
WITH split AS (
  SELECT doc_id, lang AS stratum, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
         [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines
  FROM documents
),
shingles AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM split)
),
again AS (SELECT doc_id, i FROM shingles QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
counts AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM (
    SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in words]), 0) AS BIGINT) AS word_chars,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
           CAST(len(regexp_extract_all(coalesce(text, ''), '\\p{{Lu}}')) AS BIGINT) AS n_capitals
    FROM split LEFT JOIN covered USING (doc_id))
),
measured AS ({" UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{r}' AS rule, {e} AS measure FROM counts" for r, e in _MEASURES_SQL.items())}),
marks AS (SELECT doc_id, max(quality = 1) AS good, substring(md5(CAST(doc_id AS VARCHAR)), 1, 1) < '8' AS choosing FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
binned AS (
  SELECT stratum, rule, CAST(ceil(least(1.0, measure) * {quality_rules.STEPS}) AS BIGINT) AS step, count(*) FILTER (good) AS goods, count(*) FILTER (NOT good) AS bads
  FROM measured JOIN marks USING (doc_id) WHERE NOT base_failed AND choosing GROUP BY ALL
),
totals AS (
  SELECT stratum, rule, sum(goods) AS n_good, sum(bads) AS n_bad,
         {quality_rules.ERROR} / ((SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM binned) * {len(_MEASURES_SQL)}) AS error
  FROM binned GROUP BY stratum, rule
),
tails AS (
  SELECT *, sum(exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln({quality_rules.RISK}) + (n_good - k) * ln(1 - {quality_rules.RISK}))) OVER (PARTITION BY stratum, rule ORDER BY k) AS tail
  FROM (SELECT *, unnest(range(0, CAST(floor(n_good * {quality_rules.RISK}) AS BIGINT) + 1)) AS k FROM totals)
),
limits AS (SELECT stratum, rule, any_value(n_good) AS n_good, any_value(n_bad) AS n_bad, any_value(error) AS error, coalesce(max(k) FILTER (tail <= error), -1) AS allowed FROM tails GROUP BY stratum, rule),
walk AS (
  SELECT *, sum(goods) OVER down AS rejected, sum(bads) OVER down AS caught, coalesce(lead(step) OVER down, 0) AS below
  FROM binned WINDOW down AS (PARTITION BY stratum, rule ORDER BY step DESC)
),
safe AS (
  SELECT w.*, caught / n_bad - rejected / n_good AS gain FROM walk w JOIN limits l ON w.stratum IS NOT DISTINCT FROM l.stratum AND w.rule = l.rule
  WHERE rejected <= allowed AND step > 0 AND n_bad > 0 AND n_good > 0 AND caught >= {quality_rules.PRECISION} * (caught + rejected)
    AND list_sum([exp(lgamma(caught + rejected + 1) - lgamma(k + 1) - lgamma(caught + rejected - k + 1) + (caught + rejected) * ln(0.5)) for k in range(0, CAST(rejected AS BIGINT) + 1)]) <= error
),
chosen AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY gain DESC, rule) AS turn FROM (
  SELECT stratum, rule, gain, (below + step - 1) / 2 / {float(quality_rules.STEPS)} AS cutoff FROM safe WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY gain DESC, step DESC) = 1)),
tested AS (
  SELECT m.doc_id, m.stratum, min(turn) FILTER (measure > cutoff) AS turn
  FROM measured m JOIN marks USING (doc_id) JOIN chosen c ON m.stratum IS NOT DISTINCT FROM c.stratum AND m.rule = c.rule
  WHERE NOT base_failed AND good AND NOT choosing GROUP BY m.doc_id, m.stratum
),
test_sizes AS (SELECT stratum, count(*) AS n, {quality_rules.ERROR} / (SELECT count(DISTINCT coalesce(stratum, chr(0))) FROM chosen) AS error FROM tested GROUP BY stratum),
test_tails AS (
  SELECT *, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({quality_rules.RISK}) + (n - k) * ln(1 - {quality_rules.RISK}))) OVER (PARTITION BY stratum ORDER BY k) AS tail
  FROM (SELECT *, unnest(range(0, CAST(floor(n * {quality_rules.RISK}) AS BIGINT) + 1)) AS k FROM test_sizes)
),
test_limits AS (SELECT stratum, coalesce(max(k) FILTER (tail <= error), -1) AS allowed FROM test_tails GROUP BY stratum),
cutoffs AS (
  SELECT c.stratum, c.rule, c.cutoff FROM chosen c JOIN test_limits l ON c.stratum IS NOT DISTINCT FROM l.stratum
  WHERE (SELECT count(*) FROM tested t WHERE t.stratum IS NOT DISTINCT FROM c.stratum AND t.turn <= c.turn) <= l.allowed
),
fired AS (SELECT doc_id, string_agg(m.rule, ' ' ORDER BY m.rule) AS rejected_by FROM measured m JOIN cutoffs c ON m.stratum IS NOT DISTINCT FROM c.stratum AND m.rule = c.rule WHERE measure > cutoff GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM counts LEFT JOIN fired USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op4_chat_format": chat_queries.OP4_SQL, "op10_quality_rules": OP10_SQL}

#: Queries that show an operator on rows which no table holds as they are, and their SQL.
RELATED: dict[str, Query] = {"chat_tool_calls": chat_queries.chat_tool_calls}
RELATED_SQL: dict[str, str] = {"chat_tool_calls": chat_queries.TOOL_CALLS_SQL}
