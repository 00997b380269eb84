"""Queries over the test tables, one for each operator, and SQL with the same rows.

Token vectors come from ``embeddings``: document d owns the vectors 4d to
4d + 3. Many documents own none, as in an index that lags behind another.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronry.functions.text import Analyzer, term_counts, words
from heronry.functions.vectors import all_finite, dot, int8_codes, int8_decode, int8_scale, l2_norm
from heronry.model import Subset
from heronry.operators.lexical import bm25_scores, corpus_stats, document_frequency, match_scores, positive, postings
from heronry.operators.maxsim import maxsim_arrow, maxsim_relational
from heronry.operators.presence import delete, freshness, newest_rows, present_rows, repeated, running_offsets, upsert
from heronry.operators.rank import gather_top, rank
from heronry.operators.subset import restrict
from heronry.plans.batch import search_many
from heronry.plans.lexical_index import LexicalCandidateGenerator, publish
from heronry.sources import files

Query = Callable[[SparkSession, str], DataFrame]

TERMS = ["the", "thereof", "les", "tion", "und", "erin"]
TEXT = " ".join(TERMS)
QUERY_VECTORS = (3, 77, 150, 301)
BATCH = {"a": (3, 77), "b": (150, 301), "c": (3, 301)}
LISTED = ["1", "2", "3", "5", "8", "13", "21", "34", "55", "89", "144", "150", "160", "170", "180"]
GATHER, LIMIT = 200, 20

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("vec_id div 4").alias("doc_id"), F.expr("cast(vec_id % 4 as int)").alias("pos"), F.col("embedding").alias("vector"))


def flat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(doc_id, token_count, vectors)`` with the tokens of a document in one flat array."""
    per = tokens(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "vector"))).alias("t"))
    return per.select("doc_id", F.size("t").alias("token_count"), F.flatten(F.transform("t", lambda x: x["vector"])).alias("vectors"))


def query_tokens(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = QUERY_VECTORS, name: str = "q") -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids))
    return e.select(F.lit(name).alias("query_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector"))


def _values(ids: tuple[int, ...]) -> str:
    return ", ".join(map(str, ids))


def _terms() -> str:
    return ", ".join(f"'{t}'" for t in TERMS)


# SQL fragments
S_TERMS = r"regexp_extract_all(strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss')), '[\p{L}\p{N}_]+')"
S_COUNTED = f"counted AS (SELECT doc_id, {S_TERMS} AS terms FROM documents), stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM counted)"
S_POSTINGS = f"{S_COUNTED}, postings AS (SELECT term, doc_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM counted) GROUP BY term, doc_id), freq AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"
S_BM25 = f"""{S_POSTINGS}, bm25 AS (
  SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.5 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)) AS score
  FROM postings JOIN freq USING (term) CROSS JOIN stats WHERE term IN ({_terms()}) GROUP BY doc_id)"""
S_TOKENS = "tokens AS (SELECT vec_id // 4 AS doc_id, vec_id % 4 AS pos, embedding AS vector FROM embeddings)"
S_DOT = "list_dot_product(CAST({} AS DOUBLE[]), CAST({} AS DOUBLE[]))"


def s_maxsim(ids: tuple[int, ...] = QUERY_VECTORS) -> str:
    return f"""{S_TOKENS}, maxsim AS (
  SELECT doc_id, sum(best) AS score FROM (
    SELECT t.doc_id, q.vec_id, max({S_DOT.format('t.vector', 'q.embedding')}) AS best
    FROM tokens t CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN ({_values(ids)})) q GROUP BY t.doc_id, q.vec_id)
  GROUP BY doc_id)"""


_built: dict[tuple[str, str, str], str] = {}


def built(spark: SparkSession, sf_dir: str, name: str, make: Callable[[str], None]) -> str:
    """The path of an index or store that ``make(path)`` builds once for a session and a folder of tables, as users build once and search often."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = files.temporary(spark, name)
        make(path)
        _built[key] = path
    return _built[key]


def lexical(spark: SparkSession, sf_dir: str) -> LexicalCandidateGenerator:
    """BM25 over the published index of all documents."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return LexicalCandidateGenerator(built(spark, sf_dir, "lexicon", lambda path: publish(documents, path, "docs", Analyzer())), Analyzer(), spark)


def _bm25(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    scored = lexical(spark, sf_dir).scores(Analyzer().tokens(TEXT)).withColumn("doc_id", F.col("doc_id").cast("long"))
    return scored.join(table(spark, sf_dir, "documents").select("doc_id", *keep), "doc_id") if keep else scored


def _gathered(scored: DataFrame, limit: int = GATHER) -> DataFrame:
    return gather_top(scored.withColumnRenamed("score", "gather_score"), limit, tie=("doc_id",))


@query(f"""SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS BIGINT) AS gather_rank
FROM (SELECT doc_id, CAST(len([w for w in string_split_regex(text, '\\s+') if w IN ({_terms()})]) AS BIGINT) AS score FROM documents)
WHERE score > 0 QUALIFY gather_rank < {GATHER}""")
def term_match_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = match_scores(table(spark, sf_dir, "documents"), TEXT)
    return gather_top(scored, GATHER, "score", ("doc_id",)).select("doc_id", "score", "gather_rank")


@query(f"WITH {S_COUNTED} SELECT doc_id, CAST(len(terms) AS BIGINT) AS n_terms, CAST(len(list_distinct(terms)) AS BIGINT) AS n_distinct, CAST(len([w for w in string_split_regex(coalesce(text, ''), '\\s+') if w <> '']) AS BIGINT) AS n_words FROM counted JOIN documents USING (doc_id)")
def analyzer_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("n_words", F.size(words(F.coalesce("text", F.lit("")))).cast("long"))
    return term_counts(docs, Analyzer(), keep=("n_words",)).select("doc_id", F.col("dl").alias("n_terms"), F.size("terms").cast("long").alias("n_distinct"), "n_words")


@query(f"WITH {S_POSTINGS} SELECT term, CAST(df AS BIGINT) AS df, n, round(avgdl, 6) AS avgdl FROM freq CROSS JOIN stats")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical(spark, sf_dir)
    one = index.statistics().select("n", F.round("avgdl", 6).alias("avgdl"))
    return document_frequency(index.current()[1]).crossJoin(F.broadcast(one))  # a single row


@query(f"WITH {S_BM25} SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS BIGINT) AS gather_rank FROM bm25 QUALIFY gather_rank < {GATHER}")
def bm25_gather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(_bm25(spark, sf_dir)).select("doc_id", F.round("gather_score", 6).alias("score"), "gather_rank")


@query(f"WITH {S_BM25} SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS BIGINT) AS gather_rank FROM bm25 QUALIFY gather_rank < {GATHER}")
def bm25_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``bm25_gather``, from the raw documents: analyzed once for these terms, then read as postings and as statistics."""
    path = files.temporary(spark, "counted")
    term_counts(table(spark, sf_dir, "documents"), Analyzer(), only=TERMS).write.parquet(path)
    counted = spark.read.parquet(path)
    scored = positive(bm25_scores(postings(counted), corpus_stats(counted), TERMS))
    return _gathered(scored).select("doc_id", F.round("gather_score", 6).alias("score"), "gather_rank")


def _subset(spark: SparkSession, sf_dir: str, subset: Subset) -> DataFrame:
    scored = _bm25(spark, sf_dir).select(F.lit("docs").alias("corpus"), F.col("doc_id").cast("string").alias("doc_id"), "score")
    return gather_top(restrict(scored, subset), GATHER, "score").select("doc_id", F.round("score", 6).alias("score"), "gather_rank")


def _s_subset(where: str) -> str:
    return f"WITH {S_BM25} SELECT CAST(doc_id AS VARCHAR) AS doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) - 1 AS BIGINT) AS gather_rank FROM bm25 WHERE CAST(doc_id AS VARCHAR) {where} QUALIFY gather_rank < {GATHER}"


_LISTED_SQL = "(" + ", ".join(f"'{i}'" for i in LISTED) + ")"


@query(_s_subset(f"IN {_LISTED_SQL}"))
def bm25_subset_including(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subset(spark, sf_dir, Subset().including("docs", LISTED))


@query(_s_subset(f"NOT IN {_LISTED_SQL}"))
def bm25_subset_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subset(spark, sf_dir, Subset().excluding("docs", LISTED))


@query("SELECT source AS corpus, CAST(doc_id AS VARCHAR) AS doc_id FROM documents WHERE source = 'src1' OR (source = 'src2' AND CAST(doc_id AS VARCHAR) IN ('2', '22', '42'))")
def subset_unnamed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.col("doc_id").cast("string").alias("doc_id"))
    return restrict(docs, Subset().excluding("src1", []).including("src2", ["2", "22", "42"]))


@query(f"WITH {s_maxsim()} SELECT doc_id, round(score, 6) AS score FROM maxsim")
def maxsim_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsim_relational(tokens(spark, sf_dir), query_tokens(spark, sf_dir)).select("doc_id", F.round("score", 6).alias("score"))


def _matrix(spark: SparkSession, sf_dir: str, ids: tuple[int, ...] = QUERY_VECTORS) -> np.ndarray:
    rows = table(spark, sf_dir, "embeddings").where(F.col("vec_id").isin(*ids)).orderBy("vec_id").select("embedding").collect()
    return np.array([r[0] for r in rows], np.float32)


@query(f"WITH {s_maxsim()} SELECT doc_id, round(score, 4) AS score FROM maxsim")
def maxsim_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = maxsim_arrow(flat_documents(spark, sf_dir), [("q", _matrix(spark, sf_dir))])
    return scored.select("doc_id", F.round(F.col("score").cast("double"), 4).alias("score"))


S_CODES = """coded AS (
  SELECT vec_id, scale, [CAST(greatest(-127, least(127, round(CAST(CAST(x AS FLOAT) / scale AS FLOAT)))) AS BIGINT) for x in embedding] AS codes
  FROM (SELECT vec_id, embedding, greatest(CAST(list_max([abs(x) for x in embedding]) / CAST(127 AS FLOAT) AS FLOAT), CAST(1e-12 AS FLOAT)) AS scale FROM embeddings))"""


@query(f"WITH {S_CODES} SELECT vec_id, round(CAST(scale AS DOUBLE), 9) AS scale, CAST(list_sum(codes) AS BIGINT) AS code_sum, CAST(list_max(codes) AS BIGINT) AS code_max, CAST(list_min(codes) AS BIGINT) AS code_min FROM coded")
def int8_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("scale", int8_scale(F.col("embedding")))
    coded = e.select("vec_id", "scale", int8_codes(F.col("embedding"), F.col("scale")).alias("codes"))
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return coded.select("vec_id", F.round(F.col("scale").cast("double"), 9).alias("scale"), total.alias("code_sum"), F.array_max("codes").cast("long").alias("code_max"), F.array_min("codes").cast("long").alias("code_min"))


@query(f"""WITH {S_CODES}, decoded AS (SELECT vec_id, [CAST(c AS DOUBLE) * scale for c in codes] AS v FROM coded),
unit AS (SELECT vec_id, [x / sqrt(list_dot_product(v, v)) for x in v] AS v FROM decoded)
SELECT doc_id, round(sum(best), 4) AS score FROM (
  SELECT u.vec_id // 4 AS doc_id, q.vec_id, max({S_DOT.format('u.v', 'q.embedding')}) AS best
  FROM unit u CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN ({_values(QUERY_VECTORS)})) q GROUP BY 1, 2)
GROUP BY doc_id""")
def maxsim_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokens(spark, sf_dir).withColumn("scale", int8_scale(F.col("vector")))
    t = t.withColumn("vector", int8_decode(int8_codes(F.col("vector"), F.col("scale")), F.col("scale"), True))
    return maxsim_relational(t, query_tokens(spark, sf_dir)).select("doc_id", F.round("score", 4).alias("score"))


S_PIPELINE = f"""WITH {S_BM25}, {s_maxsim()}, gathered AS (
  SELECT doc_id, score AS gather_score, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS gather_rank FROM bm25 QUALIFY gather_rank < {GATHER}),
scored AS (SELECT g.*, m.score FROM gathered g LEFT JOIN maxsim m USING (doc_id))"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    gathered = F.broadcast(_gathered(_bm25(spark, sf_dir)))  # GATHER rows at most
    held = tokens(spark, sf_dir).join(gathered.select("doc_id"), "doc_id", "left_semi")
    return gathered.join(maxsim_relational(held, query_tokens(spark, sf_dir)).drop("query_id"), "doc_id", "left")


@query(f"{S_PIPELINE} SELECT doc_id, round(score, 6) AS score, CAST(gather_rank AS BIGINT) AS gather_rank, row_number() OVER (ORDER BY score DESC, gather_rank) AS rank FROM scored WHERE score IS NOT NULL QUALIFY rank <= {LIMIT}")
def pipeline_bm25_maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(_pipeline(spark, sf_dir), LIMIT).select("doc_id", F.round("score", 6).alias("score"), "gather_rank", "rank")


@query(f"{S_PIPELINE} SELECT count(*) AS candidate_count, count(*) FILTER (score IS NULL) AS dropped, 'float32-exact-full-maxsim' AS score_semantics FROM scored")
def diagnostics_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _pipeline(spark, sf_dir).agg(F.count("*").alias("candidate_count"), F.count_if(F.col("score").isNull()).alias("dropped"))
    return seen.withColumn("score_semantics", F.lit("float32-exact-full-maxsim"))


@query(f"""SELECT doc_id, n_chars AS score, gather_rank, row_number() OVER (ORDER BY n_chars DESC, gather_rank) AS rank
FROM (SELECT doc_id, n_chars, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS gather_rank FROM documents) QUALIFY rank <= {LIMIT}""")
def pipeline_gather_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gathered in order of id; the result is sorted by score again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score"))
    gathered = docs.withColumn("gather_rank", F.col("doc_id"))  # ids are dense from 0: they are ranks
    return rank(gathered, LIMIT).select("doc_id", "score", "gather_rank", "rank")


@query(f"SELECT doc_id, round(score, 1) AS score, gather_rank, row_number() OVER (ORDER BY score DESC, gather_rank) AS rank FROM (SELECT doc_id, (n_chars // 500) * 1.0 AS score, doc_id AS gather_rank FROM documents) QUALIFY rank <= {5 * LIMIT}")
def rank_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    tied = table(spark, sf_dir, "documents").select("doc_id", F.expr("cast(n_chars div 500 as double)").alias("score"), F.col("doc_id").alias("gather_rank"))
    return rank(tied, 5 * LIMIT)


S_SEGMENTS = """rows AS (SELECT vec_id % 3 AS segment_id, vec_id AS row, CAST(vec_id // 2 AS VARCHAR) AS doc_id, CAST(1 + vec_id % 5 AS INT) AS token_count, embedding FROM embeddings),
newest AS (SELECT doc_id, max_by(row, segment_id * 1000000000 + row) AS row FROM rows GROUP BY doc_id),
present AS (SELECT r.* FROM newest JOIN rows r USING (row) WHERE row % 7 <> 0)"""


def _segments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").select(
        F.expr("vec_id % 3").alias("segment_id"), F.col("vec_id").alias("row"), F.expr("cast(vec_id div 2 as string)").alias("doc_id"), F.expr("cast(1 + vec_id % 5 as int)").alias("token_count"), "embedding"
    )
    return rows, rows.where("row % 7 = 0").select("segment_id", "row")


@query(f"WITH {S_SEGMENTS} SELECT doc_id, segment_id, row FROM present")
def store_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = _segments(spark, sf_dir)
    return present_rows(rows, gone)


@query(f"WITH {S_SEGMENTS} SELECT doc_id, max_by(segment_id, segment_id * 1000000000 + row) AS segment_id, max_by(row, segment_id * 1000000000 + row) AS row FROM rows GROUP BY doc_id")
def store_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest_rows(_segments(spark, sf_dir)[0])


@query(f"WITH {S_SEGMENTS}, asked AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS doc_id FROM labels) SELECT doc_id, token_count FROM asked LEFT JOIN present USING (doc_id)")
def store_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gone = _segments(spark, sf_dir)
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id")).distinct()
    held = rows.join(present_rows(rows, gone), ["doc_id", "segment_id", "row"], "left_semi")
    return asked.join(held.select("doc_id", "token_count"), "doc_id", "left")


@query(f"WITH {S_SEGMENTS}, asked AS (SELECT doc_id AS pos, CAST(doc_id % 300 AS VARCHAR) AS doc_id FROM labels) SELECT pos, doc_id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM asked JOIN present USING (doc_id)")
def store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors by requested position, the same document as often as it is asked for."""
    rows, gone = _segments(spark, sf_dir)
    asked = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pos"), F.expr("cast(doc_id % 300 as string)").alias("doc_id"))
    held = rows.join(present_rows(rows, gone), ["doc_id", "segment_id", "row"], "left_semi")
    total = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return asked.join(held, "doc_id").select("pos", "doc_id", F.round(total, 6).alias("total"))


@query(f"WITH {S_SEGMENTS} SELECT doc_id, CAST(row_number() OVER (ORDER BY segment_id, row) - 1 AS BIGINT) AS new_row, token_count FROM present")
def store_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One segment of what is present, in segment and row order; rows are numbered from partition totals."""
    rows, gone = _segments(spark, sf_dir)
    live = rows.join(present_rows(rows, gone), ["doc_id", "segment_id", "row"], "left_semi").select("segment_id", "row", "doc_id", "token_count")
    before = running_offsets(live.groupBy("segment_id").agg(F.count("*").alias("n")), F.col("n"), ["segment_id"], [], "before").drop("n")  # a row a segment
    inside = F.row_number().over(Window.partitionBy("segment_id").orderBy("row")) - 1
    return live.withColumn("inside", inside).join(before, "segment_id").select("doc_id", (F.col("before") + F.col("inside")).alias("new_row"), "token_count")


S_NEW = "SELECT item_id AS doc_id, text, 'xx' AS lang, 'benchmark' AS source, CAST(length(text) AS BIGINT) AS n_chars FROM benchmark"


@query(f"WITH additions AS ({S_NEW}), merged AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM additions) UNION ALL SELECT * FROM additions) SELECT doc_id, source, md5(text) AS digest FROM merged")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit("benchmark").alias("source"), F.length("text").cast("long").alias("n_chars"))
    return upsert(table(spark, sf_dir, "documents"), new, ["doc_id"]).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def delete_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delete(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("toxic = 1"), ["doc_id"]).select("doc_id", "source")


@query(f"""WITH {S_BM25}, fused AS (SELECT lang AS corpus, doc_id, score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS k FROM bm25 JOIN documents USING (doc_id) WHERE lang IN ('en', 'fr'))
SELECT corpus, doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, corpus, doc_id) - 1 AS BIGINT) AS gather_rank FROM fused WHERE k <= {GATHER}""")
def fused_two_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _bm25(spark, sf_dir, ("lang",)).withColumnRenamed("lang", "corpus").where(F.col("corpus").isin("en", "fr"))
    best = gather_top(scored, GATHER, "score", ("doc_id",), per=("corpus",)).drop("gather_rank")
    return gather_top(best, 2 * GATHER, "score").select("corpus", "doc_id", F.round("score", 6).alias("score"), "gather_rank")


S_BATCH = " UNION ALL ".join(f"SELECT '{q}' AS query_id, * FROM embeddings WHERE vec_id IN ({_values(ids)})" for q, ids in BATCH.items())


@query(f"""WITH {S_TOKENS}, batch AS ({S_BATCH}), scored AS (
  SELECT query_id, doc_id, sum(best) AS score FROM (
    SELECT q.query_id, t.doc_id, q.vec_id, max({S_DOT.format('t.vector', 'q.embedding')}) AS best FROM tokens t CROSS JOIN batch q GROUP BY ALL) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored QUALIFY rank <= {LIMIT}""")
def batch_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several queries in one plan, ranked each by itself."""
    asked = None
    for name, ids in BATCH.items():
        rows = query_tokens(spark, sf_dir, ids, name)
        asked = rows if asked is None else asked.unionByName(rows)
    scored = maxsim_relational(tokens(spark, sf_dir), asked)
    return rank(scored, LIMIT, tie="doc_id", per=("query_id",)).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


BATCH_TERMS = {"a": ["the", "thereof", "the"], "b": ["les", "und"], "c": ["erin"]}
_S_ASKED = " UNION ALL ".join(f"SELECT '{q}' AS query_id, '{t}' AS term, {ts.count(t)} AS times" for q, ts in BATCH_TERMS.items() for t in dict.fromkeys(ts))


@query(f"""WITH {S_POSTINGS}, asked AS ({_S_ASKED}), {S_TOKENS}, batch AS ({S_BATCH}), gathered AS (
  SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (1.5 * (1 - 0.75 + 0.75 * dl / avgdl) + tf)) AS s
  FROM postings JOIN freq USING (term) JOIN asked USING (term) CROSS JOIN stats GROUP BY ALL),
top AS (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) - 1 AS BIGINT) AS gather_rank FROM gathered QUALIFY gather_rank < {GATHER}),
scored AS (
  SELECT query_id, doc_id, gather_rank, sum(best) AS score FROM (
    SELECT query_id, doc_id, gather_rank, q.vec_id, max({S_DOT.format('t.vector', 'q.embedding')}) AS best FROM top JOIN tokens t USING (doc_id) JOIN batch q USING (query_id) GROUP BY ALL) GROUP BY ALL)
SELECT query_id, doc_id, round(score, 6) AS score, gather_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, gather_rank) AS rank FROM scored QUALIFY rank <= {LIMIT}""")
def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline for several queries in one plan."""
    terms = sorted({t for ts in BATCH_TERMS.values() for t in ts})
    index = lexical(spark, sf_dir)
    hits = index.current()[1].where(F.col("term").isin(terms)).withColumn("doc_id", F.col("doc_id").cast("long"))
    matrices = {q: _matrix(spark, sf_dir, ids) for q, ids in BATCH.items()}
    found = search_many(hits, index.statistics(), BATCH_TERMS, GATHER, LIMIT, tokens(spark, sf_dir), matrices)
    return found.withColumn("score", F.round("score", 6))


@query("SELECT vec_id, round(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm, len([x for x in embedding if isnan(x) OR isinf(x)]) = 0 AS finite, abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) <= 0.0011 AS unit FROM embeddings")
def normalize_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(l2_norm(v), 6).alias("norm"), all_finite(v).alias("finite"), (F.abs(l2_norm(v) - 1) <= 0.0011).alias("unit"))


@query("SELECT label, vec_id, CAST(sum(1 + vec_id % 5) OVER (PARTITION BY label ORDER BY vec_id) - (1 + vec_id % 5) AS BIGINT) AS first_token FROM embeddings")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_offsets(table(spark, sf_dir, "embeddings").select("label", "vec_id"), F.expr("1 + vec_id % 5"), ["vec_id"], ["label"], "first_token")


@query("SELECT source, min(ts) AS as_of FROM (SELECT 'src' || (user_id % 5) AS source, max(ts) AS ts FROM events GROUP BY user_id) GROUP BY source")
def as_of_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Freshness: the oldest among the latest writes of a source's members."""
    return freshness(table(spark, sf_dir, "events"), [F.col("user_id")], F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")), F.col("ts"))


@query("SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated(table(spark, sf_dir, "documents"), [F.md5(F.col("text").cast("binary")).alias("digest")], F.col("doc_id"))
    return found.withColumnRenamed("first", "first_id")


@query(f"SELECT t.vec_id, round({S_DOT.format('t.embedding', 'q.embedding')}, 6) AS product FROM embeddings t CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_VECTORS[0]}) q")
def dot_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_tokens(spark, sf_dir, QUERY_VECTORS[:1]).select(F.col("vector").alias("q"))
    return table(spark, sf_dir, "embeddings").crossJoin(F.broadcast(q)).select("vec_id", F.round(dot(F.col("embedding"), F.col("q")), 6).alias("product"))


from heronry.plans import catalogue_stores  # noqa: E402, F401  (adds the queries over stores and pipelines)
