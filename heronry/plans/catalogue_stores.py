"""Queries through stores, published indexes and whole search pipelines, and SQL with the same rows.

Each builds what it reads with the library's own writers, once for a session
and a folder of tables, and then reads it the way a user does.
"""

from __future__ import annotations

import functools
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronry.functions.kernel import maxsim_scores_packed
from heronry.functions.text import Analyzer
from heronry.functions.vectors import int8_decode
from heronry.model import Feature, Query, Representation, ResourceBudget, SearchResult, Subset
from heronry.operators.presence import delete, upsert
from heronry.operators.rank import check_scores, rank
from heronry.operators.subset import check_candidates
from heronry.plans import catalogue as c
from heronry.plans.gather import FusedGenerator, TermMatchGenerator
from heronry.plans.lexical_index import LexicalCandidateGenerator, publish
from heronry.plans.pipeline import SearchPipeline
from heronry.plans.rerank import FrameSource, MaxSimReranker
from heronry.sources import files
from heronry.sources.inputs import read_documents, read_numbered, read_packed, write_documents
from heronry.sources.npy_store import present_documents, read_npy_store, write_npy_store
from heronry.sources.store import VectorStore, VectorStoreWriter

REPRESENTATION = Representation("fixture", "1", 64, True)
NOW = datetime(2024, 5, 1, tzinfo=timezone.utc)
TEXT = c.TEXT
#: Segments of the store with a history, by the remainder of the vector's id.
PARTS = 3


def _total(name: str = "vectors") -> Column:
    return F.aggregate(F.col(name).cast("array<double>"), F.lit(0.0), lambda s, x: s + x)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.flat_documents(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))


def store(spark: SparkSession, sf_dir: str, encoding: str = "float32", lang: str | None = None) -> VectorStore:
    """A store of the documents that own vectors: all of corpus ``docs``, or those of a language as a corpus."""

    def make(path: str) -> None:
        writer = VectorStoreWriter.create(path, lang or "docs", REPRESENTATION, encoding=encoding, spark=spark)
        held = _flat(spark, sf_dir)
        if lang:
            own = c.table(spark, sf_dir, "documents").where(F.col("lang") == lang).select(F.col("doc_id").cast("string").alias("doc_id"))
            held = held.join(own, "doc_id", "left_semi")
        writer.append_frame(held)
        writer.commit()

    return VectorStore(c.built(spark, sf_dir, f"store-{encoding}-{lang}", make), spark)


def history(spark: SparkSession, sf_dir: str, compacted: bool = False) -> VectorStore:
    """A store after three appends that replace each other's documents, a deletion, a return of some, and perhaps a compaction."""

    def make(path: str) -> None:
        e = c.table(spark, sf_dir, "embeddings")
        one = e.select("vec_id", F.expr("cast(vec_id div 2 as string)").alias("doc_id"), F.lit(1).alias("token_count"), F.col("embedding").alias("vectors"))
        VectorStoreWriter.create(path, "docs", REPRESENTATION, spark=spark)
        for part in range(PARTS):
            writer = VectorStoreWriter(path, spark)  # opened anew, as other processes do
            writer.append_frame(one.where(F.col("vec_id") % PARTS == part))
            writer.commit()
        writer.delete_frame(one.where("cast(doc_id as long) % 7 = 0").select("doc_id"))
        writer.commit()
        back = one.where("vec_id % 2 = 0 and cast(doc_id as long) % 21 = 0")
        writer.append_frame(back.withColumn("token_count", F.lit(2)).withColumn("vectors", F.concat("vectors", "vectors")))
        writer.commit()
        if compacted:
            writer.compact()
            writer.commit()
            writer.vacuum(0)

    return VectorStore(c.built(spark, sf_dir, f"history-{compacted}", make), spark)


S_HISTORY = f"""one AS (SELECT vec_id, vec_id // 2 AS doc, vec_id % {PARTS} AS part, embedding FROM embeddings),
newest AS (SELECT doc, arg_max(vec_id, part) AS vec_id FROM one GROUP BY doc),
history AS (
  SELECT CAST(n.doc AS VARCHAR) AS doc_id, CAST(1 AS INT) AS token_count, e.embedding, 1 AS times FROM newest n JOIN embeddings e USING (vec_id) WHERE n.doc % 7 <> 0
  UNION ALL SELECT CAST(doc AS VARCHAR), 2, embedding, 2 FROM one WHERE vec_id % 2 = 0 AND doc % 21 = 0)"""
S_TOTAL = "round(times * list_sum(CAST(embedding AS DOUBLE[])), 5)"


@c.query(f"WITH {S_HISTORY} SELECT doc_id, token_count, {S_TOTAL} AS total FROM history")
def vector_store_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store holds after replacements, deletions and returns."""
    return history(spark, sf_dir).read(lambda v: v.present().select("doc_id", "token_count", F.round(_total(), 5).alias("total")))


@c.query(f"WITH {S_HISTORY} SELECT doc_id, token_count, {S_TOTAL} AS total, 1 AS segments, 0 AS tombstones, CAST(sum(token_count) OVER () AS BIGINT) AS tokens FROM history")
def vector_store_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents after compaction, and what the manifest says of them."""
    view = history(spark, sf_dir, True).view()
    m = view.manifest
    counted = [F.lit(len(m.segments)).alias("segments"), F.lit(len(m.tombstones)).alias("tombstones"), F.lit(sum(s[2] for s in m.segments)).cast("long").alias("tokens")]
    return view.present().select("doc_id", "token_count", F.round(_total(), 5).alias("total"), *counted)


_S_COMMITS = " UNION ALL ".join(f"SELECT {k + 1} AS n, count(DISTINCT doc) AS present FROM one WHERE part <= {k}" for k in range(PARTS))


@c.query(f"""WITH {S_HISTORY}, commits AS ({_S_COMMITS}
  UNION ALL SELECT {PARTS + 1}, count(DISTINCT doc) FROM one WHERE doc % 7 <> 0
  UNION ALL SELECT {PARTS + 2}, count(*) FROM history)
SELECT CAST(n AS BIGINT) AS commit, present FROM commits""")
def vector_store_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that was opened first sees after each commit of a writer."""
    path = files.temporary(spark, "commits")
    e = c.table(spark, sf_dir, "embeddings")
    one = e.select("vec_id", F.expr("cast(vec_id div 2 as string)").alias("doc_id"), F.lit(1).alias("token_count"), F.col("embedding").alias("vectors"))
    writer = VectorStoreWriter.create(path, "docs", REPRESENTATION, spark=spark)
    reader, seen = VectorStore(path, spark), []

    def commit() -> None:
        writer.commit()
        view = reader.view()
        seen.append((view.commit, view.index().count()))

    for part in range(PARTS):
        writer.append_frame(one.where(F.col("vec_id") % PARTS == part))
        commit()
    writer.delete_frame(one.where("cast(doc_id as long) % 7 = 0").select("doc_id"))
    commit()
    writer.append_frame(one.where("vec_id % 2 = 0 and cast(doc_id as long) % 21 = 0"))
    commit()
    return spark.createDataFrame(seen, "commit long, present long")


@c.query(f"WITH {S_HISTORY} SELECT l.doc_id, h.token_count, h.token_count IS NOT NULL AS held FROM labels l LEFT JOIN history h ON h.doc_id = CAST(l.doc_id AS VARCHAR)")
def vector_store_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = c.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))
    found = history(spark, sf_dir).view().lengths(asked)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "token_count", F.col("token_count").isNotNull().alias("held"))


@c.query(f"WITH {S_HISTORY} SELECT k AS place, h.doc_id, {S_TOTAL} AS total FROM labels l JOIN history h ON h.doc_id = CAST(l.doc_id AS VARCHAR) CROSS JOIN (SELECT unnest([0, 1]) AS k)")
def vector_store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the labelled documents that are held, each asked for twice."""
    view = history(spark, sf_dir).view()
    held = view.lengths(c.table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("doc_id"))).where("token_count is not null")
    asked = held.select(F.lit(0).alias("place"), "doc_id").unionAll(held.select(F.lit(1).alias("place"), "doc_id"))
    # the token count is what refuses absent ids
    return view.fetched(asked).where("token_count > 0").select("place", "doc_id", F.round(_total(), 5).alias("total"))


@c.query(f"WITH {c.S_CODES}, {c.S_TOKENS} SELECT CAST(vec_id // 4 AS VARCHAR) AS doc_id, CAST(sum(list_sum(codes)) AS BIGINT) AS code_sum, round(sum(CAST(scale AS DOUBLE)), 6) AS scale_sum FROM coded GROUP BY 1")
def vector_store_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and scales that an int8 store wrote."""
    codes = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return store(spark, sf_dir, "int8").view().present().select("doc_id", codes.alias("code_sum"), F.round(_total("scales"), 6).alias("scale_sum"))


def _searched(spark: SparkSession, result: SearchResult, decimals: int) -> DataFrame:
    rows = [(d.corpus, d.document_id, float(d.score), d.rank) for d in result.documents]
    return spark.createDataFrame(rows, "corpus string, doc_id string, score double, rank long").withColumn("score", F.round("score", decimals))


def _query(spark: SparkSession, sf_dir: str, text: str = TEXT) -> Query:
    return Query(text, multi_vector=Feature(REPRESENTATION, provider=lambda: c._matrix(spark, sf_dir)))


def _search(spark: SparkSession, sf_dir: str, source: object, **more) -> SearchResult:
    pipeline = SearchPipeline(c.lexical(spark, sf_dir), MaxSimReranker([source]))
    return pipeline.search(_query(spark, sf_dir), gather_limit=c.GATHER, limit=c.LIMIT, **more)


def _s_search(where: str = "") -> str:
    """As in a search: gathered by BM25 with ties by id as text, then rescored."""
    return f"""WITH {c.S_BM25}, {c.s_maxsim()}, gathered AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) - 1 AS gather_rank FROM bm25 {where} QUALIFY gather_rank < {c.GATHER}),
scored AS (SELECT g.*, m.score FROM gathered g LEFT JOIN maxsim m USING (doc_id))"""


def _s_ranked(where: str = "") -> str:
    return f"{_s_search(where)} SELECT 'docs' AS corpus, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC, gather_rank) AS rank FROM scored WHERE score IS NOT NULL QUALIFY rank <= {c.LIMIT}"


@c.query(_s_ranked())
def search_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published index gathers, a store rescores."""
    return _searched(spark, _search(spark, sf_dir, store(spark, sf_dir)), 3)


@c.query(_s_ranked())
def search_small_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under a budget of a few tokens and documents a batch."""
    return _searched(spark, _search(spark, sf_dir, store(spark, sf_dir), budget=ResourceBudget(max_batch_tokens=9, max_documents_per_batch=2)), 3)


@c.query(_s_ranked())
def search_frame_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with vectors that no store holds."""
    return _searched(spark, _search(spark, sf_dir, FrameSource(_flat(spark, sf_dir), "docs", REPRESENTATION, NOW)), 3)


@c.query(_s_ranked(f"WHERE CAST(doc_id AS VARCHAR) NOT IN {c._LISTED_SQL}"))
def search_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, _search(spark, sf_dir, store(spark, sf_dir), subset=Subset().excluding("docs", c.LISTED)), 3)


@c.query(f"""{_s_search()} SELECT count(*) AS candidate_count, count(*) FILTER (score IS NULL) AS dropped, 'LexicalCandidateGenerator' AS gatherer, 'MaxSimReranker' AS reranker, 'float32-exact-full-maxsim' AS score_semantics, true AS as_of_is_the_oldest FROM scored""")
def search_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search says of itself; it is as fresh as the older of the index and the store."""
    held = store(spark, sf_dir)
    found = _search(spark, sf_dir, held)
    d = found.diagnostics
    oldest = min(held.view().as_of, datetime.fromtimestamp(c.lexical(spark, sf_dir).current()[0]["written_at"], timezone.utc))
    row = (d["candidate_count"], d["dropped"], d["gatherer"], d["reranker"], d["score_semantics"], found.as_of == oldest)
    return spark.createDataFrame([row], "candidate_count long, dropped long, gatherer string, reranker string, score_semantics string, as_of_is_the_oldest boolean")


@c.query(f"WITH {c.S_BM25} SELECT 'docs' AS corpus, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM bm25 QUALIFY rank <= {c.LIMIT}")
def search_gather_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = SearchPipeline(c.lexical(spark, sf_dir)).search(TEXT, gather_limit=c.GATHER, limit=c.LIMIT)
    return _searched(spark, found, 3)


S_INT8 = f"""{c.S_CODES}, decoded AS (SELECT vec_id, [CAST(x AS DOUBLE) * scale for x in codes] AS v FROM coded),
unit AS (SELECT vec_id, [x / sqrt(list_dot_product(v, v)) for x in v] AS v FROM decoded),
int8 AS (SELECT doc_id, sum(best) AS score FROM (
  SELECT u.vec_id // 4 AS doc_id, q.vec_id, max({c.S_DOT.format("u.v", "q.embedding")}) AS best
  FROM unit u CROSS JOIN (SELECT * FROM embeddings WHERE vec_id IN ({c._values(c.QUERY_VECTORS)})) q GROUP BY 1, 2) GROUP BY doc_id)"""


@c.query(f"""WITH {c.S_BM25}, {S_INT8}, gathered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) - 1 AS gather_rank FROM bm25 QUALIFY gather_rank < {c.GATHER})
SELECT 'docs' AS corpus, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC, gather_rank) AS rank FROM gathered JOIN int8 USING (doc_id) QUALIFY rank <= {c.LIMIT}""")
def search_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _searched(spark, _search(spark, sf_dir, store(spark, sf_dir, "int8")), 3)


_S_MATCHES = f"CAST(len([w for w in string_split_regex(text, '\\s+') if w IN ({c._terms()})]) AS BIGINT)"


@c.query(f"""WITH {c.s_maxsim()}, matched AS (SELECT lang AS corpus, doc_id, {_S_MATCHES} AS n FROM documents WHERE lang IN ('en', 'fr')),
own AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, CAST(doc_id AS VARCHAR)) AS k FROM matched WHERE n > 0),
gathered AS (SELECT *, row_number() OVER (ORDER BY n DESC, corpus, CAST(doc_id AS VARCHAR)) - 1 AS gather_rank FROM own WHERE k <= {c.GATHER} QUALIFY gather_rank < {c.GATHER})
SELECT corpus, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC, gather_rank) AS rank FROM gathered JOIN maxsim USING (doc_id) QUALIFY rank <= {c.LIMIT}""")
def search_two_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two corpora in one list, each rescored by its own store."""
    docs = c.table(spark, sf_dir, "documents")
    gatherer = FusedGenerator(*(TermMatchGenerator(docs.where(F.col("lang") == x), x, NOW) for x in ("en", "fr")))
    reranker = MaxSimReranker([store(spark, sf_dir, lang=x) for x in ("en", "fr")])
    found = SearchPipeline(gatherer, reranker).search(_query(spark, sf_dir), gather_limit=c.GATHER, limit=c.LIMIT)
    return _searched(spark, found, 3)


S_CHANGED = f"additions AS ({c.S_NEW}), changed AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM additions) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT * FROM additions)"


@c.query(f"WITH {S_CHANGED}, {c.S_BM25.replace("FROM documents", "FROM changed")} SELECT 'docs' AS corpus, CAST(doc_id AS VARCHAR) AS doc_id, round(score, 3) AS score, row_number() OVER (ORDER BY score DESC, CAST(doc_id AS VARCHAR)) AS rank FROM bm25 QUALIFY rank <= {c.LIMIT}")
def search_next_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open generator follows an index to the generation after an upsert and a deletion."""

    def make(path: str) -> None:
        docs = c.table(spark, sf_dir, "documents").select("doc_id", "text")
        new = c.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
        publish(new, path, "docs", Analyzer())
        generator = LexicalCandidateGenerator(path, Analyzer(), spark)
        first = generator.current()[0]["sequence"]
        gone = c.table(spark, sf_dir, "labels").where("toxic = 1")
        publish(upsert(delete(docs, gone, ["doc_id"]), new, ["doc_id"]), path, "docs", Analyzer())
        if generator.current()[0]["sequence"] != first + 1:
            raise AssertionError("the generator stayed at the old generation")

    generator = LexicalCandidateGenerator(c.built(spark, sf_dir, "next-generation", make), Analyzer(), spark)
    return _searched(spark, SearchPipeline(generator).search(TEXT, gather_limit=c.GATHER, limit=c.LIMIT), 3)


@c.query(f"WITH {c.s_maxsim()} SELECT CAST(doc_id AS VARCHAR) AS doc_id, round(score, 3) AS score FROM maxsim WHERE CAST(doc_id AS VARCHAR) IN {c._LISTED_SQL}")
def kernel_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed kernel over documents that a store fetched, in batches of a few tokens."""
    view = store(spark, sf_dir).view()
    held = [i for i in c.LISTED if i in view.document_lengths(c.LISTED)]
    packed, lengths = view.fetch(held)
    scores = maxsim_scores_packed(c._matrix(spark, sf_dir), packed, lengths, max_batch_tokens=10)
    rows = [(i, round(float(s), 3)) for i, s in zip(held, scores, strict=True)]
    return spark.createDataFrame(rows, "doc_id string, score double")


def _exported(spark: SparkSession, sf_dir: str, encoding: str = "float32") -> str:
    def make(path: str) -> None:
        at = files.local(path)
        write_npy_store(store(spark, sf_dir, encoding).view().present(), at, "docs", REPRESENTATION, "exchange-vectors-2", encoding)
        np.save(f"{at}/lengths.npy", np.diff(np.load(f"{at}/segment-0.offsets.npy").astype(np.int64)))

    return files.local(c.built(spark, sf_dir, f"arrays-{encoding}", make))


S_OWNED = "SELECT CAST(vec_id // 4 AS VARCHAR) AS doc_id, CAST(count(*) AS INT) AS token_count, round(sum(list_sum(CAST(embedding AS DOUBLE[]))), 5) AS total FROM embeddings GROUP BY 1"


@c.query(S_OWNED)
def arrays_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store written as plain arrays and read back."""
    rows = present_documents(read_npy_store(spark, _exported(spark, sf_dir), "exchange-vectors-2"))
    return rows.select("doc_id", "token_count", F.round(_total(), 5).alias("total"))


@c.query(f"WITH {c.S_CODES} SELECT CAST(vec_id // 4 AS VARCHAR) AS doc_id, round(sum(list_sum([CAST(x AS DOUBLE) * scale for x in codes])), 3) AS total FROM coded GROUP BY 1")
def arrays_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of an int8 store, its codes decoded."""
    rows = present_documents(read_npy_store(spark, _exported(spark, sf_dir, "int8"), "exchange-vectors-2"))
    dim = REPRESENTATION.dimension
    tokens = F.transform(F.sequence(F.lit(0), F.col("token_count") - 1), lambda i: int8_decode(F.slice("codes", i * dim + 1, dim), F.get("scales", i), False))
    return rows.withColumn("vectors", F.flatten(tokens)).select("doc_id", F.round(_total(), 3).alias("total"))


@c.query(f"SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS position, token_count, total FROM ({S_OWNED})")
def packed_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed vectors and their lengths, read by tasks."""
    at = _exported(spark, sf_dir)
    return read_packed(spark, f"{at}/segment-0.vectors.npy", f"{at}/lengths.npy").select("position", "token_count", F.round(_total(), 5).alias("total"))


def _lines(spark: SparkSession, sf_dir: str) -> str:
    def make(path: str) -> None:
        write_documents(c.table(spark, sf_dir, "documents").select("doc_id", "text"), path)

    return c.built(spark, sf_dir, "lines", make)


@c.query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(text) AS digest FROM documents")
def documents_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON Lines and read back."""
    return read_documents(spark, _lines(spark, sf_dir)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@c.query("SELECT count(*) AS n, count(*) AS positions, CAST(0 AS BIGINT) AS first, count(*) - 1 AS last FROM documents")
def documents_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the lines of many files: dense from 0."""
    rows = read_numbered(spark, files.local(_lines(spark, sf_dir)))
    return rows.agg(F.count("*").alias("n"), F.count_distinct("position").alias("positions"), F.min("position").alias("first"), F.max("position").alias("last"))


@c.query(f"WITH {c.S_BM25} SELECT CAST(least(count(*), {c.GATHER}) AS BIGINT) AS accepted FROM bm25 WHERE CAST(doc_id AS VARCHAR) NOT IN {c._LISTED_SQL}")
def candidate_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gatherer's candidates, checked in one aggregation: number, ranks, subset, keys."""
    subset = Subset().excluding("docs", c.LISTED)
    frame = c.lexical(spark, sf_dir).gather(Query(TEXT), c.GATHER, subset=subset).frame
    return spark.createDataFrame([(check_candidates(frame, c.GATHER, subset),)], "accepted long")


@c.query("SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN doc_id % 97 = 0 THEN 1 ELSE 0 END DESC, doc_id) AS rank FROM documents QUALIFY rank <= 500")
def rank_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores 0.0 and -0.0, of which the first stands above the other; none is NaN."""
    zero = F.expr("(2 * cast(doc_id % 97 = 0 as int) - 1) * cast(0 as double)")  # as branches of a condition the two zeros would be folded to one
    scored = c.table(spark, sf_dir, "documents").select("doc_id", zero.alias("score"))
    check_scores(scored)
    return rank(scored, 500, tie="doc_id").select("doc_id", "rank")


@c.query("SELECT corpus, doc_id, allowed FROM (SELECT source AS corpus, CAST(doc_id AS VARCHAR) AS doc_id, (source = 'src1' AND CAST(doc_id AS VARCHAR) <> '7') OR (source = 'src2' AND CAST(doc_id AS VARCHAR) IN ('2', '22', '42')) AS allowed FROM documents) WHERE CAST(doc_id AS BIGINT) IN (SELECT item_id FROM benchmark)")
def subset_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership asked key by key on the driver, of the documents that the benchmark's ids name."""
    subset = functools.reduce(lambda s, part: getattr(s, part[0])(*part[1:]), [("including", "src1", ["1"]), ("excluding", "src1", ["7"]), ("including", "src2", ["2", "22", "42"])], Subset())
    items = c.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    keys = c.table(spark, sf_dir, "documents").join(items, "doc_id", "left_semi").select("source", F.col("doc_id").cast("string")).collect()
    return spark.createDataFrame([(a, b, subset.allows(a, b)) for a, b in keys], "corpus string, doc_id string, allowed boolean")
