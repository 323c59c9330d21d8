"""One query for each operator, over the standard tables: a document is a note (its source the title), benchmark items are queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whinstone.functions import notes as N
from whinstone.functions import text as X
from whinstone.operators import chunking, corpus, evalset, fusion, metrics, sync
from whinstone.operators.ann import build_ivf, ivf_search, recall_sweep
from whinstone.operators.embedding import HashingEmbedder, Md5Embedder
from whinstone.operators.evaluation import evaluate_run
from whinstone.operators.index import bm25_score, bm25_search, build_index, overlap_search, query_terms, top_terms
from whinstone.operators.retrieval import Retriever, format_hits
from whinstone.operators.shared import cut
from whinstone.operators.vectors import l2_normalise, vector_search, vector_search_lsh
from whinstone.plans import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
MD5_DIM = 64


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


def items(spark, sf_dir):
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def qrels(spark, sf_dir):
    found = cut(evalset.containment(items(spark, sf_dir), documents(spark, sf_dir)), "containment")
    first = F.min("doc_id").over(Window.partitionBy("query_id"))
    return found.withColumn("grade", F.when(F.col("doc_id") == first, 2.0).otherwise(1.0))


def ranking(spark, sf_dir, k=10, index=None):
    """The documents' keyword search for every item; index: a saved one, instead of building it."""
    return bm25_search(index or build_index(documents(spark, sf_dir)), items(spark, sf_dir), k)


# --- text, index, keyword search --------------------------------------------------------------------------------------


@query(f"WITH {S.index()} SELECT doc_id, term, tf FROM post")
def tokenize_term_freq(spark, sf_dir):
    return build_index(documents(spark, sf_dir)).postings.select("doc_id", "term", "tf")


_TEXTS = ["Agent 框架 v2.0-beta", "会话持久化，TS 构建 don't", "", "a.b_c--d 一", "㐀䶿 X1.Y2"]
_TEXTS_SQL = ", ".join("({}, '{}')".format(i, t.replace("'", "''")) for i, t in enumerate(_TEXTS))


@query(f"SELECT i, array_to_string({S.tokens('t')}, '|') AS tokens FROM (VALUES {_TEXTS_SQL}) v(i, t)")
def tokenize_cjk_literals(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(_TEXTS)), "i int, t string")
    return rows.select("i", F.array_join(X.tokenize("t"), "|").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({S.content(S.tokens('text'))}, ' ') AS tokens FROM documents")
def content_tokens_per_doc(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(X.content_tokens(X.tokenize("text")), " ").alias("tokens"))


@query(
    f"WITH {S.index()} SELECT n, total_len::BIGINT AS total_len, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM df) AS terms,"
    " (SELECT count(*) FROM post) AS postings FROM st"
)
def corpus_stats(spark, sf_dir):
    index = build_index(documents(spark, sf_dir))
    terms = index.term_df.agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return index.stats.withColumn("avgdl", F.round("avgdl", 6)).crossJoin(terms)


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS notes FROM documents")
def store_stats(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.col("source").alias("note_path"))
    return Retriever(rows).stats()


@query(f"WITH {S.index()} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st")
def term_df_idf(spark, sf_dir):
    return build_index(documents(spark, sf_dir)).idf().withColumn("idf", F.round("idf", 6))


@query(
    f"""WITH {S.index()}, {S.QUERIES}, r AS (SELECT query_id, term, coalesce(df, 0) AS df,
 round(ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)), 9) AS idf FROM qt LEFT JOIN df USING (term) CROSS JOIN st)
SELECT query_id, term, df, round(idf, 6) AS idf, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS rank FROM r)
WHERE rank <= 20"""
)
def top_terms_per_query(spark, sf_dir):
    return top_terms(build_index(documents(spark, sf_dir)), items(spark, sf_dir)).withColumn("idf", F.round("idf", 6))


_TOP10 = "SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10"


@query(f"WITH {S.bm25()} {_TOP10}")
def bm25_topk(spark, sf_dir):
    return ranking(spark, sf_dir).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {S.bm25()} SELECT item_id AS query_id, d.doc_id, round(coalesce(score, 0.0), 6) AS score
FROM benchmark CROSS JOIN (SELECT doc_id FROM documents WHERE doc_id IN (3, 42)) d
LEFT JOIN bm ON bm.query_id = item_id AND bm.doc_id = d.doc_id"""
)
def bm25_score_single_doc(spark, sf_dir):
    docs = documents(spark, sf_dir)
    ids = docs.where("doc_id in (3, 42)").select("doc_id")
    return bm25_score(build_index(docs), items(spark, sf_dir), ids).withColumn("score", F.round("score", 6))


@query(f"WITH {S.bm25(where='doc_id % 7 <> 0')} {_TOP10}")
def bm25_after_remove(spark, sf_dir):
    docs = documents(spark, sf_dir)
    index = build_index(docs).remove(docs.where("doc_id % 7 = 0"))
    return bm25_search(index, items(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(f"WITH {S.bm25()} {_TOP10}")
def bm25_after_readd(spark, sf_dir):
    docs = documents(spark, sf_dir)
    stale = build_index(docs.withColumn("text", F.when(F.col("doc_id") % 5 == 0, "old text").otherwise(F.col("text"))))
    index = stale.add(build_index(docs.where("doc_id % 5 = 0")))
    return bm25_search(index, items(spark, sf_dir)).withColumn("score", F.round("score", 6))


_TITLED = "concat_ws(' ', source, text)"


@query(f"WITH {S.bm25(_TITLED)} {_TOP10}")
def bm25_title_text(spark, sf_dir):
    index = build_index(documents(spark, sf_dir), text=F.concat_ws(" ", "source", "text"))
    return bm25_search(index, items(spark, sf_dir)).withColumn("score", F.round("score", 6))


# --- vectors ----------------------------------------------------------------------------------------------------------

_NEAR = """
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def vectors(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", "label")
    return rows, rows.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")


@query(_NEAR + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def vector_topk_exact(spark, sf_dir):
    return vector_search(*vectors(spark, sf_dir), 10).withColumn("score", F.round("score", 6))


@query()
def vector_topk_lsh(spark, sf_dir):
    return vector_search_lsh(*vectors(spark, sf_dir), 10)


def ivf(spark, sf_dir):
    rows, asked = vectors(spark, sf_dir)
    rows = rows.drop("label")
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 1
    return build_ivf(rows, dim), rows, asked


@query(_NEAR + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def ivf_topk_all_lists(spark, sf_dir):
    index, _, asked = ivf(spark, sf_dir)
    return ivf_search(index, asked, 10, probes=len(index.sizes), refine=0).withColumn("score", F.round("score", 6))


@query()
def ivf_topk(spark, sf_dir):
    index, _, asked = ivf(spark, sf_dir)
    return ivf_search(index, asked, 10, probes=max(1, len(index.sizes) * 7 // 10))


@query()
def ivf_recall_sweep(spark, sf_dir):
    index, rows, asked = ivf(spark, sf_dir)
    return recall_sweep(index, rows, asked, sorted({max(1, len(index.sizes) * p // 100) for p in (5, 20, 40, 70, 100)}), 10)


@query(
    _NEAR
    + """, h AS (SELECT query_id, doc_id, label AS note, rank FROM r JOIN embeddings ON vec_id = doc_id WHERE rank <= 50),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY query_id, note ORDER BY rank) = 1)
SELECT query_id, note::VARCHAR AS note_path, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM f"""
)
def vector_note_rankings(spark, sf_dir):
    found, asked = labelled_chunks(spark, sf_dir)
    return found.vector_rankings(asked).select("query_id", "note_path", "doc_id", "rank")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM v)
SELECT vec_id, round(u[1], 6) AS first, round(list_sum(list_transform(u, lambda x: abs(x))), 6) AS l1 FROM u"""
)
def l2_normalised(spark, sf_dir):
    unit = l2_normalise("embedding")
    l1 = F.aggregate("u", F.lit(0.0), lambda a, x: a + F.abs(x))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", unit.alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(l1, 6).alias("l1"))


@query()
def hash_embed_terms(spark, sf_dir):
    return HashingEmbedder(384).embed(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


@query(f"WITH {S.unit_vectors('documents', 'doc_id', 384, 'dv')} SELECT id, place, value FROM dv_s")
def hash_embed_md5(spark, sf_dir):
    return Md5Embedder(384).features(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


def labelled_chunks(spark, sf_dir):
    """A retriever over the vectors, a label being a note, and the queries."""
    rows, asked = vectors(spark, sf_dir)
    chunks = rows.select(
        F.col("doc_id").alias("id"), F.col("label").cast("string").alias("note_path"), F.lit("").alias("title"),
        F.array().cast("array<string>").alias("heading_path"), F.lit("").alias("text"), "embedding",
    )
    return Retriever(chunks), asked.withColumn("text", F.lit("x"))


@query(_NEAR + " SELECT query_id, doc_id, (51 - rank)::DOUBLE AS score, rank FROM r WHERE rank <= 10")
def search_vector_mode_score(spark, sf_dir):
    found, asked = labelled_chunks(spark, sf_dir)
    hits = found.search(asked, 10, "vector")
    return hits.select("query_id", "doc_id", "score", "rank")


# --- fusion -----------------------------------------------------------------------------------------------------------

_OVERLAP = f"""
ov AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, doc_id) AS rank
  FROM qt JOIN post USING (term) GROUP BY query_id, doc_id),
lists AS (SELECT query_id, 'bm25' AS retriever, doc_id, rank FROM bmr WHERE rank <= 20
  UNION ALL SELECT query_id, 'overlap', doc_id, rank FROM ov WHERE rank <= 20)"""


def two_lists(spark, sf_dir, index=None):
    index = (index or build_index(documents(spark, sf_dir))).narrowed(query_terms(items(spark, sf_dir)))
    overlap = overlap_search(index, items(spark, sf_dir), 20).select("query_id", F.lit("overlap").alias("retriever"), "doc_id", "rank")
    keyword = bm25_search(index, items(spark, sf_dir), 20).select("query_id", F.lit("bm25").alias("retriever"), "doc_id", "rank")
    return keyword.unionByName(overlap)


def _rrf_sql(lists: str, weight: str = "1.0", k: int = 60) -> str:
    return f"""
fused AS (SELECT query_id, doc_id, round(sum(w / ({k} + rank)), 9) AS score, min(rank) AS best_rank
  FROM (SELECT query_id, retriever, doc_id, min(rank) AS rank, any_value({weight}) AS w FROM {lists} GROUP BY query_id, retriever, doc_id)
  WHERE w > 0 GROUP BY query_id, doc_id),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_rank, doc_id) AS rank FROM fused)"""


_FUSED = "SELECT query_id, doc_id, round(score, 6) AS score, best_rank, rank FROM fr"


@query(f"WITH {S.bm25()}, {_OVERLAP}, {_rrf_sql('lists')} {_FUSED}")
def rrf_fusion(spark, sf_dir):
    return fusion.reciprocal_rank_fusion(two_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


_WEIGHT = "CASE WHEN retriever = 'bm25' THEN 0.0 ELSE 2.5 END"


@query(f"WITH {S.bm25()}, {_OVERLAP}, {_rrf_sql('lists', _WEIGHT)} {_FUSED}")
def rrf_weighted_zero(spark, sf_dir):
    weights = {"bm25": 0.0, "overlap": 2.5}
    return fusion.reciprocal_rank_fusion(two_lists(spark, sf_dir), weights=weights).withColumn("score", F.round("score", 6))


_LISTS = [("q", "a", "x", 1), ("q", "a", "y", 2), ("q", "a", "x", 3), ("q", "a", "z", 4), ("q", "b", "y", 1), ("q", "b", "x", 2), ("p", "b", "m", 1)]
_LISTS_SQL = "lists(query_id, retriever, doc_id, rank) AS (VALUES " + ", ".join(map(str, _LISTS)) + ")"


@query(f"WITH {_LISTS_SQL}, {_rrf_sql('lists')} {_FUSED}")
def rrf_duplicates(spark, sf_dir):
    rows = spark.createDataFrame(_LISTS, "query_id string, retriever string, doc_id string, rank int")
    return fusion.reciprocal_rank_fusion(rows).withColumn("score", F.round("score", 6))


@query(f"WITH {S.bm25()}, {_OVERLAP}, {_rrf_sql('lists')} SELECT query_id, doc_id, round(score, 6) AS score, best_rank FROM fused")
def rrf_scores(spark, sf_dir):
    return fusion.rrf_scores(two_lists(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {S.bm25()}, {_OVERLAP},
short AS (SELECT query_id, min(n) AS n FROM (SELECT query_id, retriever, max(rank) AS n FROM lists GROUP BY query_id, retriever) GROUP BY query_id),
f AS (SELECT query_id, doc_id, min((rank, retriever)) AS spot FROM lists JOIN short USING (query_id) WHERE rank <= n GROUP BY query_id, doc_id)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS rank FROM f"""
)
def interleave(spark, sf_dir):
    return fusion.interleave(two_lists(spark, sf_dir))


# --- search -----------------------------------------------------------------------------------------------------------


def retriever(spark, sf_dir):
    docs = documents(spark, sf_dir)
    embedder = Md5Embedder(MD5_DIM)
    vectors = embedder.embed(docs.select(F.col("doc_id").alias("id"), "text"))
    chunks = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("note_path"), F.lit("").alias("title"),
        F.array("lang").alias("heading_path"), "text",
    ).join(vectors, "id")
    asked = items(spark, sf_dir)
    embedded = embedder.embed(asked.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
    return Retriever(chunks), asked.join(embedded, "query_id")


_HYBRID = f"""WITH {S.bm25("concat_ws(' ', '', text)")},
{S.unit_vectors('documents', 'doc_id', MD5_DIM, 'dv')},
{S.unit_vectors('benchmark', 'item_id', MD5_DIM, 'qv')},
sims AS (SELECT q.query_id, d.doc_id, round(coalesce(s, 0.0), 9) AS score
  FROM (SELECT DISTINCT id AS query_id FROM qv) q CROSS JOIN (SELECT DISTINCT id AS doc_id FROM dv) d
  LEFT JOIN (SELECT qv.id AS query_id, dv.id AS doc_id, sum(qv.v * dv.v) AS s FROM qv JOIN dv USING (place) GROUP BY qv.id, dv.id) USING (query_id, doc_id)),
vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sims),
lists AS (SELECT query_id, 'vector' AS retriever, doc_id, rank FROM vec WHERE rank <= 50
  UNION ALL SELECT query_id, 'keyword', doc_id, rank FROM bmr WHERE rank <= 50), {_rrf_sql('lists')}"""


@query(
    _HYBRID + " SELECT query_id, fr.doc_id, round(score, 6) AS score, rank, source AS note_path, lang AS heading"
    " FROM fr JOIN documents USING (doc_id) WHERE rank <= 10"
)
def search_hybrid(spark, sf_dir):
    found, asked = retriever(spark, sf_dir)
    hits = found.search(asked, 10, "hybrid")
    return hits.select(
        "query_id", "doc_id", F.round("score", 6).alias("score"), "rank", "note_path", F.array_join("heading_path", " > ").alias("heading")
    )


@query(_HYBRID + " SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fr WHERE rank <= 10")
def search_hybrid_rerank_noop(spark, sf_dir):
    found, asked = retriever(spark, sf_dir)
    return found.search(asked, 10, "hybrid_rerank").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    f"""WITH {S.bm25("concat_ws(' ', '', text)")},
hits AS (SELECT query_id, bmr.doc_id, score, rank, source FROM bmr JOIN documents USING (doc_id) WHERE rank <= 20),
firsts AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1)
SELECT * FROM (SELECT query_id, source AS note_path, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank
  FROM firsts) WHERE rank <= 5"""
)
def search_notes_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir)
    chunks = docs.select(
        F.col("doc_id").alias("id"), F.col("source").alias("note_path"), F.lit("").alias("title"),
        F.array().cast("array<string>").alias("heading_path"), "text",
    )
    hits = Retriever(chunks).search_notes(items(spark, sf_dir), 5, "keyword")
    return hits.select("query_id", "note_path", "doc_id", F.round("score", 6).alias("score"), "rank")


@query(
    """SELECT r.id AS doc_id, r.rank, coalesce(source, '') AS note_path, length(coalesce(text, '')) AS chars
FROM (VALUES (1, 1), (7, 2), (-5, 3), (999999999, 4)) r(id, rank) LEFT JOIN documents d ON d.doc_id = r.id"""
)
def hydrate_unknown_ids(spark, sf_dir):
    ranked = spark.createDataFrame([(1, 1), (7, 2), (-5, 3), (999999999, 4)], "doc_id long, rank int")
    chunks = documents(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("note_path"), F.col("lang").alias("title"),
        F.array("lang").alias("heading_path"), "text",
    )
    return Retriever(chunks).hydrate(ranked).select("doc_id", "rank", "note_path", F.length("text").alias("chars"))


@query(
    f"""WITH {S.bm25()} SELECT query_id, rank, printf('%d. [%.4f] %s | %s | %s', rank, score, source, '(root)', replace(substr(text, 1, 160), chr(10), ' ')) AS line
FROM bmr JOIN documents USING (doc_id) WHERE rank <= 3"""
)
def format_search_hits(spark, sf_dir):
    docs = documents(spark, sf_dir)
    hits = ranking(spark, sf_dir, 3).join(docs, "doc_id").select(
        "query_id", "rank", "score", F.col("source").alias("note_path"), F.array().cast("array<string>").alias("heading_path"), "text"
    )
    return format_hits(hits, 160)


# --- evaluation -------------------------------------------------------------------------------------------------------

_EVAL = f"WITH {S.bm25()}, {S.QRELS}, {S.facts()}"


def facts(spark, sf_dir, judged=None):
    judged = qrels(spark, sf_dir) if judged is None else judged
    return metrics.per_query(ranking(spark, sf_dir), judged, items(spark, sf_dir))


@query(f"WITH {S.QRELS} SELECT * FROM qrels")
def containment_qrels(spark, sf_dir):
    return qrels(spark, sf_dir)


@query(_EVAL + ' SELECT query_id, n_relevant, "recall@1", "recall@5", "recall@10" FROM facts')
def recall_at_k(spark, sf_dir):
    return facts(spark, sf_dir).select("query_id", "n_relevant", "`recall@1`", "`recall@5`", "`recall@10`")


@query(_EVAL + ' SELECT query_id, "precision@1", "precision@5", "precision@10" FROM facts')
def precision_at_k(spark, sf_dir):
    return facts(spark, sf_dir).select("query_id", "`precision@1`", "`precision@5`", "`precision@10`")


@query(_EVAL + " SELECT query_id, rr FROM facts")
def mrr(spark, sf_dir):
    return facts(spark, sf_dir).select("query_id", "rr")


@query(_EVAL + ' SELECT query_id, round("ndcg@1", 6) AS n1, round("ndcg@5", 6) AS n5, round("ndcg@10", 6) AS n10 FROM facts')
def ndcg_at_k(spark, sf_dir):
    return facts(spark, sf_dir).select("query_id", *[F.round(f"`ndcg@{k}`", 6).alias(f"n{k}") for k in (1, 5, 10)])


_METRICS = ["queries", *(f"{m}@{k}" for k in (1, 5, 10) for m in ("recall", "ndcg")), "mrr"]


def _report(source: str) -> str:
    value = {"queries": "count(*)::DOUBLE", "mrr": "avg(rr)"}
    return " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round({value.get(m) or f'avg("{m}")'}, 6) AS value FROM {source}" for m in _METRICS
    )


@query(f"{_EVAL} {_report('facts')}")
def evaluate_report(spark, sf_dir):
    found = metrics.evaluate(ranking(spark, sf_dir), qrels(spark, sf_dir), items(spark, sf_dir))
    return found.withColumn("value", F.round("value", 6))


_STRICT = "strict AS (SELECT query_id, doc_id, grade FROM (SELECT *, max(grade) OVER (PARTITION BY query_id) AS top FROM qrels) WHERE grade = top)"


def _strict_facts() -> str:
    """CTEs strict, and s_facts: the per-query metrics of the strict view."""
    strict = S.facts("strict").replace("top10 AS (SELECT * FROM bmr WHERE rank <= 10),", "")
    for name in ("judged", "ideal", "facts"):
        strict = strict.replace(f"{name} AS", f"s_{name} AS").replace(f"JOIN {name} ", f"JOIN s_{name} ")
    return f"{_STRICT}, {strict}"


def _view_sql() -> str:
    answerable = "query_id IN (SELECT query_id FROM qrels)"
    views = [
        f"SELECT 'graded' AS view, * FROM ({_report(f'(SELECT * FROM facts WHERE {answerable})')})",
        f"SELECT 'strict' AS view, * FROM ({_report(f'(SELECT * FROM s_facts WHERE {answerable})')})",
        f"SELECT 'strict_no_leak' AS view, * FROM ({_report(f'(SELECT * FROM s_facts WHERE {answerable} AND query_id % 3 <> 0)')})",
    ]
    return f"{_EVAL}, {_strict_facts()} {' UNION ALL '.join(views)}"


@query(_view_sql())
def strict_vs_graded_views(spark, sf_dir):
    asked = items(spark, sf_dir)
    leaks = asked.where("query_id % 3 = 0")
    found = metrics.evaluate_views(ranking(spark, sf_dir), qrels(spark, sf_dir), asked, leaks)
    return found.withColumn("value", F.round("value", 6))


_COVER = f"""
cov AS (SELECT item_id AS query_id, round(CASE WHEN len(ct) > 0 AND w IS NOT NULL THEN len(list_intersect(ct, w)) / len(ct) ELSE 0.0 END, 9) AS coverage
  FROM (SELECT item_id, {S.content(S.tokens('text'))} AS ct FROM benchmark)
  LEFT JOIN (SELECT query_id, list_distinct({S.tokens("concat_ws(' ', source, text)")}) AS w FROM bmr JOIN documents USING (doc_id) WHERE rank = 1)
  ON query_id = item_id)"""


def coverage(spark, sf_dir):
    first = ranking(spark, sf_dir, 1).join(documents(spark, sf_dir), "doc_id").select("query_id", F.col("source").alias("title"), "text")
    return metrics.abstain_coverage(items(spark, sf_dir), first)


@query(f"WITH {S.bm25()}, {_COVER} SELECT * FROM cov")
def abstain_coverage(spark, sf_dir):
    return coverage(spark, sf_dir)


@query(
    f"""WITH {S.bm25()}, {S.QRELS}, {_COVER}, a AS (SELECT coverage < 0.9 AS s, query_id IN (SELECT query_id FROM qrels) AS k FROM cov)
SELECT count(*) AS queries, count(*) FILTER (k) AS answerable, count(*) FILTER (NOT k) AS unanswerable,
 round(avg(s::INT) FILTER (NOT k), 9) AS abstain_rate, round(avg(s::INT) FILTER (k), 9) AS false_abstain_rate FROM a"""
)
def abstention_report(spark, sf_dir):
    return metrics.abstention_report(coverage(spark, sf_dir), qrels(spark, sf_dir), 0.9)


@query(
    f"""{_EVAL}, {_COVER} SELECT round(avg(CASE WHEN coverage < 0.9 THEN 0.0 ELSE "recall@5" END), 9) AS recall_with_abstention
FROM facts JOIN cov USING (query_id)"""
)
def recall_with_abstain(spark, sf_dir):
    return metrics.recall_with_abstention(facts(spark, sf_dir), coverage(spark, sf_dir), 5, 0.9)


@query(
    f"""{_EVAL}, l AS (SELECT query_id, lang FROM qrels JOIN documents USING (doc_id) WHERE grade = 2)
SELECT lang, count(*) AS queries, round(avg("recall@5"), 6) AS recall5, round(avg("ndcg@10"), 6) AS ndcg10 FROM facts JOIN l USING (query_id) GROUP BY lang"""
)
def by_language_report(spark, sf_dir):
    judged = qrels(spark, sf_dir)
    langs = judged.where("grade = 2").join(documents(spark, sf_dir), "doc_id").select("query_id", "lang")
    rows = facts(spark, sf_dir, judged).join(langs, "query_id").groupBy("lang")
    return rows.agg(
        F.count("*").alias("queries"), F.round(F.avg("`recall@5`"), 6).alias("recall5"), F.round(F.avg("`ndcg@10`"), 6).alias("ndcg10")
    )


def clustered(spark, sf_dir):
    """value (recall@5), cluster (the matched document) and lang of every item that a document holds."""
    judged = qrels(spark, sf_dir)
    owner = judged.where("grade = 2").join(documents(spark, sf_dir), "doc_id").select("query_id", F.col("doc_id").alias("cluster"), "lang")
    return facts(spark, sf_dir, judged).join(owner, "query_id").select(F.col("`recall@5`").alias("value"), "cluster", "lang")


@query()
def cluster_bootstrap(spark, sf_dir):
    return metrics.cluster_bootstrap(clustered(spark, sf_dir).drop("lang"))


def _bootstrap_sql(stratum: str) -> str:
    """CTEs means and drawn, then bounds: mean, low and high of each stratum and of the differences of two."""
    steps = " + ".join(f"(u >= {p})::INTEGER" for p in metrics.AT_MOST)
    return f"""{_EVAL},
owned AS (SELECT facts.query_id, "recall@5" AS value, doc_id AS cluster, {stratum} AS stratum FROM facts JOIN qrels USING (query_id) JOIN documents USING (doc_id) WHERE grade = 2),
sums AS (SELECT cluster, stratum, sum(value) AS s, count(*) AS n FROM owned GROUP BY cluster, stratum),
draws AS (SELECT *, {steps} AS w FROM (SELECT *, ('0x' || substr(md5('0:' || sample || ':' || cluster), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM sums CROSS JOIN range(2000) r(sample))),
each AS (SELECT stratum, sample, sum(w * s) / sum(w * n) AS mean FROM draws WHERE w > 0 GROUP BY stratum, sample),
means AS (SELECT stratum, avg(value) AS mean FROM owned GROUP BY stratum),
drawn AS (SELECT * FROM each UNION ALL SELECT a.stratum || ' - ' || b.stratum, a.sample, a.mean - b.mean FROM each a JOIN each b ON a.sample = b.sample AND a.stratum < b.stratum),
known AS (SELECT * FROM means UNION ALL SELECT a.stratum || ' - ' || b.stratum, a.mean - b.mean FROM means a JOIN means b ON a.stratum < b.stratum),
bounds AS (SELECT stratum, list_sort(list(mean)) AS v FROM drawn GROUP BY stratum),
found AS (SELECT stratum, round(mean, 9) AS mean, round(v[1 + least(floor({(1 - 0.95) / 2!r} * len(v)), len(v) - 1)::INTEGER], 9) AS low,
  round(v[1 + least(floor({1 - (1 - 0.95) / 2!r} * len(v)), len(v) - 1)::INTEGER], 9) AS high FROM known LEFT JOIN bounds USING (stratum))"""


@query(_bootstrap_sql("''") + " SELECT mean, low, high FROM found")
def cluster_bootstrap_hashed(spark, sf_dir):
    return metrics.cluster_bootstrap_hashed(clustered(spark, sf_dir))


@query(_bootstrap_sql("lang") + " SELECT * FROM found")
def bootstrap_by_language(spark, sf_dir):
    return metrics.cluster_bootstrap_hashed(clustered(spark, sf_dir), stratum="lang")


_PS = (0, 25, 50, 55, 95, 99, 100)


@query(
    f"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n
  FROM events WHERE value IS NOT NULL)
SELECT DISTINCT event_type, p::DOUBLE AS p, value FROM r CROSS JOIN (SELECT unnest([{', '.join(map(str, _PS))}]) AS p)
WHERE i = greatest(1, ceil(p::DOUBLE / 100 * n))"""
)
def latency_percentiles(spark, sf_dir):
    return metrics.percentile(read(spark, sf_dir, "events"), "value", _PS, ["event_type"])


@query(
    f"""WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
SELECT p::DOUBLE AS p, value FROM r CROSS JOIN (SELECT unnest([{', '.join(map(str, _PS))}]) AS p) WHERE i = greatest(1, ceil(p::DOUBLE / 100 * n))"""
)
def overall_percentiles(spark, sf_dir):
    return metrics.percentile(read(spark, sf_dir, "events"), "value", _PS)


@query("SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS doc_id, NULL::INTEGER AS rank WHERE false")
def determinism_check(spark, sf_dir):
    return metrics.rankings_differ(ranking(spark, sf_dir), ranking(spark, sf_dir))


# --- dataset compilation ----------------------------------------------------------------------------------------------


def questions(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("query_id").alias("question_id"), F.col("text").alias("question"))


def noted(spark, sf_dir):
    return documents(spark, sf_dir).select(F.col("doc_id").alias("note"), "text")


_NT = f"nt AS (SELECT DISTINCT doc_id AS note, unnest({S.tokens('text')}) AS token FROM documents), tdf AS (SELECT token, count(*) AS df FROM nt GROUP BY token)"
_QT = f"q AS (SELECT item_id AS question_id, {S.content(S.tokens('text'))} AS ct FROM benchmark)"


@query(
    f"""WITH {_NT}, {_QT}, qq AS (SELECT question_id, len(ct) AS n, unnest(ct) AS token FROM q),
h AS (SELECT question_id, note, n, count(*) AS hit FROM qq JOIN nt USING (token) GROUP BY question_id, note, n),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY hit DESC, note) = 1)
SELECT question_id, round(CASE WHEN len(ct) = 0 THEN 1.0 ELSE coalesce(hit / n, 0.0) END, 9) AS coverage,
 CASE WHEN len(ct) = 0 THEN '' ELSE coalesce(note::VARCHAR, '') END AS note FROM q LEFT JOIN b USING (question_id)"""
)
def best_note_coverage(spark, sf_dir):
    return evalset.best_note_coverage(questions(spark, sf_dir), noted(spark, sf_dir))


@query(
    f"""WITH {_NT}, {_QT}, qq AS (SELECT question_id, len(ct) AS n, unnest(ct) AS token FROM q),
h AS (SELECT question_id, n, note, count(*) AS hit FROM qq JOIN nt USING (token) GROUP BY question_id, n, note),
b AS (SELECT question_id, max(hit / n) AS c FROM h GROUP BY question_id)
SELECT question_id FROM q LEFT JOIN b USING (question_id) WHERE round(CASE WHEN len(ct) = 0 THEN 1.0 ELSE coalesce(c, 0.0) END, 9) < 0.6"""
)
def negative_gate(spark, sf_dir):
    return evalset.negative_gate(questions(spark, sf_dir), noted(spark, sf_dir)).select("question_id")


_LEAK = f"""WITH {S.QRELS}, {_NT}, lq AS (SELECT query_id, doc_id AS note, unnest({S.content(S.tokens('text'))}) AS token
  FROM qrels JOIN benchmark ON query_id = item_id WHERE grade = 2),
lr AS (SELECT query_id, min((df, token)) AS r FROM lq JOIN nt USING (note, token) JOIN tdf USING (token) GROUP BY query_id),
leak AS (SELECT query_id AS question_id, coalesce(r[2], '') AS leak_token, coalesce(r[1], (SELECT count(DISTINCT doc_id) FROM documents)) AS leak_min_df,
  r IS NOT NULL AS leak FROM qrels LEFT JOIN lr USING (query_id) WHERE grade = 2),
lb AS (SELECT *, CASE WHEN leak_min_df <= 2 THEN '<=2' WHEN leak_min_df <= 10 THEN '3-10' WHEN leak_min_df <= 50 THEN '11-50' ELSE '>50' END AS bucket FROM leak)"""


def leaks(spark, sf_dir):
    owner = qrels(spark, sf_dir).where("grade = 2").select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("note"))
    return evalset.leak_min_df(questions(spark, sf_dir).join(owner, "question_id"), noted(spark, sf_dir))


@query(_LEAK + " SELECT * FROM lb")
def leak_min_df(spark, sf_dir):
    return leaks(spark, sf_dir)


@query(
    _LEAK + f""", {S.bm25()}, {S.facts()}
SELECT bucket, count(*) AS queries, round(avg("recall@5"), 6) AS recall5 FROM lb JOIN facts ON query_id = question_id GROUP BY bucket"""
)
def leak_bucket_recall(spark, sf_dir):
    rows = facts(spark, sf_dir).join(leaks(spark, sf_dir), F.col("query_id") == F.col("question_id")).groupBy("bucket")
    return rows.agg(F.count("*").alias("queries"), F.round(F.avg("`recall@5`"), 6).alias("recall5"))


@query(
    f"""WITH t AS (SELECT DISTINCT item_id AS question_id, unnest({S.tokens('text')}) AS token FROM benchmark),
d AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT token FROM t WHERE length(token) >= 2) JOIN documents ON contains(lower(text), token) GROUP BY token),
r AS (SELECT question_id, min((coalesce(df, 0), token)) AS r FROM t LEFT JOIN d USING (token) WHERE length(token) >= 2 GROUP BY question_id)
SELECT question_id, r[2] AS token, r[1] AS df FROM r"""
)
def keyword_rarity(spark, sf_dir):
    return evalset.keyword_rarity(questions(spark, sf_dir), noted(spark, sf_dir))


def _long(view: str, source: str, **values: str) -> list[str]:
    return [f"SELECT {view} AS view, '{m.replace('__', ' ').replace('_at_', '@')}' AS metric, round(({v})::DOUBLE, 6) AS value FROM {source}" for m, v in values.items()]


def _run_sql() -> str:
    known = "query_id IN (SELECT query_id FROM qrels)"
    rows = [
        f"SELECT 'graded' AS view, * FROM ({_report(f'(SELECT * FROM facts WHERE {known})')})",
        f"SELECT 'strict' AS view, * FROM ({_report(f'(SELECT * FROM s_facts WHERE {known})')})",
        f"SELECT 'strict_no_leak' AS view, * FROM ({_report(f'(SELECT * FROM s_facts WHERE {known} AND query_id NOT IN (SELECT query_id FROM lab WHERE leak))')})",
        *_long(
            "'abstention'", "per", answerable="count(*) FILTER (k)", unanswerable="count(*) FILTER (NOT k)", abstain_rate="avg(s::INT) FILTER (NOT k)",
            false_abstain_rate="avg(s::INT) FILTER (k)", recall_at_5__with__abstention="avg(CASE WHEN s THEN 0.0 ELSE r END) FILTER (k)",
        ),
        *_long(
            "'lang:' || lang", "per GROUP BY lang", queries="count(*) FILTER (k)", notes="count(DISTINCT cluster)", recall_at_5="avg(r) FILTER (k)", ndcg_at_10="avg(g) FILTER (k)",
            unanswerable="count(*) FILTER (NOT k)", abstained="count(*) FILTER (NOT k AND s)", false_abstain_rate="avg(s::INT) FILTER (k)",
        ),
        *_long("'leak:' || bucket", "per WHERE k GROUP BY bucket", queries="count(*)", recall_at_5="avg(r)"),
    ]
    return f"""{_LEAK}, {S.bm25()}, {S.facts()}, {_strict_facts()}, {_COVER},
lab AS (SELECT item_id AS query_id, doc_id AS cluster, coalesce(lang, 'unknown') AS lang, coalesce(bucket, '<=2') AS bucket, coalesce(leak, false) AS leak
  FROM benchmark LEFT JOIN (SELECT query_id, doc_id, lang FROM qrels JOIN documents USING (doc_id) WHERE grade = 2) o ON o.query_id = item_id LEFT JOIN lb ON question_id = item_id),
per AS (SELECT lab.*, cluster IS NOT NULL AS k, coalesce(coverage, 0.0) < 0.9 AS s, s_facts."recall@5" AS r, facts."ndcg@10" AS g
  FROM lab LEFT JOIN cov USING (query_id) LEFT JOIN s_facts USING (query_id) LEFT JOIN facts USING (query_id))
{' UNION ALL '.join(rows)}"""


@query(_run_sql())
def evaluation_run(spark, sf_dir):
    """All that an evaluation reports of keyword search but intervals and time: views, abstention and its cost, languages, leak buckets."""
    judged, asked = qrels(spark, sf_dir), items(spark, sf_dir).select("query_id")
    owner = judged.where("grade = 2").join(documents(spark, sf_dir), "doc_id").select("query_id", F.col("doc_id").alias("cluster"), "lang")
    leak = leaks(spark, sf_dir).select(F.col("question_id").alias("query_id"), "bucket", "leak")
    labels = asked.join(owner, "query_id", "left").join(leak, "query_id", "left").select(
        "query_id", "cluster", F.coalesce("lang", F.lit("unknown")).alias("lang"), F.coalesce("bucket", F.lit("<=2")).alias("bucket"), F.coalesce("leak", F.lit(False)).alias("leak")
    )
    found = evaluate_run(ranking(spark, sf_dir), coverage(spark, sf_dir), judged, labels, (1, 5, 10), 0.9, 0)
    return found.withColumn("value", F.round("value", 6))


_CANDIDATES_SQL = f"""
cand AS (SELECT 'f' || (item_id % 3) AS file, item_id AS pos, CASE WHEN item_id % 10 = 9 THEN 'nowhere' ELSE coalesce(source, 'src1') END AS note,
  CASE WHEN item_id % 8 = 7 THEN 'short' WHEN item_id % 8 = 6 THEN 'Does this note say it?' WHEN item_id % 8 = 5 THEN 'What is said of it all?' ELSE substr(b.text, 1, 60) END AS question,
  CASE WHEN item_id % 6 = 5 THEN 'tiny' WHEN item_id % 6 = 4 THEN 'words that stand nowhere in the text' ELSE b.text END AS answer_span,
  CASE WHEN item_id % 7 = 6 THEN 'fiendish' ELSE 'easy' END AS difficulty
  FROM benchmark b LEFT JOIN (SELECT query_id, d.doc_id::VARCHAR AS source FROM qrels JOIN documents d USING (doc_id) WHERE grade = 2) ON query_id = item_id),
nn AS (SELECT doc_id::VARCHAR AS note, text FROM documents UNION ALL SELECT doc_id::VARCHAR, text FROM documents WHERE doc_id % 11 = 0),
nc AS (SELECT note, count(*) AS copies, min(regexp_replace(text, '{S.SPACE}', '', 'g')) AS sq FROM nn GROUP BY note),
g AS (SELECT cand.*, CASE WHEN copies > 1 THEN 'ambiguous_note' WHEN copies IS NULL THEN 'note_missing' WHEN NOT length(question) BETWEEN 8 AND 200 THEN 'question_length'
  WHEN regexp_matches(question, '(?i)\\b(this|the) (note|article|document|passage)\\b') THEN 'meta_question' WHEN NOT length(answer_span) BETWEEN 10 AND 400 THEN 'span_length'
  WHEN NOT contains(sq, regexp_replace(answer_span, '{S.SPACE}', '', 'g')) THEN 'span_not_in_note' WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'bad_difficulty' END AS why,
  regexp_replace(question, '{S.SPACE}', '', 'g') AS key FROM cand LEFT JOIN nc USING (note)),
gated AS (SELECT file, pos, note, question, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY key, why IS NULL ORDER BY file, pos) > 1 THEN 'duplicate_question' END) AS drop_reason FROM g)"""


def gated(spark, sf_dir):
    owner = qrels(spark, sf_dir).where("grade = 2").select("query_id", F.col("doc_id").cast("string").alias("source"))
    i = F.col("query_id")
    rows = items(spark, sf_dir).join(owner, "query_id", "left")
    rows = rows.select(
        F.concat(F.lit("f"), i % 3).alias("file"),
        i.alias("pos"),
        F.when(i % 10 == 9, "nowhere").otherwise(F.coalesce("source", F.lit("src1"))).alias("note"),
        F.when(i % 8 == 7, "short")
        .when(i % 8 == 6, "Does this note say it?")
        .when(i % 8 == 5, "What is said of it all?")
        .otherwise(F.substring("text", 1, 60))
        .alias("question"),
        F.when(i % 6 == 5, "tiny").when(i % 6 == 4, "words that stand nowhere in the text").otherwise(F.col("text")).alias("answer_span"),
        F.when(i % 7 == 6, "fiendish").otherwise("easy").alias("difficulty"),
    )
    notes = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("note"), "text", "doc_id")
    notes = notes.union(notes.where("doc_id % 11 = 0")).drop("doc_id")
    return evalset.gate_candidates(rows, notes)


@query(f"WITH {S.QRELS}, {_CANDIDATES_SQL} SELECT file, pos, note, drop_reason FROM gated")
def candidate_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("file", "pos", "note", "drop_reason")


@query(f"WITH {S.QRELS}, {_CANDIDATES_SQL} SELECT coalesce(drop_reason, 'kept') AS reason, count(*) AS n FROM gated GROUP BY ALL")
def candidate_report(spark, sf_dir):
    return evalset.count_reasons(gated(spark, sf_dir))


@query(
    f"""WITH {S.QRELS}, {_CANDIDATES_SQL} SELECT printf('q%04d', row_number() OVER (ORDER BY note, question)) AS id, note, question
FROM gated WHERE drop_reason IS NULL"""
)
def numbered_dataset(spark, sf_dir):
    kept = gated(spark, sf_dir).where("drop_reason is null")
    return evalset.numbered(kept, "q", "note", "question").select("id", "note", "question")


_NAMES = ["guide__0123abcd.md", "guide.zh__89abcdef.md", "guide__ffffffff.md", "solo.zh__00000000.md", "plain.md", "x__1234567.md"]
_NAMES_SQL = "names(note) AS (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ")"


@query(
    f"""WITH {_NAMES_SQL}, s AS (SELECT note, CASE WHEN regexp_matches(note, '^(.*)__[0-9a-f]{{8}}\\.md$') THEN regexp_extract(note, '^(.*)__[0-9a-f]{{8}}\\.md$', 1) END AS slug FROM names),
w AS (SELECT note, CASE WHEN ends_with(slug, '.zh') THEN substr(slug, 1, length(slug) - 3) ELSE slug || '.zh' END AS wanted FROM s)
SELECT w.note, coalesce(min(s.note), '') AS twin FROM w LEFT JOIN s ON s.slug = w.wanted GROUP BY w.note"""
)
def twin_lookup(spark, sf_dir):
    return evalset.twins(spark.createDataFrame([(n,) for n in _NAMES], "note string"))


@query("SELECT min(doc_id) AS doc_id, sha1(text) AS sha FROM documents GROUP BY text")
def content_dedup(spark, sf_dir):
    return evalset.first_of_content(documents(spark, sf_dir), "doc_id").select("doc_id", F.sha1("text").alias("sha"))


@query("SELECT sha1(string_agg(s, '' ORDER BY s)) AS fingerprint FROM (SELECT sha1(text) AS s FROM documents)")
def corpus_fingerprint(spark, sf_dir):
    return evalset.fingerprint(documents(spark, sf_dir))


@query("SELECT sha1(string_agg(name || size, '' ORDER BY name)) AS fingerprint FROM (SELECT printf('%08d', doc_id) AS name, strlen(text)::VARCHAR AS size FROM documents)")
def sample_fingerprint(spark, sf_dir):
    files = documents(spark, sf_dir).select(F.format_string("%08d", "doc_id").alias("name"), F.octet_length("text").alias("size"))
    return evalset.sample_fingerprint(files)


@query(
    """WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM r WHERE n <= 37 OR p IN (SELECT floor(i * (n::DOUBLE / 37)) + 1 FROM range(37) t(i))"""
)
def stride_sample_uniform(spark, sf_dir):
    return evalset.stride_uniform(documents(spark, sf_dir), 37, "doc_id").select("doc_id")


@query(
    """WITH p AS (SELECT doc_id FROM documents WHERE lang = 'en'), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM p)
SELECT doc_id FROM r WHERE p % greatest(1, n // 40) = 0 AND p // greatest(1, n // 40) < 40"""
)
def stride_sample_integer(spark, sf_dir):
    return evalset.stride_integer(documents(spark, sf_dir).where("lang = 'en'"), 40, "doc_id").select("doc_id")


@query("SELECT doc_id FROM documents WHERE strlen(text) >= 1024 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def sample_pool(spark, sf_dir):
    files = documents(spark, sf_dir).select(F.col("doc_id").alias("name"), F.octet_length("text").alias("size"), "text")
    used = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"))
    return evalset.pool(files, "en", 1024, used).select(F.col("name").alias("doc_id"))


@query(
    """WITH f AS (SELECT source || '/' || printf('%08d', doc_id) || '.md' AS src, source || '__' || printf('%08d', doc_id) AS name, sha1(text) AS sha1, strlen(text) AS bytes FROM documents)
SELECT name || '__' || substr(sha1, 1, 8) || '.md' AS out, src, sha1, bytes FROM f WHERE bytes >= 200 QUALIFY row_number() OVER (PARTITION BY sha1 ORDER BY src) = 1"""
)
def corpus_manifest(spark, sf_dir):
    path = F.concat("source", F.lit("/"), F.format_string("%08d", "doc_id"), F.lit(".md"))
    return corpus.corpus_manifest(documents(spark, sf_dir).select(path.alias("path"), F.col("text").alias("raw"))).drop("raw")


@query(
    """WITH f AS (SELECT printf('%08d', doc_id) AS name, strlen(text) AS size, doc_id FROM documents),
p AS (SELECT * FROM f WHERE size >= 1024), a AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS i, count(*) OVER () AS n FROM p WHERE doc_id NOT IN (SELECT doc_id FROM labels)),
s AS (SELECT name FROM a WHERE i % greatest(1, n // 25) = 0 AND i // greatest(1, n // 25) < 25)
SELECT 'en' AS lang, 25 AS count, (SELECT count(*) FROM f) AS corpus_files, (SELECT count(*) FROM p) AS pool_after_lang_and_size_filter,
 (SELECT count(DISTINCT doc_id) FROM labels) AS excluded_names, (SELECT count(*) FROM a) AS available, (SELECT greatest(1, any_value(n) // 25) FROM a) AS stride, 1024 AS min_bytes,
 (SELECT sha1(string_agg(name || size, '' ORDER BY name)) FROM f) AS corpus_fingerprint_names_and_sizes, (SELECT array_to_string(list_slice(list_sort(list(name)), 1, 3), ' ') FROM s) AS first_three"""
)
def sample_manifest(spark, sf_dir):
    name = F.format_string("%08d", "doc_id").alias("name")
    files = documents(spark, sf_dir).select(name, F.octet_length("text").alias("size"), "text")
    _, manifest = corpus.sample_notes(files, 25, "en", 1024, read(spark, sf_dir, "labels").select(name))
    return manifest.withColumn("first_three", F.array_join("first_three", " "))


@query("SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0)")
def label_index_antijoin(spark, sf_dir):
    return evalset.unlabelled(read(spark, sf_dir, "labels"), documents(spark, sf_dir).where("doc_id % 3 <> 0"), "doc_id")


@query(
    """SELECT conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 6000) AS text FROM conversations GROUP BY conv_id"""
)
def gen_eval_export(spark, sf_dir):
    return evalset.concat_notes(read(spark, sf_dir, "conversations"), "turn", "conv_id")


@query(
    """SELECT user_id AS path, max(ts) AS modified FROM events GROUP BY user_id ORDER BY modified DESC, path LIMIT 20"""
)
def recent_notes(spark, sf_dir):
    rows = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("path")).agg(F.max("ts").alias("modified"))
    return evalset.recent(rows, 20)


_URL_STEM = r"regexp_replace(regexp_replace(url, '^https?://', ''), '\.[^.]*$', '')"


@query(
    f"""WITH p AS (SELECT page_id, sha1(url) AS sha, list_filter(list_transform(string_split({_URL_STEM}, '/'),
 lambda x: regexp_replace(regexp_replace(x, '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}._-]+', '_', 'g'), '^_+|_+$', '', 'g')), lambda x: x <> '' AND x <> '.') AS parts FROM pages),
j AS (SELECT page_id, sha, substr(array_to_string(list_slice(parts, greatest(1, len(parts) - 3), len(parts)), '__'), 1, 150) AS n FROM p)
SELECT page_id, CASE WHEN n = '' THEN 'note' ELSE n END || '__' || substr(sha, 1, 8) || '.md' AS name FROM j"""
)
def flatten_name(spark, sf_dir):
    path = F.regexp_replace("url", "^https?://", "")
    return read(spark, sf_dir, "pages").select("page_id", evalset.flat_name(path, F.sha1("url")).alias("name"))


# --- notes, chunks, synchronisation -----------------------------------------------------------------------------------


@query(
    f"""WITH w AS (SELECT doc_id, unnest(range(0, greatest(ceil((length(text) - 1200) / 1050.0), 0)::BIGINT + 1)) AS piece, text FROM documents),
s AS (SELECT doc_id, piece, piece * 1050 AS char_start, regexp_replace(substr(text, piece * 1050 + 1, 1200), '^{S.SPACE}|{S.SPACE}$', '', 'g') AS text FROM w)
SELECT doc_id, piece, char_start, length(text) AS chars, substr(sha1(doc_id || chr(31) || chr(31) || char_start || chr(31)), 1, 16) AS id,
 substr(sha1(text || chr(31)), 1, 16) AS content_hash FROM s WHERE text <> ''"""
)
def chunk_hard_split(spark, sf_dir):
    rows = chunking.hard_split(documents(spark, sf_dir))
    return rows.select("doc_id", "piece", "char_start", F.length("text").alias("chars"), "id", "content_hash")


@query("SELECT doc_id, substr(sha1(source || chr(31) || lang || chr(31) || doc_id || chr(31)), 1, 16) AS id, substr(sha1(text || chr(31)), 1, 16) AS content_hash FROM documents")
def chunk_ids_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", X.digest("source", "lang", "doc_id").alias("id"), X.digest("text").alias("content_hash")
    )


_NOTE = """---
title: Field guide
tags: [alpha, beta]
---
# Birds of the coast

Intro with [[Gulls#wings|gull]] and #shore.

## Gulls
They eat. See [[Terns]].

### Old names
Mew.

## Terns
They dive #alpha.
"""


def notes(spark):
    rows = [("birds.md", _NOTE), ("a/plain.note.md", "No heading here, see [[Birds]]."), ("broken.md", "---\ntitle: [x\n---\nBody #tag")]
    return spark.createDataFrame(rows, "path string, raw string")


@query()
def parse_note_fields(spark, sf_dir):
    return N.parse_notes(notes(spark))


@query()
def chunk_markdown(spark, sf_dir):
    return chunking.chunk_notes(N.parse_notes(notes(spark)), 80, 10)


@query()
def chunk_documents(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), F.col("source").alias("title"), F.col("text").alias("body"))
    return chunking.chunk_notes(docs)


@query()
def read_note_section(spark, sf_dir):
    return notes(spark).select("path", N.read_section("raw", "gulls").alias("section"), N.read_section("raw").alias("whole"))


_OLD_SQL = "old AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'stale' ELSE sha1(text) END AS h FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT -1, 'gone')"


def snapshots(spark, sf_dir):
    docs = documents(spark, sf_dir)
    fresh = docs.select(F.col("doc_id").alias("id"), F.sha1("text").alias("content_hash"))
    old = fresh.where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, "stale").otherwise(F.col("content_hash")).alias("content_hash"))
    return old.union(spark.createDataFrame([(-1, "gone")], "id long, content_hash string")), fresh


@query(
    f"""WITH {_OLD_SQL} SELECT coalesce(o.id, d.doc_id) AS id,
 CASE WHEN o.id IS NULL THEN 'new' WHEN d.doc_id IS NULL THEN 'stale' WHEN o.h = sha1(d.text) THEN 'unchanged' ELSE 'changed' END AS status
FROM old o FULL OUTER JOIN documents d ON o.id = d.doc_id"""
)
def sync_diff_status(spark, sf_dir):
    return sync.diff(*snapshots(spark, sf_dir))


@query(
    f"""WITH {_OLD_SQL}, up AS (SELECT doc_id AS id, sha1(text) AS h FROM documents WHERE doc_id % 5 = 0 OR doc_id % 11 = 0)
SELECT id, h AS content_hash FROM old WHERE id NOT IN (SELECT id FROM up) UNION ALL SELECT * FROM up"""
)
def upsert_snapshot(spark, sf_dir):
    old, fresh = snapshots(spark, sf_dir)
    return sync.upsert(old, fresh.where("id % 5 = 0 or id % 11 = 0"))


@query(f"WITH {_OLD_SQL} SELECT id, h AS content_hash FROM old WHERE id IN (SELECT doc_id FROM documents)")
def delete_stale(spark, sf_dir):
    old, fresh = snapshots(spark, sf_dir)
    return sync.delete(old, sync.diff(old, fresh).where("status = 'stale'"))


@query(
    f"""WITH {_OLD_SQL} SELECT doc_id AS id, lang || chr(10) || source || chr(10) || chr(10) || trim(text) AS text FROM documents
WHERE doc_id IN (SELECT id FROM old)"""
)
def embed_text_of_known(spark, sf_dir):
    old, _ = snapshots(spark, sf_dir)
    rows = documents(spark, sf_dir).join(old.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.array("source").alias("heading_path"), F.trim("text").alias("text")
    )
    return rows.select("id", chunking.embed_text().alias("text"))


