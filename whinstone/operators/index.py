"""The inverted index as three DataFrames, and BM25 over it for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whinstone.functions.text import tokenize
from whinstone.operators.shared import cut

#: Decimals to which scores are rounded before they are ordered: sums of doubles differ by an ulp with the order of addition.
DIGITS = 9


@dataclass(frozen=True)
class Index:
    """docs (doc_id, dl), postings (term, doc_id, tf, dl); k1 and b weigh term frequency and length. parts, of an index that documents
    were removed from or added to: what its postings come from, each with the ids that are gone of it."""

    docs: DataFrame
    postings: DataFrame
    k1: float = 1.5
    b: float = 0.75
    parts: tuple[tuple[DataFrame, tuple[DataFrame, ...]], ...] = ()

    def __post_init__(self):
        if self.k1 <= 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be positive and b between 0 and 1")

    @property
    def stats(self) -> DataFrame:
        """One row: n documents, avgdl (1 for an empty index)."""
        return self.docs.agg(
            F.count("*").alias("n"), F.sum("dl").alias("total_len"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avgdl")
        )

    @property
    def term_df(self) -> DataFrame:
        return self.postings.groupBy("term").agg(F.count("*").alias("df"))

    def idf(self) -> DataFrame:
        """term, df, idf = ln(1 + (n - df + 0.5) / (df + 0.5)), which is positive for every df."""
        return self.term_df.crossJoin(F.broadcast(self.stats.select("n"))).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))

    def remove(self, ids: DataFrame) -> Index:
        """Without the documents of ids (doc_id); removing twice or unknown ids changes nothing."""
        gone = ids.select("doc_id").distinct()
        return replace(
            self,
            docs=self.docs.join(gone, "doc_id", "left_anti"),
            postings=self.postings.join(gone, "doc_id", "left_anti"),
            parts=tuple((rows, (*before, gone)) for rows, before in self._parts()),
        )

    def add(self, other: Index) -> Index:
        """With the documents of other; those already there are replaced."""
        kept = self.remove(other.docs)
        return replace(
            kept,
            docs=kept.docs.unionByName(other.docs),
            postings=kept.postings.unionByName(other.postings),
            parts=kept._parts() + other._parts(),
        )

    def _parts(self) -> tuple:
        return self.parts or ((self.postings, ()),)

    def of_terms(self, terms: DataFrame) -> DataFrame:
        """The postings of some terms (term). The terms are cut first and removed documents then: Spark moves the cut below the counting
        of postings, but not below a removal, behind which all postings would be counted and shuffled."""
        wanted, out = terms.select("term").distinct(), None
        for rows, removed in self._parts():
            rows = rows.join(wanted, "term", "left_semi")
            for gone in removed:
                rows = rows.join(gone, "doc_id", "left_anti")
            out = rows if out is None else out.unionByName(rows)
        return out

    def narrowed(self, terms: DataFrame) -> Index:
        """With the postings of some terms (term) only, written once for searches that read them several times. Document numbers and
        lengths stay those of all documents."""
        return replace(self, docs=cut(self.docs, "docs"), postings=cut(self.of_terms(terms), "postings"), parts=())

    def save(self, path: str) -> None:
        """Parquet, postings sorted by term within files, so that row groups of other terms are skipped."""
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        self.postings.repartition("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")

    @staticmethod
    def load(spark: SparkSession, path: str, k1: float = 1.5, b: float = 0.75) -> Index:
        return Index(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), k1, b)


def idf(n, df):
    return F.log(F.lit(1.0) + (n - df + 0.5) / (df + 0.5))


def build_index(docs: DataFrame, doc_id: str = "doc_id", text="text", k1: float = 1.5, b: float = 0.75) -> Index:
    """The index of docs; of rows with the same id the texts belong together, so pass ids that are unique."""
    base = docs.select(F.col(doc_id).alias("doc_id"), tokenize(text).alias("tokens"))
    sized = base.select("doc_id", F.size("tokens").cast("long").alias("dl"))
    # an outer explode: of a plain one Spark infers a filter on the tokens' number, and tokenizes once more for it
    terms = base.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term")).where("term is not null")
    # all of a document is in one partition, so the map side counts it whole and the shuffle carries postings, not tokens
    postings = terms.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    return Index(sized, postings, k1, b)


def query_terms(queries: DataFrame, query_id: str = "query_id", text: str = "text") -> DataFrame:
    """query_id, term, qtf: a repeated term counts as often as it is repeated."""
    terms = queries.select(F.col(query_id).alias("query_id"), F.explode(tokenize(text)).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def bm25_scores(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score of all documents that share a term with a query (those are the ones with a positive score).

    Queries are the small side of the join on term: only postings of their terms go on, and document frequencies are counted after
    that cut. Nothing is hinted: broadcasting is up to Spark's size checks.
    """
    terms = query_terms(queries)
    wanted = index.of_terms(terms)
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    weighted = terms.join(df, "term").crossJoin(F.broadcast(index.stats.select("n", "avgdl")))
    weighted = weighted.withColumn("w", F.col("qtf") * idf(F.col("n"), F.col("df")))
    norm = F.lit(index.k1) * (F.lit(1 - index.b) + F.lit(index.b) * F.col("dl") / F.col("avgdl"))
    part = F.col("w") * (F.col("tf") * (index.k1 + 1)) / (F.col("tf") + norm)
    scored = wanted.join(weighted, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), DIGITS).alias("score"))
    return scored.where("score > 0")


def top_k(scored: DataFrame, k: int | None, id_col: str = "doc_id") -> DataFrame:
    """Adds rank: score descending, then id; the k first of each query (None or negative: all)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if k is None or k < 0 else ranked.where(F.col("rank") <= k)


#: Documents whose postings one task scores at a time, and queries it does so for.
BLOCK_DOCS, BLOCK_QUERIES = 4096, 4096


def _block_scores(k: int):
    """A block's postings and all queries' weighted terms: each query's k best documents of the block. Scores add up term by term in the
    order of terms, wherever a document lies."""

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("query_id").is_valid()
        queries, postings = table.filter(asked), table.filter(pc.invert(asked))
        empty = {"query_id": table.column("query_id")[:0], "doc_id": table.column("doc_id")[:0], "score": pa.array([], pa.float64())}
        if not len(queries) or not len(postings):
            return pa.table(empty)
        docs = postings.column("doc_id").combine_chunks().dictionary_encode()
        ids, doc = docs.dictionary, docs.indices.to_numpy()
        by_id = np.empty(len(ids), np.int64)
        by_id[np.asarray(pc.sort_indices(ids))] = np.arange(len(ids))
        doc = by_id[doc]  # places in the order of ids, so ties go by id
        names = postings.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(names.indices.to_numpy(), kind="stable")
        doc, part = doc[order], postings.column("part").to_numpy()[order]
        bounds = np.searchsorted(names.indices.to_numpy()[order], np.arange(len(names.dictionary) + 1))
        queries = queries.sort_by([("query_id", "ascending"), ("term", "ascending")])
        at = pc.index_in(queries.column("term"), names.dictionary).to_numpy(zero_copy_only=False)
        weight, numbers = queries.column("w").to_numpy(), queries.column("query_id").combine_chunks().dictionary_encode()
        ends = np.append(np.flatnonzero(np.diff(numbers.indices.to_numpy())) + 1, len(queries))
        found, start = [], 0
        for q, end in enumerate(ends):
            score = np.zeros(len(ids))
            for t, w in zip(at[start:end], weight[start:end], strict=True):
                if t == t:  # not null: the block has the term
                    s = slice(bounds[int(t)], bounds[int(t) + 1])
                    score[doc[s]] += w * part[s]
            start = end
            score = np.round(score, DIGITS)
            hit = np.flatnonzero(score > 0)
            if len(hit) > k:
                least = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                hit = hit[score[hit] >= least]
                hit = hit[np.argsort(-score[hit], kind="stable")[:k]]
            found.append((np.full(len(hit), q), hit, score[hit]))
        q, hit, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": numbers.dictionary.take(pa.array(q)), "doc_id": ids.take(pc.sort_indices(ids)).take(pa.array(hit)), "score": score})

    return run


def best_by_blocks(index: Index, queries: DataFrame, wanted: DataFrame, weighted: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score: each query's k best documents of each block by the sum of w * part over shared terms, where that is
    positive. wanted: term, doc_id, part; weighted: query_id, term, w.

    Postings are dealt by document to blocks, the queries' weighted terms to every block (a batch of more than BLOCK_QUERIES in parts,
    each of which gets the postings); a block's scores add up in arrays, so what the join would make of common terms, a row for each
    posting and query, is never a row. Queries and documents without an id are left out.
    """
    blocks, parts = (max(1, -(-n // most)) for n, most in ((index.docs.count(), BLOCK_DOCS), (queries.count(), BLOCK_QUERIES)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    kinds = dict(queries.dtypes)["query_id"], dict(index.postings.dtypes)["doc_id"]
    null = lambda kind: F.lit(None).cast(kind)
    right = wanted.where("doc_id is not null").select(
        null(kinds[0]).alias("query_id"), "term", null("double").alias("w"), "doc_id", "part", of("doc_id", blocks).alias("block"), each(parts).alias("group")
    )
    left = weighted.where("query_id is not null").select(
        "query_id", "term", "w", null(kinds[1]).alias("doc_id"), null("double").alias("part"), each(blocks).alias("block"), of("query_id", parts).alias("group")
    )
    return left.unionByName(right).groupBy("block", "group").applyInArrow(_block_scores(k), f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def bm25_best(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score: of bm25_scores each query's k best, and of each block of documents no more than that."""
    terms = query_terms(queries.where("query_id is not null"))
    index = index.narrowed(terms)
    wanted = index.postings
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    stats = F.broadcast(index.stats.select("n", "avgdl"))
    weighted = terms.join(df, "term").crossJoin(stats).select("query_id", "term", (F.col("qtf") * idf(F.col("n"), F.col("df"))).alias("w"))
    norm = F.lit(index.k1) * (F.lit(1 - index.b) + F.lit(index.b) * F.col("dl") / F.col("avgdl"))
    part = (F.col("tf") * (index.k1 + 1)) / (F.col("tf") + norm)
    return best_by_blocks(index, queries, wanted.crossJoin(stats).select("term", "doc_id", part.alias("part")), weighted, k)


def overlap_search(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank: the k documents that share the most distinct terms with a query; score is their number."""
    if k <= 0:
        raise ValueError("k must be positive")
    terms = query_terms(queries.where("query_id is not null")).select("query_id", "term", F.lit(1.0).alias("w"))
    wanted = index.of_terms(terms).select("term", "doc_id", F.lit(1.0).alias("part"))
    return top_k(best_by_blocks(index, queries, wanted, terms, k), k)


def bm25_search(index: Index, queries: DataFrame, k: int | None = 10) -> DataFrame:
    """query_id, doc_id, score, rank. Queries without known terms have no rows."""
    if k is None or k <= 0:
        return top_k(bm25_scores(index, queries), k)
    return top_k(bm25_best(index, queries, k), k)


def bm25_score(index: Index, queries: DataFrame, ids: DataFrame) -> DataFrame:
    """query_id, doc_id, score for given pairs of queries and ids (doc_id): 0 where they share nothing or the id is unknown."""
    pairs = queries.select("query_id").distinct().crossJoin(F.broadcast(ids.select("doc_id").distinct()))
    found = bm25_scores(index, queries).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return pairs.join(found, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_terms(index: Index, queries: DataFrame, k: int = 20) -> DataFrame:
    """The rarest terms of each query: query_id, term, df, idf, rank; ties by term. Unknown terms have df 0."""
    terms = query_terms(queries).select("query_id", "term").join(index.term_df, "term", "left")
    terms = terms.crossJoin(F.broadcast(index.stats.select("n"))).withColumn("df", F.coalesce("df", F.lit(0)))
    terms = terms.select("query_id", "term", "df", F.round(idf(F.col("n"), F.col("df")), DIGITS).alias("idf"))
    order = Window.partitionBy("query_id").orderBy(F.desc("idf"), "term")
    return terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
