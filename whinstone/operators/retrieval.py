"""Search in four modes over chunks, hydration, reranking and one result per note, for batches of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whinstone.operators.fusion import reciprocal_rank_fusion
from whinstone.operators.index import Index, bm25_search, build_index
from whinstone.operators.vectors import vector_search

MODES = ("vector", "keyword", "hybrid", "hybrid_rerank")


class Reranker(Protocol):
    """From queries and candidates (query_id, doc_id, score, rank and the chunk's columns) the same rows with new ranks."""

    def rerank(self, queries: DataFrame, candidates: DataFrame) -> DataFrame: ...


class KeepOrder:
    """The reranker that changes nothing."""

    def rerank(self, queries: DataFrame, candidates: DataFrame) -> DataFrame:
        return candidates


@dataclass
class Retriever:
    """chunks: id, note_path, title, heading_path, text and embedding. Queries: query_id, text, embedding."""

    chunks: DataFrame
    candidate_k: int = 50
    rrf_k: float = 60
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    reranker: Reranker = field(default_factory=KeepOrder)
    _index: Index | None = None

    @property
    def index(self) -> Index:
        """The keyword index of title and text, built when first asked for; index.save() and load() keep it across sessions."""
        if self._index is None:
            self._index = build_index(self.chunks, "id", F.concat_ws(" ", "title", "text"))
        return self._index

    def use_index(self, index: Index) -> Retriever:
        self._index = index
        return self

    def stats(self) -> DataFrame:
        return self.chunks.agg(F.count("*").alias("chunks"), F.countDistinct("note_path").alias("notes"))

    def _vector(self, queries: DataFrame, k: int, candidate_k: int) -> DataFrame:
        found = vector_search(self.chunks.select(F.col("id").alias("doc_id"), "embedding"), queries, k)
        return found.withColumnRenamed("score", "similarity").withColumn("score", (F.lit(candidate_k + 1) - F.col("rank")).cast("double"))

    def hydrate(self, ranked: DataFrame) -> DataFrame:
        """Adds the chunk's columns; an unknown id stays, with empty ones."""
        meta = self.chunks.select(F.col("id").alias("doc_id"), "note_path", "title", "heading_path", "text")
        joined = ranked.join(meta, "doc_id", "left")
        empty = {c: F.coalesce(c, F.lit("")) for c in ("note_path", "title", "text")}
        return joined.withColumns(empty | {"heading_path": F.coalesce("heading_path", F.array().cast("array<string>"))})

    def search(self, queries: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
        """query_id, doc_id, score, rank and the chunk's columns. Blank queries find nothing."""
        if k <= 0:
            raise ValueError("k must be positive")
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        queries = queries.where(F.trim("text") != "")
        candidate_k = max(k, self.candidate_k)
        if mode == "vector":
            ranked = self._vector(queries, k, candidate_k).select("query_id", "doc_id", "score", "rank")
        elif mode == "keyword":
            ranked = bm25_search(self.index, queries, k)
        else:
            legs = (("vector", self._vector(queries, candidate_k, candidate_k)), ("keyword", bm25_search(self.index, queries, candidate_k)))
            lists = [leg.select("query_id", "doc_id", "rank", F.lit(name).alias("retriever")) for name, leg in legs]
            weights = {"vector": self.vector_weight, "keyword": self.keyword_weight}
            ranked = reciprocal_rank_fusion(lists[0].unionByName(lists[1]), self.rrf_k, weights, candidate_k)
            ranked = ranked.select("query_id", "doc_id", "score", "rank")
        if mode == "hybrid_rerank":
            return self.reranker.rerank(queries, self.hydrate(ranked)).where(F.col("rank") <= k)
        return self.hydrate(ranked.where(F.col("rank") <= k))

    def search_notes(self, queries: DataFrame, k: int = 5, mode: str = "hybrid") -> DataFrame:
        """The best chunk of each note, k notes at most, out of 4 k chunks."""
        return best_per_note(self.search(queries, 4 * k, mode), k)

    def vector_rankings(self, queries: DataFrame, top_k: int = 50) -> DataFrame:
        """For experiments on vectors alone: the best chunk of every note among the top_k nearest chunks, however many notes those are."""
        return best_per_note(self.search(queries, top_k, "vector"))


def best_per_note(hits: DataFrame, k: int | None = None, note: str = "note_path") -> DataFrame:
    """Of each query's hits the first of each note (hits without a note go), ranked anew."""
    first = Window.partitionBy("query_id", note).orderBy("rank")
    kept = hits.where(F.col(note).cast("string") != "").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    return ranked if k is None else ranked.where(F.col("rank") <= k)


def format_hits(hits: DataFrame, width: int = 600) -> DataFrame:
    """query_id, rank, line: rank, score, note, breadcrumb and a snippet on one line."""
    path = F.when(F.size("heading_path") > 0, F.array_join("heading_path", " > ")).otherwise("(root)")
    text = F.translate(F.substring("text", 1, width), "\n", " ")
    line = F.format_string("%d. [%.4f] %s | %s | %s", "rank", "score", "note_path", path, text)
    return hits.select("query_id", "rank", line.alias("line"))
