"""Fusing rankings: reciprocal ranks and interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from whinstone.operators.index import DIGITS


def dealt(rankings: DataFrame) -> DataFrame:
    """rankings dealt anew by query. Spark 4.1 takes a union of lists that are each dealt by query for dealt so itself, even where their
    partitions then lie side by side: steps by query would miss the other list's rows, or a join fail. A hash of the query is no
    column of that deal, so this shuffle isn't left out as needless."""
    return rankings.repartition(F.xxhash64("query_id"))


def first_occurrences(rankings: DataFrame) -> DataFrame:
    """A document that a list repeats counts where it comes first; the places behind it stay as they are."""
    return dealt(rankings).groupBy("query_id", "retriever", "doc_id").agg(F.min("rank").alias("rank"))


def rrf_scores(rankings: DataFrame, k: float = 60, weights: dict[str, float] | None = None) -> DataFrame:
    """query_id, doc_id, score = sum of weight / (k + rank), best_rank, over rankings (query_id, retriever, doc_id, rank from 1).

    Lists without a weight weigh 1, those of weight 0 don't count. One aggregation instead of an outer join of the lists.
    """
    weights = weights or {}
    if k <= 0:
        raise ValueError("k must be positive")
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights can't be negative")
    weight = F.lit(1.0)
    for name, w in weights.items():
        weight = F.when(F.col("retriever") == name, F.lit(float(w))).otherwise(weight)
    rows = first_occurrences(rankings).withColumn("w", weight).where("w > 0")
    return rows.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(F.col("w") / (F.lit(float(k)) + F.col("rank"))), DIGITS).alias("score"), F.min("rank").alias("best_rank")
    )


def reciprocal_rank_fusion(
    rankings: DataFrame, k: float = 60, weights: dict[str, float] | None = None, limit: int | None = None
) -> DataFrame:
    """rrf_scores with rank: by score, then the best single rank, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "doc_id")
    ranked = rrf_scores(rankings, k, weights).withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def interleave(rankings: DataFrame) -> DataFrame:
    """Round robin over the lists of a query in the order of their names, as far as the shortest one goes: query_id, doc_id, rank."""
    rows = dealt(rankings).withColumn("_n", F.max("rank").over(Window.partitionBy("query_id", "retriever")))
    rows = rows.withColumn("_shortest", F.min("_n").over(Window.partitionBy("query_id"))).where("rank <= _shortest")
    firsts = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("rank", "retriever")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.rank", "at.retriever")
    return firsts.select("query_id", "doc_id", F.row_number().over(order).alias("rank"))
