"""Retrieval metrics as one long table: graded relevance, abstention, percentiles and cluster bootstrap."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whinstone.functions.text import content_tokens, tokenize
from whinstone.operators.index import DIGITS
from whinstone.operators.places import join_null_safe, running_total


def strict_view(qrels: DataFrame) -> DataFrame:
    """Only the documents with a query's highest grade; ties stay."""
    top = F.max("grade").over(Window.partitionBy("query_id"))
    return qrels.withColumn("_top", top).where("grade = _top").drop("_top")


def per_query(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """For every row of queries (query_id): n_relevant, and recall@k, precision@k, ndcg@k for each k, and rr.

    rankings: query_id, doc_id, rank; qrels: query_id, doc_id, grade. Queries without ranking or without relevant documents get zeros;
    precision divides by what was retrieved; gain is 2^grade - 1 over log2(rank + 1).
    """
    if not ks or min(ks) <= 0:
        raise ValueError("every k must be positive")
    judged = rankings.select("query_id", "doc_id", "rank").join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"], "left")
    gain = (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("rank") + 1)
    facts = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("grade").isNotNull(), F.col("rank"))).alias("first"),
        *[F.count(F.when((F.col("rank") <= k) & F.col("grade").isNotNull(), 1)).alias(f"hit{k}") for k in ks],
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"got{k}") for k in ks],
        *[F.sum(F.when((F.col("rank") <= k) & (F.col("grade") > 0), gain)).alias(f"dcg{k}") for k in ks],
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))
    ideal = qrels.select("query_id", "grade", place.alias("place")).withColumn(
        "gain", (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col("place") + 1)
    )
    ideal = ideal.groupBy("query_id").agg(
        F.count("*").alias("n_relevant"), *[F.sum(F.when(F.col("place") <= k, F.col("gain"))).alias(f"idcg{k}") for k in ks]
    )
    rows = queries.select("query_id").distinct().join(facts, "query_id", "left").join(ideal, "query_id", "left")

    def share(a: str, b: str) -> Column:
        return F.round(F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0)), DIGITS)

    return rows.select(
        "query_id",
        F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"),
        *[share(f"hit{k}", "n_relevant").alias(f"recall@{k}") for k in ks],
        *[share(f"hit{k}", f"got{k}").alias(f"precision@{k}") for k in ks],
        *[share(f"dcg{k}", f"idcg{k}").alias(f"ndcg@{k}") for k in ks],
        F.round(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)), DIGITS).alias("rr"),
    )


def check_qrels(queries: DataFrame, qrels: DataFrame) -> None:
    """Raises where a judged query is unknown, naming three."""
    lost = qrels.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_anti").limit(3).collect()
    if lost:
        raise ValueError(f"judgements of unknown queries, such as {[r[0] for r in lost]}")


def evaluate(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """metric, value: queries, recall@k and ndcg@k for each k, mrr; nulls for an empty set of queries."""
    facts = per_query(rankings, qrels, queries, ks)
    names = [f"{m}@{k}" for k in ks for m in ("recall", "ndcg")]
    row = facts.agg(
        F.count("*").cast("double").alias("queries"), *[F.avg(F.col(f"`{n}`")).alias(n) for n in names], F.avg("rr").alias("mrr")
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.round(F.col(f"`{n}`"), DIGITS).alias("value")) for n in ("queries", *names, "mrr")])
    return row.select(F.inline(pairs))


def evaluate_views(rankings: DataFrame, qrels: DataFrame, queries: DataFrame, leaks: DataFrame, ks: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """view, metric, value over answerable queries: strict, graded, and strict without queries of `leaks` (query_id)."""
    answerable = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    strict = strict_view(qrels)
    out = None
    for view, judged, asked in (
        ("strict", strict, answerable),
        ("graded", qrels, answerable),
        ("strict_no_leak", strict, answerable.join(leaks.select("query_id"), "query_id", "left_anti")),
    ):
        found = evaluate(rankings, judged, asked, ks).select(F.lit(view).alias("view"), "metric", "value")
        out = found if out is None else out.unionByName(found)
    return out


def abstain_coverage(queries: DataFrame, top_hits: DataFrame) -> DataFrame:
    """query_id, coverage: the share of a question's content tokens among the tokens of its first hit (query_id, title, text); 0
    without tokens or hits."""
    words = top_hits.select("query_id", tokenize(F.concat_ws(" ", "title", "text")).alias("words"))
    asked = queries.select("query_id", content_tokens(tokenize("text")).alias("tokens")).join(words, "query_id", "left")
    share = F.size(F.array_intersect("tokens", "words")) / F.size("tokens")
    return asked.select("query_id", F.round(F.coalesce(F.when(F.size("tokens") > 0, share), F.lit(0.0)), DIGITS).alias("coverage"))


def abstention_report(coverage: DataFrame, answerable: DataFrame, threshold: float = 0.30) -> DataFrame:
    """One row: how many queries, and how often the system abstains (coverage < threshold) on those without and with an answer; a rate
    over no queries is null."""
    rows = coverage.join(answerable.select("query_id").distinct().withColumn("a", F.lit(True)), "query_id", "left")
    silent, known = (F.col("coverage") < threshold).cast("double"), F.coalesce("a", F.lit(False))
    return rows.agg(
        F.count("*").alias("queries"),
        F.count(F.when(known, 1)).alias("answerable"),
        F.count(F.when(~known, 1)).alias("unanswerable"),
        F.round(F.avg(F.when(~known, silent)), DIGITS).alias("abstain_rate"),
        F.round(F.avg(F.when(known, silent)), DIGITS).alias("false_abstain_rate"),
    )


def recall_with_abstention(facts: DataFrame, coverage: DataFrame, k: int = 5, threshold: float = 0.30) -> DataFrame:
    """One row: mean recall@k over facts where abstaining counts as finding nothing."""
    rows = facts.join(coverage, "query_id", "left")
    value = F.when(F.col("coverage") < threshold, 0.0).otherwise(F.col(f"`recall@{k}`"))
    return rows.agg(F.round(F.avg(value), DIGITS).alias("recall_with_abstention"))


def percentile(rows: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Nearest-rank percentiles: by..., p, value: the value at place max(1, ceil(p / 100 * n)).

    Places come from counts per distinct value, added up range by range: neither equal values nor a large group meet in one task.
    """
    if any(not 0 <= p <= 100 for p in ps):
        raise ValueError("percentiles lie between 0 and 100")
    by = list(by)
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    counts = running_total(counts, by, value, "n", "upto")
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    counts = join_null_safe(counts, totals, by) if by else counts.crossJoin(F.broadcast(totals))
    places = F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("p")
    wanted = counts.select(*by, value, "n", "upto", "total", places)
    place = F.greatest(F.ceil(F.col("p") / 100 * F.col("total")), F.lit(1))
    return wanted.where((place <= F.col("upto")) & (place > F.col("upto") - F.col("n"))).select(*by, "p", F.col(value).alias("value"))


def cluster_bootstrap(
    rows: DataFrame, value: str = "value", cluster: str = "cluster", by: Sequence[str] = (), samples: int = 2000,
    confidence: float = 0.95, seed: int = 0,
) -> DataFrame:
    """by..., mean, low, high, queries, clusters: percentile interval of the mean when whole clusters are drawn with replacement.

    Clusters are summed by Spark first; each group then resamples its clusters' (sum, count) pairs in one task.
    """
    if samples <= 0 or not 0 < confidence < 1:
        raise ValueError("samples must be positive and confidence between 0 and 1")
    by = list(by)
    sums = rows.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    if not by:
        sums = sums.withColumn("_all", F.lit(1))
    keys = by or ["_all"]

    def draw(group: pd.DataFrame) -> pd.DataFrame:
        import random

        group = group.sort_values(cluster)
        s, n = group["s"].to_numpy(float), group["n"].to_numpy(float)
        rng = random.Random(seed)
        at = np.array([[rng.randrange(len(s)) for _ in s] for _ in range(samples)])
        means = np.sort(s[at].sum(axis=1) / n[at].sum(axis=1))
        tail = (1 - confidence) / 2
        low, high = int(tail * samples), min(samples - 1, int((1 - tail) * samples))
        first = {k: [group[k].iloc[0]] for k in keys}
        return pd.DataFrame(
            first | {"mean": [s.sum() / n.sum()], "low": [means[low]], "high": [means[high]], "queries": [int(n.sum())], "clusters": [len(s)]}
        )

    kinds = dict(sums.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "mean double", "low double", "high double", "queries long", "clusters long"])
    return sums.groupBy(*keys).applyInPandas(draw, schema).drop("_all")


#: Chances of drawing a cluster at most 0, 1, 2, ... times when draws are Poisson with mean 1 (fixed values of that distribution, to
#: the digits that a 32-bit hash can tell).
AT_MOST = (0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152, 0.9999167589, 0.9999897508, 0.9999988748)


def poisson_draws(cluster: Column, sample: Column, seed: int) -> Column:
    """How often a sample draws a cluster: Poisson with mean 1, from 32 bits of the MD5 of seed, sample and cluster."""
    text = F.concat_ws(":", F.lit(str(seed)), sample.cast("string"), cluster.cast("string"))
    u = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in AT_MOST), F.lit(0))


def cluster_bootstrap_hashed(
    rows: DataFrame, value: str = "value", cluster: str = "cluster", samples: int = 2000, confidence: float = 0.95, seed: int = 0,
    stratum: str | None = None,
) -> DataFrame:
    """mean, low, high: the percentile interval of the mean when clusters are drawn with replacement, by Poisson draws instead of a
    multinomial one: each sample draws each cluster by a hash of its own, so nothing but sums by sample meets anywhere. Rows without a
    value or cluster don't count, nor do samples that draw nothing.

    With a column `stratum` one row for each value of it, and one for each pair of values a < b, stratum "a - b": the interval of the
    difference of their means, both from the same sample. A cluster may have rows in several strata; it is drawn as a whole.
    """
    if samples <= 0 or not 0 < confidence < 1:
        raise ValueError("samples must be positive and confidence between 0 and 1")
    name = F.lit("") if stratum is None else F.col(stratum).cast("string")
    known = rows.where(F.col(value).isNotNull() & F.col(cluster).isNotNull()).select(
        F.col(cluster).alias("cluster"), F.col(value).cast("double").alias("value"), name.alias("stratum")
    ).where("stratum is not null")
    sums = known.groupBy("cluster", "stratum").agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    each = sums.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    each = each.withColumn("w", poisson_draws(F.col("cluster"), F.col("sample"), seed)).where("w > 0")
    drawn = each.groupBy("stratum", "sample").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("n"))).alias("mean"))
    means = known.groupBy("stratum").agg(F.avg("value").alias("mean"))
    if stratum is not None:
        pair = lambda df, on: df.alias("a").join(df.alias("b"), on).select(
            F.concat("a.stratum", F.lit(" - "), "b.stratum").alias("stratum"), *([F.col("a.sample")] if "sample" in df.columns else []),
            (F.col("a.mean") - F.col("b.mean")).alias("mean"),
        )
        less = F.col("a.stratum") < F.col("b.stratum")
        drawn = drawn.unionByName(pair(drawn, (F.col("a.sample") == F.col("b.sample")) & less))
        means = means.unionByName(pair(means, less))
    # a stratum has `samples` values at most
    tail = (1 - confidence) / 2
    ordered = drawn.groupBy("stratum").agg(F.array_sort(F.collect_list("mean")).alias("v"))
    at = lambda share: F.get("v", F.least(F.floor(F.lit(share) * F.size("v")), F.size("v") - 1).cast("int"))
    found = means.join(ordered.select("stratum", at(tail).alias("low"), at(1 - tail).alias("high")), "stratum", "left")
    found = found.select("stratum", *[F.round(c, DIGITS).alias(c) for c in ("mean", "low", "high")])
    return found if stratum is not None else found.drop("stratum")


def format_interval(mean: Column, low: Column, high: Column) -> Column:
    return F.when(mean.isNull(), F.lit("n/a")).otherwise(F.format_string("%.3f [%.3f, %.3f]", mean, low, high))


def rankings_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id, rank) that only one of two runs has: none where retrieval is deterministic."""
    cols = ["query_id", "doc_id", "rank"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def report(metrics: DataFrame, column: str = "mode") -> str:
    """A Markdown table of (column, view, metric, value), one column a mode; values with four decimals."""
    wide = metrics.groupBy("view", "metric").pivot(column).agg(F.first("value")).orderBy("view", "metric")
    names = wide.columns[2:]
    lines = ["| view | metric | " + " | ".join(names) + " |", "|" + " --- |" * (len(names) + 2)]
    for r in wide.collect():
        cells = ["-" if r[n] is None else f"{r[n]:.0f}" if r["metric"] == "queries" else f"{r[n]:.4f}" for n in names]
        lines.append(f"| {r['view']} | {r['metric']} | " + " | ".join(cells) + " |")
    return "\n".join(lines)
