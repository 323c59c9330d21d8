"""What an evaluation run reports beside its views: intervals by cluster, rollups, the cost of abstaining, drift and timing."""

from __future__ import annotations

import json
import math
import statistics
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whinstone.functions.text import leak_bucket
from whinstone.operators import metrics as M
from whinstone.operators.index import DIGITS

#: Titles of a report's sections and the kinds of views in each: a view's kind is what stands before its colon.
SECTIONS = (
    ("Quality", ("strict", "graded", "strict_no_leak")),
    ("Languages", ("lang",)),
    ("Leak buckets", ("leak",)),
    ("Abstention and time", ("abstention", "time")),
)


def nearest_rank(values: Sequence[float], p: float) -> float:
    return sorted(values)[max(0, math.ceil(p / 100 * len(values)) - 1)]


def time_figures(runs: Sequence[Sequence[float]]) -> dict[str, float]:
    """From the times of single queries, by repeat: p50 and p95 of each repeat, and of these the median, least and most."""
    found = {}
    for p in (50, 95):
        each = [nearest_rank(run, p) for run in runs]
        found |= {f"p{p} {name}": f(each) for name, f in (("median", statistics.median), ("min", min), ("max", max))}
    return found


@dataclass
class Evaluation:
    """metrics: mode, view, metric, value; rankings: mode, query_id, doc_id, rank; coverage: mode, query_id, coverage; drift: modes
    whose rankings differed between repeats."""

    metrics: DataFrame
    rankings: DataFrame
    coverage: DataFrame
    drift: list[str] = field(default_factory=list)

    def report(self) -> str:
        """Four Markdown sections, those without rows left out, and a warning for each mode that drifted."""
        kind = F.substring_index("view", ":", 1)
        parts = []
        for title, kinds in SECTIONS:
            own = self.metrics.where(kind.isin(*kinds))
            if not own.isEmpty():
                parts.append(f"## {title}\n\n{M.report(own)}")
        return "\n\n".join([*parts, *(f"Rankings of {mode} differed between repeats." for mode in self.drift)])

    def write_json(self, path: str) -> None:
        """metrics as a list, rankings and coverage by mode and query, as one JSON file of the driver: of the size of the evaluation set."""
        rankings: dict = {}
        for r in self.rankings.orderBy("mode", "query_id", "rank").toLocalIterator():
            rankings.setdefault(r["mode"], {}).setdefault(r["query_id"], []).append(r["doc_id"])
        coverage: dict = {}
        for r in self.coverage.orderBy("mode", "query_id").toLocalIterator():
            coverage.setdefault(r["mode"], {})[r["query_id"]] = r["coverage"]
        rows = [r.asDict() for r in self.metrics.orderBy("mode", "view", "metric").collect()]
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"metrics": rows, "rankings": rankings, "coverage": coverage, "drift": self.drift}, f, ensure_ascii=False, indent=1)


def query_labels(eval_set: DataFrame) -> DataFrame:
    """query_id, cluster (the note with the highest grade, of several the first; null without an answer), lang (unknown where the set has
    none), bucket (a question without leak_min_df is in the first), leak."""
    best = eval_set.select("id", F.posexplode("grades").alias("pos", "note", "grade")).groupBy("id")
    best = best.agg(F.max_by("note", F.struct("grade", -F.col("pos"))).alias("cluster"))
    return eval_set.join(best, "id", "left").select(
        F.col("id").alias("query_id"),
        "cluster",
        F.coalesce("lang", F.lit("unknown")).alias("lang"),
        leak_bucket(F.coalesce("leak_min_df", F.lit(0))).alias("bucket"),
        F.coalesce("leak", F.lit(False)).alias("leak"),
    )


def long_rows(wide: DataFrame, view: Column, names: Sequence[str]) -> DataFrame:
    """view, metric, value of the named columns."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.round(F.col(f"`{n}`").cast("double"), DIGITS).alias("value")) for n in names]
    return wide.select(view.alias("view"), F.inline(F.array(*pairs)))


def intervals(
    facts: DataFrame, labels: DataFrame, view: str, names: Sequence[str], samples: int, seed: int = 0, by: Sequence[str] = ()
) -> DataFrame:
    """view, metric, value: `<name> low` and `<name> high` of the mean of each named column of facts, whole clusters drawn. With a
    column `by` one view for each of its values."""
    pairs = [F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in names]
    rows = facts.join(labels.where("cluster is not null").select("query_id", "cluster", *by), "query_id")
    found = M.cluster_bootstrap(rows.select("cluster", *by, F.inline(F.array(*pairs))), by=["metric", *by], samples=samples, seed=seed)
    ends = [F.struct(F.concat("metric", F.lit(f" {c}")).alias("metric"), F.round(F.col(c), DIGITS).alias("value")) for c in ("low", "high")]
    return found.select(F.concat(F.lit(view), *by).alias("view"), F.inline(F.array(*ends)))


def language_rollup(
    strict: DataFrame, graded: DataFrame, coverage: DataFrame, labels: DataFrame, recall: str, ndcg: str, threshold: float
) -> DataFrame:
    """One row a language: answerable queries, their notes, mean strict recall and graded nDCG; queries without an answer, how many of
    them the system abstains on, and its rate of abstaining on the others."""
    rows = labels.select("query_id", "cluster", "lang").join(strict.select("query_id", F.col(f"`{recall}`").alias("r")), "query_id", "left")
    rows = rows.join(graded.select("query_id", F.col(f"`{ndcg}`").alias("g")), "query_id", "left").join(coverage, "query_id", "left")
    known, silent = F.col("cluster").isNotNull(), F.coalesce("coverage", F.lit(0.0)) < threshold
    return rows.groupBy("lang").agg(
        F.count(F.when(known, 1)).alias("queries"),
        F.countDistinct("cluster").alias("notes"),
        F.avg(F.when(known, F.col("r"))).alias(recall),
        F.avg(F.when(known, F.col("g"))).alias(ndcg),
        F.count(F.when(~known, 1)).alias("unanswerable"),
        F.count(F.when(~known & silent, 1)).alias("abstained"),
        F.avg(F.when(known, silent.cast("double"))).alias("false_abstain_rate"),
    )


def leak_rollup(strict: DataFrame, labels: DataFrame, recall: str) -> DataFrame:
    """One row for each leak bucket that has answerable queries: bucket, queries, mean strict recall."""
    rows = strict.join(labels.where("cluster is not null").select("query_id", "bucket"), "query_id")
    return rows.groupBy("bucket").agg(F.count("*").alias("queries"), F.avg(F.col(f"`{recall}`")).alias(recall))


def evaluate_run(
    ranked: DataFrame, coverage: DataFrame, qrels: DataFrame, labels: DataFrame, ks: Sequence[int], threshold: float, samples: int
) -> DataFrame:
    """view, metric, value of one run: the three views, intervals of strict recall and rr (none for samples = 0), abstention with its
    cost, languages, leak buckets. Recall is that at 5 and nDCG that at 10 where ks has them, else at the largest of ks."""
    recall, ndcg = (f"{name}@{k if k in ks else max(ks)}" for name, k in (("recall", 5), ("ndcg", 10)))
    asked = labels.select("query_id")
    answerable = labels.where("cluster is not null").select("query_id")
    strict = M.per_query(ranked, M.strict_view(qrels), answerable, ks).persist()
    graded = M.per_query(ranked, qrels, answerable, ks)
    out = M.evaluate_views(ranked, qrels, asked, labels.where("leak"), ks)
    silent = M.abstention_report(coverage, qrels, threshold)
    out = out.unionByName(long_rows(silent, F.lit("abstention"), ["answerable", "unanswerable", "abstain_rate", "false_abstain_rate"]))
    cost = M.recall_with_abstention(strict.select("query_id", F.col(f"`{recall}`").alias("recall@5")), coverage, 5, threshold)
    cost = cost.withColumnRenamed("recall_with_abstention", f"{recall} with abstention")
    out = out.unionByName(long_rows(cost, F.lit("abstention"), cost.columns))
    langs = language_rollup(strict, graded, coverage, labels, recall, ndcg, threshold)
    out = out.unionByName(long_rows(langs, F.concat(F.lit("lang:"), "lang"), langs.columns[1:]))
    leaks = leak_rollup(strict, labels, recall)
    out = out.unionByName(long_rows(leaks, F.concat(F.lit("leak:"), "bucket"), leaks.columns[1:]))
    if samples:
        out = out.unionByName(intervals(strict, labels, "strict", [*(f"recall@{k}" for k in ks), "rr"], samples))
        out = out.unionByName(intervals(strict, labels, "lang:", [recall], samples, by=["lang"]))
        out = out.unionByName(intervals(graded, labels, "lang:", [ndcg], samples, by=["lang"]))
    return out
