import math
import random

import pytest

from whinstone.operators import fusion as U
from whinstone.operators import metrics as M

LIST = "query_id string, retriever string, doc_id string, rank int"


def lists(spark, **named):
    return spark.createDataFrame([("q", r, d, i) for r, docs in named.items() for i, d in enumerate(docs, 1)], LIST)


def fused(df, **options):
    return [(r["doc_id"], r["score"]) for r in U.reciprocal_rank_fusion(df, **options).orderBy("rank").collect()]


def test_reciprocal_ranks(spark):
    got = fused(lists(spark, a=["x", "y"], b=["y", "z"]))
    assert [d for d, _ in got] == ["y", "x", "z"]
    assert got[0][1] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    assert [d for d, _ in fused(lists(spark, a=["b", "a"], b=["a", "b"]))] == ["a", "b"]
    assert [d for d, _ in fused(lists(spark, a=["x"], b=["y"]), weights={"a": 0})] == ["y"]
    again = dict(fused(lists(spark, a=["x", "x", "z"])))
    assert again["z"] == pytest.approx(1 / 63, abs=1e-9) and again["x"] == pytest.approx(1 / 61, abs=1e-9)
    assert fused(lists(spark, a=["x"]).where("false")) == []
    for bad in ({"k": 0}, {"weights": {"a": -1}}):
        with pytest.raises(ValueError):
            U.rrf_scores(lists(spark, a=["x"]), **bad)


def test_interleave(spark):
    got = U.interleave(lists(spark, a=["x", "y", "z"], b=["y", "w"])).orderBy("rank").collect()
    assert [r["doc_id"] for r in got] == ["x", "y", "w"]


def test_lists_from_windows_are_dealt_anew(spark):
    """Two lists that windows have dealt by query, one of them by way of more partitions than the other."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    place = F.row_number().over(Window.partitionBy("query_id").orderBy("id"))
    rows = spark.range(3000).select((F.col("id") % 50).alias("query_id"), "id")
    many, few = (rows.where(w).withColumn("rank", place).where("rank <= 5") for w in ("id >= 0", "id % 3 <> 0"))
    both = [x.select("query_id", F.lit(n).alias("retriever"), F.col("id").alias("doc_id"), "rank") for n, x in (("a", many), ("b", few))]
    union = both[0].unionByName(both[1])
    got = {}
    for r in U.interleave(union).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    plan = U.interleave(union)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "REPARTITION_BY_COL" in plan
    assert "REPARTITION_BY_COL" in U.rrf_scores(union)._jdf.queryExecution().executedPlan().toString()
    assert len(got) == 50 and len({(r["query_id"], r["doc_id"]) for r in U.rrf_scores(union).collect()}) == U.rrf_scores(union).count()
    kept = [[i for i in range(q, 3000, 50) if w(i)][:5] for q in range(50) for w in (lambda i: True, lambda i: i % 3)]
    for q in range(50):
        assert got[q] == list(dict.fromkeys(x for pair in zip(kept[2 * q], kept[2 * q + 1], strict=True) for x in pair))


def facts(spark, ranked, judged, queries, ks=(1, 3)):
    r = spark.createDataFrame([(q, d, i) for q, docs in ranked.items() for i, d in enumerate(docs, 1)] or [("-", "-", 1)], "query_id string, doc_id string, rank int")
    j = spark.createDataFrame([(q, d, float(g)) for q, ds in judged.items() for d, g in ds.items()], "query_id string, doc_id string, grade double")
    q = spark.createDataFrame([(x,) for x in queries], "query_id string")
    return r, j, q, {x["query_id"]: x.asDict() for x in M.per_query(r, j, q, ks).collect()}


def test_per_query(spark):
    ranked = {"a": ["x", "y", "z"], "b": ["m"], "d": ["x"]}
    judged = {"a": {"y": 2, "q": 1}, "b": {"m": 1}, "c": {"k": 1}}
    r, j, q, got = facts(spark, ranked, judged, "abcd")
    assert (got["a"]["recall@1"], got["a"]["recall@3"], got["a"]["rr"]) == (0, 0.5, 0.5)
    assert got["a"]["precision@3"] == pytest.approx(1 / 3) and got["b"]["precision@3"] == 1
    assert got["a"]["ndcg@3"] == pytest.approx((3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert all(got["c"][m] == 0 for m in ("recall@3", "ndcg@3", "rr", "precision@3"))
    assert got["d"]["n_relevant"] == 0 and got["d"]["recall@1"] == 0
    report = {x["metric"]: x["value"] for x in M.evaluate(r, j, q, (1, 3)).collect()}
    assert report["queries"] == 4 and report["recall@3"] == pytest.approx((0.5 + 1) / 4) and report["mrr"] == pytest.approx(1.5 / 4)
    assert "precision@1" not in report
    strict = sorted(tuple(x) for x in M.strict_view(j).collect())
    assert ("a", "q", 1.0) not in strict and len(strict) == 3
    views = {(x["view"], x["metric"]): x["value"] for x in M.evaluate_views(r, j, q, q.where("query_id = 'b'"), (3,)).collect()}
    assert views["strict", "queries"] == 3 and views["strict_no_leak", "queries"] == 2 and views["strict", "recall@3"] == pytest.approx(2 / 3)
    with pytest.raises(ValueError):
        M.per_query(r, j, q, (0,))
    with pytest.raises(ValueError):
        M.check_qrels(q.where("query_id = 'a'"), j)
    assert M.rankings_differ(r, r).count() == 0 and M.rankings_differ(r, r.where("rank = 1")).count() == 2


def test_metrics_stay_in_bounds(spark):
    rng = random.Random(3)
    ranked = {f"q{i}": rng.sample("abcdefgh", rng.randint(0, 8)) for i in range(30)}
    judged = {f"q{i}": {d: rng.randint(1, 3) for d in rng.sample("abcdefgh", rng.randint(0, 4))} for i in range(30)}
    *_, got = facts(spark, ranked, judged, [f"q{i}" for i in range(30)])
    for row in got.values():
        assert all(0 <= v <= 1 + 1e-9 for k, v in row.items() if "@" in k or k == "rr")
        assert row["recall@1"] <= row["recall@3"]


def test_abstention(spark):
    q = spark.createDataFrame([(1, "storing session state"), (2, "quantum gravity waves"), (3, "a b"), (4, "lonely words")], "query_id int, text string")
    top = spark.createDataFrame([(1, "Session", "how state is kept when storing"), (2, "Cats", "nothing alike"), (3, "x", "y")], "query_id int, title string, text string")
    cover = M.abstain_coverage(q, top)
    got = {r["query_id"]: r["coverage"] for r in cover.collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    row = M.abstention_report(cover, q.where("query_id = 1")).first()
    assert (row["abstain_rate"], row["false_abstain_rate"], row["answerable"]) == (1.0, 0.0, 1)
    assert M.abstention_report(cover, q).first()["abstain_rate"] is None


@pytest.mark.parametrize("p,true", [(0, 10), (20, 10), (21, 20), (50, 30), (95, 50), (100, 50)])
def test_percentile(spark, p, true):
    df = spark.createDataFrame([(v,) for v in (50, 10, 30, 20, 40)], "v int")
    assert M.percentile(df, "v", [p]).first()["value"] == true
    twice = df.union(df).union(spark.createDataFrame([(None,)], "v int"))
    assert M.percentile(twice, "v", [p]).first()["value"] == true


def test_bootstrap(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(float(rng.random() < 0.7), f"c{i % 10}", "en") for i in range(40)], "value double, cluster string, lang string")
    a, b = M.cluster_bootstrap(rows).first(), M.cluster_bootstrap(rows).first()
    assert a == b and a["low"] <= a["mean"] <= a["high"] and (a["queries"], a["clusters"]) == (40, 10)
    by = M.cluster_bootstrap(rows, by=["lang"]).first()
    assert (by["low"], by["high"]) == (a["low"], a["high"])
    hashed = M.cluster_bootstrap_hashed(rows, samples=500).first()
    assert hashed["low"] <= hashed["mean"] <= hashed["high"] and abs(hashed["low"] - a["low"]) < 0.1
    one = spark.createDataFrame([(1.0, "c")] * 20, "value double, cluster string")
    assert tuple(M.cluster_bootstrap(one).first())[:3] == (1.0, 1.0, 1.0)
    with pytest.raises(ValueError):
        M.cluster_bootstrap(rows, samples=0)


def test_report(spark):
    rows = spark.createDataFrame([("kw", "strict", "queries", 5.0), ("kw", "strict", "mrr", 0.12345), ("v", "strict", "mrr", None)], "mode string, view string, metric string, value double")
    text = M.report(rows)
    assert "| strict | mrr | 0.1235 | - |" in text and "| 5 |" in text
