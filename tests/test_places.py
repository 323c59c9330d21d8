import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from whinstone.functions.text import tokenize
from whinstone.operators import evalset as E
from whinstone.operators import metrics as M
from whinstone.operators import places as P


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(P, "RANGE_ROWS", 30)


def test_places_over_many_ranges(spark, small_ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", "é", None]), rng.choice([None, 1, 2, 3, 500]), i) for i in range(700)]
    df = spark.createDataFrame(rows, "s string, n int, i int").repartition(5)
    got = {r["_place"]: (r["s"], r["n"], r["i"]) for r in P.placed(df, ["s", "n", "i"], 700).collect()}
    key = lambda r: [(v is not None, v) for v in r]
    assert [got[i] for i in range(1, 701)] == sorted(rows, key=key)
    parts = df.withColumn("p", P.range_of(df, ["s", "n", "i"], 700)).groupBy("p").count().collect()
    assert len(parts) > 12 and max(r["count"] for r in parts) < 150
    named = E.numbered(df, "q", "s", "n", "i").orderBy("id").collect()
    assert [(r["s"], r["n"], r["i"]) for r in named] == sorted(rows, key=key) and named[0]["id"] == "q0001"
    assert P.placed(df.where("false"), ["s"], 0).count() == 0


def test_percentiles_over_many_ranges(spark, small_ranges):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([7.0, rng.random() * 100, None])) for _ in range(900)]
    df = spark.createDataFrame(rows, "g string, v double")
    for by in ([], ["g"]):
        got = {(r["g"] if by else 0, r["p"]): r["value"] for r in M.percentile(df, "v", [0, 20, 55, 95, 100], by).collect()}
        for g in {r[0] for r in rows} if by else [0]:
            own = sorted(v for k, v in rows if v is not None and (not by or k == g))
            for p in (0, 20, 55, 95, 100):
                assert got[g, p] == own[max(0, math.ceil(p / 100 * len(own)) - 1)]


def test_substring_counts_without_comparing_all(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abé一二丁._'-9 ", k=rng.randint(1, 9))) for _ in range(60)]
    notes = [(i % 40, " ".join(rng.choices(words, k=rng.randint(0, 12))).upper()) for i in range(50)] + [(99, None), (98, "x" * 30000 + "abab")]
    asked = [(i, " ".join(rng.choices(words, k=4))) for i in range(30)] + [(70, ""), (71, "a b"), (72, None), (73, "xxxxx zq")]
    df = spark.createDataFrame(notes, "note int, text string")
    questions = spark.createDataFrame(asked, "question_id int, question string")
    found = E.keyword_rarity(questions, df)
    assert "NestedLoop" not in E.substring_df(questions.select(F.explode(tokenize("question")).alias("token")).distinct(), df)._jdf.queryExecution().executedPlan().toString()
    tokens = {r["question_id"]: r["t"] for r in questions.select("question_id", tokenize("question").alias("t")).collect()}
    got = {r["question_id"]: (r["token"], r["df"]) for r in found.collect()}
    for q, _ in asked:
        own = {t for t in tokens[q] if len(t) >= 2}
        df_of = {t: len({n for n, text in notes if t in (text or "").lower()}) for t in own}
        assert got[q] == (min(own, key=lambda t: (df_of[t], t)), min(df_of.values())) if own else got[q] == ("", 42)


def drawn(cluster, sample, seed):
    u = int(hashlib.md5(f"{seed}:{sample}:{cluster}".encode()).hexdigest()[:8], 16) / 2**32
    n, p, upto = 0, math.exp(-1), math.exp(-1)
    while u >= upto and n < 9:
        n += 1
        p /= n
        upto += p
    return n


def test_poisson_bootstrap_by_its_definition(spark):
    rng = random.Random(4)
    rows = [(rng.random(), f"c{rng.randint(0, 14)}", rng.choice(["en", "zh"])) for _ in range(80)] + [(None, "c1", "en"), (0.5, None, "zh"), (0.5, "c2", None)]
    df = spark.createDataFrame(rows, "value double, cluster string, lang string")
    known = [r for r in rows if None not in r]
    got = {r["stratum"]: (r["mean"], r["low"], r["high"]) for r in M.cluster_bootstrap_hashed(df, samples=200, seed=3, stratum="lang").collect()}
    times = {(c, s): drawn(c, s, 3) for c in {r[1] for r in known} for s in range(200)}
    mean = lambda rows, w: sum(w(r) * r[0] for r in rows) / sum(map(w, rows))
    means, plain = {}, {}
    for lang in ("en", "zh"):
        own = [r for r in known if r[2] == lang]
        means[lang] = [mean(own, lambda r, s=s: times[r[1], s]) for s in range(200)]
        plain[lang] = mean(own, lambda r: 1)
    means["en - zh"] = [a - b for a, b in zip(means["en"], means["zh"], strict=True)]
    plain["en - zh"] = plain["en"] - plain["zh"]
    for k, v in means.items():
        v = sorted(v)
        assert got[k] == pytest.approx((plain[k], v[int((1 - 0.95) / 2 * 200)], v[int((1 - (1 - 0.95) / 2) * 200)]), abs=1e-8)
    counts = [drawn(f"c{i}", 0, 0) for i in range(20000)]
    assert abs(sum(counts) / 20000 - 1) < 0.03 and abs(sum(c * c for c in counts) / 20000 - 2) < 0.08


def test_seeded_bootstrap_by_its_definition(spark):
    rng = random.Random(5)
    rows = [(rng.random(), f"c{rng.randint(0, 6)}") for _ in range(30)]
    got = M.cluster_bootstrap(spark.createDataFrame(rows, "value double, cluster string"), samples=300, seed=9).first()
    groups = {c: [v for v, k in rows if k == c] for c in sorted({c for _, c in rows})}
    draw, names, means = random.Random(9), list(groups), []
    for _ in range(300):
        picked = [groups[names[draw.randrange(len(names))]] for _ in names]
        means.append(sum(map(sum, picked)) / sum(map(len, picked)))
    means.sort()
    assert (got["low"], got["high"]) == pytest.approx((means[int(0.025 * 300)], means[int(0.975 * 300)]), abs=1e-12)
