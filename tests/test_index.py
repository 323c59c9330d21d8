import math
import random
from collections import Counter

import pytest

from whinstone.operators.index import Index, bm25_score, bm25_search, build_index, top_terms

WORDS = "alpha beta gamma delta epsilon zeta".split()
PHRASES = ["会话", "持久化", "框架"]


def tokens(text):
    import re

    text = text.lower()
    out = re.findall(r"[a-z0-9]+(?:[._'-][a-z0-9]+)*", text)
    for run in re.findall("[㐀-䶿一-鿿]+", text):
        out += list(run) + [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def plain(docs, query, k1=1.5, b=0.75):
    """Every document scored term by term."""
    bags = {d: Counter(tokens(t)) for d, t in docs}
    n, mean = len(docs), sum(sum(c.values()) for c in bags.values()) / len(docs)
    scores = {}
    for d, bag in bags.items():
        s = 0.0
        for t in tokens(query):
            df = sum(t in c for c in bags.values())
            if bag[t]:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * bag[t] * (k1 + 1) / (bag[t] + k1 * (1 - b + b * sum(bag.values()) / mean))
        if s > 0:
            scores[d] = round(s, 9)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def corpus(seed, n=60):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        parts = rng.choices(WORDS, k=rng.randint(3, 40)) + rng.choices(PHRASES, k=rng.randint(0, 10))
        rng.shuffle(parts)
        docs.append((f"d{i:03}", " ".join(parts)))
    queries = [" ".join(rng.choices(WORDS + PHRASES, k=rng.randint(1, 6))) for _ in range(12)]
    return docs, [q + " " + q.split()[0] if i % 3 == 0 else q for i, q in enumerate(queries)]


@pytest.mark.parametrize("seed", [7, 11])
def test_against_plain_scorer(spark, seed):
    docs, queries = corpus(seed)
    index = build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    asked = spark.createDataFrame([*enumerate(queries), (98, ""), (99, "unknown")], "query_id int, text string")
    for k in (1, 5, -1):
        rows = bm25_search(index, asked, k).collect()
        for i, q in enumerate(queries):
            got = [(r["doc_id"], r["score"]) for r in sorted(rows, key=lambda r: r["rank"]) if r["query_id"] == i]
            true = plain(docs, q)[: None if k < 0 else k]
            assert [d for d, _ in got] == [d for d, _ in true]
            assert [s for _, s in got] == pytest.approx([s for _, s in true], rel=1e-9, abs=2e-9)
        assert not [r for r in rows if r["query_id"] > 90]


def test_remove_and_add(spark, tmp_path):
    docs, queries = corpus(13, 30)
    df = spark.createDataFrame(docs, "doc_id string, text string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")
    find = lambda index: sorted(map(tuple, bm25_search(index, asked, 5).collect()))
    left = df.where("doc_id >= 'd010'")
    gone = df.where("doc_id < 'd010'")
    index = build_index(df)
    assert find(index.remove(gone)) == find(index.remove(gone).remove(gone)) == find(build_index(left))
    assert find(index.remove(gone).add(build_index(gone))) == find(index)
    index.save(str(tmp_path))
    assert find(Index.load(spark, str(tmp_path))) == find(index)


def test_stats_scores_and_terms(spark):
    df = spark.createDataFrame([("a", "cat dog"), ("b", "cat cat"), ("c", "bird")], "doc_id string, text string")
    index = build_index(df)
    row = index.stats.first()
    assert (row["n"], row["total_len"], row["avgdl"]) == (3, 5, pytest.approx(5 / 3))
    asked = spark.createDataFrame([(1, "cat bird zebra")], "query_id int, text string")
    terms = [(r["term"], r["df"]) for r in top_terms(index, asked).orderBy("rank").collect()]
    assert terms == [("zebra", 0), ("bird", 1), ("cat", 2)]
    ids = spark.createDataFrame([("a",), ("zz",)], "doc_id string")
    scores = {r["doc_id"]: r["score"] for r in bm25_score(index, asked, ids).collect()}
    assert scores["zz"] == 0 and scores["a"] > 0
    empty = build_index(df.where("false"))
    assert empty.stats.first()["avgdl"] == 1.0 and bm25_search(empty, asked).count() == 0
    for bad in ({"k1": 0}, {"b": 1.5}):
        with pytest.raises(ValueError):
            build_index(df, **bad)


def test_plan_has_no_cartesian_product(spark, capsys):
    docs, queries = corpus(17, 10)
    index = build_index(spark.createDataFrame(docs, "doc_id string, text string"))
    bm25_search(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, text string")).explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan


def test_blocks_of_documents_and_queries_score_as_the_join_does(spark, monkeypatch):
    from whinstone.operators import index as I

    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "x1", "框架", "会话"]
    docs = [(f"d{i}", " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(60)] + [(None, "alpha beta"), ("e", None)]
    docs += [(f"same{i}", "alpha beta") for i in range(9)]
    asked = [(i, " ".join(rng.choices([*words, "unknown"], k=rng.randint(0, 5)))) for i in range(25)] + [(None, "alpha"), (99, None), (98, "alpha alpha")]
    df = spark.createDataFrame(docs, "doc_id string, text string")
    queries = spark.createDataFrame(asked, "query_id int, text string")
    index = I.build_index(df)
    scores = I.bm25_scores(index, queries.where("query_id is not null")).where("doc_id is not null")
    for blocks in (4096, 7):
        monkeypatch.setattr(I, "BLOCK_DOCS", blocks)
        monkeypatch.setattr(I, "BLOCK_QUERIES", blocks)
        for k in (1, 4, 500):
            want = sorted(tuple(r) for r in I.top_k(scores, k).select("query_id", "doc_id", "score", "rank").collect())
            got = sorted(tuple(r) for r in I.bm25_search(index, queries, k).select("query_id", "doc_id", "score", "rank").collect())
            assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in want]
            assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=2e-9)
    assert I.bm25_search(index, queries.where("false"), 5).count() == 0 and I.bm25_search(I.build_index(df.where("false")), queries, 5).count() == 0
