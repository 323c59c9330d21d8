import random

import numpy as np
import pyarrow as pa
import pytest

from whinstone.llm import common as C


def plain_components(edges):
    least = {}
    for e in edges:
        for n in e:
            least[n] = n
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            if least[a] != m or least[b] != m:
                least[a] = least[b] = m
                changed = True
    return least


@pytest.mark.parametrize("kind", ["chain", "star", "random", "loops", "none"])
def test_components(spark, kind):
    rng = random.Random(1)
    edges = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(100, i) for i in range(40)] + [(100, 200), (300, 301)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)],
        "loops": [(1, 1), (2, 3), (3, 2), (-5, 2)],
        "none": [],
    }[kind]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    true = {n: c for n, c in plain_components(edges).items() if any(n in e and e[0] != e[1] for e in edges)}
    assert got == true


def test_sorted_runs():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 12, 200))
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 7]), pa.array(np.arange(i, min(200, i + 7)))], names=["k", "v"]) for i in range(0, 200, 7)]
    parts = list(C.sorted_runs(batches, ("k",)))
    assert np.concatenate([p[1] for p in parts]).tolist() == list(range(200))
    for a, b in zip(parts, parts[1:], strict=False):
        assert a[0][-1] != b[0][0]
    assert list(C.sorted_runs([], ("k",))) == []


def test_spanning_edges():
    near = lambda i, others: abs(others - i) == 2
    edges = C.spanning_edges(9, near)
    assert len(edges) == 7 and all(abs(a - b) == 2 for a, b in edges)
    assert C.spanning_edges(0, near) == []


def test_text_blocks():
    text = b"aa bb  cc\tdddddddd e\n" * 20
    assert b"".join(C.text_blocks(text, 7)) == text
    assert [w for b in C.text_blocks(text, 7) for w in b.split()] == text.split()
    assert list(C.text_blocks(b"")) == [b""]


def test_cut_writes_to_the_shared_folder(spark, tmp_path, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert C.shared_dir(spark) == (named.rstrip("/") if named else f"file://{C._own_folder[0]}")
    monkeypatch.setattr(C, "shared_dir", lambda _: f"file://{tmp_path}")
    df = C.cut(spark.range(5).toDF("id"), "x")
    assert [p.name.startswith("whinstone-x-") for p in tmp_path.iterdir()] == [True] and df.count() == 5
    C.release(df)
    assert not list(tmp_path.iterdir())


def test_a_hot_bucket_without_links_meets_in_bounded_cells(spark):
    """100,000 rows of one key, none linked; a key with a large component and few others; a key that is settled."""
    n, limit = 100_000, C.BUCKET_ROWS
    rows = spark.range(n).selectExpr("1L as key", "id").union(spark.range(n, n + 30_000).selectExpr("2L as key", "id"))
    rows = rows.union(spark.range(n, n + 20_000).selectExpr("3L as key", "id"))
    hot = C.hot_keys(rows.groupBy("key").count().withColumnRenamed("count", "n"), limit)
    settled = spark.range(n, n + 29_990).selectExpr("id as node", f"{n}L as component")
    minority, everything = C.unsettled(rows, hot, settled, limit)
    sides = [x.groupBy("key", "salt", "block").count().collect() for x in (minority, everything)]
    left, right = [{(r["key"], r["salt"], r["block"]): r["count"] for r in side} for side in sides]
    assert max(left.values()) < 1.1 * limit and max(right.values()) < 1.1 * limit
    met = {k: sum(left[c] * right.get(c, 0) for c in left if c[0] == k) for k in (1, 2, 3)}
    assert met == {1: (n - 1) * n, 2: 10 * 30_000, 3: 0}  # each row of the minority meets each row of its key once
    assert sum(v for c, v in right.items() if c[0] == 2) == 30_000


def test_pick_ignores_clashing_columns(spark):
    df = spark.createDataFrame([(1, "t", "x", "y")], "doc_id int, text string, fp string, component string")
    assert C.pick(df, doc_id="long", text="string").dtypes == [("doc_id", "bigint"), ("text", "string")]
