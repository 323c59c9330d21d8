import numpy as np
import pytest

from whinstone.llm import embedding_dedup as E
from whinstone.llm.hnsw import Graph, unit


def brute(rows, least=0.95):
    ok = [e is not None and len(e) > 0 and None not in e and bool(np.isfinite(e).all()) and any(e) for _, e in rows]
    links = [[] for _ in rows]
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].append(j)
    out = []
    for i, (v, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least_id = min(rows[j][0] for j in seen)
        out.append((v, len(links[i]), least_id, v == least_id))
    return sorted(out)


def test_graph_recall():
    rng = np.random.default_rng(0)
    x = unit(rng.normal(size=(3000, 24)))
    graph = Graph(x)
    again = Graph.unpacked(x, graph.packed())
    q = unit(rng.normal(size=(200, 24)))
    true = np.argsort(-(q @ x.T), axis=1)[:, :10]
    for g in (graph, again):
        ids, _ = g.search(q, 64)
        assert np.mean([len(set(a) & set(b[:10])) / 10 for a, b in zip(true, ids)]) > 0.9


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(8, 16))
    rows = []
    for i in range(240):
        v = base[rng.integers(8)] + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 3])
        rows.append((i, [float(x) for x in v]))
    rows += [(500, rows[3][1]), (501, rows[3][1]), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in E.near_duplicate_vectors(df).collect())
    assert got == brute(rows)


def test_odd_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.01]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [float("nan"), 1.0]), (8, [1.0, None]),
        (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.001]), (2, [1.0, 0.0]), (11, [float("inf"), 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, n int")
    got = sorted(tuple(r) for r in E.near_duplicate_vectors(df).collect())
    assert got == brute(rows)
    assert E.near_duplicate_vectors(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40])
def test_tiny_graphs(n):
    x = unit(np.random.default_rng(n).normal(size=(n, 4)))
    ids, sims = Graph(x).search(x, 8)
    assert (ids[:, 0] == np.arange(n)).all() and np.allclose(sims[:, 0], 1, atol=1e-5)


def test_a_large_group_is_found_whole():
    rng = np.random.default_rng(3)
    x = unit(np.concatenate([1 + rng.normal(size=(700, 16)) * 0.02, rng.normal(size=(800, 16))]))
    graph = Graph(x)
    a, b, _ = E._search(graph, x, x, 0.95, 32)
    assert len(a) == ((x @ x.T) >= 0.95).sum()


def test_upper_layers_larger_than_the_first_block(monkeypatch):
    from whinstone.llm import hnsw

    monkeypatch.setattr(hnsw, "EXACT", 16)
    monkeypatch.setattr(hnsw, "BATCH", 8)
    x = unit(np.random.default_rng(4).normal(size=(900, 8)))
    graph = Graph(x)
    assert graph.sizes[1] > 16
    ids, _ = graph.search(x, 48)
    assert (ids[:, 0] == np.arange(len(x))).mean() > 0.99


def test_large_and_tiny_finite_vectors(spark):
    rows = [(1, [1e200, 0.0]), (2, [2e200, 0.0]), (3, [5e-324, 0.0]), (4, [1e308, 1.7e308]), (5, [1e-200, 1.7e-200]), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in E.near_duplicate_vectors(df).collect())
    assert got == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 0, 6)]


def test_wider_beams_walk_the_graph(monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([np.repeat(centres, 150, 0) + rng.normal(size=(1800, 24)) * 0.1, rng.normal(size=(3200, 24))])
    x = unit(x[rng.permutation(len(x))])
    graph, beams = Graph(x), []
    walk = graph.search
    monkeypatch.setattr(graph, "search", lambda q, beam: beams.append(beam) or walk(q, beam))
    a, b, _ = E._search(graph, x, x, 0.95, E._audited(graph, x, x, 0.95, E.BEAM))
    true = set(zip(*np.nonzero(x @ x.T >= 0.95)))
    found = set(zip(a.tolist(), b.tolist()))
    assert max(beams) >= 4 * E.BEAM and found <= true and len(found) >= 0.995 * len(true)


def test_shards_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(E, "SHARD_BYTES", 16 * 8 * 20)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in base[i % 8] + rng.normal(size=16) * 0.05]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in E.near_duplicate_vectors(df).collect()) == brute(rows)
