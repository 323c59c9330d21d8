import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from whinstone.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, rank int, d string, row string"


def brute(rows, every=10, k=5, floor=80):
    """The definition, pair by pair, in Python's integers."""
    ok = [r for r in dict.fromkeys((i, tuple(v) if v is not None else None, lab) for i, v, lab in rows)]
    ok = [r for r in ok if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ok = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in ok]
    out = []
    for i, v, lab in ok:
        if i % every:
            continue
        scored = [(sum(p * q for p, q in zip(v, w, strict=True)), j, m) for j, w, m in ok if len(w) == len(v)]
        best = lambda rows: sorted(rows, key=lambda r: (-r[0], r[1]))[:k]
        for s, j, _ in best([r for r in scored if r[2] == lab and r[1] != i]):
            fits = [r for r in scored if r[2] != lab and floor * s <= 100 * r[0] <= 100 * s]
            out += [(i, j, n, q, s, t) for n, (t, q, _) in enumerate(best(fits), 1)]
    return sorted(out)


def mined(spark, rows, every=10, **kw):
    df = spark.createDataFrame([(i, v, lab, 9, "x", "y") for i, v, lab in rows], SCHEMA)
    found = H.hard_negatives(df, F.col("vec_id") % every == 0, **kw).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in found)


def clustered(n, d, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, d)) + 1.5
    x = centres[rng.integers(labels, size=n)] * np.linspace(2, 0.1, d) + 0.3 * rng.normal(size=(n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("cell", [2048, 16])
def test_against_every_pair(spark, monkeypatch, cell):
    monkeypatch.setattr(H, "CELL", cell)
    rows = clustered(240, 24, 1)
    found = mined(spark, rows)
    assert len(found) > 100 and found == brute(rows)


def test_copies_ties_repeats_and_rows_that_take_no_part(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL", 32)
    rows = clustered(120, 8, 2, labels=2)
    hot = rows[7][1]
    rows += [(200 + i, hot, i % 2) for i in range(90)]  # ties, by id
    rows += [rows[10]] * 40 + [(10, rows[30][1], 1), (11, rows[31][1], 0)]  # repeated rows, and others of the same id
    rows += [(300, None, 1), (301, [1.0, None] * 4, 1), (302, [math.nan] * 8, 0), (303, [math.inf] + [0.0] * 7, 1), (304, hot, None), (None, hot, 1)]
    rows += [(310, [0.0] * 8, 1), (320, [], 1), (321, [], 0), (330, [0.5, 0.5], 0), (331, [0.5, 0.25], 0), (332, [0.45, 0.3], 1)]
    assert mined(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1)]) == []
    assert mined(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], 2)]) == [(0, 1, 1, 2, 65536, 256 * 230)]
    assert mined(spark, [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.9], 2)]) == []


def test_numbers_too_large_for_a_score_take_no_part(spark):
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.9, 1.0], 2), (3, [1e30, 0.0], 1), (4, [2.0**19, 0.0], 1)]
    found = mined(spark, rows)
    assert found == brute([r for r in rows if r[0] != 3])


@pytest.mark.parametrize("rotated", [True, False])
def test_no_pair_in_range_is_discarded_and_most_others_are(rotated):
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.normal(size=(900, 40)) * np.exp(-np.arange(40) / 4)).astype(np.int64)
    x = x[:, rng.permutation(40)]
    basis, stops = H.principal_basis(x) if rotated else (None, [10, 20])
    a, every = H.Rotated(x[:60], basis, stops), H.Rotated(x, basis, stops)
    exact = x[:60] @ x.T
    low, high = np.quantile(exact, 0.99, axis=1), np.quantile(exact, 0.999, axis=1)
    i, j = H.surviving_pairs(a, every, stops, low, high, np.ones(exact.shape, bool))
    wanted = {*zip(*map(list, np.nonzero((exact >= low[:, None]) & (exact <= high[:, None]))), strict=True)}
    assert wanted <= {*zip(i.tolist(), j.tolist(), strict=True)}
    assert len(i) < (0.05 if rotated else 0.8) * exact.size
    assert (H.exact_products(a.whole, every.whole, i, j) == exact[i, j]).all()


def test_copies_beyond_the_list_are_no_rows_of_a_cell():
    v = np.array([[1, 2]] * 9 + [[3, 4]])
    labels, ids = np.array([0] * 5 + [1] * 4 + [0]), np.array([9, 8, 7, 6, 5, 4, 3, 2, 1, 0])
    assert H.first_copies(v, labels, ids, 2).tolist() == [3, 4, 7, 8, 9]
    assert not len(H.best_of_each(*(np.empty(0, np.int64),) * 3, 5))
