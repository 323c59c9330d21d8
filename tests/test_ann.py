import numpy as np
import pytest
from pyspark.sql import functions as F

from whinstone.operators import ann as A
from whinstone.operators.vectors import vector_search


def table(spark, x):
    return spark.createDataFrame([(i, v) for i, v in enumerate(x)], "doc_id long, embedding array<float>")


def clustered(n=900, d=16, centres=30, spread=0.35, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, d))
    return (c[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, d))).astype(np.float32).tolist()


def asked(df, every=20):
    return df.where(f"doc_id % {every} = 0").select(F.col("doc_id").alias("query_id"), "embedding")


def rows(found):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())


@pytest.fixture(scope="module")
def built(spark):
    df = table(spark, clustered())
    return df, A.build_ivf(df, 16)


def test_all_lists_in_full_is_an_exact_search(spark, built, monkeypatch):
    df, index = built
    want = rows(vector_search(df, asked(df), 10))
    assert rows(A.ivf_search(index, asked(df), 10, probes=1000, refine=0)) == want
    monkeypatch.setattr(A, "QUERY_BLOCK", 7)
    monkeypatch.setattr(A, "LIST_BLOCK", 8)
    assert rows(A.ivf_search(A.build_ivf(df, 16), asked(df), 10, probes=1000, refine=0)) == want


def test_recall_grows_with_probes(spark, built):
    df, index = built
    sweep = {r["probes"]: r for r in A.recall_sweep(index, df, asked(df), [1, 4, 30], 10).collect()}
    truth = {(q, d) for q, _, d, _ in rows(vector_search(df, asked(df), 10))}
    for p, r in sweep.items():
        found = {(q, d) for q, _, d, _ in rows(A.ivf_search(index, asked(df), 10, p))}
        assert r["recall"] == pytest.approx(len(found & truth) / len(truth), abs=1e-6) and r["queries"] == 45
    assert sweep[1]["recall"] < sweep[30]["recall"] and sweep[4]["recall"] >= 0.9
    assert sweep[4]["scanned"] < 0.2 and sweep[4]["compared"] <= 40 / 900 + 1e-6 and sweep[30]["scanned"] == 1.0


def test_given_vectors_reach_their_recall(spark):
    """Vectors without clusters: half of the lists by code, a fiftieth of the pairs in full."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")
    index = A.build_ivf(df, 64)
    (row,) = A.recall_sweep(index, df, asked(df, 100), [len(index.sizes) * 6 // 10], 10).collect()
    assert row["recall"] >= 0.9 and row["scanned"] < 0.65 and row["compared"] <= 0.02


def test_saved_lists_answer_alike(spark, built, tmp_path):
    df, index = built
    index.save(str(tmp_path / "ivf"))
    loaded = A.IvfIndex.load(spark, str(tmp_path / "ivf"))
    assert rows(A.ivf_search(loaded, asked(df), 5, 3)) == rows(A.ivf_search(index, asked(df), 5, 3))
    assert len(list((tmp_path / "ivf" / "rows").glob("list=*"))) == (index.sizes > 0).sum()
    assert index.sizes.sum() == 900


def test_a_query_gets_k_rows_wherever_there_are_k(spark):
    x = [[1.0, 0.01 * i] for i in range(3)] + [[-1.0, 0.01 * i] for i in range(40)]
    df = table(spark, x)
    found = rows(A.ivf_search(A.build_ivf(df, 2, lists=2), df.where("doc_id = 0").select(F.col("doc_id").alias("query_id"), "embedding"), 10, 1))
    assert len(found) == 10 and [r[2] for r in found][:3] == [0, 1, 2]


def test_copies_ties_and_vectors_that_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_BLOCK", 16)
    x = clustered(100, 4) + [[1.0, 2.0, 3.0, 4.0]] * 150 + [[0.0] * 4, [float("nan"), 1.0, 1.0, 1.0], [1.0, 2.0], [float("inf")] * 4]
    df = spark.createDataFrame([*enumerate(x), (500, None)], "doc_id long, embedding array<float>")
    index = A.build_ivf(df, 4)
    assert index.sizes.sum() == 250
    queries = df.where("doc_id in (5, 110, 250, 251, 252, 500)").select(F.col("doc_id").alias("query_id"), "embedding")
    ok = df.where("doc_id < 250")
    assert rows(A.ivf_search(index, queries, 12, 100, 0)) == rows(vector_search(ok, queries.where("query_id < 250"), 12))
    assert [r[2] for r in rows(A.ivf_search(index, queries, 12, 100)) if r[0] == 110] == list(range(100, 112))


def test_empty_tables_and_wrong_arguments(spark, built):
    df, index = built
    empty = A.build_ivf(df.where("false"), 16)
    assert A.ivf_search(empty, asked(df), 5).count() == 0 and A.ivf_search(index, asked(df).where("false"), 5).count() == 0
    for bad in ({"k": 0}, {"probes": 0}, {"refine": -1}):
        with pytest.raises(ValueError):
            A.ivf_search(index, asked(df), **bad)
    with pytest.raises(ValueError):
        A.build_ivf(df, 0)


def test_probing_holds_few_vectors():
    """2,000 queries that probe all of 500 lists: their vectors repeated for each list would be 256 MB."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from whinstone.operators.ann import _probe

    n, dim = 2_000, 32
    x = np.random.default_rng(1).normal(size=(n, dim))
    lists = pa.ListArray.from_arrays(np.arange(0, n * dim + 1, dim, dtype=np.int32), pa.array(x.ravel()))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), lists], names=["query_id", "embedding"])
    run, before, most = _probe(x[:500], np.ones(500, np.int64), 500, 1), pa.total_allocated_bytes(), 0
    rows = 0
    for b in run(iter([batch])):
        rows, most = rows + b.num_rows, max(most, pa.total_allocated_bytes() - before)
    assert rows == n * 500 and most < 64e6
