"""What keeps searches and jobs from growing faster than their tables."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from whinstone.operators import evalset
from whinstone.operators.embedding import Md5Embedder, _hash_vectors
from whinstone.operators.index import build_index, overlap_search
from whinstone.operators.vectors import l2_normalise

TEXTS = ["the red fox runs", "the the dog", "", None, "会话持久化 red Fox", "a fox, a dog and the red hen", "dog"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def test_texts_are_tokenized_once(spark):
    """Spark infers a filter on the size of what a plain explode takes apart, which tokenizes again."""
    assert "Filter ((size(" not in plan(build_index(docs(spark)).postings)
    assert "Filter ((size(" not in plan(evalset.note_tokens(docs(spark).withColumnRenamed("doc_id", "note")))


def test_terms_are_cut_before_documents_are_removed(spark):
    """Behind the removal, Spark doesn't move the cut below the counting of postings. Searches and narrowed indexes ask of_terms()."""
    whole, terms = docs(spark), spark.createDataFrame([("fox",), ("dog",)], "term string")
    gone, empty = whole.where("doc_id % 2 = 0"), whole.where("false")
    for index in (build_index(whole).remove(gone), build_index(whole).add(build_index(empty)).remove(gone)):
        found = index.of_terms(terms)
        steps = found._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= steps.index("Join LeftAnti") < steps.index("Join LeftSemi")
        for rows in (found, index.postings.where("term in ('fox', 'dog')"), index.narrowed(terms).postings):
            assert sorted(map(tuple, rows.select("term", "doc_id", "tf", "dl").collect())) == [("dog", 1, 1, 3), ("dog", 5, 1, 8), ("fox", 5, 1, 8)]


def test_overlap_makes_no_row_a_pair(spark):
    asked = spark.createDataFrame([(1, "the red dog dog"), (2, "fox"), (3, "nothing here"), (None, "dog"), (4, "化 hen")], "query_id int, text string")
    found = overlap_search(build_index(docs(spark)), asked, 2)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect())
    assert got == [(1, 1, 5, 3.0), (1, 2, 0, 2.0), (2, 1, 0, 1.0), (2, 2, 4, 1.0), (4, 1, 4, 1.0), (4, 2, 5, 1.0)]
    questions = asked.select(F.col("query_id").alias("question_id"), F.col("text").alias("question"))
    assert "Join" not in plan(evalset.best_note_coverage(questions, docs(spark).withColumnRenamed("doc_id", "note"))).split("FlatMapGroupsInArrow")[1]


def test_md5_vectors_come_without_a_shuffle(spark):
    texts = docs(spark).withColumnRenamed("doc_id", "id")
    embedder = Md5Embedder(16)
    found = embedder.embed(texts)
    assert "Exchange" not in plan(found)
    sums = {}
    for r in embedder.features(texts).collect():
        sums.setdefault(r["id"], [0.0] * 16)[r["place"]] = float(r["value"])
    want = spark.createDataFrame([(i, sums.get(i, [0.0] * 16)) for i in range(len(TEXTS))], "id long, v array<double>")
    want = {r["id"]: r["u"] for r in want.select("id", l2_normalise("v").alias("u")).collect()}
    assert {r["id"]: r["embedding"] for r in found.collect()} == want


def test_hashing_holds_few_tokens():
    """3,000 texts of 500 tokens as Python strings would be some 100 MB."""
    words = pa.array([f"word{i % 5000}" for i in range(1_500_000)])
    tokens = pa.ListArray.from_arrays(np.arange(0, 1_500_001, 500, dtype=np.int32), words)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(3000)), tokens], names=["id", "tokens"])
    tracemalloc.start()
    sizes = [b.num_rows for b in _hash_vectors(64)(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 3000 and peak < 40e6


def test_annotations_are_worked_out_once(spark, tmp_path):
    """Numbering reads its rows several times: those are a table by then."""
    from jobs import compile_eval_set as job

    sf = "/root/testdata/sf0.001"
    done = job.compile_eval_set(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", str(tmp_path))
    found = spark.read.parquet(f"{tmp_path}/annotated")
    assert found.count() == job.read_questions(spark, str(tmp_path)).count() == done["kept"]
    assert "documents.parquet" not in plan(job.numbered(found))


def test_candidates_are_gated_once_against_their_own_notes(spark):
    """Placing reads its rows several times, and notes that no candidate names need no squeezing and no shuffle."""
    from whinstone.plans.catalogue import QUERIES

    sf = "/root/testdata/sf0.001"
    found = QUERIES["numbered_dataset"](spark, sf)
    assert "documents.parquet" not in plan(found)
    assert [r["id"] for r in found.orderBy("id").collect()] == [f"q{i:04}" for i in range(1, found.count() + 1)]
    steps = QUERIES["candidate_gate"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in steps[steps.index("Aggregate [note") :]
