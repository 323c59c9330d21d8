import pytest

from whinstone.engine import Engine, Settings
from whinstone.operators.chunking import chunk_or_fail, chunk_spans
from whinstone.operators.evaluation import time_figures
from whinstone.sources.files import read_eval_set


def test_settings_from_a_file_and_the_environment(tmp_path, monkeypatch):
    env = tmp_path / ".env"
    env.write_text('﻿# settings\n\nWHINSTONE_VAULT="my notes"\nexport WHINSTONE_EMBED_DIM=16\nWHINSTONE_RRF_K = 30.5\nOTHER=1\nWHINSTONE_TOP_K=3\n')
    monkeypatch.setenv("WHINSTONE_TOP_K", "7")
    got = Settings.from_environment(str(env))
    assert (got.vault, got.embed_dim, got.rrf_k, got.top_k, got.embed_batch) == ("my notes", 16, 30.5, 7, 64)
    monkeypatch.delenv("WHINSTONE_TOP_K")
    assert Settings.from_environment(str(tmp_path / "none")) == Settings()
    with pytest.raises(ValueError, match="table_layout"):
        _ = Engine(None, Settings(table_layout="other")).table


def test_a_note_that_breaks_the_chunker_is_a_failure(spark):
    notes = spark.createDataFrame([("a", "A", "fine"), ("b", "B", "boom"), ("c", "C", "also fine"), ("d", "D", None)], "path string, title string, body string")

    def spans(body, most, overlap):
        if body == "boom":
            raise RuntimeError("broken note")
        return chunk_spans(body, most, overlap)

    chunks, failures = chunk_or_fail(notes, spans=spans)
    assert sorted((r["note_path"], r["text"]) for r in chunks.collect()) == [("a", "fine"), ("c", "also fine")]
    assert [tuple(r) for r in failures.collect()] == [("b", "RuntimeError: broken note")]


def test_time_figures():
    runs = [[1.0, 2.0, 3.0, 4.0], [10.0, 20.0, 30.0, 40.0], [5.0, 5.0, 5.0, 6.0]]
    assert time_figures(runs) == {"p50 median": 5.0, "p50 min": 2.0, "p50 max": 20.0, "p95 median": 6.0, "p95 min": 4.0, "p95 max": 40.0}


def test_single_queries_are_timed_and_sets_without_answers_refused(spark, tmp_path):
    vault = tmp_path / "vault"
    vault.mkdir()
    for i in range(4):
        (vault / f"n{i}.md").write_text(f"# Note {i}\nwords about subject{i} here")
    engine = Engine(spark, Settings(vault=str(vault), table=f"file://{tmp_path}/t", embed_dim=16))
    assert engine.ingest().files_scanned == 4
    path = tmp_path / "set.jsonl"
    path.write_text('{"id": "1", "question": "subject1", "relevant_notes": ["n1.md"]}\n{"id": "2", "question": "subject2", "relevant_notes": ["n2.md"]}\n')
    rows = {r["metric"]: r["value"] for r in engine.latency(read_eval_set(spark, str(path)), ["keyword"], repeats=2, queries=2).collect()}
    assert set(rows) == {f"ms of a query p{p} {n}" for p in (50, 95) for n in ("median", "min", "max")}
    assert 0 < rows["ms of a query p50 min"] <= rows["ms of a query p50 median"] <= rows["ms of a query p50 max"]
    assert engine.search(["subject3"], mode="keyword").first()["note_path"] == "n3.md"
    path.write_text('{"id": "1", "question": "q", "relevant_notes": []}\n')
    with pytest.raises(ValueError, match="answer"):
        engine.evaluation(read_eval_set(spark, str(path)), ["keyword"])
