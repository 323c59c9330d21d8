import hashlib
import logging

import pytest
from pyspark.sql import functions as F

from jobs import sync_chunks as J
from jobs.common import configured
from whinstone.operators.chunking import chunk_notes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, version long"
SETTINGS = J.Settings(embedder="md5", dim=16, max_chars=60, overlap=10, version="version")


def body(i, n=6, word="word"):
    return "\n\n".join(f"# Part {p}\n{word} {i} of part {p}, some text that is long enough" for p in range(n))


def put(spark, folder, rows):
    """One more file in the folder of notes."""
    rows = [(i, t, "en", f"note {i}", 0, v) for i, t, v in rows]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def state(spark, target):
    rows = J.current(spark, target).select("note_path", "id", "text", "title", "lang", "embedding").collect()
    return sorted((r["note_path"], r["id"], r["text"], r["title"], r["lang"], tuple(r["embedding"])) for r in rows)


def expected(spark, notes):
    df = spark.createDataFrame([(str(i), f"note {i}", t) for i, t in notes.items()], "path string, title string, body string")
    chunks = chunk_notes(df, 60, 10).collect()
    return sorted((r["note_path"], r["id"], r["text"], r["title"]) for r in chunks)


def test_two_runs_over_growing_input(spark, tmp_path, caplog):
    notes, target = str(tmp_path / "notes"), str(tmp_path / "target")
    caplog.set_level(logging.INFO, "jobs")
    put(spark, notes, [(i, body(i), 1) for i in range(20)])
    (first,) = J.sync_chunks(spark, notes, target, SETTINGS)
    want = {i: body(i) for i in range(20)}
    assert (first["read"], first["new"], first["changed"], first["deleted"]) == (20, 20, 0, 0)
    assert first["chunks"] == first["embedded"] == len(expected(spark, want))
    assert [r[:4] for r in state(spark, target)] == expected(spark, want)

    # nothing new: nothing is read, and no file changes
    before = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "target").rglob("*.parquet"))
    assert J.sync_chunks(spark, notes, target, SETTINGS) == []
    assert before == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "target").rglob("*.parquet"))

    # a new file: one note as it was, one changed in one part, one deleted, two new ones
    changed = body(3).replace("3 of part 2", "three of part 2")
    put(spark, notes, [(1, body(1), 2), (3, changed, 2), (5, None, 2), (20, body(20), 1), (21, "", 1)])
    (second,) = J.sync_chunks(spark, notes, target, SETTINGS)
    assert (second["batch"], second["read"], second["new"], second["changed"], second["deleted"]) == (1, 5, 2, 1, 1)
    want |= {3: changed, 20: body(20)}
    want.pop(5)
    assert [r[:4] for r in state(spark, target)] == expected(spark, want)
    # of the changed note only what stands elsewhere or says something else is embedded again
    kept = {r[1:3] for r in expected(spark, {3: body(3)})}
    now = {r[1:3] for r in expected(spark, {3: changed, 20: body(20)})}
    assert second["embedded"] == len(now - kept) < second["chunks"] == len(now)
    assert "batch 1 read 5 rows; 2 new, 1 changed, 1 deleted notes" in caplog.text

    # it comes back
    put(spark, notes, [(5, body(5), 3)])
    (third,) = J.sync_chunks(spark, notes, target, SETTINGS)
    assert third["new"] == 1 and any(r[0] == "5" for r in state(spark, target))


def test_a_batch_that_broke_off_gives_the_same_rows_again(spark, tmp_path):
    notes, target = str(tmp_path / "notes"), str(tmp_path / "target")
    put(spark, notes, [(i, body(i), 1) for i in range(6)])
    J.sync_chunks(spark, notes, target, SETTINGS)
    put(spark, notes, [(i, body(i, 3, "other"), 2) for i in range(4, 9)])
    J.sync_chunks(spark, notes, target, SETTINGS)
    want = state(spark, target)
    again = spark.read.parquet(notes).where("version = 2")
    for _ in range(2):  # the same batch, after its chunks or all of it had been written
        J.apply_batch(spark, again, 1, target, SETTINGS)
        assert state(spark, target) == want


def test_several_versions_in_a_batch_and_several_batches(spark, tmp_path):
    notes, target = str(tmp_path / "notes"), str(tmp_path / "target")
    put(spark, notes, [(1, body(1), 1), (1, body(1, 2), 3), (1, body(1, 4), 2), (1, body(1, 2), 3), (2, body(2), None), (None, body(9), 1)])
    put(spark, notes, [(1, body(1, 5), 2), (2, body(2, 1), None)])
    settings = J.Settings(embedder="md5", dim=16, max_chars=60, overlap=10, version="version", files_per_batch=1)
    done = J.sync_chunks(spark, notes, target, settings)
    assert len(done) == 2 and sum(d["read"] for d in done) == 8
    # version 2 of note 1 never replaces version 3, in whichever batch it comes; of note 2 both came without a version
    found = [r[:4] for r in state(spark, target) if r[0] == "1"]
    assert found == expected(spark, {1: body(1, 2)})


def test_vectors_are_those_of_the_chunks(spark, tmp_path):
    notes, target = str(tmp_path / "notes"), str(tmp_path / "target")
    put(spark, notes, [(1, body(1), 1)])
    J.sync_chunks(spark, notes, target, SETTINGS)
    rows = J.current(spark, target).withColumn("whole", F.concat("title", F.lit("\n"), F.array_join("heading_path", " > "), F.lit("\n\n"), "text"))
    for r in rows.collect():
        v = [0.0] * 16
        import re

        for t in re.findall(r"[a-z0-9]+(?:[._'-][a-z0-9]+)*", r["whole"].lower()):
            h = int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
            v[h % 16] += 1 if h >> 31 else -1
        norm = sum(x * x for x in v) ** 0.5
        assert r["embedding"] == pytest.approx([x / norm for x in v], abs=1e-6)


def test_empty_input_and_wrong_settings(spark, tmp_path):
    notes, target = str(tmp_path / "notes"), str(tmp_path / "target")
    put(spark, notes, [])
    J.sync_chunks(spark, notes, target, SETTINGS)
    put(spark, notes, [(1, body(1), 1)])
    J.sync_chunks(spark, notes, target, SETTINGS)
    assert [r[:4] for r in state(spark, target)] == expected(spark, {1: body(1)})
    with pytest.raises(ValueError, match="embedder"):
        J.sync_chunks(spark, notes, target, J.Settings(embedder="none"))
    config = tmp_path / "c.json"
    config.write_text('{"dim": 8, "files": 3}')
    with pytest.raises(ValueError, match="files"):
        configured(J.Settings, str(config))
    config.write_text('{"dim": 8}')
    assert configured(J.Settings, str(config)) == J.Settings(dim=8)
