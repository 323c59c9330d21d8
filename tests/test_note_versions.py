import pytest

from whinstone.functions.notes import parse_notes
from whinstone.operators import sync as S
from whinstone.operators.chunking import chunk_notes
from whinstone.operators.embedding import HashingEmbedder


class Counting(HashingEmbedder):
    """Remembers how many texts it was given."""

    def __init__(self, dim=8):
        super().__init__(dim)
        self.given = []

    def embed(self, texts):
        self.given.append(texts.count())
        return super().embed(texts)


def chunks(spark, notes):
    rows = [(f"{k}.md", "\n".join(f"# {h}\n{t}" for h, t in v.items())) for k, v in notes.items()]
    return chunk_notes(parse_notes(spark.createDataFrame(rows, "path string, raw string")))


def state(table):
    return sorted((r["note_path"], r["heading_path"][0], r["text"]) for r in table.read().collect())


def want(notes):
    return sorted((f"{k}.md", h, t) for k, v in notes.items() for h, t in v.items())


NOTES = {f"n{i}": {"A": f"text {i}", "B": f"more {i}"} for i in range(30)}


def test_a_sync_writes_the_notes_that_changed(spark, tmp_path):
    table, embedder = S.NoteVersions(spark, f"file://{tmp_path}/t"), Counting()
    assert not table.exists() and state(table) == []
    stats = S.sync_chunks(table, chunks(spark, NOTES), embedder)
    assert (stats.chunks_new, stats.embeddings_computed) == (60, 60) and state(table) == want(NOTES)

    # nothing changed: nothing is written or embedded
    files = sorted((tmp_path / "t").rglob("*.parquet"))
    stats = S.sync_chunks(table, chunks(spark, NOTES), embedder)
    assert (stats.chunks_unchanged, stats.embeddings_computed) == (60, 0) and embedder.given == [60]
    assert files == sorted((tmp_path / "t").rglob("*.parquet"))

    # one part of one note: that note is written, that part embedded, the other one's vector and time kept
    before = {r["id"]: (r["embedding"], r["updated_at"]) for r in table.read().where("note_path = 'n3.md'").collect()}
    now = NOTES | {"n3": {"A": "text 3", "B": "other"}}
    stats = S.sync_chunks(table, chunks(spark, now), embedder)
    assert (stats.chunks_changed, stats.chunks_unchanged, stats.embeddings_computed) == (1, 59, 1)
    batches = sorted((tmp_path / "t" / "chunks").glob("batch=*"))
    assert len(batches) == 2 and spark.read.parquet(str(batches[1])).count() == 2
    after = {r["id"]: (r["embedding"], r["updated_at"], r["text"]) for r in table.read().where("note_path = 'n3.md'").collect()}
    assert [after[i][:2] == before[i] for i in after if after[i][2] == "text 3"] == [True] and state(table) == want(now)

    # a note goes, and another loses a part
    now = {k: v for k, v in now.items() if k != "n7"} | {"n8": {"A": "text 8"}}
    stats = S.sync_chunks(table, chunks(spark, now), embedder)
    assert (stats.chunks_deleted, stats.embeddings_computed) == (3, 0) and state(table) == want(now)

    # compacted, it is one batch with the same chunks, and goes on from there
    table.compact()
    assert len(list((tmp_path / "t" / "chunks").glob("batch=*"))) == 1 and state(table) == want(now)
    now |= {"new": {"A": "x"}}
    assert S.sync_chunks(table, chunks(spark, now), embedder).chunks_new == 1 and state(table) == want(now)


def test_full_and_purge(spark, tmp_path):
    table, embedder = S.NoteVersions(spark, f"file://{tmp_path}/t"), Counting()
    S.sync_chunks(table, chunks(spark, NOTES), embedder)
    fewer = {k: v for k, v in NOTES.items() if k < "n2"}
    stats = S.sync_chunks(table, chunks(spark, fewer), embedder, full=True)
    assert stats.embeddings_computed == 2 * len(fewer) and stats.chunks_deleted == 0 and state(table) == want(NOTES)
    stats = S.sync_chunks(table, chunks(spark, fewer), embedder, full=True, purge=True)
    assert stats.chunks_deleted == 60 - 2 * len(fewer) and state(table) == want(fewer)


def test_two_writers_keep_each_others_notes(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    S.sync_chunks(S.NoteVersions(spark, path), chunks(spark, NOTES), Counting())
    one, two = {"n1": {"A": "one"}}, {"n2": {"A": "two"}}
    only = lambda k: spark.createDataFrame([(f"{k}.md",)], "note_path string")
    # the second writer has read the table before the first one writes
    slow = S.NoteVersions(spark, path)
    seen = slow.read(only("n2"))
    S.sync_chunks(S.NoteVersions(spark, path), chunks(spark, one), Counting(), within=only("n1"))
    slow.read = lambda within=None: seen
    S.sync_chunks(slow, chunks(spark, two), Counting(), within=only("n2"))
    assert state(S.NoteVersions(spark, path)) == want(NOTES | one | two)


def test_within_leaves_other_notes_and_deletes_emptied_ones(spark, tmp_path):
    table = S.NoteVersions(spark, f"file://{tmp_path}/t")
    S.sync_chunks(table, chunks(spark, NOTES), Counting())
    some = spark.createDataFrame([("n1.md",), ("n2.md",), ("n99.md",)], "note_path string")
    stats = S.sync_chunks(table, chunks(spark, {"n1": {"A": "text 1", "C": "third"}}), Counting(), within=some)
    assert (stats.chunks_new, stats.chunks_unchanged, stats.chunks_deleted) == (1, 1, 3)
    assert state(table) == want({k: v for k, v in NOTES.items() if k not in ("n1", "n2")} | {"n1": {"A": "text 1", "C": "third"}})
    with pytest.raises(ValueError, match="NoteVersions"):
        S.sync_chunks(S.SnapshotTable(spark, f"file://{tmp_path}/s", S.CHUNK_TABLE), chunks(spark, NOTES), Counting(), within=some)


def test_chunks_without_their_notes_are_not_there_yet(spark, tmp_path):
    table = S.NoteVersions(spark, f"file://{tmp_path}/t")
    S.sync_chunks(table, chunks(spark, NOTES), Counting())
    stray = table.read().where("note_path = 'n5.md'").collect()
    spark.createDataFrame(stray, table.read().schema).selectExpr("*", "9000000000000000000L as batch").write.mode("append").partitionBy("batch").parquet(f"{tmp_path}/t/chunks")
    assert state(table) == want(NOTES)
