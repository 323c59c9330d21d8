"""Incremental synchronisation by content hash, over versioned snapshots of a table."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whinstone.operators.chunking import embed_text
from whinstone.operators.embedding import Embedder


def diff(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """id, status (new, changed, unchanged, stale) by comparing (id, content_hash) of both: one full outer join."""
    k = known.select("id", F.col("content_hash").alias("old_hash"))
    f = fresh.select("id", F.col("content_hash").alias("new_hash"))
    status = (
        F.when(F.col("old_hash").isNull(), "new")
        .when(F.col("new_hash").isNull(), "stale")
        .when(F.col("old_hash") == F.col("new_hash"), "unchanged")
        .otherwise("changed")
    )
    return k.join(f, "id", "full_outer").select("id", status.alias("status"))


def upsert(table: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """table with the rows of batch instead of those of the same key, or beside them."""
    return table.join(batch.select(key), key, "left_anti").unionByName(batch.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


class SnapshotTable:
    """A table as numbered Parquet snapshots. A snapshot counts once its marker is there, a file that is made in one step after all
    data; readers take the newest one, so they see a whole table at any moment, and a write that fails leaves it as it was. The
    KEEP newest snapshots stay for readers that have begun. The embedding's length is fixed by the first write."""

    KEEP = 4

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def versions(self) -> list[str]:
        """Snapshots that count, the oldest first: their names begin with the time."""
        fs, at = self._fs(f"{self.path}/CURRENT-*")
        return sorted(x.getPath().getName().removeprefix("CURRENT-") for x in (fs.globStatus(at) or ()))

    def current(self) -> str | None:
        return (self.versions() or [None])[-1]

    def exists(self) -> bool:
        return self.current() is not None

    def read(self) -> DataFrame:
        version = self.current()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def write(self, rows: DataFrame) -> None:
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.path}/{version}")
        fs, marker = self._fs(f"{self.path}/CURRENT-{version}")
        fs.create(marker, False).close()
        for old in self.versions()[: -self.KEEP]:
            fs.delete(self._fs(f"{self.path}/CURRENT-{old}")[1], False)
            fs.delete(self._fs(f"{self.path}/{old}")[1], True)


CHUNK_TABLE = (
    "id string, note_path string, title string, heading_path array<string>, text string, content_hash string, char_start int,"
    " char_end int, embedding array<float>, updated_at timestamp"
)


class NoteVersions:
    """A chunk table that only grows: each write adds the chunks of the notes that changed as one partition `batch` of path/chunks, and
    then those notes' names to path/notes. A note's chunks are those of its latest batch, so a write costs what changed, not what is
    there; a note is seen as it was or as it is, never in part; and writers of different notes don't disturb each other.

    compact() puts the current state into one batch and deletes what it replaces; it is for a time without readers and writers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str = ""):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema or CHUNK_TABLE

    def _table(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def exists(self) -> bool:
        return self._table("notes", "note_path string, batch long") is not None

    def read(self, within: DataFrame | None = None) -> DataFrame:
        """The current chunks; of the notes in `within` (note_path) only, where given."""
        notes, chunks = self._table("notes", "note_path string, batch long"), self._table("chunks", f"{self.schema}, batch long")
        if notes is None or chunks is None:
            return self.spark.createDataFrame([], self.schema)
        if within is not None:
            notes = notes.join(within.select("note_path").distinct(), "note_path", "left_semi")
        latest = notes.groupBy("note_path").agg(F.max("batch").alias("batch"))
        return chunks.join(latest, ["note_path", "batch"], "left_semi").select(*self.spark.createDataFrame([], self.schema).columns)

    def replace(self, notes: DataFrame, chunks: DataFrame) -> int:
        """From now on the notes (note_path) have these chunks, or none; the batch's number."""
        batch = time.time_ns()
        add = lambda rows, name: rows.withColumn("batch", F.lit(batch)).write.mode("append").partitionBy("batch").parquet(f"{self.path}/{name}")
        add(chunks, "chunks")
        add(notes.select("note_path").distinct(), "notes")
        return batch

    def compact(self) -> int:
        now = self.read()
        batch = self.replace(now.select("note_path"), now)
        jvm = self.spark.sparkContext._jvm
        for name in ("notes", "chunks"):  # names first: what they list is there until they are gone
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for x in fs.listStatus(at):
                found = x.getPath().getName().removeprefix("batch=")
                if found.isdigit() and int(found) < batch:
                    fs.delete(x.getPath(), True)
        return batch


@dataclass
class SyncStats:
    files_scanned: int = 0
    notes_failed: int = 0
    chunks_total: int = 0
    chunks_new: int = 0
    chunks_changed: int = 0
    chunks_unchanged: int = 0
    chunks_deleted: int = 0
    embeddings_computed: int = 0
    elapsed_s: float = 0.0
    failures: list[str] = field(default_factory=list)


def sync_chunks(
    table: SnapshotTable | NoteVersions, chunks: DataFrame, embedder: Embedder, full: bool = False, purge: bool | None = None,
    within: DataFrame | None = None,
) -> SyncStats:
    """Bring the table to the state of chunks; only new and changed chunks are embedded.

    full embeds all of them and, as nothing is then known, leaves stale rows unless purge says otherwise. In a SnapshotTable the new
    state is one snapshot, of which readers see all or none; in NoteVersions only notes with new, changed or stale chunks are written.
    within (note_path; NoteVersions only): chunks are all there is of these notes, and others are left as they are.
    """
    began, stats = time.time(), SyncStats()
    purge = not full if purge is None else purge
    versions = isinstance(table, NoteVersions)
    if within is not None and not versions:
        raise ValueError("part of the notes can be synchronised in NoteVersions only")
    now = table.read(within) if versions else table.read()
    have = now.select("embedding").where("embedding is not null").first()
    if have and len(have[0]) != embedder.dim:
        raise ValueError(f"the table's embeddings have {len(have[0])} numbers, the embedder gives {embedder.dim}")
    state = diff(now, chunks).cache()
    counts = {r["status"]: r["count"] for r in state.groupBy("status").count().collect()}
    stats.chunks_total = sum(counts.get(s, 0) for s in ("new", "changed", "unchanged"))
    if full:
        stats.chunks_new = stats.chunks_total
    else:
        stats.chunks_new, stats.chunks_changed = counts.get("new", 0), counts.get("changed", 0)
        stats.chunks_unchanged = counts.get("unchanged", 0)
    stats.chunks_deleted = counts.get("stale", 0) if purge else 0
    touched = state.where("status in ('new', 'changed')" + (" or status = 'unchanged'" if full else ""))
    work = chunks.join(touched.select("id"), "id", "left_semi")
    stats.embeddings_computed = stats.chunks_new + stats.chunks_changed
    if stats.embeddings_computed or stats.chunks_deleted or not table.exists():
        vectors = embedder.embed(work.select("id", embed_text().alias("text")))
        fresh = work.join(vectors, "id", "left").withColumn("updated_at", F.current_timestamp())
        kept = delete(now, state.where("status = 'stale'")) if purge else now
        if versions:
            noted = now.select("id", "note_path").unionByName(chunks.select("id", "note_path")).distinct()
            moved = state.where("status <> 'unchanged'" + (" or true" if full else "")).select("id")
            notes = noted.join(moved, "id", "left_semi").select("note_path").distinct()
            rows = upsert(kept, fresh.select(*now.columns)).join(notes, "note_path", "left_semi")
            table.replace(notes, rows.select(*now.columns))
        else:
            table.write(upsert(kept, fresh.select(*now.columns)))
    state.unpersist()
    stats.elapsed_s = time.time() - began
    return stats
