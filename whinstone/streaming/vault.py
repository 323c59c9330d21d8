"""A vault that is watched: every micro-batch of changed notes goes through the same incremental synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from whinstone.functions.notes import parse_notes
from whinstone.operators.chunking import chunk_notes
from whinstone.operators.embedding import Embedder
from whinstone.operators.sync import NoteVersions, SnapshotTable, sync_chunks, upsert


def watch(notes: DataFrame, table: SnapshotTable | NoteVersions, embedder: Embedder, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Keeps the table at the state of a stream of notes (path, raw; a later row of a path replaces the earlier one, null raw deletes).

    Within a micro-batch the last row of each path counts. In NoteVersions a batch reads and writes its own notes only; in a
    SnapshotTable the chunks of untouched notes are handed on as they are. Either way nothing of them is embedded.
    """

    def step(batch: DataFrame, _: int) -> None:
        last = batch.groupBy("path").agg(F.max_by("raw", "at").alias("raw"))
        fresh = chunk_notes(parse_notes(last.where("raw is not null")))
        if isinstance(table, NoteVersions):
            sync_chunks(table, fresh, embedder, within=last.select(F.col("path").alias("note_path")))
            return
        now = table.read().drop("embedding", "updated_at")
        kept = now.join(last.select(F.col("path").alias("note_path")), "note_path", "left_anti")
        sync_chunks(table, upsert(kept.select(*fresh.columns), fresh), embedder)

    return notes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
