"""Keep a table of embedded chunks up to date with a growing folder of notes.

    python -m jobs.sync_chunks NOTES TARGET [--config jobs/sync_chunks.json]

NOTES is a folder of Parquet files that gets new files (a pattern or a single file will do too): notes with an id, a title, a language and a text. Each run reads the files that
came since the last one (a file stream whose checkpoint is in TARGET), in micro-batches of a bounded number of files. Notes whose content
hash is known are skipped; new and changed ones are cut into chunks by headings, and of their chunks only those that weren't there
before, under the same title, are embedded. A note that comes again without a text is deleted.

TARGET/chunks is partitioned by batch and lang, TARGET/notes by batch: one row for each version of a note. A batch writes its chunks
first and its notes last, and replaces its own partitions only; so a batch that broke off and runs again gives the same rows, and
chunks whose note isn't listed are not yet there for a reader. current() has the latest version of every note. A run without new files
changes nothing. The checkpoint belongs to the target: don't delete one without the other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, log, replace_partitions
from whinstone.operators.chunking import chunk_notes, embed_text
from whinstone.operators.embedding import Embedder, HashingEmbedder, Md5Embedder

NOTES = "note_path string, version long, title string, sha string, status string, n_chunks long, n_embedded long, batch long"
CHUNKS = (
    "id string, note_path string, title string, heading_path array<string>, text string, char_start int, char_end int, content_hash string,"
    " embedding array<float>, embedded boolean, batch long, lang string"
)
EMBEDDERS = {"hashing": HashingEmbedder, "md5": Md5Embedder}


@dataclass
class Settings:
    """id, title, lang, text: names of the notes' columns. version: a column that orders versions of a note within a batch (none: the
    text's hash does). max_chars, overlap: of chunks. embedder and dim: what embeds. files_per_batch bounds a micro-batch."""

    id: str = "doc_id"
    title: str = "source"
    lang: str = "lang"
    text: str = "text"
    version: str | None = None
    max_chars: int = 1200
    overlap: int = 150
    embedder: str = "hashing"
    dim: int = 384
    files_per_batch: int = 1000


def notes_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(NOTES).parquet(f"{target}/notes")


def chunks_table(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(CHUNKS).parquet(f"{target}/chunks")


def current(spark: SparkSession, target: str) -> DataFrame:
    """The chunks of every note's latest version; none of a deleted note."""
    latest = notes_table(spark, target).groupBy("note_path").agg(F.max("batch").alias("batch"))
    return chunks_table(spark, target).join(latest, ["note_path", "batch"], "left_semi")


def _incoming(batch: DataFrame, s: Settings) -> DataFrame:
    """One row for each note of a batch: of several versions the latest. Rows without an id are left out."""
    version = F.col(f"`{s.version}`").cast("long") if s.version else F.lit(None).cast("long")
    rows = batch.select(
        F.col(f"`{s.id}`").cast("string").alias("path"),
        version.alias("version"),
        F.coalesce(F.col(f"`{s.title}`").cast("string"), F.lit("")).alias("title"),
        F.col(f"`{s.lang}`").cast("string").alias("lang"),
        F.col(f"`{s.text}`").cast("string").alias("body"),
    ).where("path is not null")
    rows = rows.withColumn("sha", F.sha1(F.to_json(F.struct("title", "lang", "body"))))
    # a version is limited to its first row before it is shuffled, so a note that comes very often is no hot key
    order = Window.partitionBy("path").orderBy(F.desc_nulls_last("version"), F.desc("sha"))
    return rows.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def _changes(spark: SparkSession, rows: DataFrame, target: str, batch_id: int) -> DataFrame:
    """rows with status new, changed or deleted; unchanged ones, and older versions than the known one, are gone."""
    if batch_id:
        known = notes_table(spark, target).where(F.col("batch") < batch_id)
        known = known.groupBy(F.col("note_path").alias("path")).agg(F.max_by(F.struct("sha", "status", "version"), "batch").alias("k"))
        rows = rows.join(known, "path", "left").where("k is null or k.version is null or version is null or version >= k.version")
    else:
        rows = rows.withColumn("k", F.lit(None).cast("struct<sha:string,status:string,version:long>"))
    there = F.col("k").isNotNull() & (F.col("k.status") != "deleted")
    status = F.when(F.col("body").isNull(), F.when(there, "deleted")).when(~there, "new").when(F.col("k.sha") != F.col("sha"), "changed")
    return rows.withColumn("status", status).where("status is not null").drop("k")


def _with_vectors(fresh: DataFrame, old: DataFrame | None, embedder: Embedder) -> DataFrame:
    """Chunks with embedding, and embedded: whether it was worked out now or was there under the same id, title and content."""
    key = ["id", "title", "content_hash"]
    todo = fresh if old is None else fresh.join(old.select(*key), key, "left_anti")
    vectors = embedder.embed(todo.select("id", embed_text().alias("text"))).select("id", F.col("embedding").cast("array<float>").alias("embedding"))
    done = todo.join(vectors, "id").withColumn("embedded", F.lit(True))
    if old is None:
        return done
    return done.unionByName(fresh.join(old.select(*key, "embedding"), key).withColumn("embedded", F.lit(False)).select(*done.columns))


def apply_batch(spark: SparkSession, batch: DataFrame, batch_id: int, target: str, s: Settings) -> dict:
    """Bring one micro-batch into the target; what was done, in numbers."""
    changes = _changes(spark, _incoming(batch, s), target, batch_id)
    fresh = chunk_notes(changes.where("status <> 'deleted'"), s.max_chars, s.overlap, carry=("lang",))
    old = None
    if batch_id:
        before = notes_table(spark, target).where(F.col("batch") < batch_id).groupBy("note_path").agg(F.max("batch").alias("batch"))
        before = before.join(changes.select(F.col("path").alias("note_path")), "note_path", "left_semi")
        old = chunks_table(spark, target).join(before, ["note_path", "batch"], "left_semi")
    chunks = _with_vectors(fresh, old, EMBEDDERS[s.embedder](s.dim)).withColumn("batch", F.lit(batch_id).cast("long"))
    replace_partitions(chunks, f"{target}/chunks", "batch", "lang")

    written = chunks_table(spark, target).where(F.col("batch") == batch_id).groupBy(F.col("note_path").alias("path"))
    written = written.agg(F.count("*").alias("n_chunks"), F.count_if("embedded").alias("n_embedded"))
    notes = changes.select("path", "version", "title", "sha", "status").join(written, "path", "left")
    notes = notes.select(
        F.col("path").alias("note_path"), "version", "title", "sha", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.coalesce("n_embedded", F.lit(0)).alias("n_embedded"), F.lit(batch_id).cast("long").alias("batch"),
    )
    replace_partitions(notes, f"{target}/notes", "batch")

    done = notes_table(spark, target).where(F.col("batch") == batch_id)
    counts = [F.count_if(F.col("status") == x).alias(x) for x in ("new", "changed", "deleted")]
    row = done.agg(*counts, F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("n_embedded"), F.lit(0)).alias("embedded")).first()
    return {"batch": batch_id, "read": batch.count(), **row.asDict()}


def _pattern(path: str) -> str:
    """The path as a pattern that only it matches: a file stream takes folders and patterns, but no plain path of a single file."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def sync_chunks(spark: SparkSession, notes: str, target: str, settings: Settings | None = None) -> list[dict]:
    """Take in what is new under `notes`; one dict of numbers for each micro-batch, an empty list where nothing is new."""
    s = settings or Settings()
    if s.embedder not in EMBEDDERS:
        raise ValueError(f"embedder must be one of {sorted(EMBEDDERS)}")
    done: list[dict] = []

    def take(batch: DataFrame, batch_id: int) -> None:
        done.append(apply_batch(batch.sparkSession, batch, batch_id, target, s))
        log.info("sync_chunks: batch %(batch)d read %(read)d rows; %(new)d new, %(changed)d changed, %(deleted)d deleted notes; %(chunks)d chunks, %(embedded)d embedded", done[-1])

    log.info("sync_chunks: %s into %s", notes, target)
    schema = spark.read.parquet(notes).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", s.files_per_batch).parquet(_pattern(notes))
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{target}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("sync_chunks: %d batches", len(done))
    return done


if __name__ == "__main__":
    command_line(Settings, sync_chunks, "notes", "target", description=__doc__)
