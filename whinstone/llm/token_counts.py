"""Token counts through a digest cache: only distinct texts that the cache lacks are encoded, and then appended to it."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import cut, forget_at_exit, pick, shared_dir
from whinstone.llm.tokens import count_tokens, version

CACHE = "digest binary, tokenizer string, n_tokens long"


def _encode(tokenizer: str, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = count_tokens(tokenizer, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("digest"), pa.array([key] * len(counts)), pa.array(counts, pa.int64())],
                names=["digest", "tokenizer", "n_tokens"],
            )

    return run


def _read_cache(spark, path: str) -> DataFrame | None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.schema(CACHE).parquet(path)


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", cache: str | None = None, limit: int = 1024
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as an empty one (0 bytes, 0 tokens); repeated rows stay repeated; an empty table gives an empty result.
    The cache is a Parquet table of (content digest, tokenizer digest, count): a byte-level tokenizer has no normalizer, so the
    normalised content is the text itself. Equal texts meet in a map-side aggregation before the shuffle, so a hot group of copies
    costs one row a task. Without a cache path the counts go to a new table in the shared folder.
    """
    spark = docs.sparkSession
    key = version(tokenizer)
    unnamed = cache is None
    cache = cache or f"{shared_dir(spark)}/whinstone-token-counts-{uuid.uuid4().hex}"
    base = pick(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    narrow = cut(base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "digests")
    misses = base.select("digest", "text").groupBy("digest").agg(F.first("text").alias("text"))
    if (known := _read_cache(spark, cache)) is not None:
        misses = misses.join(known.where(F.col("tokenizer") == key).select("digest").distinct(), "digest", "left_anti")
    misses.mapInArrow(_encode(tokenizer, key), CACHE).write.mode("append").parquet(cache)
    if unnamed:
        forget_at_exit(spark, cache)
    counts = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == key)
    # two writers may have appended the same digest: one row of it counts
    counts = cut(counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "counts")  # AQE can then split a hot digest
    return narrow.join(counts, "digest", "left").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
