"""A corpus cleaned and packed: five stages, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whinstone.llm.common import cut
from whinstone.llm.decontamination import decontaminate
from whinstone.llm.line_dedup import drop_duplicate_lines
from whinstone.llm.near_copies import drop_near_copies
from whinstone.llm.packing import pack_documents
from whinstone.llm.quality import keep_sample
from whinstone.llm.simhash import drop_near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps, a sample as large as the good part of the corpus: ties with the last one stay, too.

    All stages but the last return rows as they came, with all columns, whatever their names; nulls in other columns don't matter,
    repeated rows are judged alike and stay or go together, texts of any length are read whole, and no rows give no rows. Here a null
    text counts as one without words, and both weigh as their neutral n-grams do."""
    return keep_sample(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated lines; documents that consisted of nothing else go. n_chars follows the text.

    Of a line's occurrences that of the smallest doc_id stays; texts without words, and null ones, have no lines and stay as they are.
    Repeated rows (same id and text) are one document."""
    kept = drop_duplicate_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by op9's SimHash first: fingerprints of at most three differing bits. Of what that
    leaves, documents whose five-word shingles have a similarity of 0.8 or more follow: MinHash bands find them, and they are verified."""
    return drop_near_copies(drop_near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark. Null and empty texts hold none and stay; null and empty items fit nothing."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in sequences of at most 1024. A null or empty text is one id, the closing one, and
    repeated rows are packed each by itself."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: SQL has no n-gram models, SimHash, edit matching or tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
