"""A fixed corpus from many files, and samples of it, written by Spark with a manifest and a fingerprint beside the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whinstone.operators import evalset as E


def corpus_manifest(files: DataFrame, least_bytes: int = 200, limit: int | None = None) -> DataFrame:
    """out, src, sha1, bytes, raw of the files (path, raw) that belong to the corpus: those of least_bytes or more, of equal contents the
    first by path, and of more than `limit` as many, spread evenly over the paths. Files without a text are left out."""
    rows = files.select(F.col("path").alias("src"), F.col("raw")).where("raw is not null").where(F.octet_length("raw") >= least_bytes)
    rows = E.first_of_content(rows, "src", "raw")
    rows = E.stride_uniform(rows, limit, "src") if limit else rows
    sha = F.sha1("raw")
    return rows.select(E.flat_name(F.col("src"), sha).alias("out"), "src", sha.alias("sha1"), F.octet_length("raw").alias("bytes"), "raw")


def save_corpus(files: DataFrame, folder: str, least_bytes: int = 200, limit: int | None = None) -> DataFrame:
    """Replace the corpus in `folder`: texts (Parquet: out, raw; partitioned by the first digit of the hash), manifest (JSON lines:
    out, src, sha1, bytes) and fingerprint (text: files=, bytes=, fingerprint= of the hashes in order). Gives the manifest read back.

    The texts are written first and everything after that is worked out from what was written, so the three belong together; a run that
    broke off is mended by the next.
    """
    rows = corpus_manifest(files, least_bytes, limit)
    rows.withColumn("part", F.substring("sha1", 1, 1)).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/texts")
    spark = files.sparkSession
    kept = spark.read.schema("out string, src string, sha1 string, bytes long, raw string, part string").parquet(f"{folder}/texts").drop("part")
    kept.drop("raw").write.mode("overwrite").json(f"{folder}/manifest")
    total = kept.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).crossJoin(F.broadcast(E.fingerprint(kept, "raw")))
    lines = F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in ("files", "bytes", "fingerprint")])
    total.select(F.explode(lines).alias("value")).write.mode("overwrite").text(f"{folder}/fingerprint")
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("out string, src string, sha1 string, bytes long").json(f"{folder}/manifest")


def sample_notes(
    files: DataFrame, count: int, lang: str | None = None, least_bytes: int = 1024, excluded: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(sample, manifest): every n-th of the files (name, size, text) of a language and size that are not excluded (name), `count` of
    them, by name; and one row that says from what they were taken. An error where too few are left."""
    pool = E.pool(files, lang, least_bytes)
    left = pool if excluded is None else pool.join(excluded.select("name").distinct(), "name", "left_anti")
    available = left.count()
    sample = E.stride_integer(left, count, "name")
    names = sample.select("name").orderBy("name").limit(3).agg(F.array_sort(F.collect_list("name")).alias("first_three"))
    about = files.agg(F.count("*").alias("corpus_files")).crossJoin(pool.agg(F.count("*").alias("pool_after_lang_and_size_filter")))
    about = about.crossJoin(E.sample_fingerprint(files).withColumnRenamed("fingerprint", "corpus_fingerprint_names_and_sizes")).crossJoin(names)
    given = {
        "lang": F.lit(lang or "any"), "count": F.lit(count), "excluded_names": F.lit(0 if excluded is None else excluded.select("name").distinct().count()),
        "available": F.lit(available), "stride": F.lit(max(1, available // max(1, count))), "min_bytes": F.lit(least_bytes),
    }
    return sample, about.withColumns(given)


def save_sample(sample: DataFrame, manifest: DataFrame, folder: str) -> None:
    """The sample's names as JSON lines in their order, and its manifest."""
    sample.select("name").orderBy("name").write.mode("overwrite").json(f"{folder}/names")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
