"""Readers: vaults of Markdown, evaluation sets, candidate questions, name lists; and the writers of reports and datasets."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Fixed values of the vault format.
SUFFIXES = (".md", ".markdown")
SKIPPED = (".obsidian", ".trash", ".git", "node_modules")
SKIPPED_ROOTS = (*SKIPPED, "__pycache__", ".venv", "dist", "build")
FILES_PER_PARTITION = 256


def vault_paths(root: str, hidden: bool = False, skipped: Sequence[str] = SKIPPED) -> list[str]:
    """Relative paths of Markdown files, sorted. Skipped folders and (unless hidden) those that begin with a dot go; files that begin
    with a dot are content."""
    found = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in skipped and (hidden or not d.startswith(".")))
        for name in names:
            if os.path.splitext(name)[1].lower() in SUFFIXES and name not in skipped:
                found.append(os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/"))
    return sorted(found)


@dataclass
class _Paths(InputPartition):
    root: str
    paths: list[str]


class VaultSource(DataSource):
    """spark.read.format("vault").load(folder): path, content, modified, size. Options: hidden, skipped (comma-separated).

    Spark's own file source drops names that begin with a dot or underscore, so this one lists files itself: names on the driver,
    contents on the executors.
    """

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, content binary, modified timestamp, size long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _VaultReader(dict(self.options))


class _VaultReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.hidden = options.get("hidden", "false").lower() == "true"
        self.skipped = tuple(s for s in options.get("skipped", ",".join(SKIPPED)).split(",") if s)

    def partitions(self) -> Sequence[InputPartition]:
        if not os.path.isdir(self.root):
            raise FileNotFoundError(f"there is no folder {self.root}")
        paths = vault_paths(self.root, self.hidden, self.skipped)
        return [_Paths(self.root, paths[i : i + FILES_PER_PARTITION]) for i in range(0, len(paths), FILES_PER_PARTITION)]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        import datetime

        for path in partition.paths:
            full = os.path.join(partition.root, path)
            try:
                with open(full, "rb") as f:
                    content = f.read()
                stat = os.stat(full)
                yield path, content, datetime.datetime.fromtimestamp(stat.st_mtime), stat.st_size
            except OSError:
                yield path, None, None, None


def read_vault(spark: SparkSession, root: str, hidden: bool = False, skipped: Sequence[str] = SKIPPED) -> DataFrame:
    """path, content, modified, size of a vault's files; content is null for a file that can't be read."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"there is no folder {root}")
    spark.dataSource.register(VaultSource)
    return spark.read.format("vault").option("hidden", str(hidden)).option("skipped", ",".join(skipped)).load(root)


def read_roots(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path (absolute), content, modified, size of Markdown files under several folders or files, each once; folders with a leading dot
    count, build folders don't."""
    out = None
    for root in sorted(set(map(os.path.abspath, roots))):
        if not os.path.exists(root):
            raise FileNotFoundError(f"there is no {root}")
        folder, name = (root, None) if os.path.isdir(root) else os.path.split(root)
        found = read_vault(spark, folder, True, SKIPPED_ROOTS)
        found = found if name is None else found.where(F.col("path") == name)
        found = found.withColumn("path", F.concat(F.lit(folder + "/"), "path"))
        out = found if out is None else out.unionByName(found)
    return out.dropDuplicates(["path"]).orderBy("path")


def decode(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable, failures): path and raw text with line ends as line feeds; path and reason of unreadable files and broken UTF-8."""
    ok = F.col("content").isNotNull() & F.coalesce(F.call_function("is_valid_utf8", F.col("content").cast("string")), F.lit(False))
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"\r\n?", "\n")
    others = [c for c in files.columns if c not in ("path", "content")]
    good = files.where(ok).select("path", text.alias("raw"), *others)
    bad = files.where(~ok).select("path", F.when(F.col("content").isNull(), "unreadable").otherwise("not UTF-8").alias("reason"))
    return good, bad


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """id, question, grades (map of note to grade), answerable and the other fields of an evaluation set: one JSON object a line, blank
    lines and those that begin with // aside.

    relevant_notes is a list (grade 1 each), an object of grades, or empty (no answer); a line that is no such object is an error.
    """
    lines = spark.read.text(path).where("trim(value) <> '' and not ltrim(value) like '//%'")
    fields = (
        "id string, question string, relevant_notes string, answerable boolean, difficulty string, answer_span string, lang string,"
        " leak boolean, leak_token string, leak_min_df int"
    )
    rows = lines.select("value", F.from_json("value", fields).alias("r")).select("value", "r.*")
    graded = F.from_json("relevant_notes", "map<string,double>")
    listed = F.map_from_entries(
        F.transform(F.array_distinct(F.from_json("relevant_notes", "array<string>")), lambda n: F.struct(n, F.lit(1.0)))
    )
    shape = F.substring(F.ltrim("relevant_notes"), 1, 1)
    grades = F.when(shape == "{", graded).when(shape == "[", listed)
    rows = rows.withColumn("grades", grades)
    bad = rows.where("id is null or question is null or grades is null").select("value").limit(1).collect()
    if bad:
        texts = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
        at = texts.where(F.col("line") == bad[0][0]).agg(F.min("at")).first()[0]
        where = path if at is None else f"{path}:{at + 1}"
        raise ValueError(f"{where}: id, question and relevant_notes (a list or an object) are needed: {bad[0][0][:200]}")
    if rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    return rows.drop("value", "relevant_notes")


def to_qrels(eval_set: DataFrame) -> DataFrame:
    """query_id, doc_id, grade."""
    return eval_set.select(F.col("id").alias("query_id"), F.explode("grades").alias("doc_id", "grade"))


def read_candidates(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(candidates, unreadable files): file, pos, note, question, answer_span, difficulty of a folder of JSON files with a note_path and
    a list of questions each."""
    schema = (
        "note_path string, questions array<struct<question string, answer_span string, difficulty string>>, _corrupt_record string"
    )
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    rows = rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    good = rows.where("note_path is not null and questions is not null")
    flat = good.select("file", F.col("note_path").alias("note"), F.posexplode("questions").alias("pos", "q"))
    return flat.select("file", "pos", "note", "q.*"), rows.where("note_path is null or questions is null").select("file")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """name: the last parts of the paths in a JSON list, which may begin with a byte order mark."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^﻿", "").alias("v"))
    paths = text.select(F.explode(F.from_json("v", "array<string>")).alias("p"))
    return paths.select(F.element_at(F.split(F.translate("p", "\\", "/"), "/"), -1).alias("name")).distinct()


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON object a line, in one file: for compiled sets, which are small."""
    rows.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def write_corpus(files: DataFrame, folder: str, dry_run: bool = False) -> DataFrame:
    """Writes raw texts under flattened names; returns the manifest (out, src, sha1, bytes). files: path, raw."""
    from whinstone.operators.evalset import flat_name

    sha = F.sha1("raw")
    manifest = files.select(
        flat_name(F.col("path"), sha).alias("out"), F.col("path").alias("src"), sha.alias("sha1"), F.octet_length("raw").alias("bytes"), "raw"
    )
    if not dry_run:
        os.makedirs(folder, exist_ok=True)

        def put(rows: Iterator) -> None:
            for r in rows:
                with open(os.path.join(folder, r["out"]), "w", encoding="utf-8", newline="\n") as f:
                    f.write(r["raw"])

        manifest.select("out", "raw").foreachPartition(put)
    return manifest.drop("raw")
