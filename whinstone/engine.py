"""The engine's entry points: ingest a vault, search it, evaluate retrieval, export drafts, read notes."""

from __future__ import annotations

import os
import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from whinstone.functions.notes import parse_notes, read_section
from whinstone.operators import metrics as M
from whinstone.operators.chunking import chunk_or_fail
from whinstone.operators.embedding import Embedder, build_embedder
from whinstone.operators.evaluation import Evaluation, evaluate_run, query_labels, time_figures
from whinstone.operators.evalset import concat_notes, recent, require_indexed
from whinstone.operators.retrieval import MODES, KeepOrder, Reranker, Retriever
from whinstone.operators.sync import CHUNK_TABLE, NoteVersions, SnapshotTable, SyncStats, sync_chunks
from whinstone.sources.files import decode, read_vault, to_qrels


@dataclass
class Settings:
    """Read from WHINSTONE_<NAME> where the environment has it, else from such a line of a .env file."""

    vault: str = "vault"
    table: str = "chunk-table"
    embed_dim: int = 384
    embed_base_url: str = ""
    embed_model: str = ""
    embed_api_key: str = ""
    embed_batch: int = 64
    embed_timeout: float = 60.0
    top_k: int = 10
    candidate_k: int = 50
    rrf_k: float = 60.0
    vector_weight: float = 1.0
    keyword_weight: float = 1.0
    chunk_chars: int = 1200
    chunk_overlap: int = 150
    #: versions: a sync writes the notes that changed; snapshots: each sync is a whole new table that appears at once.
    table_layout: str = "versions"

    @classmethod
    def from_environment(cls, env_file: str = ".env") -> Settings:
        """Names are upper-cased; in the file empty lines and those that begin with # are skipped, and quotes around a value go."""
        given = {}
        if os.path.isfile(env_file):
            with open(env_file, encoding="utf-8-sig") as f:
                for line in map(str.strip, f):
                    name, found, value = line.removeprefix("export ").partition("=")
                    if found and not line.startswith("#"):
                        value = value.strip()
                        given[name.strip().upper()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
        given |= os.environ
        keys = {name: f"WHINSTONE_{name.upper()}" for name in cls.__dataclass_fields__}
        return cls(**{name: type(cls.__dataclass_fields__[name].default)(given[key]) for name, key in keys.items() if key in given})


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings.from_environment)
    reranker: Reranker = field(default_factory=KeepOrder)

    @property
    def table(self) -> SnapshotTable | NoteVersions:
        kinds = {"versions": NoteVersions, "snapshots": SnapshotTable}
        if self.settings.table_layout not in kinds:
            raise ValueError(f"table_layout must be one of {', '.join(kinds)}")
        return kinds[self.settings.table_layout](self.spark, self.settings.table, CHUNK_TABLE)

    @property
    def embedder(self) -> Embedder:
        s = self.settings
        return build_embedder(s.embed_dim, s.embed_base_url, s.embed_model, s.embed_api_key, s.embed_batch, s.embed_timeout)

    def chunks(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(chunks, readable files, failures) of the vault."""
        good, bad = decode(read_vault(self.spark, self.settings.vault))
        chunks, broken = chunk_or_fail(parse_notes(good), self.settings.chunk_chars, self.settings.chunk_overlap)
        return chunks, good, bad.unionByName(broken)

    def preview(self, n: int = 5, width: int = 120) -> DataFrame:
        """The first chunks, without touching the table."""
        chunks, _, _ = self.chunks()
        return chunks.orderBy("note_path", "char_start").limit(n).select(
            "id", "note_path", F.array_join("heading_path", " > ").alias("heading"), F.translate(F.substring("text", 1, width), "\n", " ").alias("text")
        )

    def ingest(self, full: bool = False) -> SyncStats:
        chunks, good, bad = self.chunks()
        chunks = chunks.persist()
        stats = sync_chunks(self.table, chunks, self.embedder, full)
        failures = [f"{r['path']}: {r['reason']}" for r in bad.orderBy("path").limit(10).collect()]
        stats.failures, stats.notes_failed = failures, bad.count()
        stats.files_scanned = good.select("path").unionByName(bad.select("path")).distinct().count()
        chunks.unpersist()
        return stats

    def retriever(self) -> Retriever:
        s = self.settings
        return Retriever(self.table.read(), s.candidate_k, s.rrf_k, s.vector_weight, s.keyword_weight, self.reranker)

    def queries(self, texts: DataFrame) -> DataFrame:
        """query_id, text with embedding."""
        vectors = self.embedder.embed(texts.select(F.col("query_id").alias("id"), "text")).withColumnRenamed("id", "query_id")
        return texts.select("query_id", "text").join(vectors, "query_id")

    def search(self, texts: Sequence[str], k: int | None = None, mode: str = "hybrid", notes: bool = False) -> DataFrame:
        k = self.settings.top_k if k is None else k
        asked = self.queries(self.spark.createDataFrame(list(enumerate(texts)), "query_id long, text string"))
        found = self.retriever()
        return found.search_notes(asked, k, mode) if notes else found.search(asked, k, mode)

    def evaluate(self, eval_set: DataFrame, modes: Sequence[str] = MODES, ks: Sequence[int] = (1, 5, 10), threshold: float = 0.30) -> DataFrame:
        """mode, view, metric, value of evaluation(), without intervals."""
        return self.evaluation(eval_set, modes, ks, threshold, samples=0).metrics

    def evaluation(
        self, eval_set: DataFrame, modes: Sequence[str] = MODES, ks: Sequence[int] = (1, 5, 10), threshold: float = 0.30,
        repeats: int = 1, samples: int = 2000, single: int = 0,
    ) -> Evaluation:
        """All modes over an evaluation set (see evaluate_run()). All queries of a mode are one job, so its time is the job's by the
        number of queries: p50 and p95 over the repeats. Each repeat runs every mode in turn; the first one's rankings count, and
        modes that a later one ranks otherwise are named as drift. With `single` so many questions are also asked one by one (latency())."""
        if repeats < 1 or samples < 0 or not modes or not ks or min(ks) <= 0:
            raise ValueError("repeats, modes and every k must be positive, samples not negative")
        qrels = to_qrels(eval_set)
        if qrels.isEmpty():
            raise ValueError("no question has an answer, so rankings can't be judged")
        require_indexed(qrels.select(F.col("doc_id").alias("note_path")), self.table.read())
        asked = self.queries(eval_set.select(F.col("id").alias("query_id"), F.col("question").alias("text"))).persist()
        n, found, labels = max(1, asked.count()), self.retriever(), query_labels(eval_set).persist()
        runs: dict[str, DataFrame] = {}
        times, drift = [], []
        for _ in range(repeats):
            for mode in modes:
                hits = found.search_notes(asked, max(ks), mode)
                # a plan equal to a persisted one would be read from there, and not be run again
                hits = hits.withColumn("run", F.lit(len(times))).persist()
                start = time.perf_counter()
                hits.count()
                times.append((mode, (time.perf_counter() - start) * 1000 / n))
                now = hits.select("query_id", F.col("note_path").alias("doc_id"), "rank")
                if mode not in runs:
                    runs[mode] = hits
                    continue
                before = runs[mode].select("query_id", F.col("note_path").alias("doc_id"), "rank")
                if mode not in drift and not M.rankings_differ(before, now).isEmpty():
                    drift.append(mode)
                hits.unpersist()
        spent = self.spark.createDataFrame(times, "mode string, ms double")
        spent = M.percentile(spent, "ms", (50, 95), ["mode"])
        metrics = spent.select("mode", F.lit("time").alias("view"), F.format_string("ms_per_query p%d", F.col("p").cast("int")).alias("metric"), "value")
        rankings = coverage = None
        for mode, hits in runs.items():
            ranked = hits.select("query_id", F.col("note_path").alias("doc_id"), "rank")
            covered = M.abstain_coverage(asked, hits.where("rank = 1"))
            rows = evaluate_run(ranked, covered, qrels, labels, ks, threshold, samples)
            metrics = metrics.unionByName(rows.withColumn("mode", F.lit(mode)))
            ranked, covered = ranked.withColumn("mode", F.lit(mode)), covered.withColumn("mode", F.lit(mode))
            rankings = ranked if rankings is None else rankings.unionByName(ranked)
            coverage = covered if coverage is None else coverage.unionByName(covered)
        if single:
            metrics = metrics.unionByName(self.latency(eval_set, modes, repeats, single, max(ks)))
        return Evaluation(metrics.persist(), rankings, coverage, drift)

    def latency(self, eval_set: DataFrame, modes: Sequence[str] = MODES, repeats: int = 3, queries: int = 20, k: int = 10) -> DataFrame:
        """mode, view (time), metric, value: how long single queries take (milliseconds) on a prepared index, one job a query: p50 and
        p95 over the first `queries` questions, and of the repeats' figures the median, least and most. Repeats take modes in turn."""
        if repeats < 1 or queries < 1:
            raise ValueError("repeats and queries must be positive")
        asked = self.queries(eval_set.select(F.col("id").alias("query_id"), F.col("question").alias("text")).orderBy("query_id").limit(queries)).persist()
        found = self.retriever()
        index = found.index
        held = [df.persist() for df in (found.chunks, index.docs, index.postings)]
        for df in held:
            df.count()
        ids = [r["query_id"] for r in asked.select("query_id").orderBy("query_id").collect()]
        runs: dict[str, list[list[float]]] = {mode: [] for mode in modes}
        for _ in range(repeats):
            for mode in modes:
                times = []
                for i in ids:
                    start = time.perf_counter()
                    found.search_notes(asked.where(F.col("query_id") == i), k, mode).collect()
                    times.append((time.perf_counter() - start) * 1000)
                runs[mode].append(times)
        for df in (asked, *held):
            df.unpersist()
        rows = [(mode, "time", f"ms of a query {name}", float(v)) for mode, r in runs.items() for name, v in time_figures(r).items()]
        return self.spark.createDataFrame(rows, "mode string, view string, metric string, value double")

    def drafts(self, limit: int | None = None, most: int = 6000) -> DataFrame:
        """note_path, text of each note, for writing questions."""
        out = concat_notes(self.table.read(), "char_start", most=most)
        return out if limit is None else out.orderBy("note_path").limit(limit)

    def read_note(self, path: str, heading: str = "") -> str:
        """A note, or one section of it; paths that leave the vault and other files than Markdown are errors."""
        root = os.path.realpath(self.settings.vault)
        full = os.path.realpath(os.path.join(root, path))
        if os.path.commonpath([root, full]) != root or not full.lower().endswith((".md", ".markdown")):
            raise ValueError(f"{path} is no note of the vault")
        with open(full, encoding="utf-8") as f:
            row = self.spark.createDataFrame([(f.read(),)], "raw string").select(read_section("raw", heading)).first()
        if row[0] is None:
            raise ValueError(f"{path} has no heading {heading}")
        return row[0]

    def recent_notes(self, n: int = 10) -> DataFrame:
        files = read_vault(self.spark, self.settings.vault, hidden=True, skipped=(".obsidian", ".trash"))
        return recent(files.where("lower(path) like '%.md'").select("path", "modified"), n)
