"""An inverted-file index of vectors: lists around coarse centroids, small codes to scan them by, and a recall knob.

Every vector lies in the list of its nearest centroid, with its numbers as 8-bit codes beside it. A query scans the codes of the lists
nearest to it and compares in full only the best of what it found. The knob is the number of lists (probes); how many candidates are
compared in full is another (refine).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from whinstone.operators.index import DIGITS, top_k
from whinstone.operators.vectors import dot, l2_normalise, vector_search

#: Centroids are fitted on a bounded sample: so many rows for each, and so many numbers in all. Every row is indexed.
ROWS_A_CENTROID, SAMPLE_NUMBERS = 128, 1 << 22
#: What all centroids may have together (32 MB): they travel with each task. More vectors than that suits get longer lists.
CENTROID_NUMBERS = 1 << 22
#: Rows of a list, and queries, that meet in one cell; longer lists and larger batches of queries are split.
LIST_BLOCK, QUERY_BLOCK = 16_384, 4_096
ITERATIONS = 12
#: Numbers of the queries' vectors, repeated for each list they probe, and of distances to centroids that a task holds at a time.
STEP_NUMBERS = 1 << 20


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """Vectors of dim finite numbers, none null, that aren't all zero."""
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return vectors.where((F.size("embedding") == dim) & (squared > 0) & (squared < float("inf")))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(whole), -1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def spherical_means(x: np.ndarray, lists: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows: the mean of each list, normalised, ITERATIONS times; an empty list starts again at a row."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), lists, replace=len(x) < lists)]
    for _ in range(ITERATIONS):
        near = np.argmax(x @ centroids.T, axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        empty = norm < 1e-12
        sums[empty], norm[empty] = x[rng.integers(len(x), size=int(empty.sum()))], 1.0
        centroids = sums / norm[:, None]
    return centroids


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as 8-bit integers, and what to multiply each with to have it back about."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-30) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


@dataclass(frozen=True)
class IvfIndex:
    """rows: doc_id, embedding, list, block, code (binary), scale; lists: list, centroid, n (rows), blocks. centroids and sizes are what
    `lists` has, in the order of list."""

    rows: DataFrame
    lists: DataFrame
    centroids: np.ndarray
    sizes: np.ndarray

    def save(self, path: str) -> None:
        """Parquet: rows partitioned by list, so that a search reads the lists it probes and no columns that it doesn't need."""
        self.lists.write.mode("overwrite").parquet(f"{path}/lists")
        self.rows.repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IvfIndex:
        lists = spark.read.parquet(f"{path}/lists")
        found = lists.orderBy("list").collect()
        centroids = np.array([r["centroid"] for r in found], np.float64)
        return IvfIndex(spark.read.parquet(f"{path}/rows"), lists, centroids, np.array([r["n"] for r in found], np.int64))


def _assign(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding"))
                code, scale = codes(x)
                near = np.argmax(x @ centroids.T, axis=1).astype(np.int32)
                made = [pa.array(near), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("embedding"), *made], names=["doc_id", "embedding", "list", "code", "scale"])

    return run


def build_ivf(vectors: DataFrame, dim: int, lists: int | None = None, seed: int = 0) -> IvfIndex:
    """Index vectors (doc_id, embedding) of dim numbers; others, and those that `usable` leaves out, are never found, as in an exact
    search. lists: about the root of their number unless given."""
    if dim <= 0 or (lists is not None and lists <= 0):
        raise ValueError("dim and lists must be positive")
    rows = usable(vectors.select("doc_id", "embedding"), dim)
    n = rows.count()
    most = max(1, CENTROID_NUMBERS // dim)
    wanted = min(most, lists or max(1, round(n**0.5)))
    take = max(1, min(ROWS_A_CENTROID * wanted, SAMPLE_NUMBERS // dim))
    # the rows of smallest hash: the same ones however the table is partitioned
    sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(take).select("embedding").toArrow().column("embedding")
    centroids = spherical_means(_matrix(sample), wanted, seed) if len(sample) else np.eye(1, dim)
    kind = dict(rows.dtypes)
    assigned = rows.mapInArrow(_assign(centroids), f"doc_id {kind['doc_id']}, embedding {kind['embedding']}, list int, code binary, scale double")
    sizes = np.zeros(len(centroids), np.int64)
    for r in assigned.groupBy("list").agg(F.count("*").alias("n")).collect():  # a row a list
        sizes[r["list"]] = r["n"]
    spark = vectors.sparkSession
    table = [(i, c.tolist(), int(s), int(-(-s // LIST_BLOCK))) for i, (c, s) in enumerate(zip(centroids, sizes, strict=True))]
    known = spark.createDataFrame(table, "list int, centroid array<double>, n long, blocks int")
    blocked = assigned.join(known.select("list", "blocks"), "list")
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).drop("blocks")
    return IvfIndex(blocked.select("doc_id", "embedding", "list", "block", "code", "scale"), known, centroids, sizes)


def _probe(centroids: np.ndarray, sizes: np.ndarray, probes: int, least: int):
    """Per query its nearest lists: `probes` of those that have rows, and more until they have `least` rows."""
    used = np.flatnonzero(sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = len(used) * centroids.shape[1]
        step = max(1, STEP_NUMBERS // max(1, wide))
        for batch in (b.slice(lo, step) for b in batches for lo in range(0, b.num_rows, step)):
            if len(used):
                order = used[np.argsort(-(_matrix(batch.column("embedding")) @ centroids[used].T), axis=1, kind="stable")]
                enough = (np.cumsum(sizes[order], axis=1) < least).sum(axis=1) + 1
                take = np.minimum(np.maximum(enough, probes), len(used))
                at = np.repeat(np.arange(len(order)), take)
                lists = np.concatenate([o[:t] for o, t in zip(order, take, strict=True)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(at)) for c in ("query_id", "embedding")] + [pa.array(lists)], names=["query_id", "embedding", "list"])

    return run


def _scan(k: int, exact: bool):
    """A cell's queries against its rows: each query's k best, by codes or in full."""

    def run(table: pa.Table) -> pa.Table:
        asked = table.column("query_id").is_valid().to_numpy()
        rows, queries = table.filter(pa.array(~asked)), table.filter(pa.array(asked))
        if not len(rows) or not len(queries):
            return pa.table({c: table.column(c)[:0] for c in ("query_id", "doc_id")} | {"score": pa.array([], pa.float64())})
        q = _matrix(queries.column("embedding"))
        if exact:
            x = _matrix(rows.column("embedding"))
        else:
            code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.int8).reshape(len(rows), -1)
            x = code * rows.column("scale").to_numpy()[:, None].astype(np.float32)
            q = q.astype(np.float32)
        # ties go by id, as they do in the end
        ids = rows.column("doc_id").combine_chunks()
        by_id = np.asarray(pa.compute.sort_indices(ids))
        x, found = x[by_id], []
        step = max(1, (1 << 22) // len(x))
        for at in range(0, len(q), step):
            score = np.round(q[at : at + step] @ x.T, DIGITS) if exact else q[at : at + step] @ x.T
            best = np.argsort(-score, axis=1, kind="stable")[:, :k]
            found.append((np.repeat(np.arange(at, at + len(score)), best.shape[1]), best.ravel(), np.take_along_axis(score, best, 1).ravel()))
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"query_id": queries.column("query_id").take(pa.array(i)), "doc_id": ids.take(pa.array(by_id[j])), "score": pa.array(score.astype(np.float64))})

    return run


def ivf_candidates(index: IvfIndex, queries: DataFrame, k: int, probes: int, exact: bool = False) -> DataFrame:
    """query_id, doc_id, score, rank: the k best in the probed lists, by codes or (exact) in full."""
    asked = usable(queries.select("query_id", "embedding"), index.centroids.shape[1])
    kinds, ids = dict(asked.dtypes), dict(index.rows.dtypes)["doc_id"]
    splits = max(1, -(-asked.count() // QUERY_BLOCK))
    probed = asked.mapInArrow(_probe(index.centroids, index.sizes, probes, k), f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, list int")
    left = probed.join(index.lists.where("blocks > 0").select("list", "blocks"), "list").select(
        "query_id", F.lit(None).cast(ids).alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("binary").alias("code"),
        F.lit(None).cast("double").alias("scale"), "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("query_id"), F.lit(splits)).cast("int").alias("split"),
    )
    vector = F.col("embedding").cast("array<double>") if exact else F.lit(None).cast("array<double>")
    code = F.lit(None).cast("binary") if exact else F.col("code")
    wanted = index.rows.join(probed.select("list").distinct(), "list", "left_semi")
    right = wanted.select(
        F.lit(None).cast(kinds["query_id"]).alias("query_id"), "doc_id", vector.alias("embedding"), code.alias("code"), "scale", "list", "block",
        F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"),
    )
    cells = left.unionByName(right).groupBy("list", "block", "split")
    return top_k(cells.applyInArrow(_scan(k, exact), f"query_id {kinds['query_id']}, doc_id {ids}, score double"), k)


def ivf_search(index: IvfIndex, queries: DataFrame, k: int = 10, probes: int = 8, refine: int = 4) -> DataFrame:
    """query_id, doc_id, score (cosine), rank: about the k nearest vectors of each query (query_id, embedding).

    The lists probed are the `probes` nearest ones, and more where these have fewer than k rows, so a query gets k rows wherever the
    index has them. k * refine candidates are compared in full; refine = 0 compares whatever is probed in full, and with all lists
    probed the result is then that of an exact search.
    """
    if k <= 0 or probes <= 0 or refine < 0:
        raise ValueError("k and probes must be positive, refine at least 0")
    if not refine:
        return ivf_candidates(index, queries, k, probes, True)
    near = ivf_candidates(index, queries, k * refine, probes).select("query_id", "doc_id")
    full = near.join(index.rows.select("doc_id", "embedding"), "doc_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    score = dot(l2_normalise(F.col("q")), l2_normalise(F.col("embedding")))
    return top_k(full.select("query_id", "doc_id", F.round(score, DIGITS).alias("score")), k)


def recall_sweep(index: IvfIndex, vectors: DataFrame, queries: DataFrame, probes: Sequence[int], k: int = 10, refine: int = 4) -> DataFrame:
    """probes, queries, recall (share of an exact search's k rows that are found), scanned and compared (shares of all pairs of queries
    and indexed vectors that codes, and full vectors, are looked at for)."""
    truth = vector_search(vectors, queries, k).select("query_id", "doc_id")
    asked = usable(queries.select("query_id", "embedding"), index.centroids.shape[1])
    pairs = asked.agg((F.count("*") * F.lit(float(max(1, index.sizes.sum())))).alias("pairs"), F.count("*").alias("queries"))
    out = None
    for p in probes:
        found = ivf_search(index, queries, k, p, refine).select("query_id", "doc_id", F.lit(1).alias("hit"))
        kinds = dict(asked.dtypes)
        lists = asked.mapInArrow(_probe(index.centroids, index.sizes, p, k * max(1, refine)), f"query_id {kinds['query_id']}, embedding {kinds['embedding']}, list int")
        seen = lists.join(index.lists, "list").groupBy("query_id").agg(F.sum("n").alias("n"))
        full = F.least("n", F.lit(k * refine)) if refine else F.col("n")
        looked = seen.agg(F.sum("n").alias("codes"), F.sum(full).alias("full"))
        recall = truth.join(found, ["query_id", "doc_id"], "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
        row = recall.crossJoin(looked).crossJoin(pairs).select(
            F.lit(p).alias("probes"), "queries", F.round("recall", 6).alias("recall"),
            F.round(F.lit(1.0 if refine else 0.0) * F.col("codes") / F.col("pairs"), 6).alias("scanned"), F.round(F.col("full") / F.col("pairs"), 6).alias("compared"),
        )
        out = row if out is None else out.unionByName(row)
    return out
