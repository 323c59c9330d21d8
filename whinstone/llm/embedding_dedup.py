"""Near-duplicate embeddings: navigable small-world graphs per shard, audited beams, verified cosine, united components."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import components, cut, pick, stars
from whinstone.llm.hnsw import Graph, unit

#: Points of a shard at most, bytes of its vectors in double precision, and shards at least: every vector asks every shard, so shards
#: stay few while each fits a task.
SHARD_ROWS, SHARD_BYTES, MIN_SHARDS = 200_000, 1 << 28, 3
BEAM, AUDIT, AUDIT_RECALL = 32, 128, 0.995
#: A beam of over one in so many points of the shard is as wide as the shard: a walk would cost more than comparing them all.
WIDEST = 8
#: Cells of the table of visited points that a search may hold.
CELLS = 1 << 26


def _build(shard: pd.DataFrame) -> pd.DataFrame:
    ids = shard["id"].to_numpy()
    by = np.argsort(ids, kind="stable")  # the same graph whatever order the rows came in
    raw = np.stack(shard["embedding"].to_numpy()[by])
    blob = pickle.dumps((ids[by], shard["n"].to_numpy()[by], raw, Graph(unit(raw.astype(np.float64))).packed()), protocol=5)
    return pd.DataFrame({"dim": [shard["dim"].iloc[0]], "shard": [shard["shard"].iloc[0]], "blob": [blob]})


def _search(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, point, cosine) of all links found; a query with links in over three quarters of its beam asks again with one four times as wide."""
    found: list[tuple] = []
    todo = np.arange(len(q))
    while len(todo):
        beam = min(beam, len(x))
        wider = []
        everything = beam * WIDEST > len(x) > WIDEST * BEAM or beam == len(x)
        step = max(1, (1 << 22) // len(x) if everything else min(256, CELLS // (len(x) + 1), (1 << 20) // beam))
        for lo in range(0, len(todo), step):
            rows = todo[lo : lo + step]
            if everything:  # a beam as wide as the shard holds all of its points: they are compared without a walk
                a, point = np.nonzero(q[rows] @ x.T >= least - 1e-9)
                who = rows[a]
                cosine = np.einsum("ij,ij->i", q[who], x[point])
                ok = cosine >= least
                found.append((who[ok], point[ok], cosine[ok]))
                continue
            ids, sims = graph.search(q[rows], beam)
            full = ((sims >= least - 1e-3).sum(axis=1) > 3 * beam // 4) & (beam < len(x))
            wider.append(rows[full])
            a, b = np.nonzero((sims >= least - 1e-3) & (ids >= 0) & ~full[:, None])
            who, point = rows[a], ids[a, b]
            cosine = np.einsum("ij,ij->i", q[who], x[point])
            ok = cosine >= least
            found.append((who[ok], point[ok], cosine[ok]))
        todo = np.concatenate(wider) if wider else todo[:0]
        beam *= 4
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3


def _audited(graph: Graph, x: np.ndarray, q: np.ndarray, least: float, beam: int) -> int:
    """The narrowest beam (doubling from `beam`) with which two samples find AUDIT_RECALL of the links that comparing them with every
    point of the shard tells: one of q, and one of the shard's own points, each moved as far away as just still links."""
    at = np.unique(np.linspace(0, len(q) - 1, AUDIT).astype(int))
    near = x[np.unique(np.linspace(0, len(x) - 1, AUDIT).astype(int))]
    aside = np.random.default_rng(len(x)).normal(size=near.shape)
    aside -= np.einsum("ij,ij->i", aside, near)[:, None] * near
    length = np.sqrt(np.einsum("ij,ij->i", aside, aside))[:, None]
    aside = np.divide(aside, length, out=np.zeros_like(aside), where=length > 1e-12)
    c = least + 0.1 * (1 - least)
    sample = np.concatenate([q[at], unit(c * near + math.sqrt(1 - c * c) * aside)])
    links = (sample @ x.T >= least).sum(axis=1)
    while beam < len(x):
        who, _, _ = _search(graph, x, sample, least, beam)
        got = np.bincount(who, minlength=len(sample))
        if got.sum() >= AUDIT_RECALL * links.sum() and (got > 0).sum() >= AUDIT_RECALL * (links > 0).sum():
            break
        beam *= 2
    return beam


def _query(least: float):
    """Rows sorted by (dim, shard, block, kind): a graph, then the vectors that ask it. Gives (a, b, n): links to n vectors of a, or
    with n = 0 an edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = weight = x = graph = None
        for batch in batches:
            kind = batch.column("kind").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(kind == 0)
            for lo, hi in zip([0, *cuts], [*cuts, len(kind)], strict=True):
                if lo < len(kind) and kind[lo] == 0 and lo < hi:
                    ids, weight, raw, packed = pickle.loads(batch.column("blob")[int(lo)].as_buffer())
                    x = unit(raw.astype(np.float64))
                    graph = Graph.unpacked(x, packed)
                    lo += 1
                if lo >= hi:
                    continue
                part = batch.slice(int(lo), int(hi - lo))
                who = part.column("id").to_numpy(zero_copy_only=False)
                q = unit(part.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(who), -1).astype(np.float64))
                a, b, _ = _search(graph, x, q, least, _audited(graph, x, q, least, BEAM))
                other = who[a] != ids[b]
                a, b = a[other], b[other]
                if not len(a):
                    continue
                links = np.bincount(a, weights=weight[b], minlength=len(who)).astype(np.int64)
                some = np.flatnonzero(links)
                one, other = stars(who[a], ids[b])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([who[some], one])),
                        pa.array(np.concatenate([who[some], other])),
                        pa.array(np.concatenate([links[some], np.zeros(len(one), np.int64)])),
                    ],
                    names=["a", "b", "n"],
                )

    return run


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.95, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Per row of vectors (vec_id, embedding): vec_id, n_links (other rows with cosine >= least), component_id (smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id).

    Equal vectors are one class with a count, so a hot vector meets in a map-side aggregation. Classes are dealt to shards by a hash
    of their smallest vec_id; each shard, a bounded group, becomes a graph. Every class asks every shard, block by block: a task
    reads one graph and then streams a block's vectors. Its beam doubles until an audit against all points of the shard, of vectors
    and of points moved to the edge of linking, finds 99.5 % of links, and grows on for a query with links in over three quarters of it, so large groups are found whole.
    A beam of over an eighth of the shard's points holds all of them. Cosines are verified in double precision, of vectors scaled by powers of two first. A task sends each vector's number of links and a spanning forest of what it linked,
    never all pairs. Vectors that are null, empty or zero or have null or non-finite components link with nothing, and those of
    different lengths not with each other. Repeated rows are vectors of their own. Vectors without a vec_id count as links but name no
    component, unless all of a class have none: then it links with nothing. An empty table gives no rows; extra columns don't matter.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = pick(vectors, vec_id="long", embedding=kind)
    good = F.expr(
        "embedding is not null and size(embedding) > 0 and forall(embedding, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))"
        " and exists(embedding, v -> v <> 0)"
    )
    rows = rows.withColumn("embedding", F.when(F.coalesce(good, F.lit(False)), F.col("embedding")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    classes = cut(classes.where("id is not null").withColumn("dim", F.size("embedding")), "vector-classes")
    total, longest = classes.agg(F.count("*"), F.coalesce(F.max("dim"), F.lit(1))).first()
    shard_rows = min(shard_rows, max(1, SHARD_BYTES // (8 * longest)))
    shards = max(MIN_SHARDS, math.ceil(total / shard_rows))
    blocks = max(1, math.ceil(total / max(8192, math.ceil(total / shards))))
    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    graphs = cut(
        dealt.groupBy("dim", "shard").applyInPandas(_build, "dim int, shard int, blob binary"), "graphs"
    )
    asked = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    first = graphs.select(
        "dim", "shard", asked.alias("block"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"),
        F.lit(None).cast(kind).alias("embedding"), "blob",
    )
    then = classes.join(F.broadcast(graphs.select("dim", "shard")), "dim").select(
        "dim", "shard", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), F.lit(1).alias("kind"), "id",
        "embedding", F.lit(None).cast("binary").alias("blob"),
    )
    found = (
        first.union(then)
        .repartition("dim", "shard", "block")
        .sortWithinPartitions("dim", "shard", "block", "kind")
        .mapInArrow(_query(least), "a long, b long, n long")
    )
    found = cut(found, "vector-links")
    links = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("links"))
    comp = components(found.where("n = 0").select("a", "b"))
    named = (
        classes.join(links, F.col("id") == F.col("a"), "left")
        .join(comp, F.col("id") == F.col("node"), "left")
        .select(
            F.col("embedding").alias("e"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "id").alias("component_id"),
        )
    )
    named = cut(named, "vector-components")
    out = rows.join(named, F.col("embedding") == F.col("e"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
