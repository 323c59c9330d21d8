"""Near copies of documents by the similarity of their word shingles: MinHash bands for candidates, verified on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import (
    LOWER,
    binary_texts,
    components,
    cut,
    hot_keys,
    pick,
    run_bounds,
    salted,
    sorted_runs,
    spanning_edges,
    stars,
    unsettled,
)
from whinstone.llm.simhash import digests

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Documents of similarity 0.8 share all MinHashes of a band with probability 0.41, and those of any band with 0.99997.
BANDS, ROWS = 20, 4
#: So many bands are linked first; of the others only buckets that these left in several components.
FIRST = 4
#: Classes of a bucket that one task links at a time: each brings its whole set.
BUCKET_SETS = 1024
_RNG = np.random.default_rng(SEED)
_XOR, _TIMES = (_RNG.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
_BAND = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of the text's shingles (runs without ASCII white space are words), sorted; of fewer words, all together."""
    words = text.translate(LOWER).split() if text else []
    return np.unique(np.concatenate([np.empty(0, np.uint64), *digests(words, shingle, SEED)]))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key for each band, of its MinHashes and its place."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        np.minimum(low, ((found[at : at + 1024] ^ _XOR) * _TIMES).min(axis=1), out=low)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        key = (key ^ column) * _BAND
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def _id(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes())


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [shingle_set(t, shingle) for t in binary_texts(batch.column("text").slice(lo, 256))]
                ids = np.array([_id(x) for x in found], np.uint64).view(np.int64)
                keys = pa.array([band_keys(x) for x in found], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, 256), pa.array(ids), keys], names=["doc_id", "id", "keys"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [shingle_set(t, shingle) for t in binary_texts(batch.column("text").slice(lo, 256))]
                ids = np.array([_id(x) for x in found], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "found"])

    return run


def _similar(k: int, sets: list[np.ndarray], others: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the others have this Jaccard similarity with set k, or more. Sizes alone rule out many."""
    own, out = sets[k], np.zeros(len(others), bool)
    sizes = np.array([len(sets[j]) for j in others])
    fit = np.flatnonzero(np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own)) - 1e-9)
    for lo in range(0, len(fit), 256):
        part = fit[lo : lo + 256]
        flat = np.concatenate([sets[j] for j in others[part]])
        there = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        common = np.add.reduceat(there.astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
        out[part] = common >= similarity * (sizes[part] + len(own) - common) - 1e-9
    return out


def _link(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spanning edges (a, b) of every (key, salt) run of rows sorted by it."""
        small = (b.slice(lo, 1024) for b in batches for lo in range(0, b.num_rows, 1024))
        for key, salt, ids, found in sorted_runs((b.select(["key", "salt", "id", "found"]) for b in small), ("key", "salt")):
            bounds, edges = run_bounds([key, salt]), []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    sets = [np.frombuffer(x, np.uint64) for x in found[lo:hi]]
                    links = spanning_edges(hi - lo, lambda k, others, sets=sets: _similar(k, sets, others, similarity))
                    edges += [(ids[lo + a], ids[lo + b]) for a, b in links]
            if edges:
                a, b = stars(*np.array(edges, np.int64).T)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _link_open(similarity: float):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Rows of the minority against all rows of one (key, salt): one edge for each component that a row links to."""
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        ids, comp, edges = right["id"].to_numpy(), right["component"].to_numpy(), []
        sets = [np.frombuffer(x, np.uint64) for x in right["found"]]
        for i, c, x in zip(left["id"], left["component"], left["found"], strict=True):
            others = np.flatnonzero(comp != c)
            hit = others[_similar(len(sets), [*sets, np.frombuffer(x, np.uint64)], others, similarity)]
            _, first = np.unique(comp[hit], return_index=True)
            edges += [(i, ids[k]) for k in hit[first]]
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")

    return run


def _edges(hits: DataFrame, sets: DataFrame, similarity: float, bucket_sets: int) -> DataFrame:
    """Edges that join what the buckets of hits (key, id) link."""
    work = hits.join(sets, "id")
    hot = hot_keys(hits.groupBy("key").agg(F.count("*").alias("n")), bucket_sets)
    rows = salted(work, hot).repartition("key", "salt").sortWithinPartitions("key", "salt")
    edges = cut(rows.mapInArrow(_link(similarity), "a long, b long").distinct(), "near-links")
    if hot is None:
        return edges
    minority, everything = unsettled(work, hot, components(edges), bucket_sets)
    pairs = minority.groupBy("key", "salt", "block").cogroup(everything.groupBy("key", "salt", "block"))
    return cut(edges.union(pairs.applyInPandas(_link_open(similarity), "a long, b long")).distinct(), "near-links")


def near_copies(
    docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, bucket_sets: int = BUCKET_SETS
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, component_id (the smallest doc_id reachable by links).

    Documents link where the Jaccard similarity of their sets of word shingles is `similarity` or more; equal sets, those without
    words included, are one class from the start. Candidates share one of BANDS buckets of ROWS MinHashes each; no bit limit of a
    SimHash is both that wide and selective. Only the sets of classes that share a bucket are made again and compared, whole. The
    first bands settle most groups, so the others need only buckets that still hold several components. Large buckets are salted,
    and what that parts is compared afterwards. A null doc_id names no component.
    """
    texts = pick(docs, doc_id="long", text="string")
    prints = cut(texts.mapInArrow(_signatures(shingle), "doc_id long, id long, keys array<long>"), "near-prints")
    classes = cut(prints.groupBy("id").agg(F.min("doc_id").alias("first")).where("first is not null"), "near-classes")
    rows = prints.where("doc_id is not null").select("id", F.posexplode("keys").alias("v", "key"))
    shared = rows.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x < y").select("key")
    hits = cut(rows.join(shared, "key", "left_semi").distinct(), "near-hits")
    near = cut(hits.select("id").distinct().join(classes.select("id", "first"), "id"), "near-ids")
    there = texts.join(near.select(F.col("first").alias("doc_id")).distinct(), "doc_id", "left_semi")
    sets = there.mapInArrow(_sets(shingle), "id long, found binary").join(near.select("id"), "id", "left_semi")
    sets = cut(sets.dropDuplicates(["id"]), "near-sets")
    edges = _edges(hits.where(F.col("v") < FIRST).select("key", "id"), sets, similarity, bucket_sets)
    more = hits.where(F.col("v") >= FIRST).select("key", "id")
    now = more.join(components(edges), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    several = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    more = cut(more.join(several, "key", "left_semi"), "near-open")
    comp = components(edges.union(_edges(more, sets, similarity, bucket_sets)))
    grouped = classes.join(comp, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    best = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = grouped.join(best, "component").select(F.col("id").alias("_id"), "component_id")
    return prints.select("doc_id", "id").join(named, F.col("id") == F.col("_id"), "left").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each group of near copies: the one whose doc_id names the group. Repeated rows of that doc_id stay
    (they are one document), and so do rows without a doc_id."""
    found = near_copies(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of docs can clash
    return rows.join(found, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")
