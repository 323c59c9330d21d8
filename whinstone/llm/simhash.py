"""SimHash near-duplicates of documents by deletion-variant signatures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import (
    BUCKET_ROWS,
    LOWER,
    binary_texts,
    components,
    cut,
    hot_keys,
    pick,
    popcount,
    run_bounds,
    salted,
    sorted_runs,
    spanning_edges,
    stars,
    unsettled,
)

BLOCK_WORDS = 1 << 16
#: Fingerprints of at most this many differing bits link; two segments then differ in at most one bit in one of them.
MAX_BITS = 3


def digests(words: list[bytes], shingle: int, seed: int) -> Iterator[np.ndarray]:
    """The XXH64 of the words' shingles, in blocks. Fewer words than a shingle: all of them together; none: nothing."""
    if words and len(words) < shingle:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], np.uint64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(words) - shingle + 1, BLOCK_WORDS):
        block = words[at : at + BLOCK_WORDS + shingle - 1]
        joined = b" ".join(block)
        ends, p = [], -1
        for w in block:
            p += len(w) + 1
            ends.append(p)
        starts = [0] + [e + 1 for e in ends[: len(block) - shingle]]
        yield np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :], strict=True)], "<u8")


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the UTF-8 text: its words (runs without ASCII white space), their shingles' XXH64, and the strict majority of
    each bit. Fewer words than a shingle: all of them together; none, or null: zero."""
    words = text.translate(LOWER).split() if text else []
    ones, n = np.zeros(64, np.int64), 0
    for h in digests(words, shingle, seed):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle, seed) for t in binary_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Columns doc_id, fp (the fingerprint's 64 bits as a long)."""
    return pick(docs, doc_id="long", text="string").mapInArrow(_fingerprints(shingle, seed), "doc_id long, fp long")


def _variants(classes: DataFrame) -> DataFrame:
    """64 rows (key, fp, id) for each class: segment s of 32 bits without its bit j, as a key that names s and j."""
    seg = F.when(F.col("v") < 32, F.col("fp").bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned("fp", 32))
    gap = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("v") % 32)
    rows = classes.select("fp", "id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    key = F.shiftleft(F.col("v").cast("long"), 32).bitwiseOR(seg.bitwiseAND(F.bitwise_not(gap)))
    return rows.select(key.alias("key"), "fp", "id")


def _adjacent(v: int, x, y) -> np.ndarray:
    """Whether fingerprints link, in the one bucket of a pair that counts: segment and bit where they differ, or bit 0 of an equal
    segment."""
    d = x ^ y
    seg = (d & np.uint64(0xFFFFFFFF)) if v < 32 else (d >> np.uint64(32))
    here = seg == np.uint64(1 << (v % 32))
    if v % 32 == 0:
        here |= seg == 0
    return here & (popcount(d) <= MAX_BITS)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning edges (a, b) of every (key, salt) run of rows sorted by it."""
    for key, salt, fp, ids in sorted_runs(
        (b.select(["key", "salt", "fp", "id"]) for b in batches), ("key", "salt")
    ):
        bounds = run_bounds([key, salt])
        size = np.diff(bounds)
        fp = fp.view(np.uint64)
        out_a, out_b = [], []
        pairs = bounds[:-1][size == 2]
        if len(pairs):  # most shared buckets are two rows
            v = (key[pairs] >> 32).astype(np.uint64)
            d = fp[pairs] ^ fp[pairs + 1]
            seg = np.where(v < 32, d & np.uint64(0xFFFFFFFF), d >> np.uint64(32))
            here = (seg == (np.uint64(1) << (v % np.uint64(32)))) | ((seg == 0) & (v % np.uint64(32) == 0))
            here &= popcount(d) <= MAX_BITS
            out_a.append(ids[pairs[here]])
            out_b.append(ids[pairs[here] + 1])
        for i in np.flatnonzero(size > 2):
            lo, hi = bounds[i], bounds[i + 1]
            x, v = fp[lo:hi], int(key[lo] >> 32)
            if v % 32:  # a link needs both values of the bit
                bit = (x >> np.uint64(v)) & np.uint64(1)
                if not bit.any() or bit.all():
                    continue
            found = spanning_edges(len(x), lambda k, others, x=x, v=v: _adjacent(v, x[k], x[others]))
            if found:
                e = np.array(found)
                out_a.append(ids[lo + e[:, 0]])
                out_b.append(ids[lo + e[:, 1]])
        if out_a:
            a, b = stars(np.concatenate(out_a), np.concatenate(out_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _link_open(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows of the minority against all rows of one (key, salt): one edge for each component that a row links to."""
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    x, ids, comp = right["fp"].to_numpy().view(np.uint64), right["id"].to_numpy(), right["component"].to_numpy()
    edges = []
    for v, fp, i, c in zip(left["key"].to_numpy() >> 32, left["fp"].to_numpy().view(np.uint64), left["id"], left["component"], strict=True):
        hit = np.flatnonzero(_adjacent(int(v), fp, x) & (comp != c))
        _, first = np.unique(comp[hit], return_index=True)
        edges += [(i, ids[k]) for k in hit[first]]
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def near_duplicates(docs: DataFrame, shingle: int = 3, seed: int = 42, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, fp (long), component_id (the smallest doc_id reachable by links).

    Documents link where their fingerprints differ in at most three bits; equal fingerprints, those without words included, are one
    class from the start, so copies meet in a map-side aggregation. Each class is indexed by 64 signatures: one of two 32-bit
    segments without one of its bits. Of three differing bits at most one falls into one of the segments, so every linked pair
    shares a signature, and is verified in just one of those it shares. Signatures are sorted, their runs give spanning edges
    (never all pairs), and components come from alternating stars. Signatures with more than bucket_rows classes are salted; what
    salting may part is compared afterwards across components, so no link is lost. A null doc_id is a document like any other but
    names no component unless all its documents have none.
    """
    prints = cut(fingerprints(docs, shingle, seed), "fingerprints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "classes")
    rows = _variants(classes)
    # a signature's rows are at most those of its two completions: whole segments are counted, a 32nd of the rows
    segments = classes.select(
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("s"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("seg")),
                F.struct(F.lit(32).alias("s"), F.shiftrightunsigned("fp", 32).alias("seg")),
            )
        ).alias("x")
    ).groupBy("x.s", "x.seg").agg(F.count("*").alias("n"))
    j = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("j"))
    upper = segments.where(F.col("n") > bucket_rows // 2).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(31))))
    upper = upper.select(
        F.shiftleft((F.col("s") + F.col("j")).cast("long"), 32).bitwiseOR(F.col("seg").bitwiseAND(F.bitwise_not(j))).alias("key"), "n"
    )
    hot = hot_keys(upper.groupBy("key").agg((F.sum("n") + bucket_rows // 2).alias("n")), bucket_rows)
    edges = (
        salted(rows, hot)
        .repartition("key", "salt")
        .sortWithinPartitions("key", "salt")
        .mapInArrow(_link, "a long, b long")
    )
    if hot is None:
        comp = components(edges)
    else:
        edges = cut(edges.distinct(), "links")
        comp = components(edges)
        minority, everything = unsettled(rows, hot, comp, bucket_rows)
        more = (
            minority.groupBy("key", "salt", "block").cogroup(everything.groupBy("key", "salt", "block")).applyInPandas(_link_open, "a long, b long")
        )
        edges = cut(edges.union(more).distinct(), "links")
        comp = components(edges)
    named = classes.join(comp, F.col("id") == F.col("node"), "left").select(
        F.col("fp").alias("c_fp"), F.coalesce("component", "id").alias("component_id")
    )
    return prints.join(named, F.col("fp") == F.col("c_fp"), "left").select("doc_id", "fp", "component_id")


def hexadecimal(fp: str) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each near-duplicate group: the one whose doc_id names the group. Repeated rows of that doc_id stay
    (they are one document), and so do rows without a doc_id."""
    found = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct()
    found = cut(found, "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of docs can clash
    return rows.join(found, F.col("row.doc_id") == F.col("gone"), "left_anti").select("row.*")
