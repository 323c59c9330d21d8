"""Hard negatives: exact inner products of integer vectors, with pairs discarded early by partial products in a rotated basis.

A vector's numbers x become floor(256 x). An orthogonal basis of a sample's principal components puts most of an inner product into
its leading terms; what the others can add is at most the product of the two residual norms. A pair whose partial product plus or
minus that bound (and a slack for rounding) can't reach what is wanted is discarded; the rest is settled by integer products.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whinstone.llm.common import cut

#: Rows and anchors that meet in one cell of the grid, at up to 64 numbers a vector; of longer vectors, fewer by the same factor.
CELL = 2048
#: The basis is fitted to at most so many rows, and so many numbers in all; it decides how early pairs go, never which rows are found.
SAMPLE_ROWS, SAMPLE_NUMBERS = 8192, 1 << 21
#: Vectors of more numbers keep their own coordinates, which are an orthogonal basis as well.
MOST_ROTATED = 1024
#: Shares of the sample's squared length after which a pair is judged.
STAGES = (0.5, 0.85)
#: Pairs whose numbers a task holds at a time.
PAIRS = 1 << 16
#: Squared lengths of integer vectors up to which a hundred times a score fits 64 bits: rows beyond take no part.
MOST_SQUARED = 2.0**56


def integer_vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """floor(256 x) of list columns of one length, as rows of int64."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(flat * 256).astype(np.int64).reshape(len(whole), -1)


def principal_basis(sample: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The sample's principal directions as columns, the strongest first, and after how many of them STAGES are reached."""
    power, basis = np.linalg.eigh(sample.T.astype(np.float64) @ sample)
    share = np.cumsum(power[::-1]) / max(power.sum(), 1e-300)
    return np.ascontiguousarray(basis[:, ::-1]), [int(np.searchsorted(share, s)) + 1 for s in STAGES]


class Rotated:
    """Integer vectors, their coordinates in a basis, and the norms of what is left after each stage."""

    def __init__(self, whole: np.ndarray, basis: np.ndarray | None, stops: list[int]):
        self.whole = whole
        self.turned = whole.astype(np.float64) if basis is None else whole @ basis
        self.rest = [np.sqrt((self.turned[:, c:] ** 2).sum(axis=1)) for c in stops]
        self.norm = np.sqrt((self.turned**2).sum(axis=1))

    def some(self, at: slice) -> Rotated:
        out = object.__new__(Rotated)
        out.whole, out.turned, out.norm, out.rest = self.whole[at], self.turned[at], self.norm[at], [r[at] for r in self.rest]
        return out


def exact_products(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of rows i of a with rows j of x, some PAIRS at a time."""
    out = np.empty(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        s = slice(at, at + PAIRS)
        out[s] = np.einsum("ij,ij->i", a[i[s]], x[j[s]])
    return out


def surviving_pairs(a: Rotated, x: Rotated, stops: list[int], low: np.ndarray, high: np.ndarray, allowed: np.ndarray):
    """Pairs (i, j) that are allowed and whose product may be between low[i] and high[i]: none that is goes missing."""
    d = a.whole.shape[1]
    slack = 8.0 * d * d * np.finfo(float).eps
    first = stops[0]
    part = a.turned[:, :first] @ x.turned[:, :first].T
    bound = a.rest[0][:, None] * x.rest[0] + slack * a.norm[:, None] * x.norm
    i, j = np.nonzero(allowed & (part + bound >= low[:, None]) & (part - bound <= high[:, None]))
    part = part[i, j]
    for stage, (start, stop) in enumerate(zip(stops, stops[1:], strict=False), 1):
        for at in range(0, len(i), PAIRS):
            s = slice(at, at + PAIRS)
            part[s] += np.einsum("ij,ij->i", a.turned[i[s], start:stop], x.turned[j[s], start:stop])
        bound = a.rest[stage][i] * x.rest[stage][j] + slack * a.norm[i] * x.norm[j]
        keep = (part + bound >= low[i]) & (part - bound <= high[i])
        i, j, part = i[keep], j[keep], part[keep]
    return i, j


def first_copies(vectors: np.ndarray, labels: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Rows but for those of which `most` with the same vector and label and a smaller id are there: as scores tie by id, no list of
    `most` - 1 others can hold them. A hot vector's copies so cost a cell no more than `most` rows."""
    keyed = np.ascontiguousarray(np.column_stack([vectors, np.unique(labels, return_inverse=True)[1]]))
    kind = np.unique(keyed.view(np.dtype((np.void, keyed.itemsize * keyed.shape[1]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort([ids, kind])
    starts = np.flatnonzero(np.append(True, kind[order][1:] != kind[order][:-1]))
    nth = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[nth < most])


def best_of_each(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each owner's k best: by score, the highest first, then by id."""
    order = np.lexsort([ids, -score, owner])
    own = owner[order]
    starts = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, np.int64)
    nth = np.arange(len(own)) - np.repeat(starts, np.diff(np.append(starts, len(own))))
    return order[nth < k]


def _cell(basis: dict, k: int):
    """What a cell's two sides have in common: rows (without needless copies), anchors, and both rotated."""

    def sides(table: pa.Table):
        anchor = table.column("is_anchor").to_numpy()
        d = table.column("d")[0].as_py()
        turn, stops = basis.get(d) or (None, [max(1, d // 4), max(1, d // 2)])
        names = {c: table.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row", "label")}
        whole = integer_vectors(table.column("embedding"))
        rows, asked = np.flatnonzero(~anchor), np.flatnonzero(anchor)
        rows = rows[first_copies(whole[rows], names["label"][rows], names["vec_id"][rows], k + 1)] if len(rows) else rows
        a, x = (Rotated(whole[at], turn, stops) for at in (asked, rows))
        return asked, rows, a, x, stops, names

    return sides


def _positives(basis: dict, k: int):
    sides = _cell(basis, k)

    def run(table: pa.Table) -> pa.Table:
        asked, rows, a, x, stops, names = sides(table)
        found = []
        step = max(1, 16 * PAIRS // max(1, len(rows)))
        for at in range(0, len(asked) if len(rows) else 0, step):
            part, b = asked[at : at + step], a.some(slice(at, at + step))
            allowed = names["vec_id"][part][:, None] != names["vec_id"][rows]
            low = np.full(len(part), -np.inf)
            if len(rows) > k:  # the k-th best of the k + 1 most promising ones is a score that the k-th best of all reaches
                part_product = np.where(allowed, b.turned[:, : stops[0]] @ x.turned[:, : stops[0]].T, -np.inf)
                seed = np.argpartition(-part_product, k, axis=1)[:, : k + 1]
                seeded = exact_products(b.whole, x.whole, np.repeat(np.arange(len(part)), k + 1), seed.ravel()).reshape(seed.shape).astype(float)
                seeded[~np.take_along_axis(allowed, seed, 1)] = -np.inf
                low = -np.sort(-seeded, axis=1)[:, k - 1]
            i, j = surviving_pairs(b, x, stops, low, np.full(len(part), np.inf), allowed)
            score = exact_products(b.whole, x.whole, i, j)
            best = best_of_each(i, score, names["vec_id"][rows][j], k)
            found.append((part[i[best]], rows[j[best]], score[best]))
        i, j, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        return pa.table(
            {"anchor_id": names["vec_id"][i], "row": names["row"][i], "positive_id": names["vec_id"][j], "positive_score": score.astype(np.int64)}
        )

    return run


def _negatives(basis: dict, k: int, floor: int):
    sides = _cell(basis, k)

    def run(table: pa.Table) -> pa.Table:
        asked, rows, a, x, stops, names = sides(table)
        positives = table.column("positives").to_pylist()
        slots = [positives[i] for i in asked]
        found = []
        step = max(1, 16 * PAIRS // max(1, len(rows)))
        for at in range(0, len(asked) if len(rows) else 0, step):
            part, b = asked[at : at + step], a.some(slice(at, at + step))
            scores = [[p["score"] for p in s] for s in slots[at : at + step]]
            low = np.array([min(s) * floor / 100 for s in scores]) - 1
            high = np.array([max(s) for s in scores], np.float64)
            allowed = names["label"][part][:, None] != names["label"][rows]
            i, j = surviving_pairs(b, x, stops, low, high, allowed)
            score = exact_products(b.whole, x.whole, i, j)
            width = max(len(s) for s in scores)
            for slot in range(width):
                top = np.array([s[slot] if slot < len(s) else -1 for s in scores], np.int64)[i]
                fits = np.flatnonzero((top >= 0) & (floor * top <= 100 * score) & (score <= top))
                best = fits[best_of_each(i[fits], score[fits], names["vec_id"][rows][j[fits]], k)]
                found.append((part[i[best]], np.full(len(best), slot), rows[j[best]], score[best], at + i[best]))
        i, slot, j, score, place = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 5
        owner = [slots[p][s] for p, s in zip(place.tolist(), slot.tolist(), strict=True)]
        return pa.table(
            {
                "anchor_id": names["vec_id"][i], "row": names["row"][i], "slot": slot.astype(np.int32),
                "positive_id": pa.array([p["id"] for p in owner], pa.int64()), "positive_score": pa.array([p["score"] for p in owner], pa.int64()),
                "negative_id": names["vec_id"][j], "negative_score": score.astype(np.int64),
            }
        )

    return run


def _grid(rows: DataFrame, anchors: DataFrame, by: list[str], name: str) -> DataFrame:
    """Both sides dealt to cells: rows of a key in blocks of about CELL, anchors of that key too, each block of one side with each of
    the other. A hot key only has more cells; keys that one side lacks have none."""
    blocks = lambda n: F.ceil(n * F.greatest(F.col("d"), F.lit(64)) / (64.0 * CELL)).cast("int")
    sizes = rows.groupBy(*by).agg(blocks(F.count("*")).alias("rows"))
    asked = anchors.groupBy(*by).agg(blocks(F.count("*")).alias("anchors"))
    plan = cut(sizes.join(asked, by), name)
    nothing = [F.lit(None).cast(dict(anchors.dtypes)[c]).alias(c) for c in anchors.columns if c not in rows.columns]
    cell = lambda n: F.pmod(F.xxhash64("vec_id", "row"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.select("*", *nothing).join(plan, by).withColumn("r", cell("rows")).withColumn("a", each("anchors"))
    right = anchors.join(plan, by).withColumn("a", cell("anchors")).withColumn("r", each("rows"))
    both = left.withColumn("is_anchor", F.lit(False)).unionByName(right.withColumn("is_anchor", F.lit(True)))
    return both.drop("rows", "anchors").groupBy(*by, "r", "a")


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, floor: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (a row of `vectors` that the
    condition `anchors` on vec_id or label holds for) its first `positives` other rows of the same label, and for each of them the
    first `negatives` rows of another label whose score is between floor % of the positive's and the positive's own.

    vectors has vec_id, embedding, label. A score is the integer product of vectors of floor(256 x); higher ones come first, ties by
    the smaller vec_id. Rows take no part if vec_id, label or embedding is null, a number in it is null or not finite, or the squared
    length of the integer vector is MOST_SQUARED or more (numbers about a million). Rows of different lengths have no score. Equal
    rows count once; rows that share a vec_id but differ are rows of their own, and none of them is a positive of another. An anchor
    without positives, or a positive below zero, gives no rows; an empty table none either. Other columns, whatever their names, are
    ignored.

    Rows and anchors meet in cells of a grid, so no task holds more than a cell, and each sends the few best of each list.
    """
    squared = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") * 256, F.lit(2)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").where("vec_id is not null and label is not null")
    rows = rows.where(squared < MOST_SQUARED)  # which null, infinite and undefined numbers fail too
    rows = rows.distinct().withColumns({"d": F.size("embedding"), "row": F.xxhash64("vec_id", "label", "embedding")})
    rows = cut(rows, "negative-rows")

    basis: dict = {}
    usual = rows.where("d > 0").groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if usual and usual["d"] <= MOST_ROTATED:
        some = rows.where(F.col("d") == usual["d"]).orderBy("row").limit(max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // usual["d"])))
        basis[usual["d"]] = principal_basis(integer_vectors(some.select("embedding").toArrow().column("embedding")))

    asked = rows.where(anchors)
    kinds = "anchor_id long, row long, positive_id long, positive_score long"
    found = _grid(rows, asked, ["d", "label"], "positive-cells").applyInArrow(_positives(basis, positives), kinds)
    nth = Window.partitionBy("anchor_id", "row").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("nth", F.row_number().over(nth)).where(F.col("nth") <= positives).where("positive_score >= 0")
    own = found.groupBy("anchor_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("nth", F.col("positive_id").alias("id"), F.col("positive_score").alias("score")))).alias("positives")
    )
    own = cut(own.withColumnRenamed("anchor_id", "vec_id"), "positives")
    asked = asked.join(own, ["vec_id", "row"])

    kinds = "anchor_id long, row long, slot int, positive_id long, positive_score long, negative_id long, negative_score long"
    found = _grid(rows, asked, ["d"], "negative-cells").applyInArrow(_negatives(basis, negatives, floor), kinds)
    nth = Window.partitionBy("anchor_id", "row", "slot").orderBy(F.desc("negative_score"), "negative_id")
    return (
        found.withColumn("rank", F.row_number().over(nth))
        .where(F.col("rank") <= negatives)
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
