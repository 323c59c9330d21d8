"""Global order without one task that sees it all: rows are dealt to ranges of the order, places come from counts of the ranges before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A range holds about so many rows, but there are no more ranges than RANGES.
RANGE_ROWS, RANGES = 50_000, 512


def range_of(rows: DataFrame, order: Sequence[str], n: int) -> Column:
    """An expression: which range of the order (ascending, nulls first) a row of `rows` (n of them) belongs to.

    The bounds are values, from a bounded sample, so a row's range is the same wherever and whenever it is worked out. Rows that agree
    in all columns of the order share a range.
    """
    wanted = min(RANGES, n // RANGE_ROWS + 1)
    if wanted < 2:
        return F.lit(0)
    keys = rows.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order)])
    sample = keys.sample(min(1.0, 100 * wanted / n), seed=7) if n > 100 * wanted else keys
    # nulls sort before everything else, here as in the session
    found = sorted({tuple(r) for r in sample.limit(200 * wanted).collect()}, key=lambda r: [(v is not None, v) for v in r])
    bounds = dict.fromkeys(found[i * len(found) // wanted] for i in range(1, wanted)) if found else {}
    if not bounds:
        return F.lit(0)
    kinds = [t for _, t in keys.dtypes]
    named = lambda values: F.struct(*[v.cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(values, kinds, strict=True))])
    own = named([F.col(c) for c in order])
    return F.size(F.filter(F.array(*[named([F.lit(v) for v in b]) for b in bounds]), lambda b: b <= own))


def placed(rows: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """rows (n of them) with _place, from 1 in the global order; rows that agree in the whole order share neighbouring places."""
    ranged = rows.withColumn("_part", range_of(rows, order, n))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n"))
    before = sizes.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))  # RANGES rows at most
    return ranged.withColumn("_in", within).join(before, "_part").withColumn("_place", F.col("_in") + F.col("_before")).drop("_in", "_part", "_before")


def running_total(counts: DataFrame, by: Sequence[str], order: str, count: str, name: str) -> DataFrame:
    """counts with `name`: the sum of `count` over the rows of the same `by` up to this one in the order."""
    n = counts.count()
    ranged = counts.withColumn("_part", range_of(counts, [order], n))
    within = F.sum(count).over(Window.partitionBy(*by, "_part").orderBy(order))
    sums = ranged.groupBy(*by, "_part").agg(F.sum(count).alias("_sum"))
    # of each `by` one row a range
    before = sums.select(*by, "_part", (F.sum("_sum").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_sum")).alias("_before"))
    ranged = ranged.withColumn("_within", within)
    joined = join_null_safe(ranged, before, [*by, "_part"])
    return joined.select(*counts.columns, (F.col("_within") + F.col("_before")).alias(name))


def join_null_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """The inner join on columns of one name where null equals null; left's columns, then right's others."""
    renamed = right.withColumnsRenamed({c: f"_of_{c}" for c in on})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in on]
    return left.join(renamed, same).drop(*[f"_of_{c}" for c in on])
