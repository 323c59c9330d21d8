"""What the operators share: the shared folder, cutting lineage, sorted-bucket linking and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset in local mode (tests) one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="whinstone-"))
    return f"file://{_own_folder[0]}"


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder with the file system that it belongs to."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a folder when it ends."""
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: the lineage ends there, and a lost executor costs a file read.

    The table is deleted when the driver's JVM ends (or by release()).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/whinstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._whinstone_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that no later plan reads."""
    path = getattr(df, "_whinstone_path", None)
    if path:
        drop_path(df.sparkSession, path)


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast: extra columns, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{name}`").cast(kind).alias(name) for name, kind in kinds.items()])


def binary_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


# --- linking inside buckets -------------------------------------------------------------------------------------------


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[list[np.ndarray | list]]:
    """From batches sorted by keys: pieces that hold whole runs of equal keys, as one array (or list) per column."""
    kept: list | None = None
    names: list[str] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        names = batch.schema.names
        cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(kept, cols, strict=True)]
        at = [names.index(k) for k in keys]
        same = np.ones(len(cols[0]), bool)
        for i in at:
            same &= cols[i] == cols[i][-1]
        last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        kept = [c[last:] for c in cols]
        if last:
            yield [c[:last] for c in cols]
    if kept is not None and len(kept[0]):
        yield kept


def run_bounds(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)


def spanning_edges(n: int, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the graph over 0..n-1 whose edges linked(i, others) tells: at most n-1 edges, never all pairs.

    Each node is compared once, with those not reached before it, so a dense group costs about n comparisons.
    """
    left = np.arange(n)
    edges: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            hit = linked(i, left)
            if hit.any():
                found = left[hit]
                edges += [(i, int(j)) for j in found]
                queue += found.tolist()
                left = left[~hit]
    return edges


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts that pairs (a, b) join, as edges from each id to the smallest of its part: what a task sends of all it has linked."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))
    for i, j in zip(code[: len(a)].tolist(), code[len(a) :].tolist(), strict=True):
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[max(i, j)] = min(i, j)
    top = np.array(root, np.int64)
    while len(top) and not np.array_equal(up := top[top], top):
        top = up
    own = np.arange(len(nodes))
    return nodes[own != top], nodes[top[own != top]]


# --- connected components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Columns node, component (the smallest node reachable) for every node of edges (a, b: long).

    Alternating large and small stars: every round is two aggregations and two joins, rounds grow with the logarithm of the
    longest path, and after each one the lineage is cut by a table in the shared folder. Nothing but two sums comes to the driver.
    """
    now = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .distinct()
        )
        after = cut(small, "edges")
        release(now)
        was, now, mark = mark, after, _mark(after)
        if mark == was:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("h"), F.expr("sum(cast(b as decimal(38,0)))").alias("s")
    ).first()
    return row["n"] or 0, row["h"], row["s"]


# --- exact linking of rows that share a bucket --------------------------------------------------------------------------

#: Rows of one bucket that one task links at a time; buckets with more are salted.
BUCKET_ROWS = 8192


def salted(rows: DataFrame, hot: DataFrame | None) -> DataFrame:
    """rows with a column salt: 0, or for keys in hot (key, salts) one of `salts`, by the row's id."""
    if hot is None:
        return rows.withColumn("salt", F.lit(0))
    return rows.join(hot, "key", "left").withColumn(
        "salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).otherwise(0)
    ).drop("salts")


def hot_keys(counts: DataFrame, bucket_rows: int) -> DataFrame | None:
    """From counts (key, n): the keys with more than bucket_rows rows and how many salts each gets; None if there are none."""
    hot = cut(
        counts.where(F.col("n") > bucket_rows).select("key", F.ceil(F.col("n") / bucket_rows).cast("int").alias("salts")), "hot"
    )
    return None if hot.isEmpty() else hot


def unsettled(rows: DataFrame, hot: DataFrame, settled: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """What salting has left open: rows of hot buckets that hold more than one component of `settled` (node, component).

    Gives (minority, all): every bucket's rows outside its most frequent component, and all of its rows. A link between two components
    has an end in the minority, so comparing these two sides by (key, salt, block) loses none, and a bucket whose rows are already one
    component costs nothing more. The two are laid out as a grid: a row of all has one salt, one of the minority one of as many blocks
    as hold bucket_rows of it, and each goes to every cell of its line, so no cell has more than about bucket_rows rows of either side,
    also where nothing in a bucket is linked. A minority within one block isn't split, and all rows then move once.
    """
    mine = salted(rows.join(hot.select("key"), "key", "left_semi"), hot)
    mine = mine.join(settled, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    mine = cut(mine.drop("node"), "hot-rows")
    per = mine.groupBy("key", "component").agg(F.count("*").alias("n"))
    most = per.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("c"), (F.sum("n") - F.max("n")).alias("rest")
    )
    most = cut(most.where("c > 1").select("key", "most", F.ceil(F.col("rest") / bucket_rows).alias("blocks")), "hot-most")
    open_rows = mine.join(most, "key")
    minority = open_rows.where("component <> most").drop("salt").join(hot, "key")
    minority = minority.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")))
    minority = minority.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    everything = cut(open_rows.drop("most"), "hot-open")
    everything = everything.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return minority.drop("salts", "most", "blocks"), everything.drop("blocks")


# --- words ------------------------------------------------------------------------------------------------------------

#: A-Z to a-z, byte by byte: no other UTF-8 byte changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TEXT_BLOCK = 1 << 20


def text_blocks(text: bytes, size: int = TEXT_BLOCK) -> Iterator[bytes]:
    """The text in blocks that end at white space, so that a huge text never becomes one huge list of words."""
    start, space = 0, b" \t\n\r\x0b\x0c"
    while len(text) - start > size:
        at = start + size
        while at < len(text) and text[at] not in space:
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


# --- edit distance ----------------------------------------------------------------------------------------------------


def common_ends(a: str, b: str) -> tuple[int, int]:
    """With how many characters a and b both begin, and with how many of the rest they both end."""
    lo, most = 0, min(len(a), len(b))
    while lo < most:
        mid = (lo + most + 1) // 2
        if a.startswith(b[lo:mid], lo):
            lo = mid
        else:
            most = mid - 1
    hi, most = 0, min(len(a), len(b)) - lo
    while hi < most:
        mid = (hi + most + 1) // 2
        if a.endswith(b[len(b) - mid : len(b) - hi], 0, len(a) - hi):
            hi = mid
        else:
            most = mid - 1
    return lo, hi


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance of a and b, or most + 1 where it is larger. Common ends are cut off first; the rest is Myers' bit-parallel
    recurrence, with the rows of a column that a path of cost `most` can pass as two integers. What lies beyond these rows counts too
    much, which no such path sees. The distance never falls along a diagonal, so the one that ends in the corner tells when to stop."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    lo, hi = common_ends(a, b)
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b)
    m, n = len(a), len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    # of a short column all rows cost no more
    least, highest = ((m - n - most) // 2, (m - n + most + 1) // 2) if m > 256 else (-n, m)
    step = max(16, min(m, most) // 4)
    pv = mv = base = lo = hi = 0
    for j in range(0, n, step):
        end = min(n, j + step)
        drop = max(0, j + least) - lo  # rows lo + 1 to hi; base is the distance at row lo
        if drop:
            low = (1 << drop) - 1
            base += (pv & low).bit_count() - (mv & low).bit_count()
            pv, mv, lo = pv >> drop, mv >> drop, lo + drop
        top = min(m, end + highest)
        pv |= ((1 << (top - hi)) - 1) << (hi - lo)
        hi = top
        full = (1 << (hi - lo)) - 1
        get = (peq if full >> m - 1 else {c: peq[c] >> lo & full for c in set(b[j:end]) if c in peq}).get
        for c in b[j:end]:  # bits beyond `full` are never looked at, and cut off below
            eq = get(c, 0)
            d = (((eq & pv) + pv) ^ pv) | eq | mv
            ph = (mv | (full ^ (d | pv))) << 1 | 1
            pv, mv = (d & pv) << 1 | (full ^ (d | ph)), ph & d
        pv &= full
        mv &= full
        base += end - j
        if (row := end + m - n - lo) >= 0:
            low = (1 << row) - 1
            score = base + (pv & low).bit_count() - (mv & low).bit_count()
            if score > most:
                return most + 1
    return score
