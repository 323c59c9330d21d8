"""URL rules: a blocked Bloom filter of the listed canonical URLs passes possible hits to an exact hash join.

Everything is DataFrame expressions: no Python runs on the executors.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Odd multipliers of a split-block Bloom filter, one for each 32-bit word of a block (fixed values of the Parquet format).
SALTS = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)
#: A block has 8 words of 32 bits; 16 keys in each set about a third of its bits.
KEYS_PER_BLOCK = 16
#: The filter is broadcast up to this size only (1 GB of list makes about 40 MB of filter); a larger one is joined by block.
MAX_FILTER_BYTES = 64 << 20
#: Distinct (labels, path length) shapes of a list up to which only they are tried for each URL; beyond, all of the URL's own are.
MAX_SHAPES = 4096


def canonical(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where there is no ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _word_bit(h: F.Column, i: int) -> F.Column:
    """The bit of word i that a key with hash h sets: the top five of the low 32 bits of a product (31 bits of h: no overflow)."""
    return F.shiftrightunsigned((h.bitwiseAND(0x7FFFFFFF) * F.lit(SALTS[i])).bitwiseAND(0xFFFFFFFF), 27)


def bloom_filter(keys: DataFrame, blocks: int) -> DataFrame:
    """keys (h: long) as rows (block, words: eight longs of 32 bits), one for each block that has a key."""
    bits = [F.expr(f"bit_or(shiftleft(1L, cast(b{i} as int)))").alias(f"w{i}") for i in range(8)]
    rows = keys.select(_block(F.col("h"), blocks).alias("block"), *[_word_bit(F.col("h"), i).alias(f"b{i}") for i in range(8)])
    return rows.groupBy("block").agg(*bits)


def _block(h: F.Column, blocks: int) -> F.Column:
    return F.pmod(F.shiftright(h, 32), F.lit(blocks))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", unlisted: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict (a clash with such a column of pages: theirs goes).

    rules has columns host, path, verdict. A rule fits its host and that host's subdomains where the URL's path starts with the
    rule's path; the longest rule wins (of equal lengths the one whose text sorts last), and a rule listed twice counts once (the
    smallest verdict). A URL that no rule fits gets null and `unlisted`. Null, empty and malformed URLs have empty host and path and
    fit only a rule of that kind; URLs of any length are judged whole. Rows of pages are never merged or dropped; no rules or no
    pages are fine.

    The list's keys go into a blocked Bloom filter. Each URL is cut into as many candidate keys as the list has shapes (number of
    host labels, length of path); what the filter passes is joined with the list exactly, so false positives end there. URLs are
    taken distinct first, so a hot URL is judged once.
    """
    listed = rules.select(
        F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host is not null and r_path is not null")
    listed = listed.groupBy("r_host", "r_path").agg(F.min("r_verdict").alias("r_verdict"))
    listed = listed.withColumn("h", F.xxhash64("r_host", "r_path"))
    shapes = listed.select(
        F.size(F.split("r_host", r"\.")).alias("k"), F.length("r_path").alias("n")
    ).distinct()
    shapes = [(r["k"], r["n"]) for r in shapes.limit(MAX_SHAPES + 1).collect()]
    host, path = canonical(F.col(f"`{url}`"))
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    whole = pages.select(*[F.col(f"`{c}`") for c in rest], host.alias("host"), path.alias("path"))
    if not shapes:
        return whole.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(unlisted)})

    asked = whole.select("host", "path").distinct()
    labels = F.split("host", r"\.")

    def candidate(k: F.Column, n: F.Column) -> F.Column:
        last = F.slice(labels, F.greatest(F.size(labels) - k + 1, F.lit(1)), k)
        return F.struct(F.array_join(last, ".").alias("r_host"), F.substr("path", F.lit(1), n).alias("r_path"))

    if len(shapes) <= MAX_SHAPES:
        fitting = [
            F.when((F.size(labels) >= k) & (F.length("path") >= n), candidate(F.lit(k), F.lit(n))) for k, n in shapes
        ]
        tried = asked.select("host", "path", F.explode(F.array(*fitting)).alias("c")).where("c is not null")
    else:  # a list of too many shapes: every host suffix with every beginning of the path
        each = asked.select("host", "path", F.explode(F.sequence(F.lit(1), F.size(labels))).alias("k"))
        each = each.select("*", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
        tried = each.select("host", "path", candidate(F.col("k"), F.col("n")).alias("c"))
    tried = tried.select("host", "path", "c.*").withColumn("h", F.xxhash64("r_host", "r_path"))

    blocks = max(1, -(-listed.count() // KEYS_PER_BLOCK))
    passes = F.lit(True)
    for i in range(8):
        passes &= F.call_function("shiftright", F.col(f"w{i}"), _word_bit(F.col("h"), i).cast("int")).bitwiseAND(1) == 1
    known = bloom_filter(listed.select("h"), blocks)
    known = F.broadcast(known) if blocks * 64 <= MAX_FILTER_BYTES else known
    tried = tried.withColumn("block", _block(F.col("h"), blocks)).join(known, "block")
    tried = tried.where(passes).select("host", "path", "r_host", "r_path")
    hits = tried.join(listed, ["r_host", "r_path"])
    best = hits.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("r_host") + F.length("r_path")).alias("n"),
                F.concat("r_host", "r_path").alias("rule"),
                F.col("r_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    return whole.join(best, ["host", "path"], "left").select(
        *[F.col(f"`{c}`") for c in rest], "host", "path", "best.rule", F.coalesce("best.verdict", F.lit(unlisted)).alias("verdict")
    )
