import random

import pytest

from whinstone.llm import url_filter as U
from whinstone.llm import queries

#: The rules of the URL query, written out here on their own.
RULES = [
    ("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"),
]


def plain(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


URLS = [
    None, "", "nothing", "http://", "://x", "HTTP://A.B.Com/EN/x", "http://com/en/", "http://xcom/en/", "http://a.example.com/en/712?q#f", "https://example.com/en/6",
    "http://m.example.net/de/8", "http://m.example.net/de/9#/x", "http://m.example.org/es/?a=/b", "http://org?es/", "http://a..com/en/x\ny", "ftp://x.org/es/1://y", "http://É.com/en/",
]


@pytest.mark.parametrize("bound", [None, "MAX_FILTER_BYTES", "MAX_SHAPES"])
def test_against_plain_rules(spark, monkeypatch, bound):
    if bound:
        monkeypatch.setattr(U, bound, 0)
    rng = random.Random(1)
    urls = URLS + [f"http://{rng.choice(['a', 'b.c', 'example'])}.{rng.choice(['com', 'net', 'org', 'example.com'])}/{rng.choice(['en', 'de', 'es'])}/{rng.randint(0, 99)}" for _ in range(300)]
    urls += ["http://hot.com/en/1"] * 200
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    rows = U.judge_urls(pages, rules).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]], RULES), urls[r["page_id"]]


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    row = U.judge_urls(pages, rules.where("false")).first()
    assert (row["rule"], row["verdict"]) == (None, "allow")
    assert U.judge_urls(pages.where("false"), rules).count() == 0


def test_filter_has_no_false_negatives(spark):
    from pyspark.sql import functions as F

    keys = spark.range(2000).select(F.xxhash64("id").alias("h"))
    blocks = 125
    known = U.bloom_filter(keys, blocks)
    probes = spark.range(4000).select("id", F.xxhash64("id").alias("h")).withColumn("block", U._block(F.col("h"), blocks))
    passes = F.lit(True)
    for i in range(8):
        passes &= F.call_function("shiftright", F.col(f"w{i}"), U._word_bit(F.col("h"), i).cast("int")).bitwiseAND(1) == 1
    found = [r["id"] for r in probes.join(known, "block").where(passes).collect()]
    assert set(range(2000)) <= set(found) and len(found) < 2100


def test_the_query_uses_these_rules(spark, tmp_path):
    assert queries.RULES == RULES
    urls = [*URLS, "http://a.net/de/1", "http://net/de/", "http://example.net/de/7", "http://example.net/de/81", "http://b.org/es/" + "x" * 3_000_000]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    rows = queries.op7_url_filter(spark, str(tmp_path)).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain(urls[r["page_id"]], RULES), r["page_id"]


def test_two_fitting_rules_of_one_length(spark):
    """Where the method's rules tie in length, the rule whose text comes last wins, as the docstring says."""
    rules = [("b.com", "/x", "block"), ("com", "/xyz", "allow"), ("b.com", "/x/", "allow")]
    pages = spark.createDataFrame([(1, "http://b.com/xyz"), (2, "http://b.com/x/"), (3, "http://b.com/xy")], "page_id long, url string")
    rows = {r["page_id"]: r["rule"] for r in U.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert rows == {1: max(["b.com/x", "com/xyz"], key=lambda r: (len(r), r)), 2: "b.com/x/", 3: "b.com/x"}
