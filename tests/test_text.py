import pytest
from pyspark.sql import functions as F

from whinstone.functions import notes as N
from whinstone.functions import text as X


def rows(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").collect()]


def test_tokenize(spark):
    got = rows(spark, ["Hello, v2.0-beta don't stop_now", "会话 TS 框", "", None, "a..b", "A-1_b'c"], X.tokenize("t"))
    assert got[0] == ["hello", "v2.0-beta", "don't", "stop_now"]
    assert got[1] == ["ts", "会", "话", "会话", "框"]
    assert got[2] == got[3] == []
    assert got[4] == ["a", "b"] and got[5] == ["a-1_b'c"]


def test_content_tokens(spark):
    got = rows(spark, ["the word words word 会话持", "a bc"], X.content_tokens(X.tokenize("t")))
    assert got == [["word", "words", "会话", "话持"], []]


def test_white_space(spark):
    odd = "　\x85 \tx y  \x1f"
    assert rows(spark, [odd], X.strip("t")) == [odd.strip()]
    assert rows(spark, [odd], X.squeeze("t")) == ["xy"]
    texts = ["a\r\nb\nc\x0bd\x85e f", "a\n", "", "\n\n", "x"]
    assert rows(spark, texts, X.split_lines("t")) == [t.splitlines() for t in texts]


def test_language_and_buckets(spark):
    assert rows(spark, ["abc", "ab会", "㐀"], X.language("t")) == ["en", "zh", "en"]
    df = spark.createDataFrame([(d,) for d in (0, 2, 3, 10, 11, 50, 51, 9999)], "d int")
    assert [r[0] for r in df.select(X.leak_bucket("d")).collect()] == ["<=2", "<=2", "3-10", "3-10", "11-50", "11-50", ">50", ">50"]
    assert rows(spark, ["7", " ", "x", None], X.lenient_int("t")) == [7, 0, 0, 0]


def test_digest(spark):
    import hashlib

    got = rows(spark, ["ü"], X.digest("t", F.lit(5)))
    assert got == [hashlib.sha1("ü\x1f5\x1f".encode()).hexdigest()[:16]]


NOTE = "---\ntitle: Front\ntags: a, b c\n---\n\nText [[One#h|alias]] and [[Two]] [[One]] #x/y tag#no\n"


@pytest.mark.parametrize(
    "path,raw,title,tags,links",
    [
        ("n.md", NOTE, "Front", ["a", "b", "c", "x/y"], ["One", "Two"]),
        ("d/my.note.md", "no heading", "my.note", [], []),
        ("n.md", "---\ntitle: T\n---\n## Sub\n# First #\n# Second", "First", [], []),
        ("n.md", "---\ntitle: [broken\n---\nbody", "n", [], []),
        ("n.md", "---\ntags: [q, 3]\n---\n#\nbody", "n", ["q", "3"], []),
        ("n.md", "---\r\ntitle: W\r\n---\r\nbody", "W", [], []),
    ],
)
def test_parse(spark, path, raw, title, tags, links):
    row = N.parse_notes(spark.createDataFrame([(path, raw)], "path string, raw string")).first()
    assert (row["title"], row["tags"], row["links"]) == (title, tags, links)
    assert "---" not in row["body"]


def test_read_section(spark):
    raw = "---\na: 1\n---\n# Top\nintro\n## Part One ##x\nbody\n#tag line\nmore\n"
    assert rows(spark, [raw], N.read_section("t", "top")) == ["# Top\nintro"]
    assert rows(spark, [raw], N.read_section("t", "part one ##X")) == ["## Part One ##x\nbody"]
    assert rows(spark, [raw], N.read_section("t", "nothing")) == [None]
    assert rows(spark, [raw], N.read_section("t"))[0].startswith("# Top")
    assert rows(spark, ["x" * 30_000], N.read_section("t")) == ["x" * 20_000]
