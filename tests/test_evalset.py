import hashlib

import pytest
from pyspark.sql import functions as F

from whinstone.operators import evalset as V
from whinstone.operators.retrieval import Retriever, best_per_note


def notes(spark):
    rows = [("n1", "session state is kept on disk"), ("n2", "birds migrate south in winter"), ("n3", "session birds")]
    return spark.createDataFrame(rows, "note string, text string")


def test_coverage_and_leaks(spark):
    q = spark.createDataFrame([(1, "Session state disk?", "n1"), (2, "a b", "n2"), (3, "unheard topics", "n2"), (4, "birds session", "n3")], "question_id int, question string, note string")
    got = {r["question_id"]: (r["coverage"], r["note"]) for r in V.best_note_coverage(q, notes(spark)).collect()}
    assert got == {1: (1.0, "n1"), 2: (1.0, ""), 3: (0.0, ""), 4: (1.0, "n3")}
    assert [r["question_id"] for r in V.negative_gate(q, notes(spark)).collect()] == [3]
    leak = {r["question_id"]: (r["leak_token"], r["leak_min_df"], r["leak"]) for r in V.leak_min_df(q, notes(spark)).collect()}
    assert leak == {1: ("disk", 1, True), 2: ("", 3, False), 3: ("", 3, False), 4: ("birds", 2, True)}
    rare = {r["question_id"]: (r["token"], r["df"]) for r in V.keyword_rarity(q, notes(spark)).collect()}
    assert rare[1] == ("disk", 1) and rare[3] == ("topics", 0) and rare[2] == ("", 3)


def test_candidate_rules(spark):
    rows = [
        ("f", 0, "n1", "Where is session state kept?", "session state is kept", "easy"),
        ("f", 1, "n9", "Where is session state kept?", "session state is kept", "easy"),
        ("f", 2, "n1", "Short?", "session state is kept", "easy"),
        ("f", 3, "n1", "What does this note say?", "session state is kept", "easy"),
        ("f", 4, "n1", "Where is state kept then?", "tiny", "easy"),
        ("f", 5, "n1", "Where is state kept then?", "session state was lost", "easy"),
        ("f", 6, "n1", "Where is state kept then?", "session  state\nis kept", "brutal"),
        ("g", 0, "n1", "Where is  session state kept?", "session state is kept", "hard"),
        ("g", 1, "dup", "Where is session state kept?", "session state is kept", "hard"),
    ]
    both = notes(spark).union(spark.createDataFrame([("dup", "x"), ("dup", "y")], "note string, text string"))
    gated = V.gate_candidates(spark.createDataFrame(rows, "file string, pos int, note string, question string, answer_span string, difficulty string"), both)
    got = [r["drop_reason"] for r in gated.orderBy("file", "pos").collect()]
    assert got == [
        None, "note_missing", "question_length", "meta_question", "span_length", "span_not_in_note", "bad_difficulty", "duplicate_question", "ambiguous_note",
    ]
    assert {r["reason"]: r["n"] for r in V.count_reasons(gated).collect()}["kept"] == 1
    assert V.numbered(gated.where("drop_reason is null"), "q", "note").first()["id"] == "q0001"


def test_names_and_twins(spark):
    names = ["a__00000000.md", "a.zh__11111111.md", "b__22222222.md", "odd.md"]
    got = {r["note"]: r["twin"] for r in V.twins(spark.createDataFrame([(n,) for n in names], "note string")).collect()}
    assert got == {names[0]: names[1], names[1]: names[0], names[2]: "", "odd.md": ""}
    df = spark.createDataFrame([("a/b c/./d!/e/f.g.md", "ab" * 20), ("___.md", "cd" * 20)], "p string, s string")
    assert [r[0] for r in df.select(V.flat_name(F.col("p"), F.col("s"))).collect()] == ["b_c__d__e__f.g__abababab.md", "note__cdcdcdcd.md"]


def test_dedup_and_fingerprints(spark):
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id int, text string")
    assert sorted(r["doc_id"] for r in V.first_of_content(docs, "doc_id").collect()) == [1, 2]
    shas = sorted(hashlib.sha1(t.encode()).hexdigest() for t in "xxy")
    assert V.fingerprint(docs).first()[0] == hashlib.sha1("".join(shas).encode()).hexdigest()
    files = spark.createDataFrame([("b", 10), ("a", 2)], "name string, size int")
    assert V.sample_fingerprint(files).first()[0] == hashlib.sha1(b"a2b10").hexdigest()


@pytest.mark.parametrize("n,limit", [(10, 3), (97, 10), (5, 9)])
def test_strides(spark, n, limit):
    docs = spark.range(n).select((F.col("id") * 3).alias("doc_id")).repartition(4)
    got = sorted(r["doc_id"] for r in V.stride_uniform(docs, limit, "doc_id").collect())
    assert got == ([3 * int(i * n / limit) for i in range(limit)] if n > limit else [3 * i for i in range(n)])
    if n < limit:
        with pytest.raises(ValueError):
            V.stride_integer(docs, limit, "doc_id")
    else:
        got = sorted(r["doc_id"] for r in V.stride_integer(docs, limit, "doc_id").collect())
        assert got == [3 * i for i in range(0, n, max(1, n // limit))][:limit]


def test_strides_with_other_columns(spark):
    """Many ranges, shuffled rows and columns beside the key, against a plain sort."""
    n = 400_000
    docs = spark.range(n).selectExpr("(id * 7919) % 400000 AS doc_id", "concat('t', id) AS text", "id AS more").repartition(7, "text")
    got = sorted((r["doc_id"], r["text"], r["more"]) for r in V.stride_uniform(docs, 1000, "doc_id").collect())
    assert [g[0] for g in got] == [int(i * n / 1000) for i in range(1000)]
    assert all(text == f"t{more}" and more * 7919 % n == key for key, text, more in got)
    assert sorted(r["doc_id"] for r in V.stride_integer(docs, 300, "doc_id").collect()) == [i * (n // 300) for i in range(300)]


def test_keyword_rarity_without_tokens(spark):
    notes = spark.createDataFrame([("a", "some text"), ("b", "more")], "note string, text string")
    asked = spark.createDataFrame([(1, "?!"), (2, "some more"), (3, "text")], "question_id int, question string")
    got = {r["question_id"]: (r["token"], r["df"]) for r in V.keyword_rarity(asked, notes).collect()}
    assert got == {1: ("", 2), 2: ("more", 1), 3: ("text", 1)}


def test_pools_and_checks(spark):
    files = spark.createDataFrame([("a", 5000, "text"), ("b", 10, "text"), ("c", 5000, "会")], "name string, size int, text string")
    assert [r["name"] for r in V.pool(files, "en", 100).collect()] == ["a"]
    assert V.pool(files, None, 0, files.where("name = 'a'")).count() == 2
    labels = spark.createDataFrame([("x",), ("y",)], "note_path string")
    with pytest.raises(ValueError):
        V.require_indexed(labels, labels.where("note_path = 'x'"))
    V.require_indexed(labels, labels)
    parts = spark.createDataFrame([("n", 2, "two"), ("n", 1, "one")], "note_path string, pos int, text string")
    assert V.concat_notes(parts, "pos").first()["text"] == "one\n\ntwo" and V.concat_notes(parts, "pos", most=4).first()["text"] == "one\n"


def test_containment(spark):
    docs = spark.createDataFrame([(1, "so alpha beta gamma delta end"), (2, "xalpha beta gamma deltay"), (3, "alpha beta delta gamma")], "doc_id int, text string")
    q = spark.createDataFrame([(7, "alpha beta gamma delta"), (8, "not in there at all")], "query_id int, text string")
    assert sorted(map(tuple, V.containment(q, docs).collect())) == [(7, 1), (7, 2)]


def test_hydration_and_notes(spark):
    chunks = spark.createDataFrame([("c1", "n1", "T", ["A"], "text")], "id string, note_path string, title string, heading_path array<string>, text string")
    ranked = spark.createDataFrame([("q", "c1", 1.0, 1), ("q", "zz", 0.5, 2)], "query_id string, doc_id string, score double, rank int")
    got = {r["doc_id"]: (r["note_path"], r["heading_path"]) for r in Retriever(chunks).hydrate(ranked).collect()}
    assert got == {"c1": ("n1", ["A"]), "zz": ("", [])}
    hits = spark.createDataFrame([("q", "a", "n", 1), ("q", "b", "n", 2), ("q", "c", "m", 3), ("q", "d", "", 4)], "query_id string, doc_id string, note_path string, rank int")
    assert [(r["doc_id"], r["rank"]) for r in best_per_note(hits, 5).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
