"""One pass over notes for all that is asked of them, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from jobs import compile_eval_set as job
from whinstone.functions.text import content_tokens, tokenize
from whinstone.operators import evalset as E
from whinstone.operators import holdings as H

SIGNS = "abcé一二丁𠀀._'-9 AKİΩß"


def made(seed):
    """Notes with repeated, null and textless rows, and questions of which some are pieces of notes."""
    rng = random.Random(seed)
    words = ["".join(rng.choices(SIGNS, k=rng.randint(1, 14))) for _ in range(80)]
    notes = [(f"n{rng.randint(0, 70)}", " ".join(rng.choices(words, k=rng.randint(0, 25)))) for _ in range(120)]
    notes += [("n3", t) for _, t in notes[:30]] + [("n98", None), (None, "abc a9 b-c"), ("n97", ""), ("n96", "x" * 3000 + "abcabcabcabcabc 一二丁" * 40)]
    pieces = []
    for _, text in rng.sample(notes[:120], 25):
        start = rng.randint(0, len(text) // 2)
        pieces.append(text[start : start + rng.randint(3, 60)])
    asked = [(i, q) for i, q in enumerate([*pieces, *(" ".join(rng.choices(words, k=4)) for _ in range(15)), "", "a b", None, "abcabcabcabc zq", "一二 abc"])]
    return notes, [*asked, (None, "abc a9 b-c")]


@pytest.mark.parametrize("small", [False, True])
def test_holdings_equal_plain_loops(spark, monkeypatch, small):
    if small:
        for name, value in (("QUESTION_BLOCK", 17), ("PIECE_BYTES", 700), ("MARKS", 400), ("BLOCK_DOCS", 9)):
            monkeypatch.setattr(H, name, value)
    notes, asked = made(7 + small)
    df = spark.createDataFrame(notes, "note string, text string").repartition(3)
    questions = spark.createDataFrame(asked, "question_id int, question string")
    found = H.holdings(questions, df, literal=True).cache()
    rows = df.select("note", "text", F.lower("text").alias("low"), tokenize("text").alias("t")).where("note is not null").collect()
    names = {r["note"] for r in rows}
    tokens = {n: {t for r in rows if r["note"] == n for t in r["t"]} for n in names}
    own = {r["question_id"]: (r["q"], r["t"], r["c"]) for r in questions.where("question_id is not null").select("question_id", F.col("question").alias("q"), tokenize("question").alias("t"), content_tokens(tokenize("question")).alias("c")).collect()}
    every = {t for _, ts, _ in own.values() for t in ts}
    held = {t: n for t in every if (n := sum(t in tokens[name] for name in names))}
    within = {t: n for t in every if len(t) >= 2 and (n := len({r["note"] for r in rows if t in (r["low"] or "")}))}
    assert dict(map(tuple, H.token_counts(found, "held").collect())) == held
    counted = dict(map(tuple, H.token_counts(found, "within").collect()))
    assert {t: n for t, n in counted.items() if len(t) >= 2} == within
    assert H.note_count(found).first()[0] == len(names)
    literal = {(q, r["note"]) for q, (text, _, _) in own.items() for r in rows if text is not None and text in (r["text"] or "") and r["text"] is not None}
    got = E.literal(found).collect()
    assert set(map(tuple, got)) == literal and len(got) == len(literal)
    covered = {r["question_id"]: (r["coverage"], r["note"]) for r in E.coverage(questions.where("question_id is not null"), found).collect()}
    for q, (_, _, content) in own.items():
        hits, note = min(((-sum(t in tokens[n] for t in content), n) for n in names), default=(0, ""))
        assert covered[q] == ((round(-hits / len(content), 9), note if hits else "") if content else (1.0, ""))
    found.unpersist()


def test_words_that_go_on_beside_cjk(spark):
    """The last word of a question may go on in a text, also where the question has CJK characters."""
    docs = spark.createDataFrame([(1, "in 学习 notes cover ablest goods"), (2, "an able")], "doc_id int, text string")
    asked = spark.createDataFrame([(7, "学习 notes cover able"), (8, "an ab")], "query_id int, text string")
    assert sorted(map(tuple, E.containment(asked, docs).collect())) == [(7, 1), (8, 2)]


def test_broken_bytes_are_no_error(spark):
    notes = spark.sql("SELECT 1 AS note, CAST(X'616263FF20646566E4B8' AS STRING) AS text UNION ALL SELECT 2, 'abc def'")
    questions = spark.createDataFrame([(1, "abc def")], "question_id int, question string")
    found = H.holdings(questions, notes, literal=True).cache()
    assert dict(map(tuple, H.token_counts(found, "held").collect())) == {"abc": 2, "def": 2} and [tuple(r) for r in E.literal(found).collect()] == [(1, 2)]


def test_no_row_for_a_token_and_a_note(spark):
    """Substrings were counted by joining the distinct runs of all notes: a row for each note, run and token, 32 M on 0.1 GB."""
    notes = spark.createDataFrame([(i, "some text of many words") for i in range(50)], "note int, text string")
    tokens = spark.createDataFrame([("some",), ("ex",)], "token string")
    steps = E.substring_df(tokens, notes)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in steps[steps.index("FlatMapGroupsInArrow") :] and "explode" not in steps
    assert sorted(map(tuple, E.substring_df(tokens, notes).collect())) == [("ex", 50), ("some", 50)]


def test_job_takes_texts_apart_once(spark, tmp_path, monkeypatch):
    asked, read = [], H.holdings
    monkeypatch.setattr(job, "holdings", lambda *a, **k: asked.append(a) or read(*a, **k))
    monkeypatch.setattr(E, "holdings", lambda *a, **k: pytest.fail("once more"))
    sf = "/root/testdata/sf0.001"
    job.compile_eval_set(spark, f"{sf}/documents.parquet", f"{sf}/benchmark.parquet", str(tmp_path))
    assert len(asked) == 1
