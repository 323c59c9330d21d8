import logging

from pyspark.sql import functions as F

from jobs import compile_eval_set as J

NOTES = [
    (1, "The harbour wall was rebuilt after the storm, and quayside cranes came back in spring. 鸟类迁徙"),
    (2, "Quayside cranes came back in spring, says another note about harbours."),
    (3, "Nothing of that: only tides and ledgers and lanterns."),
    (3, "Nothing of that: only tides and ledgers and lanterns."),
    (4, None),
]
QUESTIONS = [
    (10, "cranes came back in spring"), (11, "cranes  came back in\nspring"), (12, "ledgers and lanterns."), (13, "two words"), (14, "lanterns ledgers tides"),
    (15, "who painted the observatory ceiling"), (16, None), (None, "a question without an id"), (17, "鸟类迁徙"), (18, "where zebras sleep tonight"), (10, "cranes came back in spring"),
]


def tables(spark, folder, notes=NOTES, questions=QUESTIONS):
    spark.createDataFrame(notes, "doc_id long, text string").withColumn("reason", F.lit("x")).write.parquet(f"{folder}/notes")
    spark.createDataFrame(questions, "item_id long, text string").withColumn("note", F.lit(1)).write.parquet(f"{folder}/questions")
    return f"{folder}/notes", f"{folder}/questions", f"{folder}/target"


def result(spark, target):
    rows = [r.asDict() for r in J.read_questions(spark, target).orderBy("id").collect()]
    report = sorted(tuple(r) for r in J.read_report(spark, target).select("section", "key", "n").collect())
    return rows, report


def test_set_and_report(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO, "jobs")
    notes, questions, target = tables(spark, str(tmp_path))
    done = J.compile_eval_set(spark, notes, questions, target)
    assert done == {"kept": 5, "duplicate_question": 1, "too_short": 1, "covered": 1}
    assert "read 8 questions; 1 covered, 1 duplicate_question, 5 kept, 1 too_short" in caplog.text
    rows, report = result(spark, target)
    assert [(r["id"], r["question_id"], r["note"], r["relevant_notes"], r["answerable"], r["lang"]) for r in rows] == [
        ("n0001", "18", None, {}, False, "en"), ("n0002", "15", None, {}, False, "en"), ("q0001", "10", "1", {"1": 2.0, "2": 1.0}, True, "en"),
        ("q0002", "17", "1", {"1": 2.0}, True, "zh"), ("q0003", "12", "3", {"3": 2.0}, True, "en"),
    ]
    by = {r["id"]: r for r in rows}
    assert (by["q0001"]["leak_token"], by["q0001"]["leak_min_df"], by["q0001"]["bucket"]) == ("back", 2, "<=2")
    assert (by["q0003"]["rare_token"], by["q0003"]["rare_df"]) == ("lanterns", 1)
    assert by["n0001"]["bucket"] is None and not by["n0001"]["leak"] and by["n0001"]["rare_df"] == 0
    assert report == [
        ("answerable", "false", 2), ("answerable", "true", 3), ("lang", "en", 4), ("lang", "zh", 1), ("leak", "<=2", 3), ("questions_of_a_note", "1", 1),
        ("questions_of_a_note", "2", 1), ("reason", "covered", 1), ("reason", "duplicate_question", 1), ("reason", "kept", 5), ("reason", "too_short", 1),
    ]
    assert {p.name for p in (tmp_path / "target" / "questions").iterdir() if p.is_dir()} == {"answerable=true", "answerable=false"}


def test_running_again_replaces_all(spark, tmp_path):
    notes, questions, target = tables(spark, str(tmp_path))
    J.compile_eval_set(spark, notes, questions, target)
    first = result(spark, target)
    J.compile_eval_set(spark, notes, questions, target)
    assert result(spark, target) == first
    # fewer questions: no partition of the larger set stays
    spark.createDataFrame([(12, "ledgers and lanterns.")], "item_id long, text string").write.mode("overwrite").parquet(questions)
    assert J.compile_eval_set(spark, notes, questions, target) == {"kept": 1}
    rows, report = result(spark, target)
    assert [r["id"] for r in rows] == ["q0001"] and ("answerable", "false", 2) not in report


def test_no_questions_and_no_notes(spark, tmp_path):
    notes, questions, target = tables(spark, str(tmp_path / "a"), questions=[])
    assert J.compile_eval_set(spark, notes, questions, target) == {}
    assert result(spark, target) == ([], [])
    notes, questions, target = tables(spark, str(tmp_path / "b"), notes=[])
    assert J.compile_eval_set(spark, notes, questions, target)["kept"] == 6
    rows, _ = result(spark, target)
    assert {r["answerable"] for r in rows} == {False} and {r["coverage"] for r in rows} == {0.0}
