"""Compile an evaluation set from notes and questions, with a build report.

    python -m jobs.compile_eval_set NOTES QUESTIONS TARGET [--config jobs/compile_eval_set.json]

NOTES and QUESTIONS are Parquet tables. A question is a passage or phrase; the notes that hold it literally are its relevant notes, the
first of them by id graded 2, the others 1. A question that no note holds becomes one without an answer, unless a single note covers
most of its content words. Every question kept is annotated: its language, the rarest content word that it shares with its note and in
how many notes that occurs (how far the question gives the answer away), and its token that the fewest notes hold as a substring.

TARGET/candidates has every question with what became of it, partitioned by reason; TARGET/annotated the kept ones with what was found
out about them, before they are numbered; TARGET/questions the set as JSON lines, partitioned by answerable and lang; TARGET/report
counts, partitioned by section. A run replaces all four, so running it again gives the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import command_line, log
from whinstone.functions.text import language, leak_bucket, squeeze, tokenize
from whinstone.operators import evalset as E
from whinstone.operators.holdings import holdings
from whinstone.operators.shared import cut

QUESTIONS = (
    "id string, question_id string, question string, relevant_notes map<string,double>, note string, n_relevant long, coverage double,"
    " leak boolean, leak_token string, leak_min_df long, bucket string, rare_token string, rare_df long, answerable boolean, lang string"
)


@dataclass
class Settings:
    """note, text: columns of the notes. question, question_text: of the questions. least_tokens: shorter questions are left out.
    most_coverage: from this share of its content words in one note on, a question without a note is no negative."""

    note: str = "doc_id"
    text: str = "text"
    question: str = "item_id"
    question_text: str = "text"
    least_tokens: int = 3
    most_coverage: float = E.NEGATIVE_COVERAGE


def asked_once(questions: DataFrame, s: Settings) -> DataFrame:
    """question_id, question, reason (too_short, duplicate_question or null)."""
    short = F.size(tokenize("question")) < s.least_tokens
    again = Window.partitionBy("short", "key").orderBy("question_id")
    rows = questions.withColumns({"short": short, "key": squeeze("question")}).withColumn("nth", F.row_number().over(again))
    return rows.withColumn("reason", F.when(F.col("short"), "too_short").when(F.col("nth") > 1, "duplicate_question")).drop("short", "key", "nth")


def candidates(rows: DataFrame, found: DataFrame, s: Settings) -> DataFrame:
    """question_id, question, note, n_relevant, grades, coverage, reason (kept, too_short, duplicate_question or covered), from the
    notes' holdings of the rows without a reason."""
    # of a question that very many notes hold, all are relevant: the map is part of the set
    owned = E.literal(found).groupBy("question_id").agg(F.min("note").alias("note"), F.array_sort(F.collect_set("note")).alias("every"))
    grades = F.map_from_entries(F.transform("every", lambda n: F.struct(n.cast("string"), F.when(n == F.col("note"), 2.0).otherwise(1.0))))
    owned = owned.select("question_id", "note", F.size("every").cast("long").alias("n_relevant"), grades.alias("grades"))
    covered = E.coverage(rows.where("reason is null"), found).select("question_id", "coverage")
    rows = rows.join(owned, "question_id", "left").join(covered, "question_id", "left")
    negative = F.col("note").isNull() & (F.col("coverage") >= s.most_coverage)
    return rows.withColumn("reason", F.coalesce("reason", F.when(negative, "covered"), F.lit("kept")))


def annotated(kept: DataFrame, notes: DataFrame, found: DataFrame) -> DataFrame:
    """kept with leaks, rarest tokens and lang."""
    leaks = E.leak_min_df(kept.where("note is not null").select("question_id", "question", "note"), notes, found)
    rare = E.keyword_rarity(kept.select("question_id", "question"), notes, found).withColumnsRenamed({"token": "rare_token", "df": "rare_df"})
    return kept.join(leaks, "question_id", "left").join(rare, "question_id", "left").withColumn("lang", language("question"))


def numbered(rows: DataFrame) -> DataFrame:
    """The set's rows, q0001... with an answer and n0001... without. It reads the annotated rows several times."""
    numbers = [E.numbered(rows.where(of).withColumn("answerable", F.lit(yes)), p, *order) for of, yes, p, order in (
        ("note is not null", True, "q", ("note", "question", "question_id")), ("note is null", False, "n", ("question", "question_id")),
    )]
    both = numbers[0].unionByName(numbers[1])
    return both.select(
        "id", F.col("question_id").cast("string").alias("question_id"), "question", F.coalesce("grades", F.create_map().cast("map<string,double>")).alias("relevant_notes"),
        F.col("note").cast("string").alias("note"), F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"), "coverage", F.coalesce("leak", F.lit(False)).alias("leak"),
        "leak_token", F.col("leak_min_df").cast("long").alias("leak_min_df"), F.when(F.col("leak_min_df").isNotNull(), leak_bucket("leak_min_df")).alias("bucket"), "rare_token", F.col("rare_df").cast("long").alias("rare_df"), "answerable", "lang",
    )


def build_report(tried: DataFrame, compiled: DataFrame) -> DataFrame:
    """section, key, n: what became of the candidates; languages, answers and leak buckets of the set; how many notes have how many
    questions."""
    counted = lambda rows, section, key: rows.groupBy(key.alias("key")).agg(F.count("*").alias("n")).select(F.lit(section).alias("section"), "key", "n")
    answered = compiled.where("answerable")
    per_note = answered.groupBy("note").count()
    parts = [
        counted(tried, "reason", F.col("reason")),
        counted(compiled, "lang", F.col("lang")),
        counted(compiled, "answerable", F.col("answerable").cast("string")),
        counted(answered, "leak", F.col("bucket")),
        counted(per_note, "questions_of_a_note", F.col("count").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_questions(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(QUESTIONS).json(f"{target}/questions")


def read_report(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("section string, key string, n long").parquet(f"{target}/report")


def compile_eval_set(spark: SparkSession, notes: str, questions: str, target: str, settings: Settings | None = None) -> dict[str, int]:
    """Write the four tables; how many rows of each kind there are."""
    s = settings or Settings()
    log.info("compile_eval_set: %s and %s into %s", notes, questions, target)
    known = spark.read.parquet(notes).select(F.col(f"`{s.note}`").alias("note"), F.col(f"`{s.text}`").cast("string").alias("text")).where("note is not null and text is not null")
    asked = spark.read.parquet(questions).select(F.col(f"`{s.question}`").alias("question_id"), F.col(f"`{s.question_text}`").cast("string").alias("question"))
    asked = asked.where("question_id is not null and question is not null").dropDuplicates(["question_id"])
    rows = cut(asked_once(asked, s), "asked-once")
    found = cut(holdings(rows.where("reason is null"), known, literal=True), "holdings")
    judged = candidates(rows, found, s)
    judged.write.mode("overwrite").partitionBy("reason").parquet(f"{target}/candidates")
    tried = spark.read.schema(judged.schema).parquet(f"{target}/candidates")
    kept = tried.where("reason = 'kept'").drop("reason")
    noted = annotated(kept, known, found)
    noted.write.mode("overwrite").parquet(f"{target}/annotated")
    noted = spark.read.schema(noted.schema).parquet(f"{target}/annotated")
    numbered(noted).write.mode("overwrite").partitionBy("answerable", "lang").json(f"{target}/questions")
    compiled = read_questions(spark, target)
    build_report(tried, compiled).write.mode("overwrite").partitionBy("section").parquet(f"{target}/report")
    report = read_report(spark, target)
    done = {r["key"]: r["n"] for r in report.where("section = 'reason'").collect()}
    log.info("compile_eval_set: read %d questions; %s", sum(done.values()), ", ".join(f"{n} {k}" for k, n in sorted(done.items())))
    return done


if __name__ == "__main__":
    command_line(Settings, compile_eval_set, "notes", "questions", "target", description=__doc__)
