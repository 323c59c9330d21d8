"""Compiling evaluation sets: candidate rules, leakage, twins, negative questions, corpus preparation and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from whinstone.functions.text import content_tokens, language, leak_bucket, squeeze, tokenize
from whinstone.operators.holdings import holdings, note_count, token_counts
from whinstone.operators.index import DIGITS
from whinstone.operators.places import placed
from whinstone.operators.shared import cut

# Fixed values of the dataset's rules.
DIFFICULTIES = ("easy", "medium", "hard")
QUESTION_CHARS, SPAN_CHARS = (8, 200), (10, 400)
NEGATIVE_COVERAGE = 0.60
FLATTENED = r"^(.*)__[0-9a-f]{8}\.md$"
UNSAFE = r"[^0-9A-Za-z\x{4e00}-\x{9fff}._-]+"


def note_tokens(notes: DataFrame) -> DataFrame:
    """note, token: each note's distinct tokens."""
    # an outer explode: of a plain one Spark infers a filter on the tokens' number, and tokenizes once more for it
    return notes.select("note", F.explode_outer(F.array_distinct(tokenize("text"))).alias("token")).where("token is not null")


def token_df(notes: DataFrame) -> DataFrame:
    """token, df: in how many notes a token occurs."""
    return note_tokens(notes).groupBy("token").agg(F.countDistinct("note").alias("df"))


def question_tokens(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", content_tokens(tokenize("question")).alias("tokens"))


def best_note_coverage(questions: DataFrame, notes: DataFrame) -> DataFrame:
    """question_id, coverage, note: the note that holds the largest share of a question's content tokens, the smallest name of equal
    ones; a question without tokens is covered (1, empty name). Rows without a note or a question's id are left out."""
    return coverage(questions, holdings(questions, notes))


def coverage(questions: DataFrame, found: DataFrame) -> DataFrame:
    """best_note_coverage() from the holdings."""
    best = found.where("kind = 'best'").groupBy("question_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "note")).alias("b"))
    joined = question_tokens(questions).join(best, "question_id", "left")
    empty = F.size("tokens") == 0
    return joined.select(
        "question_id",
        F.round(F.when(empty, 1.0).otherwise(F.coalesce(-F.col("b.m") / F.size("tokens"), F.lit(0.0))), DIGITS).alias("coverage"),
        F.when(empty, "").otherwise(F.coalesce(F.col("b.note").cast("string"), F.lit(""))).alias("note"),
    )


def negative_gate(questions: DataFrame, notes: DataFrame, most: float = NEGATIVE_COVERAGE) -> DataFrame:
    """Questions that no note covers to the share `most`: fit to have no answer."""
    kept = best_note_coverage(questions, notes).where(F.col("coverage") < most).select("question_id")
    return questions.join(kept, "question_id", "left_semi")


def leak_min_df(questions: DataFrame, notes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """question_id, leak_token, leak_min_df, leak, bucket: the rarest content token that a question shares with its note (question_id,
    question, note); by df, then token. Without one: an empty token and the number of notes. found: holdings of these questions, or
    of more of them."""
    found = cut(holdings(questions, notes), "holdings") if found is None else found
    tokens = questions.select("question_id", "note", F.explode(content_tokens(tokenize("question"))).alias("token"))
    # only the questions' own notes are taken apart again
    own = note_tokens(notes.join(questions.select("note").distinct(), "note", "left_semi")).distinct()
    shared = tokens.join(own, ["note", "token"]).join(token_counts(found, "held"), "token")
    rarest = shared.groupBy("question_id").agg(F.min(F.struct("df", "token")).alias("r"))
    rows = questions.select("question_id").join(rarest, "question_id", "left").crossJoin(F.broadcast(note_count(found)))
    rows = rows.select(
        "question_id",
        F.coalesce("r.token", F.lit("")).alias("leak_token"),
        F.coalesce("r.df", "total").alias("leak_min_df"),
        F.col("r").isNotNull().alias("leak"),
    )
    return rows.withColumn("bucket", leak_bucket("leak_min_df"))


def substring_df(tokens: DataFrame, notes: DataFrame) -> DataFrame:
    """token, df: in how many notes (note, text) a token (distinct, of two characters or more, as tokenize gives them) stands as a
    substring; tokens that none holds have no row."""
    asked = tokens.select(F.col("token").alias("question_id"), F.col("token").alias("question"))
    return token_counts(holdings(asked, notes), "within").join(tokens.select("token"), "token", "left_semi")


def keyword_rarity(questions: DataFrame, notes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """question_id, token, df: the question's token (two characters or more) that the fewest notes hold as a substring; ties by token.
    Without such a token: an empty one and the number of notes. found: holdings of these questions, or of more of them."""
    found = cut(holdings(questions, notes), "holdings") if found is None else found
    tokens = questions.select("question_id", F.explode(F.array_distinct(tokenize("question"))).alias("token")).where(F.length("token") >= 2)
    rows = tokens.join(token_counts(found, "within"), "token", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    rarest = rows.groupBy("question_id").agg(F.min(F.struct("df", "token")).alias("r"))
    every = questions.select("question_id").distinct().join(rarest, "question_id", "left").crossJoin(F.broadcast(note_count(found)))
    return every.select("question_id", F.coalesce("r.token", F.lit("")).alias("token"), F.coalesce("r.df", "total").alias("df"))


def gate_candidates(candidates: DataFrame, notes: DataFrame, meta: str = r"(?i)\b(this|the) (note|article|document|passage)\b") -> DataFrame:
    """candidates (file, pos, note, question, answer_span, difficulty) with drop_reason: the first rule that one breaks, null if kept.

    Rules in order: the note's name is unique, the note exists, the question's length, no talk about the text itself, the span's
    length, the span stands in the note (white space aside), a known difficulty, and no earlier kept candidate with the same question
    (white space aside).
    """
    candidates = cut(candidates, "candidates")
    # only notes that a candidate names are squeezed and shuffled
    named = notes.join(candidates.select("note").distinct(), "note", "left_semi")
    named = named.groupBy("note").agg(F.count("*").alias("copies"), F.min(squeeze("text")).alias("squeezed"))
    rows = candidates.join(named, "note", "left")
    q, s = F.length("question"), F.length("answer_span")
    reason = (
        F.when(F.col("copies") > 1, "ambiguous_note")
        .when(F.col("copies").isNull(), "note_missing")
        .when(~q.between(*QUESTION_CHARS), "question_length")
        .when(F.col("question").rlike(meta), "meta_question")
        .when(~s.between(*SPAN_CHARS), "span_length")
        .when(~F.contains(F.col("squeezed"), squeeze("answer_span")), "span_not_in_note")
        .when(~F.coalesce(F.col("difficulty"), F.lit("")).isin(*DIFFICULTIES), "bad_difficulty")
    )
    rows = rows.withColumn("drop_reason", reason).withColumn("key", squeeze("question"))
    first = Window.partitionBy("key", F.col("drop_reason").isNull()).orderBy("file", "pos")
    rows = rows.withColumn("nth", F.row_number().over(first))
    again = F.col("drop_reason").isNull() & (F.col("nth") > 1)
    return rows.withColumn("drop_reason", F.when(again, "duplicate_question").otherwise(F.col("drop_reason"))).drop(
        "copies", "squeezed", "key", "nth"
    )


def count_reasons(gated: DataFrame) -> DataFrame:
    return gated.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def numbered(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """Adds id: q0001, q0002, ... in the order given, range by range: no task numbers all rows. rows are written once, as placing reads
    them several times."""
    rows = cut(rows, "to-number")
    return placed(rows, order, rows.count()).withColumn("id", F.format_string(f"{prefix}%04d", "_place")).drop("_place")


def slug(note: Column) -> Column:
    """The name that a flattened file had before its hash; null for other names."""
    return F.when(note.rlike(FLATTENED), F.regexp_extract(note, FLATTENED, 1))


def twins(notes: DataFrame) -> DataFrame:
    """note, twin: the translation of each note, whose slug has .zh where this one's has not; empty where there is none. Of several the
    first by name."""
    named = notes.select("note", slug(F.col("note")).alias("slug"))
    wanted = F.when(F.endswith("slug", F.lit(".zh")), F.expr("substring(slug, 1, length(slug) - 3)")).otherwise(F.concat("slug", F.lit(".zh")))
    first = named.where("slug is not null").groupBy("slug").agg(F.min("note").alias("twin"))
    return named.withColumn("wanted", wanted).join(first.withColumnRenamed("slug", "wanted"), "wanted", "left").select(
        "note", F.coalesce("twin", F.lit("")).alias("twin")
    )


def flat_name(path: Column, sha1: Column) -> Column:
    """A file name from the last four parts of a path without suffix, safe characters only, and the content's hash."""
    stem = F.regexp_replace(path, r"\.[^.]*$", "")
    parts = F.filter(F.split(stem, "/"), lambda p: ~p.isin("", "."))
    safe = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, UNSAFE, "_"), "^_+|_+$", ""))
    safe = F.filter(safe, lambda p: p != "")
    last = F.slice(safe, F.greatest(F.size(safe) - 3, F.lit(1)), F.lit(4))
    joined = F.substring(F.array_join(last, "__"), 1, 150)
    return F.concat(F.when(joined == "", "note").otherwise(joined), F.lit("__"), F.substring(sha1, 1, 8), F.lit(".md"))


def first_of_content(docs: DataFrame, order: str, text: str = "text") -> DataFrame:
    """docs without later copies of a text: a two-phase minimum by hash, then a semi-join, so a hot text meets in the map side."""
    keyed = docs.withColumn("_sha", F.sha1(text))
    first = keyed.groupBy("_sha").agg(F.min(order).alias(order))
    return keyed.join(first, ["_sha", order], "left_semi").drop("_sha")


def fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: SHA-1 over the sorted SHA-1s of all texts. It needs all digests in one place, 40 bytes each."""
    return docs.agg(F.sha1(F.array_join(F.array_sort(F.collect_list(F.sha1(text))), "")).alias("fingerprint"))


def sample_fingerprint(files: DataFrame) -> DataFrame:
    """One row: SHA-1 over name and size of all files (name, size) in the order of names."""
    rows = F.array_sort(F.collect_list(F.struct("name", F.col("size").cast("string").alias("size"))))
    return files.agg(F.sha1(F.array_join(F.transform(rows, lambda r: F.concat(r["name"], r["size"])), "")).alias("fingerprint"))


def stride_uniform(docs: DataFrame, limit: int, order: str) -> DataFrame:
    """`limit` rows spread evenly over the order: those at floor(i * n / limit)."""
    n = docs.count()
    if limit <= 0 or n <= limit:
        return docs
    spark = docs.sparkSession
    places = spark.range(limit).select((F.floor(F.col("id") * F.lit(n / limit)) + 1).alias("_place"))
    ranked = placed(docs, [order], n)
    return ranked.join(F.broadcast(places), "_place", "left_semi").drop("_place")


def stride_integer(docs: DataFrame, count: int, order: str) -> DataFrame:
    """Every (n // count)-th row from the first on, `count` of them; an error where there are fewer rows."""
    n = docs.count()
    if n < count:
        raise ValueError(f"{count} rows are wanted, there are {n}")
    stride = max(1, n // count)
    at = F.col("_place") - 1
    return placed(docs, [order], n).where((at % stride == 0) & (at / stride < count)).drop("_place")


def pool(files: DataFrame, lang: str | None = None, least_bytes: int = 0, excluded: DataFrame | None = None) -> DataFrame:
    """Files (name, size, text) of a language and size that are not excluded (name)."""
    out = files.where(F.col("size") >= least_bytes)
    if lang:
        out = out.where(language("text") == lang)
    return out if excluded is None else out.join(excluded.select("name"), "name", "left_anti")


def unlabelled(labels: DataFrame, index: DataFrame, key: str = "note_path") -> DataFrame:
    """Labels whose note the index lacks."""
    return labels.select(key).distinct().join(index.select(key).distinct(), key, "left_anti")


def require_indexed(labels: DataFrame, index: DataFrame, key: str = "note_path") -> None:
    lost = unlabelled(labels, index, key).limit(3).collect()
    if lost:
        raise ValueError(f"labelled but not indexed, such as {[r[0] for r in lost]}")


def concat_notes(chunks: DataFrame, order: str, note: str = "note_path", most: int = 6000) -> DataFrame:
    """note, text: a note's chunks in order, joined by blank lines, cut to `most` characters."""
    parts = F.array_sort(F.collect_list(F.struct(order, "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")
    return chunks.groupBy(note).agg(F.substring(text, 1, most).alias("text"))


def recent(notes: DataFrame, n: int, at: str = "modified", path: str = "path") -> DataFrame:
    """The n notes modified last, by time and then path; n between 1 and 50."""
    n = min(50, max(1, n))
    return notes.orderBy(F.desc(at), path).limit(n)


def containment(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id where a document (doc_id, text) holds a question (query_id, text) literally."""
    asked, notes = questions.select(F.col("query_id").alias("question_id"), F.col("text").alias("question")), docs.select(F.col("doc_id").alias("note"), "text")
    return literal(holdings(asked, notes, literal=True)).select(F.col("question_id").alias("query_id"), F.col("note").alias("doc_id"))


def literal(found: DataFrame) -> DataFrame:
    """question_id, note where a note holds a question literally, from the holdings."""
    return found.where("kind = 'literal'").select("question_id", "note")
