"""The jobs as queries over the standard tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import compile_eval_set as compiler
from jobs import sync_chunks as sync
from jobs.common import new_folder
from whinstone.plans import sql as S


def job1_sync_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder: the first takes all documents, the second finds nothing new."""
    target = new_folder(spark, "sync-chunks")
    settings = sync.Settings(embedder="md5", dim=64)
    for _ in range(2):
        sync.sync_chunks(spark, f"{sf_dir}/documents.parquet", target, settings)
    numbers = F.size(F.filter("embedding", lambda x: x != 0)).alias("numbers")
    return sync.current(spark, target).select("id", "note_path", "title", "lang", "char_start", "char_end", "text", "content_hash", numbers)


JOB1_SQL = rf"""
WITH t AS (SELECT doc_id, source, lang, regexp_replace(text, '^{S.SPACE}|{S.SPACE}$', '', 'g') AS text FROM documents),
w AS (SELECT *, unnest(range(0, greatest(ceil((length(text) - 1200) / 1050.0), 0)::BIGINT + 1)) * 1050 AS char_start FROM t WHERE text <> ''),
c AS (
  SELECT substr(sha1(doc_id || chr(31) || chr(31) || char_start || chr(31)), 1, 16) AS id, doc_id::VARCHAR AS note_path, source AS title, lang,
         char_start::INTEGER AS char_start, least(char_start + 1200, length(text))::INTEGER AS char_end,
         regexp_replace(substr(text, char_start + 1, 1200), '^{S.SPACE}|{S.SPACE}$', '', 'g') AS text FROM w),
e AS (SELECT id, title || chr(10) || chr(10) || chr(10) || text AS text FROM c),
{S.unit_vectors('e', 'id', 64, 'ev')}
SELECT c.*, substr(sha1(text || chr(31)), 1, 16) AS content_hash, coalesce(numbers, 0)::INTEGER AS numbers
FROM c LEFT JOIN (SELECT id, count(*) FILTER (value <> 0) AS numbers FROM ev_s GROUP BY id) USING (id) WHERE text <> ''
"""

def job2_compile_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs into one folder: the set's questions and the report's counts, as they stand then."""
    target = new_folder(spark, "compile-eval-set")
    for _ in range(2):
        compiler.compile_eval_set(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", target)
    about = ("question_id", "lang", "note", "n_relevant", "coverage", "leak_token", "bucket", "rare_token", "rare_df")
    rows = compiler.read_questions(spark, target).select(F.lit("question").alias("part"), F.col("id").alias("key"), *about, F.col("leak_min_df").alias("n"))
    report = compiler.read_report(spark, target).select(F.col("section").alias("part"), "key", "n")
    return rows.unionByName(report, allowMissingColumns=True)


JOB2_SQL = rf"""
WITH t0 AS (SELECT item_id, text, {S.tokens('text')} AS t, regexp_replace(text, '{S.SPACE}', '', 'g') AS k FROM benchmark),
t AS (SELECT item_id, text, t, CASE WHEN len(t) < 3 THEN 'too_short'
  WHEN row_number() OVER (PARTITION BY len(t) < 3, k ORDER BY item_id) > 1 THEN 'duplicate_question' END AS r FROM t0),
a AS (SELECT item_id, text, t, {S.content('t')} AS ct FROM t WHERE r IS NULL),
owner AS (SELECT item_id, min(doc_id) AS note, count(DISTINCT doc_id) AS n_relevant FROM a JOIN documents d ON contains(d.text, a.text) GROUP BY item_id),
nt AS (SELECT DISTINCT doc_id AS note, unnest({S.tokens('text')}) AS token FROM documents),
tdf AS (SELECT token, count(*) AS df FROM nt GROUP BY token),
h AS (SELECT item_id, note, count(*) AS hit FROM (SELECT item_id, unnest(ct) AS token FROM a) JOIN nt USING (token) GROUP BY item_id, note),
cov AS (SELECT item_id, round(CASE WHEN len(ct) = 0 THEN 1.0 ELSE coalesce(max(hit), 0) / len(ct) END, 9) AS coverage FROM a LEFT JOIN h USING (item_id) GROUP BY item_id, ct),
tried AS (SELECT t.item_id, t.text, note, n_relevant, coverage, coalesce(r, CASE WHEN note IS NULL AND coverage >= 0.6 THEN 'covered' END, 'kept') AS reason
  FROM t LEFT JOIN owner USING (item_id) LEFT JOIN cov USING (item_id)),
lk AS (SELECT item_id, min((df, token)) AS l FROM (SELECT item_id, owner.note, unnest(ct) AS token FROM owner JOIN a USING (item_id)) JOIN nt USING (note, token) JOIN tdf USING (token) GROUP BY item_id),
tok AS (SELECT DISTINCT item_id, unnest(t) AS token FROM a),
sdf AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT DISTINCT token FROM tok WHERE length(token) >= 2) JOIN documents ON contains(lower(text), token) GROUP BY token),
rare AS (SELECT item_id, min((coalesce(df, 0), token)) AS q FROM tok LEFT JOIN sdf USING (token) WHERE length(token) >= 2 GROUP BY item_id),
total AS (SELECT count(DISTINCT doc_id) AS total FROM documents),
q AS (SELECT tried.*, note IS NOT NULL AS answerable, CASE WHEN regexp_matches(tried.text, '[\x{{4e00}}-\x{{9fff}}]') THEN 'zh' ELSE 'en' END AS lang,
  CASE WHEN note IS NOT NULL THEN coalesce(l[2], '') END AS leak_token, CASE WHEN note IS NOT NULL THEN coalesce(l[1], total) END AS leak_min_df,
  coalesce(q[2], '') AS rare_token, coalesce(q[1], total) AS rare_df,
  row_number() OVER (PARTITION BY note IS NULL ORDER BY note, tried.text, item_id) AS i
  FROM tried LEFT JOIN lk USING (item_id) LEFT JOIN rare USING (item_id) CROSS JOIN total WHERE reason = 'kept'),
b AS (SELECT *, CASE WHEN leak_min_df <= 2 THEN '<=2' WHEN leak_min_df <= 10 THEN '3-10' WHEN leak_min_df <= 50 THEN '11-50' WHEN leak_min_df > 50 THEN '>50' END AS bucket FROM q),
report AS (SELECT 'reason' AS part, reason AS key, count(*) AS n FROM tried GROUP BY ALL
  UNION ALL SELECT 'lang', lang, count(*) FROM b GROUP BY ALL UNION ALL SELECT 'answerable', answerable::VARCHAR, count(*) FROM b GROUP BY ALL
  UNION ALL SELECT 'leak', bucket, count(*) FROM b WHERE answerable GROUP BY ALL
  UNION ALL SELECT 'questions_of_a_note', c::VARCHAR, count(*) FROM (SELECT count(*) AS c FROM b WHERE answerable GROUP BY note) GROUP BY c)
SELECT 'question' AS part, printf('%s%04d', CASE WHEN answerable THEN 'q' ELSE 'n' END, i) AS key, item_id::VARCHAR AS question_id, lang, note::VARCHAR AS note,
 coalesce(n_relevant, 0) AS n_relevant, coverage, leak_token, bucket, rare_token, rare_df, leak_min_df AS n FROM b
UNION ALL SELECT part, key, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n FROM report
"""

QUERIES = {"job1_sync_chunks": job1_sync_chunks, "job2_compile_eval_set": job2_compile_eval_set}
ORACLE = {"job1_sync_chunks": JOB1_SQL, "job2_compile_eval_set": JOB2_SQL}
