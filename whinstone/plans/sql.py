"""Pieces of DuckDB SQL that repeat the engine's functions."""

from __future__ import annotations

WORD = r"[a-z0-9]+(?:[._''-][a-z0-9]+)*"
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}]+"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def tokens(c: str) -> str:
    return (
        f"list_concat(regexp_extract_all(lower({c}), '{WORD}'), flatten(list_transform(regexp_extract_all(lower({c}), '{CJK}'),"
        " lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: substr(r, i, 1)),"
        " list_transform(range(1, length(r)), lambda i: substr(r, i, 2))))))"
    )


def content(t: str) -> str:
    return (
        f"list_sort(list_distinct(list_filter({t}, lambda t: CASE WHEN regexp_full_match(t, '[\\x00-\\x7f]*')"
        " THEN length(t) >= 4 ELSE length(t) = 2 END)))"
    )


def index(text: str = "text", where: str = "true") -> str:
    """CTEs docs_t, dl, post, df, st of the keyword index of documents."""
    return f"""
docs_t AS (SELECT doc_id, {tokens(text)} AS t FROM documents WHERE {where}),
dl AS (SELECT doc_id, len(t) AS dl FROM docs_t),
post AS (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM docs_t) GROUP BY term, doc_id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, sum(dl) AS total_len, avg(dl) AS avgdl FROM dl)"""


QUERIES = f"""
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark)
  GROUP BY query_id, term)"""

SCORES = """
bm AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9)
  AS score FROM qt JOIN post USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY query_id, doc_id)"""

RANKED = "bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"


def bm25(text: str = "text", where: str = "true") -> str:
    return ",".join([index(text, where), QUERIES, SCORES, RANKED])


#: Documents that hold an item literally: the smallest doc_id is graded 2, others 1.
QRELS = """
qrels AS (SELECT item_id AS query_id, doc_id, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY item_id) THEN 2.0 ELSE 1.0 END AS grade
  FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def facts(qrels: str = "qrels", ks: tuple[int, ...] = (1, 5, 10)) -> str:
    """CTE facts: per-query metrics of the first ten by BM25."""
    share = "round(coalesce(CASE WHEN {b} > 0 THEN {a} / {b} END, 0.0), 9)"
    cols = ", ".join(
        [share.format(a=f"hit{k}", b="n_relevant") + f' AS "recall@{k}"' for k in ks]
        + [share.format(a=f"hit{k}", b=f"got{k}") + f' AS "precision@{k}"' for k in ks]
        + [share.format(a=f"dcg{k}", b=f"idcg{k}") + f' AS "ndcg@{k}"' for k in ks]
    )
    sums = ", ".join(
        f"count(*) FILTER (rank <= {k} AND grade IS NOT NULL) AS hit{k}, count(*) FILTER (rank <= {k}) AS got{k},"
        f" sum((2 ** grade - 1) / log2(rank + 1)) FILTER (rank <= {k} AND grade > 0) AS dcg{k}"
        for k in ks
    )
    ideal = ", ".join(f"sum((2 ** grade - 1) / log2(place + 1)) FILTER (place <= {k}) AS idcg{k}" for k in ks)
    return f"""
top10 AS (SELECT * FROM bmr WHERE rank <= 10),
judged AS (SELECT query_id, min(rank) FILTER (grade IS NOT NULL) AS first_, {sums}
  FROM (SELECT t.query_id, t.rank, q.grade FROM top10 t LEFT JOIN {qrels} q USING (query_id, doc_id)) GROUP BY query_id),
ideal AS (SELECT query_id, count(*) AS n_relevant, {ideal}
  FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS place FROM {qrels}) GROUP BY query_id),
facts AS (SELECT query_id, coalesce(n_relevant, 0) AS n_relevant, {cols}, round(coalesce(1.0 / first_, 0.0), 9) AS rr
  FROM (SELECT item_id AS query_id FROM benchmark) LEFT JOIN judged USING (query_id) LEFT JOIN ideal USING (query_id))"""


def md5_place(t: str, dim: int) -> str:
    return f"(('0x' || substr(md5({t}), 1, 8))::BIGINT % {dim})::INTEGER"


def md5_sign(t: str) -> str:
    return f"CASE WHEN ('0x' || substr(md5({t}), 1, 8))::BIGINT >= 2147483648 THEN 1 ELSE -1 END"


def unit_vectors(table: str, key: str, dim: int, name: str) -> str:
    """CTE name: key, place, v of the MD5 embedding, normalised."""
    return f"""
{name}_s AS (SELECT id, place, sum(sign) AS value FROM (SELECT id, {md5_place('term', dim)} AS place, {md5_sign('term')} AS sign
  FROM (SELECT {key} AS id, unnest({tokens('text')}) AS term FROM {table})) GROUP BY id, place),
{name} AS (SELECT id, place, value / sqrt(sum(value * value) OVER (PARTITION BY id)) AS v FROM {name}_s
  QUALIFY sum(value * value) OVER (PARTITION BY id) > 0)"""
