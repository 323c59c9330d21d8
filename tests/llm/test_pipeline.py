import importlib

import pytest

SF = "/root/testdata/sf0.001"
pipeline = importlib.import_module("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == columns, name
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, left))
        assert after <= before and len(after) >= 0.5 * len(before)
        docs = left
    pieces = pipeline.run(spark, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_near_duplicates_and_leaks_go(spark):
    text = " ".join(f"word{i}" for i in range(80))
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate([text, text.upper(), f"before {item} after", "clean text"])], schema)
    kept = pipeline.simhash_dedup(spark, docs, SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3]
    assert sorted(r["doc_id"] for r in pipeline.decontamination(spark, docs, SF).collect()) == [0, 1, 3]
    lines = pipeline.line_dedup(spark, docs, SF)
    assert {r["doc_id"]: r["n_chars"] for r in lines.collect()} == {0: len(text), 2: len(item) + 13, 3: 10}
    assert pipeline.line_dedup(spark, docs.where("false"), SF).count() == 0


@pytest.mark.parametrize("name", ["op6_packing", "op7_url_filter", "op9_simhash_dedup"])
def test_queries_are_registered(name):
    entry = importlib.import_module("__spark_entry__")
    assert name in entry.queries() and "pipeline" in entry.queries()


CLASHES = "key string, salt int, component long, kept boolean, node long, t1 long, hit int, sequence_id long"


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages_take_any_table(spark, name):
    """Nulls in every column, empty and white texts, repeated rows, a long text and clashing columns; then no rows at all."""
    stage = dict(pipeline.STAGES)[name]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
    other = ("k", 1, 2, True, 3, 4, 5, 6)
    long = " ".join(f"w{i * i % 99991}" for i in range(30_000))
    plain = [(1, "A plain sentence of a clean text that says something."), (2, None), (3, ""), (4, " \n\t"), (None, "A text without an id, of nine words."), (5, long)]
    rows = [(i, t, "en", "s", None, *other) for i, t in [*plain, plain[0], plain[0]]] + [(6, "Columns that are null beside it", *[None] * 11)]
    docs = spark.createDataFrame(rows, schema)
    left = stage(spark, docs, SF)
    found = left.collect()
    if name == "packing":
        ids = {r["doc_id"] for r in found}
        assert ids == {1, 2, 3, 4, 5, 6, None} and sum(r["length"] for r in found) > 30_000
    else:
        assert left.columns == docs.columns
        seen = [(r["doc_id"], r["text"]) for r in found]
        assert {i for i, _ in seen} <= {r[0] for r in rows} and (5, long) in seen and len(seen) <= len(rows)
        assert all((r["key"], r["salt"], r["node"]) in ((None, None, None), ("k", 1, 3)) for r in found)
        # as the docstrings say: rows without words stay but in near-dedup, where they are one group; repeated rows stay together
        ids = [i for i, _ in seen]
        assert ids.count(1) == 3 and [i in ids for i in (2, 3, 4)] == [True, *[name != "simhash_dedup"] * 2]
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_fingerprints_alone_link_near_duplicates(spark):
    """Copies of one passage that each end in words of their own: few bits of the SimHash differ, few distinct shingles agree."""
    passage = "one passage of nine words that comes again often " * 60
    texts = [passage + " ".join(f"{own}{i}" for i in range(12)) for own in "ab"] + [" ".join(f"w{i}" for i in range(90))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in pipeline.simhash_dedup(spark, docs, SF).collect()) == [0, 2]
