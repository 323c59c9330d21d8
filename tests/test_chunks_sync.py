import hashlib
import json
import random

import pytest

from whinstone.engine import Engine, Settings
from whinstone.operators import sync as S
from whinstone.operators.chunking import chunk_notes, chunk_spans, hard_split
from whinstone.operators.embedding import CachedEmbedder, HashingEmbedder, Md5Embedder, build_embedder
from whinstone.operators.evaluation import language_rollup, leak_rollup, query_labels
from whinstone.sources.files import decode, read_candidates, read_eval_set, read_names, read_roots, read_vault, to_qrels, write_corpus, write_jsonl


def test_headings():
    body = "lead\n# A\none\n### C\ntwo\n### D\nthree\n## B\nfour\n#\nfive\n####### no\n"
    got = [(p, t) for p, t, _, _ in chunk_spans(body)]
    assert got == [
        ((), "lead"), (("A",), "one"), (("A", "C"), "two"), (("A", "C", "D"), "three"), (("A", "B"), "four\n#\nfive\n####### no"),
    ]
    assert chunk_spans("# only\n## headings\n") == []


def test_offsets_point_into_the_body():
    body = "# A\n\n  text one  \n\n# B\ntext two"
    (_, a, start, end), (_, b, at, to) = chunk_spans(body)
    assert body[start:].lstrip().startswith(a) and end - start == len(a)
    assert body[at:to] == b


def test_long_sections():
    paragraphs = "\n\n".join(f"{i:03}" + "x" * 200 for i in range(20))
    chunks = chunk_spans(paragraphs, 500, 80)
    assert all(len(t) <= 500 for _, t, _, _ in chunks)
    assert "".join(t for _, t, _, _ in chunks).count("x") == 4000
    words = " ".join(f"w{i}" for i in range(200))
    windows = chunk_spans(words, 300, 60)
    assert [s for _, _, s, _ in windows] == [i * 240 for i in range(len(windows))]
    assert len(chunk_spans("tiny one\n\ntiny two")) == 1 and len(chunk_spans("# a\nx\n# b\ny")) == 2
    for bad in ((0, 0), (100, 100)):
        with pytest.raises(ValueError):
            chunk_spans("x", *bad)


def test_ids(spark):
    notes = spark.createDataFrame([("n.md", "T", "# A\nbody")], "path string, title string, body string")
    row = chunk_notes(notes).first()
    sha = lambda *p: hashlib.sha1("".join(f"{x}\x1f" for x in p).encode()).hexdigest()[:16]
    assert row["id"] == sha("n.md", "A", 4) and row["content_hash"] == sha("body") and row["heading_path"] == ["A"]


def test_hard_split_equals_the_chunker(spark):
    rng = random.Random(1)
    docs = [(i, "".join(rng.choices("ab c\n", k=rng.randint(1, 5000))).replace("\n\n", "\n")) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in hard_split(df).collect())
    starts = {r["doc_id"]: 0 for r in df.collect()}
    assert {d for d, _ in got} == {d for d in starts if dict(docs)[d].strip()}
    for d, text in docs:
        if len(text) <= 1200 and text.strip():
            assert [t for x, t in got if x == d] == [text.strip()]


def test_hashing_embedder(spark):
    texts = spark.createDataFrame([(1, "cat dog cat"), (2, ""), (3, "dog cat cat")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in HashingEmbedder(16).embed(texts).collect()}
    true = [0.0] * 16
    for t in ("cat", "dog", "cat"):
        v = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        true[v % 16] += 1 if v >> 63 else -1
    norm = sum(x * x for x in true) ** 0.5
    assert got[1] == pytest.approx([x / norm for x in true], abs=1e-6) and got[1] == got[3] and set(got[2]) == {0.0}
    md5 = {r["id"]: r["embedding"] for r in Md5Embedder(16).embed(texts).collect()}
    assert sum(x * x for x in md5[1]) == pytest.approx(1) and set(md5[2]) == {0.0}
    assert isinstance(build_embedder(8), HashingEmbedder) and build_embedder(8, "http://x", "m").dim == 8
    with pytest.raises(ValueError):
        HashingEmbedder(0)


def test_cached_embedder(spark, tmp_path):
    class Counting(HashingEmbedder):
        def embed(self, texts):
            self.seen = texts.count()
            return super().embed(texts)

    inner = Counting(8)
    cached = CachedEmbedder(inner, str(tmp_path / "cache"))
    texts = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "a")], "id string, text string")
    first = sorted(map(tuple, cached.embed(texts).collect()))
    assert inner.seen == 2 and len(first) == 3 and first[0][1] == first[2][1]
    assert sorted(map(tuple, cached.embed(texts).collect())) == first and inner.seen == 0


@pytest.fixture
def vault(tmp_path):
    root = tmp_path / "vault"
    for name, data in {
        "note.md": b"# One\nbirds sing\n", "sub/deep.markdown": b"deep text [[note]]\r\nline", ".obsidian/w.md": b"no", "image.png": b"no",
        ".x__hash.md": b"# Dot\ndot file", ".hidden/in.md": b"no", "bad.md": b"\xff\xfe\xfa", "heads.md": b"# Only\n## Heads\n", "_u.md": b"under",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root


def test_vault(spark, vault):
    good, bad = decode(read_vault(spark, str(vault)))
    assert sorted(r["path"] for r in good.collect()) == [".x__hash.md", "_u.md", "heads.md", "note.md", "sub/deep.markdown"]
    assert [r["path"] for r in bad.collect()] == ["bad.md"]
    assert "\r" not in good.where("path = 'sub/deep.markdown'").first()["raw"]
    assert ".hidden/in.md" in {r["path"] for r in read_vault(spark, str(vault), hidden=True).collect()}
    roots = read_roots(spark, [str(vault), str(vault / "note.md")])
    assert roots.where("path like '%note.md'").count() == 1
    with pytest.raises(FileNotFoundError):
        read_vault(spark, str(vault / "none"))
    manifest = write_corpus(good.select("path", "raw"), str(vault.parent / "out"))
    names = {r["out"] for r in manifest.collect()}
    assert len(names) == 5 and {p.name for p in (vault.parent / "out").iterdir()} == names


def test_sync_and_search(spark, vault, tmp_path):
    engine = Engine(spark, Settings(vault=str(vault), table=f"file://{tmp_path}/table", embed_dim=32))
    assert engine.preview().count() == 4
    first = engine.ingest()
    assert (first.files_scanned, first.notes_failed, first.chunks_new, first.embeddings_computed) == (6, 1, 4, 4)
    again = engine.ingest()
    assert (again.embeddings_computed, again.chunks_unchanged, again.chunks_deleted) == (0, 4, 0)
    (vault / "note.md").write_text("# One\nbirds fly south\n")
    (vault / "_u.md").unlink()
    third = engine.ingest()
    assert (third.chunks_changed + third.chunks_new, third.embeddings_computed, third.chunks_deleted) == (1, 1, 1)
    assert engine.ingest(full=True).embeddings_computed == 3
    for mode in ("keyword", "hybrid", "hybrid_rerank", "vector"):
        hits = engine.search(["birds fly"], 2, mode, notes=True).orderBy("rank").collect()
        assert hits[0]["note_path"] == "note.md", mode
    assert engine.search([" "], 2, "keyword").count() == 0
    with pytest.raises(ValueError):
        engine.search(["x"], 0)
    with pytest.raises(ValueError):
        engine.search(["x"], 1, "none")
    assert engine.read_note("note.md", "one") == "# One\nbirds fly south"
    for bad in ("../secret.md", "image.png"):
        with pytest.raises(ValueError):
            engine.read_note(bad)
    assert engine.recent_notes(3).count() == 3 and engine.drafts().count() == 3
    other = Engine(spark, Settings(vault=str(vault), table=f"file://{tmp_path}/table", embed_dim=16))
    with pytest.raises(ValueError):
        other.ingest()
    path = tmp_path / "eval.jsonl"
    path.write_text('// comment\n\n{"id": "1", "question": "birds fly", "relevant_notes": ["note.md"], "lang": "en", "leak": false}\n'
                    '{"id": "2", "question": "deep", "relevant_notes": {"sub/deep.markdown": 2, "note.md": 1}}\n{"id": "3", "question": "nope", "relevant_notes": []}\n')  # fmt: skip
    rows = read_eval_set(spark, str(path))
    assert sorted((r["query_id"], r["doc_id"], r["grade"]) for r in to_qrels(rows).collect()) == [
        ("1", "note.md", 1.0), ("2", "note.md", 1.0), ("2", "sub/deep.markdown", 2.0),
    ]
    found = engine.evaluation(rows, ["keyword"], (1, 5), repeats=2, samples=20)
    got = {(r["mode"], r["view"], r["metric"]): r["value"] for r in found.metrics.collect()}
    report = {key[1:]: value for key, value in got.items()}
    assert report["strict", "recall@1"] == 1 and report["strict", "queries"] == 2 and report["abstention", "abstain_rate"] == 1
    # a row without a language counts as unknown, one without leak_min_df in the first bucket
    assert got["keyword", "lang:en", "queries"] == got["keyword", "lang:en", "notes"] == 1 and got["keyword", "lang:en", "unanswerable"] == 0
    assert got["keyword", "lang:unknown", "queries"] == got["keyword", "lang:unknown", "abstained"] == 1
    assert got["keyword", "leak:<=2", "queries"] == 2 and 0 <= got["keyword", "lang:en", "ndcg@5 low"] <= got["keyword", "lang:en", "ndcg@5 high"] <= 1
    assert got["keyword", "strict", "recall@1 low"] == got["keyword", "strict", "recall@1 high"] == 1
    assert got["keyword", "abstention", "recall@5 with abstention"] == 1 and got["keyword", "time", "ms_per_query p95"] > 0
    assert found.drift == []
    text = found.report()
    assert [x for x in text.splitlines() if x.startswith("## ")] == ["## Quality", "## Languages", "## Leak buckets", "## Abstention and time"]
    found.write_json(str(tmp_path / "run.json"))
    run = json.loads((tmp_path / "run.json").read_text())
    assert run["rankings"]["keyword"]["1"][0] == "note.md" and run["coverage"]["keyword"]["1"] == 1 and run["drift"] == []
    for bad in ({"repeats": 0}, {"ks": ()}, {"samples": -1}):
        with pytest.raises(ValueError):
            engine.evaluation(rows, ["keyword"], **bad)


def test_query_labels(spark):
    rows = spark.createDataFrame(
        [("a", "what", {"x": 1.0, "y": 2.0, "z": 2.0}, None, None, 3), ("b", "什么", {}, None, True, None)],
        "id string, question string, grades map<string,double>, lang string, leak boolean, leak_min_df int",
    )
    got = {r["query_id"]: tuple(r)[1:] for r in query_labels(rows).collect()}
    assert got == {"a": ("y", "unknown", "3-10", False), "b": (None, "unknown", "<=2", True)}


def test_rollups(spark):
    labels = spark.createDataFrame(
        [("a", "n1", "en", "<=2", False), ("b", "n1", "en", "3-10", False), ("c", "n2", "zh", "<=2", False), ("d", None, "en", "<=2", False)],
        "query_id string, cluster string, lang string, bucket string, leak boolean",
    )
    facts = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 0.5), ("c", 1.0, 0.0)], "query_id string, `recall@5` double, `ndcg@10` double")
    coverage = spark.createDataFrame([("a", 0.9), ("b", 0.1), ("c", 0.9), ("d", 0.2)], "query_id string, coverage double")
    got = {r["lang"]: tuple(r)[1:] for r in language_rollup(facts, facts, coverage, labels, "recall@5", "ndcg@10", 0.3).collect()}
    assert got == {"en": (2, 1, 0.5, 0.75, 1, 1, 0.5), "zh": (1, 1, 1.0, 0.0, 0, 0, 0.0)}
    assert {tuple(r) for r in leak_rollup(facts, labels, "recall@5").collect()} == {("<=2", 2, 1.0), ("3-10", 1, 0.0)}


def test_broken_eval_sets(spark, tmp_path):
    for text in ('{"id": "1", "question": "q", "relevant_notes": 5}\n', '{"id": "1"}\n', "nonsense\n", "// nothing\n"):
        path = tmp_path / "x.jsonl"
        path.write_text(text)
        with pytest.raises(ValueError):
            read_eval_set(spark, str(path))
    path.write_text('// one\n{"id": "1", "question": "q", "relevant_notes": []}\n{"id": "1"}\n')
    with pytest.raises(ValueError, match=r"x\.jsonl:3: "):
        read_eval_set(spark, str(path))


def test_candidates_and_names(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"note_path": "n.md", "questions": [{"question": "q1", "answer_span": "s", "difficulty": "easy"}, {"question": "q2"}]}')
    (tmp_path / "b.json").write_text("{broken")
    good, bad = read_candidates(spark, str(tmp_path))
    assert sorted((r["file"], r["pos"], r["note"], r["question"]) for r in good.collect()) == [("a.json", 0, "n.md", "q1"), ("a.json", 1, "n.md", "q2")]
    assert [r["file"] for r in bad.collect()] == ["b.json"]
    (tmp_path / "names.txt").write_text('﻿["x\\\\y/n1.md", "n2.md"]', encoding="utf-8")
    assert sorted(r["name"] for r in read_names(spark, str(tmp_path / "names.txt")).collect()) == ["n1.md", "n2.md"]
    write_jsonl(good.select("note", "question"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_diff(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, content_hash string")
    fresh = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "id string, content_hash string")
    assert {r["id"]: r["status"] for r in S.diff(known, fresh).collect()} == {"a": "unchanged", "b": "changed", "c": "stale", "d": "new"}
    assert sorted(map(tuple, S.upsert(known, fresh).collect())) == [("a", "1"), ("b", "2"), ("c", "1"), ("d", "1")]
    assert [r["id"] for r in S.delete(known, fresh).collect()] == ["c"]


def test_streaming_watch(spark, tmp_path):
    from whinstone.streaming.vault import watch

    source = tmp_path / "in"
    source.mkdir()
    table = S.SnapshotTable(spark, f"file://{tmp_path}/t", S.CHUNK_TABLE)
    put = lambda n, rows: spark.createDataFrame(rows, "path string, raw string, at long").coalesce(1).write.mode("append").json(str(source))
    put(1, [("a.md", "first", 1), ("b.md", "second", 1)])
    stream = spark.readStream.schema("path string, raw string, at long").json(str(source))
    query = watch(stream, table, HashingEmbedder(8), str(tmp_path / "cp"), "0 seconds")
    query.processAllAvailable()
    put(2, [("a.md", "changed", 2), ("b.md", None, 2)])
    query.processAllAvailable()
    query.stop()
    assert [(r["note_path"], r["text"]) for r in table.read().collect()] == [("a.md", "changed")]


def test_snapshots_are_whole_at_any_moment(spark, tmp_path):
    table = S.SnapshotTable(spark, f"file://{tmp_path}/t", "id long, v string")
    assert table.read().count() == 0
    reader = None
    for k in range(S.SnapshotTable.KEEP + 3):
        table.write(spark.createDataFrame([(1, f"v{k}")], "id long, v string"))
        if reader is not None:  # what a reader has begun with is still there
            assert reader.first()["v"] == f"v{k - 1}"
        reader = table.read()
        assert reader.first()["v"] == f"v{k}"
    assert len(table.versions()) == S.SnapshotTable.KEEP
    (tmp_path / "t" / "v99999999999999999999-x").mkdir()  # data without a marker: a write that failed
    assert table.read().first()["v"] == f"v{k}"
