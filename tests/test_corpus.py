import hashlib

import pytest

from whinstone.operators import corpus as C

FILES = [(f"a/b/n{i:02}.md", f"text number {i} " * 20) for i in range(12)] + [("a/copy.md", "text number 3 " * 20), ("small.md", "tiny"), ("none.md", None), ("é x/ü.md", "umlaut " * 40)]


def saved(spark, folder):
    texts = {r["out"]: r["raw"] for r in spark.read.schema("out string, raw string, part string").parquet(f"{folder}/texts").collect()}
    return texts, dict(r["value"].split("=") for r in spark.read.text(f"{folder}/fingerprint").collect())


def test_corpus_manifest_and_fingerprint(spark, tmp_path):
    folder = str(tmp_path / "corpus")
    df = spark.createDataFrame(FILES, "path string, raw string")
    for _ in range(2):  # a second run replaces the first
        rows = {r["src"]: r for r in C.save_corpus(df, folder).collect()}
        texts, found = saved(spark, folder)
        assert set(rows) == {p for p, t in FILES if t and len(t) >= 200} - {"a/copy.md"}
        for src, r in rows.items():
            raw = dict(FILES)[src].encode()
            assert (r["sha1"], r["bytes"], texts[r["out"]].encode()) == (hashlib.sha1(raw).hexdigest(), len(raw), raw)
        shas = "".join(sorted(r["sha1"] for r in rows.values()))
        assert found == {"files": "13", "bytes": str(sum(r["bytes"] for r in rows.values())), "fingerprint": hashlib.sha1(shas.encode()).hexdigest()}
    assert rows["a/b/n01.md"]["out"] == f"a__b__n01__{rows['a/b/n01.md']['sha1'][:8]}.md"
    C.save_corpus(df, folder, limit=5)
    texts, found = saved(spark, folder)
    assert len(texts) == 5 and found["files"] == "5"
    assert C.save_corpus(df.where("false"), folder).count() == 0 and saved(spark, folder)[1]["files"] == "0"


def test_sample_and_its_manifest(spark, tmp_path):
    files = [(f"n{i:02}", 1000 + i, "english" if i % 3 else "汉字") for i in range(60)]
    df = spark.createDataFrame(files, "name string, size int, text string")
    used = spark.createDataFrame([("n41",), ("n44",), ("other",), ("n41",)], "name string")
    sample, manifest = C.sample_notes(df, 4, "en", 1024, used)
    pool = [n for n, s, t in files if s >= 1024 and t == "english"]
    left = [n for n in pool if n not in ("n41", "n44")]
    want = left[:: len(left) // 4][:4]
    assert sorted(r["name"] for r in sample.collect()) == want
    row = manifest.first().asDict()
    digest = hashlib.sha1("".join(f"{n}{s}" for n, s, _ in files).encode()).hexdigest()
    assert row == {
        "lang": "en", "count": 4, "corpus_files": 60, "pool_after_lang_and_size_filter": len(pool), "excluded_names": 3, "available": len(left), "stride": len(left) // 4,
        "min_bytes": 1024, "corpus_fingerprint_names_and_sizes": digest, "first_three": want[:3],
    }
    C.save_sample(sample, manifest, str(tmp_path / "s"))
    assert [r["name"] for r in spark.read.json(f"{tmp_path}/s/names").orderBy("name").collect()] == want
    assert spark.read.json(f"{tmp_path}/s/manifest").first()["stride"] == row["stride"]
    with pytest.raises(ValueError, match="wanted"):
        C.sample_notes(df, 100, "en")
