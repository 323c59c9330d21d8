import random

import numpy as np
import pytest
import xxhash

from whinstone.llm.simhash import drop_near_duplicates, fingerprint, fingerprints, hexadecimal, near_duplicates


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c in " \t\n\r\x0b\x0c":
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", None, " \n", "One", "a B", "a b c", "É é x y z É", "w " * 500, "x\x0by\x0cz\tq\r\nw", "a b c a b c a b c"])
def test_fingerprint(text):
    assert fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_long_texts_come_in_blocks(monkeypatch):
    from whinstone.llm import simhash

    text = " ".join(random.Random(1).choices([f"w{i}" for i in range(50)], k=400))
    whole = fingerprint(text.encode())
    monkeypatch.setattr(simhash, "BLOCK_WORDS", 7)
    assert fingerprint(text.encode()) == whole == plain_fingerprint(text)


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choices(words, k=150) for _ in range(6)]
    docs = []
    for i in range(250):
        b = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            b[rng.randrange(len(b))] = rng.choice(words)
        docs.append((i, rng.choice([None, "", "A b", "a B"]) if rng.random() < 0.05 else " ".join(b)))
    return docs + docs[:4]


def brute(docs):
    fps = [plain_fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, fps[i], least[root(i)]) for i, (d, _) in enumerate(docs))


@pytest.mark.parametrize("bucket_rows", [8192, 4])
def test_against_all_pairs(spark, bucket_rows):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = near_duplicates(df, bucket_rows=bucket_rows).collect()
    assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got) == brute(docs)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(empty).count() == 0
    clash = spark.createDataFrame([(2, "a b c d", 5, "x"), (1, "A b c d", 6, "y"), (None, "other words are here", 7, "z")], "doc_id long, text string, fp int, component_id string")
    rows = {r["doc_id"]: r["component_id"] for r in near_duplicates(clash).collect()}
    assert rows[2] == rows[1] == 1
    assert rows[None] is None
    left = drop_near_duplicates(clash)
    assert left.columns == clash.columns and sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1]


def test_hexadecimal(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    rows = {r["doc_id"]: r["h"] for r in fingerprints(df).select("doc_id", hexadecimal("fp").alias("h")).collect()}
    assert rows == {1: f"{plain_fingerprint('a b c'):016x}", 2: "0" * 16}
    assert np.uint64(int(rows[1], 16))


def test_columns_of_any_name_survive(spark):
    from whinstone.llm.near_copies import drop_near_copies
    from whinstone.llm.simhash import drop_near_duplicates

    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, 5), (2, text, 6), (3, "something else", 7), (None, text, 8), (4, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k int").selectExpr(
        "doc_id", "text", "k as _gone", "k as gone", "k as row", "k as id", "k as component_id", "k as fp"
    )
    for drop in (drop_near_duplicates, drop_near_copies):
        left = drop(df)
        assert left.columns == df.columns
        assert {1, 3, 4} <= {r["doc_id"] for r in left.collect()} and 2 not in {r["doc_id"] for r in left.collect()}
