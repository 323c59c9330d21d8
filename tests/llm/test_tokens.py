import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from whinstone.llm import tokens
from whinstone.llm.packing import differencing, pack, pack_documents, shares
from whinstone.llm.queries import op6_packing
from whinstone.llm.token_counts import token_counts

NAME = "byte_bpe_50k.json"
TEXTS = [
    "", "a", "hello <|endoftext|> wörld　中文  \n\n x", "\U0001f600" * 5 + "'s 'LL 123  ", "a " * 60_000, "ab" * 20_000, "x \x85y​z", " lead", "tail ",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.resolve(NAME))


def test_both_ways_give_the_library_ids(library):
    fast = tokens.fast_byte_bpe(NAME)
    counts = tokens.count_tokens(NAME, TEXTS)
    for text, n in zip(TEXTS, counts, strict=True):
        true = library.encode(text, add_special_tokens=False).ids
        assert n == len(true)
        assert np.array_equal(fast.ids(text), true) and np.array_equal(fast.library_ids(text), true)
    fast.audit("some text")
    assert fast.trusted


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_count_as_their_library(name):
    counts = tokens.count_tokens(name, TEXTS[:4])
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=tokens.resolve(name))
        assert counts == [len(model.encode(t)) for t in TEXTS[:4]]
    else:
        model = Tokenizer.from_file(tokens.resolve(name))
        assert counts == [len(model.encode(t, add_special_tokens=False).ids) for t in TEXTS[:4]]


def test_digest_cache(spark, library, tmp_path, monkeypatch):
    rows = [*enumerate(TEXTS), (50, None), (51, "a"), (51, "a")]
    df = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, digest binary")
    cache = f"file://{tmp_path}/cache"

    def check(found):
        got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found.collect())
        exp = []
        for d, text in rows:
            n = len(library.encode(text or "", add_special_tokens=False).ids)
            exp.append((d, len((text or "").encode()), n, n > 1024))
        assert got == sorted(exp)

    check(token_counts(df, NAME, cache))
    assert spark.read.parquet(cache).count() == len(set(TEXTS))
    check(token_counts(df, NAME, cache))
    assert spark.read.parquet(cache).count() == len(set(TEXTS))
    more = df.union(spark.createDataFrame([(60, "something new", b"")], df.schema))
    assert token_counts(more, NAME, cache).where("doc_id = 60").first()["n_tokens"] == 2
    assert spark.read.parquet(cache).count() == len(set(TEXTS)) + 1
    assert token_counts(df.where("false"), NAME).count() == 0


def test_differencing():
    assert sorted(differencing([8, 7, 6, 5, 4], 2).tolist()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])
    sums = np.bincount(differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])
    assert abs(sums[0] - sums[1]) <= 2
    rng = np.random.default_rng(0)
    for n, m in ((1, 3), (5, 5), (60, 7), (200, 31)):
        sizes = rng.integers(1, 100, n).tolist()
        at = differencing(sizes, m)
        assert len(at) == n and at.min() >= 0 and at.max() < m
        if n > 4 * m:
            sums = np.bincount(at, weights=sizes, minlength=m)
            assert sums.max() - sums.min() <= 100
    assert np.bincount(pack([60, 60, 60], 100)).tolist() == [1, 1, 1]


def test_shares():
    for n in range(1, 1024):
        assert sum(shares(n, 0.35, 4)) == n and min(shares(n, 0.35, 4)) > 0


def check_packing(pieces, docs, library):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            part = np.array(ids[at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
            at += r["length"]
        assert at == len(ids)
    used = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        used += 1024
    return used


def test_packing_loses_nothing(spark, library, tmp_path):
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["the", "quick", "Brown", "zz9", "ü"], rng.integers(0, 1500)))) for i in range(120)] + [(500, None), (501, "")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    pieces = op6_packing(spark, str(tmp_path)).collect()
    used = check_packing(pieces, docs, library)
    total = sum(r["length"] for r in pieces)
    assert used - total <= 2 * 1024 + 0.01 * total
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
