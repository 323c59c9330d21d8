"""Embedders: feature hashing (in one pass, or as pure expressions), a remote service, and a content-keyed cache."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.functions.text import tokenize

DIM = 384


class Embedder(Protocol):
    """Adds embedding (array of floats) to texts (id, text)."""

    dim: int

    def embed(self, texts: DataFrame) -> DataFrame: ...


#: Tokens whose places and sums are made at a time.
SLICE_TOKENS = 1 << 18


def _blake2b(term: bytes) -> tuple[int, float]:
    v = int.from_bytes(hashlib.blake2b(term, digest_size=8).digest(), "big")
    return v, 1.0 if v >> 63 else -1.0


def _md5(term: bytes) -> tuple[int, float]:
    v = int.from_bytes(hashlib.md5(term, usedforsecurity=False).digest()[:4], "big")
    return v, 1.0 if v >> 31 else -1.0


class _Features(dict):
    """term: (place, sign) by a hash, remembered up to a bound."""

    def __init__(self, dim: int, hashed: Callable[[bytes], tuple[int, float]] = _blake2b):
        self.dim, self.hashed = dim, hashed

    def __missing__(self, term: bytes) -> tuple[int, float]:
        if len(self) > 200_000:
            self.clear()
        v, sign = self.hashed(term)
        self[term] = found = (v % self.dim, sign)
        return found


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows that have about SLICE_TOKENS tokens, or one row of more."""
    at, ends = 0, np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
        yield at, to
        at = to


def _hash_vectors(dim: int, hashed: Callable[[bytes], tuple[int, float]] = _blake2b, kind=np.float32):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features(dim, hashed)
        for batch in batches:
            tokens = batch.column("tokens")
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi in _slices(sizes):
                # each distinct term of a slice is hashed once, the sums are one count
                terms = tokens.slice(lo, hi - lo).flatten().dictionary_encode()
                found = [features[t] for t in terms.dictionary.cast(pa.binary()).to_pylist()]
                place, sign = (np.array(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0))
                at, row = terms.indices.to_numpy(), np.repeat(np.arange(hi - lo), sizes[lo:hi])
                out = np.bincount(row * dim + place[at], weights=sign[at], minlength=(hi - lo) * dim)
                out = out.astype(np.float64, copy=False).reshape(hi - lo, dim)  # of no tokens the counts are integers
                norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
                np.divide(out, norm, out=out, where=norm > 0)
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, dim, dtype=np.int32), pa.array(out.ravel().astype(kind)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), lists], names=["id", "embedding"])

    return run


class HashingEmbedder:
    """Every token adds +1 or -1 at a place that its hash decides; the sum is normalised, and stays zero for a text without tokens.

    Tokens come from the JVM's tokenizer; hashing goes over Arrow batches and remembers terms, so there is no shuffle.
    """

    def __init__(self, dim: int = DIM):
        if dim <= 0:
            raise ValueError("dim must be positive")
        self.dim = dim

    def embed(self, texts: DataFrame) -> DataFrame:
        kind = dict(texts.dtypes)["id"]
        return texts.select("id", tokenize("text").alias("tokens")).mapInArrow(
            _hash_vectors(self.dim), f"id {kind}, embedding array<float>"
        )


class Md5Embedder:
    """The same sum with places and signs from MD5, so that any SQL engine can repeat it: features() does, as expressions only; embed()
    makes whole vectors in one pass without a shuffle."""

    def __init__(self, dim: int = DIM):
        self.dim = dim

    def features(self, texts: DataFrame) -> DataFrame:
        """id, place, value: the sparse sums."""
        terms = texts.select("id", F.explode_outer(tokenize("text")).alias("term")).where("term is not null")
        v = F.conv(F.substring(F.md5("term"), 1, 8), 16, 10).cast("long")
        rows = terms.select("id", (v % self.dim).cast("int").alias("place"), F.when(v >= 1 << 31, 1).otherwise(-1).alias("sign"))
        return rows.groupBy("id", "place").agg(F.sum("sign").alias("value"))

    def embed(self, texts: DataFrame) -> DataFrame:
        kind = dict(texts.dtypes)["id"]
        return texts.select("id", tokenize("text").alias("tokens")).mapInArrow(
            _hash_vectors(self.dim, _md5, np.float64), f"id {kind}, embedding array<double>"
        )


class RemoteEmbedder:
    """An HTTP service with the common /embeddings interface; batches of texts go out from the executors. The first answer's length
    must be dim."""

    def __init__(self, base_url: str, model: str, api_key: str = "", dim: int = DIM, batch: int = 64, timeout: float = 60):
        self.base_url, self.model, self.api_key, self.dim, self.batch, self.timeout = base_url, model, api_key, dim, batch, timeout

    def request(self, texts: list[str]) -> list[list[float]]:
        import json
        import urllib.request

        ask = urllib.request.Request(
            f"{self.base_url.rstrip('/')}/embeddings",
            json.dumps({"model": self.model, "input": texts}).encode(),
            {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {}),
        )
        with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
            rows = sorted(json.load(answer)["data"], key=lambda r: r["index"])
        vectors = [r["embedding"] for r in rows]
        if len(vectors) != len(texts) or (vectors and len(vectors[0]) != self.dim):
            raise ValueError(f"the service gave vectors of {len(vectors[0]) if vectors else 0} numbers for {self.dim}")
        return vectors

    def embed(self, texts: DataFrame) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                found: list = []
                for lo in range(0, len(frame), self.batch):
                    found += self.request(frame["text"].iloc[lo : lo + self.batch].tolist())
                x = np.array(found, np.float64).reshape(len(frame), -1)
                norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, norm, out=x, where=norm > 0)
                yield pd.DataFrame({"id": frame["id"], "embedding": list(x.astype(np.float32))})

        kind = dict(texts.dtypes)["id"]
        return texts.select("id", "text").mapInPandas(run, f"id {kind}, embedding array<float>")


class CachedEmbedder:
    """Embeds only texts whose SHA-1 a table lacks, each distinct one once, and appends them to it."""

    def __init__(self, inner: Embedder, path: str):
        self.inner, self.path, self.dim = inner, path, inner.dim

    def embed(self, texts: DataFrame) -> DataFrame:
        spark = texts.sparkSession
        keyed = texts.select("id", F.sha1("text").alias("key"), "text")
        try:
            known = spark.read.parquet(self.path).select("key")
        except Exception as e:  # no cache yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = spark.createDataFrame([], "key string")
        misses = keyed.select("key", "text").groupBy("key").agg(F.first("text").alias("text")).join(known, "key", "left_anti")
        fresh = self.inner.embed(misses.withColumnRenamed("key", "id")).withColumnRenamed("id", "key")
        fresh.write.mode("append").parquet(self.path)
        cache = spark.read.parquet(self.path).groupBy("key").agg(F.first("embedding").alias("embedding"))
        return keyed.select("id", "key").join(cache, "key", "left").select("id", "embedding")


def build_embedder(dim: int = DIM, base_url: str = "", model: str = "", api_key: str = "", batch: int = 64, timeout: float = 60) -> Embedder:
    """Remote where both its address and its model are known, else hashing."""
    return RemoteEmbedder(base_url, model, api_key, dim, batch, timeout) if base_url and model else HashingEmbedder(dim)
