"""Quality by importance resampling: hashed n-gram models of target and raw text, and a Gumbel top-k sample of the ratio."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import LOWER, TEXT_BLOCK, binary_texts, cut, pick, text_blocks

#: Buckets of each of the three families of n-grams: words, pairs of words, pairs of word shapes.
BUCKETS, FAMILIES = 1 << 14, 3
#: How much a model of raw text weighs in the target's smoothing, in n-grams.
PRIOR = 500.0
#: The share of documents that weigh less than the temperature, either way. Weights are sums over whole texts and spread over hundreds,
#: so noise of size 1 would decide nothing: they are divided by a temperature fitted to that spread, and the noise then decides among
#: about this share of the documents, those that the two models tell least apart.
NEAR = 0.01
#: N-grams of ratio 1 that are added to every text, so that a few rare words don't condemn a short one.
NEUTRAL = 20

_CLASSES = bytes(
    65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)
)
_RUNS = re.compile(rb"(.)\1+", re.S)
_REPEAT = np.uint64(0x5EED)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """word: hash of its lower case (upper 32 bits) and of its shape (lower ones), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        shape = _RUNS.sub(rb"\1", word.translate(_CLASSES))
        self[word] = found = zlib.crc32(word.translate(LOWER)) << 32 | zlib.crc32(shape)
        return found


def _bucket(a: np.ndarray, b: np.ndarray | None = None) -> np.ndarray:
    x = a * _MIX if b is None else (a * _MIX) ^ (b + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return ((x * _MIX) >> np.uint64(64 - 14)).astype(np.int64)


def buckets(words: _Words, text: bytes | None, size: int = TEXT_BLOCK) -> Iterator[np.ndarray]:
    """The buckets of a text's n-grams, block by block; a family's buckets are numbered after those of the one before. A block's last
    word is carried into the next one, so where blocks end makes no difference. A pair of equal words is one and the same n-gram
    whatever the word, so repetition shows however rare the word is."""
    last, out, low = np.empty(0, np.uint64), None, np.uint64(0xFFFFFFFF)
    for block in text_blocks(text or b"", size):
        found = block.split()
        if not found:
            continue
        if out is not None:
            yield out
        both = np.concatenate([last, np.array(list(map(words.__getitem__, found)), np.uint64)])
        word, shape = both >> np.uint64(32), both & low
        two = _bucket(word[:-1], word[1:])
        two[word[:-1] == word[1:]] = int(_bucket(_REPEAT[None])[0])
        around = _bucket(shape[:-1], shape[1:])
        out = np.concatenate([_bucket(word[len(last) :]), two + BUCKETS, around + 2 * BUCKETS])
        last = both[-1:]
    if out is not None:  # the last word's shape, with nothing after it
        yield np.append(out, _bucket(last & low, np.zeros(1, np.uint64)) + 2 * BUCKETS)


@dataclass
class Ratio:
    """Log ratios of the two models by bucket, and the mean ratio that parts good labels from bad ones."""

    logs: np.ndarray
    cut: float = -np.inf

    def summed(self, words: _Words, text: bytes | None) -> tuple[float, int]:
        """The summed log ratio of a text's n-grams and how many they are, NEUTRAL more of ratio 1 included."""
        total, n = 0.0, NEUTRAL
        for b in buckets(words, text):
            total += float(self.logs[b].sum())
            n += len(b)
        return total, n

    def weigh(self, words: _Words, text: bytes | None) -> float:
        """The log weight: the summed log ratio, less the cut for each n-gram. That is a length term: target texts go on after an
        n-gram with exp(-cut) times the raw texts' probability."""
        total, n = self.summed(words, text)
        return total - n * self.cut if np.isfinite(self.cut) else total


def gumbel(doc_id: int | None, seed: int) -> float:
    """Standard Gumbel noise that only doc_id and seed decide."""
    u = (xxhash.xxh64_intdigest(str(doc_id).encode(), seed) + 0.5) / 2.0**64
    return float(-np.log(-np.log(min(max(u, 1e-300), 1 - 1e-16))))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, raw, target = _Words(), np.zeros(BUCKETS * FAMILIES, np.int64), np.zeros(BUCKETS * FAMILIES, np.int64)
    for batch in batches:
        for text, quality in zip(binary_texts(batch.column("text")), batch.column("quality").to_pylist(), strict=True):
            for b in buckets(words, text):
                n = np.bincount(b, minlength=len(raw))
                raw += n
                if quality == 1:
                    target += n
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays(
        [pa.array(at.astype(np.int32)), pa.array(raw[at]), pa.array(target[at])], names=["slot", "raw", "target"]
    )


def _weigh(ratio: Ratio, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            weights = [ratio.weigh(words, t) for t in binary_texts(batch.column("text"))]
            noise = [gumbel(i, seed) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(weights, pa.float64()), pa.array(noise, pa.float64())],
                names=["doc_id", "log_weight", "noise"],
            )

    return run


def _means(ratio: Ratio):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            sums = [ratio.summed(words, t) for t in binary_texts(batch.column("text"))]
            means = pa.array([total / n for total, n in sums], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), means], names=["doc_id", "quality", "mean"])

    return run


def _sample(ratio: Ratio, seed: int, least: float, temperature: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            rows = zip(batch.column("doc_id").cast(pa.int64()).to_pylist(), binary_texts(batch.column("text")), strict=True)
            keep = [ratio.weigh(words, t) / temperature + gumbel(i, seed) >= least for i, t in rows]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _labelled(labels: DataFrame, max_rows: int) -> DataFrame:
    known = pick(labels, doc_id="long", quality="int").where("quality is not null and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 50_000, seed: int = 11) -> Ratio:
    """Raw model: n-grams of all documents. Target model: those of documents labelled 1, of one half of at most max_rows labelled rows
    (by a hash of doc_id; their ids are broadcast, at most 12 bytes each). Tasks count into arrays of fixed size, which Spark sums.

    The cut is the mean log ratio with the best balanced accuracy on the other half, which the target model has not seen (of rows with
    one doc_id, the smallest mean); without labels of both kinds, none.
    """
    known = F.broadcast(_labelled(labels, max_rows))
    texts = pick(docs, doc_id="long", text="string").join(known, "doc_id", "left")
    fold = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(2))
    counts = texts.select("text", F.when(fold == 0, F.col("quality")).alias("quality")).mapInArrow(_count, "slot int, raw long, target long")
    counts = counts.groupBy("slot").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS * FAMILIES), np.zeros(BUCKETS * FAMILIES)
    raw[counts["slot"]], target[counts["slot"]] = counts["raw"], counts["target"]
    raw, target = raw.reshape(FAMILIES, -1), target.reshape(FAMILIES, -1)
    p = (raw + 0.5) / (raw.sum(1, keepdims=True) + 0.5 * BUCKETS)
    q = (target + PRIOR * p) / (target.sum(1, keepdims=True) + PRIOR)
    ratio = Ratio((np.log(q) - np.log(p)).ravel() if target.any() else np.zeros(raw.size))
    graded = texts.where("quality is not null").where(fold == 1).select("doc_id", "text", "quality")
    rows = graded.mapInArrow(_means(ratio), "doc_id long, quality int, mean double")
    rows = rows.groupBy("doc_id", "quality").agg(F.min("mean").alias("mean")).toPandas()  # at most max_rows
    ratio.cut = best_cut(rows["mean"].to_numpy(float), rows["quality"].to_numpy(int))
    return ratio


def best_cut(weights: np.ndarray, quality: np.ndarray) -> float:
    """Where to part labels 1 (at or above) from the others with the best balanced accuracy: the middle of the gap there."""
    good, bad = int((quality == 1).sum()), int((quality != 1).sum())
    if not good or not bad:
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, y = weights[order], quality[order] == 1
    below_bad, below_good = np.append(0, np.cumsum(~y)), np.append(0, np.cumsum(y))
    gain = below_bad / bad + (good - below_good) / good
    gain[1:-1][w[1:] == w[:-1]] = -1
    i = int(gain.argmax())
    if i == 0:
        return -np.inf
    return float(w[i - 1] + 1e-9 if i == len(w) else (w[i - 1] + w[i]) / 2)


def kth_largest(scored: DataFrame, key: str, k: int, exact_at: int = 10_000) -> float:
    """The k-th largest value of a column, by counts in ever narrower ranges: only counts and one bounded range reach the driver."""
    low, high = scored.agg(F.min(key), F.max(key)).first()
    above = 0
    while True:
        span = high - low
        inside = scored.where(F.col(key).between(low, high))
        if span <= abs(high) * 1e-15 or not np.isfinite(span):
            return low
        slot = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(span) * 1024), F.lit(1023))
        found = inside.groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
        for r in sorted(found.collect(), key=lambda r: -r["slot"]):
            if above + r["n"] >= k:
                low, high, n = r["a"], r["b"], r["n"]
                break
            above += r["n"]
        else:
            return low
        if n <= exact_at:
            values = sorted((r[0] for r in scored.where(F.col(key).between(low, high)).select(key).collect()), reverse=True)
            return values[k - above - 1]


def _threshold(docs: DataFrame, ratio: Ratio, seed: int, k: int | None, temperature: float | None) -> tuple[DataFrame, float, float]:
    """doc_id, log_weight, sample_key of all rows; the smallest key that is kept; the temperature."""
    scored = cut(
        pick(docs, doc_id="long", text="string").mapInArrow(_weigh(ratio, seed), "doc_id long, log_weight double, noise double"), "weights"
    )
    n = scored.count()
    if temperature is None:
        temperature = 1.0
        if n and np.isfinite(ratio.cut):
            near = scored.select((-F.abs("log_weight")).alias("near"))
            temperature = max(1.0, -kth_largest(near, "near", int(np.ceil(NEAR * n))))
    keyed = scored.select("doc_id", "log_weight", (F.col("log_weight") / F.lit(float(temperature)) + F.col("noise")).alias("sample_key"))
    if k is None:
        k = scored.where("log_weight >= 0").count() if np.isfinite(ratio.cut) else n
    return keyed, kth_largest(keyed, "sample_key", min(k, n)) if min(k, n) > 0 else np.inf, temperature


def importance_sample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, max_rows: int = 50_000, seed: int = 11, temperature: float | None = None
) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, log_weight (summed log ratio of the target's and the raw model's probabilities of its
    n-grams, with a length term: Ratio.weigh), sample_key (that over the temperature, plus Gumbel noise by doc_id), kept (among the k
    largest keys; rows tied with the last stay too).

    k is by default how many documents weigh 0 or more, the cut between labels 1 and 0, so the sample is as large as the good part of
    the corpus; the temperature is by default the weight, either way, that a share NEAR of all documents doesn't exceed (1 at least).
    Whole texts count, also very long ones, in blocks. A null text or one without words has no n-grams but the NEUTRAL ones;
    null labels don't count; without labels of both kinds everything is kept; an empty table gives an empty result. Repeated rows get equal
    keys, and so do rows without a doc_id and of the same text. Extra columns of docs don't matter.
    """
    scored, least, _ = _threshold(docs, fit(docs, labels, max_rows, seed), seed, k, temperature)
    return scored.withColumn("kept", F.col("sample_key") >= F.lit(least))


def keep_sample(
    docs: DataFrame, labels: DataFrame, k: int | None = None, max_rows: int = 50_000, seed: int = 11, temperature: float | None = None
) -> DataFrame:
    """The rows of docs, all columns, that importance_sample() keeps; they are weighed again on the way, so no text is shuffled."""
    ratio = fit(docs, labels, max_rows, seed)
    _, least, temperature = _threshold(docs, ratio, seed, k, temperature)
    return docs.mapInArrow(_sample(ratio, seed, least, temperature), docs.schema)
