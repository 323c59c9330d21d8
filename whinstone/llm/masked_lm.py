"""Masked pseudo-likelihood: a bidirectional window network, trained in numpy, predicts every word from both sides."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import LOWER, binary_texts, cut, pick, text_blocks

#: Context words on each side, width of the hidden layer, and the least output classes x words per class (a two-level softmax).
SIDE, WIDTH, CLASSES, PER_CLASS = 2, 16, 32, 32
VOCABULARY = CLASSES * PER_CLASS
#: Words outside the vocabulary fall into this many buckets by hash; they take the last ids.
UNKNOWN = 256
#: From so many words on the vocabulary grows with the cube root of the corpus.
LEAST_WORDS = 1 << 22
#: Counts of so many words outside the vocabulary, the most frequent, go to the tasks; those of the others are joined.
HEAD = 100_000
#: Positions of a training step, and of a scoring block.
STEP, BLOCK = 8192, 16384
FIXED_POINT = 1e6
_OFFSETS = [*range(-SIDE, 0), *range(1, SIDE + 1)]


def side(n_words: int) -> int:
    """Classes, and words per class, for a corpus of so many words."""
    return round(CLASSES * max(1.0, n_words / LEAST_WORDS) ** (1 / 6))


def _hash(word: bytes) -> int:
    """63 bits: those of Spark's xxhash64 but the last."""
    return xxhash.xxh64_intdigest(word, 42) >> 1


class Vocabulary(dict):
    """word: id. Ids end at `size`; counts are those of words outside: per bucket (`totals`, `kinds`), of frequent ones by word
    (`head`), of all others by hash (`tail`: h, n)."""

    size, head = VOCABULARY, {}
    totals = kinds = np.zeros(UNKNOWN, np.int64)
    tail: DataFrame | None = None


class Words(dict):
    """Codes of words as bytes: the id, or for unknown ones -1 - hash, remembered up to a bound."""

    def __init__(self, vocabulary: dict, size: int | None = None):
        super().__init__(vocabulary)
        self.size = size or getattr(vocabulary, "size", VOCABULARY)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            for w in [w for w, i in self.items() if i < 0]:
                del self[w]
        self[word] = code = -1 - (xxhash.xxh64_intdigest(word, 42) >> 1)  # _hash()
        return code


def word_codes(words: Words, text: bytes | None) -> np.ndarray:
    if not text:
        return np.empty(0, np.int64)
    get = words.__getitem__
    parts = []
    for block in text_blocks(text):
        found = block.translate(LOWER).split()
        parts.append(np.fromiter(map(get, found), np.int64, len(found)))
    return np.concatenate(parts)


def code_ids(codes: np.ndarray, size: int) -> np.ndarray:
    """Ids of codes: unknown words' buckets."""
    return np.where(codes < 0, size - UNKNOWN + (-1 - codes) % UNKNOWN, codes).astype(np.int32)


def word_ids(words: Words, text: bytes | None) -> np.ndarray:
    return code_ids(word_codes(words, text), words.size)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def out():
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"]
        )
        seen.clear()
        return batch

    for batch in batches:
        for text in binary_texts(batch.column("text")):
            for block in text_blocks(text or b""):
                seen.update(block.translate(LOWER).split())
        if len(seen) > 200_000:
            yield out()
    yield out()


def initial_model(counts: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the biases are the log frequencies, so training begins at the unigram model."""
    rng = np.random.default_rng(seed)
    p = (counts + 1.0) / (counts.sum() + len(counts))
    n = round(len(counts) ** 0.5)
    by_class = p.reshape(n, n)
    return {
        "embed": rng.normal(0, 0.1, (2 * SIDE, len(counts) + 1, WIDTH)).astype(np.float32),
        "class_w": rng.normal(0, 0.1, (WIDTH, n)).astype(np.float32),
        "class_b": np.log(by_class.sum(1)).astype(np.float32),
        "word_w": rng.normal(0, 0.1, (n, WIDTH, n)).astype(np.float32),
        "word_b": np.log(by_class / by_class.sum(1, keepdims=True)).astype(np.float32),
    }


def _exp(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp of the rows of x, in its place, and their sums. Hidden values lie within -1 and 1, so logits stay small; 80 keeps float32 finite."""
    e = np.exp(np.minimum(x, 80, out=x), out=x)
    return e, e @ np.ones(x.shape[1], np.float32)


def _off(x: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """What a softmax of the rows of x has too much, with 1 at `place` as the truth; a share of n rows."""
    e, total = _exp(x)
    e *= (np.float32(1 / n) / total)[:, None]
    e[np.arange(len(e)), place] -= np.float32(1 / n)
    return e


def _with_bias(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with the bias as their last row: the hidden values' last column is 1."""
    return np.concatenate([weights, bias[..., None, :]], axis=-2)


def _forward(model: dict, ids: np.ndarray, at: np.ndarray):
    """Hidden values of positions `at` of ids (padded with the vocabulary's size on both sides), a column of ones beside them, and their
    words sorted by class."""
    total = model["embed"][0].take(ids[at + _OFFSETS[0]], axis=0)
    for k, o in enumerate(_OFFSETS[1:], 1):
        total += model["embed"][k].take(ids[at + o], axis=0)
    h = np.ones((len(at), total.shape[1] + 1), np.float32)
    np.tanh(total, out=h[:, :-1])
    target = ids[at]
    classes, _, per_class = model["word_w"].shape
    cls = target // per_class
    order = _order(cls, classes)
    bounds = np.searchsorted(cls[order], np.arange(classes + 1))
    return h, target, cls, order, bounds


def log_probabilities(model: dict, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """log p(word | the words around it) at each position."""
    out = np.empty(len(at), np.float64)
    to_class, to_word = _with_bias(model["class_w"], model["class_b"]), _with_bias(model["word_w"], model["word_b"])
    for lo in range(0, len(at), BLOCK):
        here = at[lo : lo + BLOCK]
        h, target, cls, order, bounds = _forward(model, ids, here)
        x = h @ to_class
        got = (x[np.arange(len(here)), cls] - np.log(_exp(x)[1])).astype(np.float64)
        by_class, place = h.take(order, axis=0), target[order] % model["word_w"].shape[2]
        inner = np.empty(len(here))
        for c in np.flatnonzero(np.diff(bounds)):
            a, b = bounds[c], bounds[c + 1]
            x = by_class[a:b] @ to_word[c]
            inner[a:b] = x[np.arange(b - a), place[a:b]] - np.log(_exp(x)[1])
        got[order] += inner
        out[lo : lo + BLOCK] = got
    return out


def _order(x: np.ndarray, size: int) -> np.ndarray:
    """A stable order of numbers below size; small ones are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if size < 1 << 16 else x, kind="stable")


def _views(flat: np.ndarray, like: dict) -> dict:
    """Parts of a flat array, shaped like the parameters, one after the other by name."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class Trainer:
    """Adam over blocks of positions; parameters, gradients and moments are flat arrays, so a step updates all of them at once."""

    def __init__(self, model: dict, rate: float):
        self.flat = np.concatenate([model[k].ravel() for k in sorted(model)]).astype(np.float32)
        self.g, self.m, self.v, self.work = (np.zeros_like(self.flat) for _ in range(4))
        self.model, self.gradient = _views(self.flat, model), _views(self.g, model)
        self.t, self.rate = 0, rate

    def step(self, ids: np.ndarray, at: np.ndarray) -> None:
        model, n = self.model, len(at)
        h, target, cls, order, bounds = _forward(model, ids, at)
        g = self.gradient
        self.g[:] = 0
        p = _off(h @ _with_bias(model["class_w"], model["class_b"]), cls, n)
        both = h.T @ p
        g["class_w"][:], g["class_b"][:] = both[:-1], both[-1]
        gh = p @ model["class_w"].T
        to_word = _with_bias(model["word_w"], model["word_b"])
        by_class, place, back = h.take(order, axis=0), target[order] % to_word.shape[2], np.empty_like(gh)
        for c in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[c], bounds[c + 1]
            hr = by_class[lo:hi]
            q = _off(hr @ to_word[c], place[lo:hi], n)
            both = hr.T @ q
            g["word_w"][c], g["word_b"][c] = both[:-1], both[-1]
            np.matmul(q, model["word_w"][c].T, out=back[lo:hi])
        gh[order] += back
        h = h[:, :-1]
        gh *= 1 - h * h
        # the neighbours' words are sorted once: beside each of them lie the positions that it is a neighbour of
        first, last = at[0] - SIDE, at[-1] + SIDE
        spread = np.zeros((last - first + 1 + 2 * SIDE, gh.shape[1]), np.float32)
        spread[at - first + SIDE] = gh
        around = ids[first : last + 1]
        by = _order(around, model["embed"].shape[1])
        around = around[by]
        starts = np.flatnonzero(np.append(True, around[1:] != around[:-1]))
        beside = np.concatenate([spread.take(by + (SIDE - o), axis=0) for o in _OFFSETS], axis=1)
        sums = np.add.reduceat(beside, starts, axis=0).reshape(len(starts), len(_OFFSETS), -1)
        for k in range(len(_OFFSETS)):
            g["embed"][k][around[starts]] = sums[:, k]
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        # m and v are held as ten and a thousand times themselves, which takes fewer passes
        m, v, work = self.m, self.v, self.work
        m *= np.float32(0.9)
        m += self.g
        v *= np.float32(0.999)
        v += np.multiply(self.g, self.g, out=work)
        np.sqrt(v, out=work)
        work += np.float32(1e-8 * 1000**0.5)
        np.divide(m, work, out=work)
        work *= np.float32(scale * 0.1 * 1000**0.5)
        self.flat -= work


def _join(parts: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids in one array with padding between them, and the positions of words in it."""
    pad = np.full(SIDE, size, np.int32)
    ids = np.concatenate([pad, *[x for p in parts for x in (p, pad)]])
    return ids, np.flatnonzero(ids != size)


def _encode(vocabulary: Vocabulary):
    """Documents as codes (int32): ids of vocabulary words, beyond them the places in `head`, of other words -1 - bucket, and the hashes
    of the latter."""
    n_ids = vocabulary.size
    codes = dict(vocabulary) | {w: n_ids + i for i, w in enumerate(vocabulary.head)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(codes, n_ids)
        for batch in batches:
            texts, first = binary_texts(batch.column("text")), 0
            while first < len(texts):  # a few documents at a time
                here, size = [], 0
                while first + len(here) < len(texts) and size < 1 << 19:
                    here.append(word_codes(words, texts[first + len(here)]))
                    size += len(here[-1])
                flat = np.concatenate(here)
                far = flat < 0
                ends = np.cumsum([0, *map(len, here)])
                rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(far))[ends], pa.int32()), pa.array(-1 - flat[far]))
                flat = np.where(far, -1 - (-1 - flat) % UNKNOWN, flat).astype(np.int32)
                coded = pa.array([flat[lo:hi].tobytes() for lo, hi in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(here)), coded, rare], names=["doc_id", "codes", "rare"])
                first += len(here)

    return run


def _head_buckets(vocabulary: Vocabulary) -> np.ndarray:
    return np.array([_hash(w) % UNKNOWN for w in vocabulary.head], np.int32)


def _coded_ids(codes: bytes, size: int, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of _encode(), and their ids: those of other words are buckets."""
    codes = np.frombuffer(codes, np.int32)
    ids = np.where(codes < 0, size - UNKNOWN - 1 - codes, codes)
    known = codes >= size
    ids[known] = size - UNKNOWN + buckets[codes[known] - size]
    return codes, ids


def _train(model: dict, vocabulary: Vocabulary, rate: float):
    n_ids, buckets = model["embed"].shape[1] - 1, _head_buckets(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, total, parts, size = Trainer(model, rate), 0, [], 0

        def learn():
            ids, at = _join(parts, n_ids)
            for lo in range(0, len(at), STEP):
                trainer.step(ids, at[lo : lo + STEP])

        for batch in batches:
            for codes in batch.column("codes").to_pylist():
                if len(ids := _coded_ids(codes, n_ids, buckets)[1]):
                    parts.append(ids)
                    size += len(ids)
                    total += len(ids)
                if size >= 16 * STEP:
                    learn()
                    parts, size = [], 0
        if parts:
            learn()
        if total:
            weight = total // 1000 + 1
            flat = trainer.flat.astype(np.float64)
            value = np.rint(flat * FIXED_POINT).astype(np.int64) * weight
            slots = np.arange(-1, len(flat), dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(slots), pa.array(np.insert(value, 0, weight))], names=["slot", "value"]
            )

    return run


def _score(model: dict, vocabulary: Vocabulary):
    n_ids, buckets = vocabulary.size, _head_buckets(vocabulary)
    logs = np.log(np.array(list(vocabulary.head.values()), np.float64) + 1)
    below = np.log(vocabulary.totals + vocabulary.kinds + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, first = batch.column("codes").to_pylist(), 0
            while first < len(parts):  # a few documents at a time
                last, size = first, 0
                while last < len(parts) and (last == first or size < 1 << 19):
                    size += len(parts[last]) // 4
                    last += 1
                sizes = np.array([len(p) // 4 for p in parts[first:last]], np.int64)
                sums = np.zeros(len(sizes))
                if size:
                    flat, ids = _coded_ids(b"".join(parts[first:last]), n_ids, buckets)
                    joined, at = _join(np.split(ids, np.cumsum(sizes)[:-1]), n_ids)
                    got = log_probabilities(model, joined, at)
                    known = flat >= n_ids
                    out = known | (flat < 0)
                    got[out] -= below[ids[out] - (n_ids - UNKNOWN)]
                    got[known] += logs[flat[known] - n_ids]
                    doc = np.repeat(np.arange(len(sizes)), sizes)
                    sums += np.bincount(doc, weights=got, minlength=len(sizes))
                cols = [batch.column(c).slice(first, last - first) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes), pa.array(sums)], names=["doc_id", "row", "n_tokens", "log_prob"])
                first = last

    return run


def count(docs: DataFrame, head: int = HEAD) -> tuple[Vocabulary, np.ndarray]:
    """Vocabulary (word: id), and the counts of its ids, from all documents.

    Words are counted over the corpus (a map-side count, then one aggregation); the most frequent become the vocabulary, which
    grows with the corpus; counts of all others stay for the words' shares of their buckets.
    """
    texts = pick(docs, doc_id="long", text="string")
    found = cut(
        texts.select("text").mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts"
    )
    kinds = sorted(map(tuple, found.groupBy("n").agg(F.count("*")).collect()), reverse=True)
    vocabulary = Vocabulary()
    vocabulary.size = side(sum(n * k for n, k in kinds)) ** 2
    keep = vocabulary.size - UNKNOWN
    top = found.orderBy(F.desc("n"), "word").limit(keep).collect()
    vocabulary.update((bytes(r["word"]), i) for i, r in enumerate(top))
    least, total = (kinds[0][0] + 1 if kinds else 1), 0
    for n, k in kinds:
        total += k
        if total > keep + head:
            break
        least = n
    vocabulary.head = {w: r["n"] for r in found.where(F.col("n") >= least).collect() if (w := bytes(r["word"])) not in vocabulary}
    hashed = found.select(F.shiftrightunsigned(F.xxhash64("word"), 1).alias("h"), "n")
    vocabulary.tail = hashed.where(F.col("n") < least)
    vocabulary.totals, vocabulary.kinds = np.zeros(UNKNOWN, np.int64), np.zeros(UNKNOWN, np.int64)
    for r in hashed.groupBy((F.col("h") % UNKNOWN).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).collect():
        vocabulary.totals[r["b"]], vocabulary.kinds[r["b"]] = r["n"], r["k"]
    for r in top:
        b = _hash(bytes(r["word"])) % UNKNOWN
        vocabulary.totals[b] -= r["n"]
        vocabulary.kinds[b] -= 1
    counts = np.ones(vocabulary.size)
    counts[: len(top)] = [r["n"] for r in top]
    counts[keep:] = np.maximum(1, vocabulary.totals)
    return vocabulary, counts


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """A table of doc_id, codes, rare, row of docs (doc_id, text): training and scoring look no word up again."""
    coded = pick(docs, doc_id="long", text="string").mapInArrow(_encode(vocabulary), "doc_id long, codes binary, rare array<long>")
    return cut(coded.withColumn("row", F.monotonically_increasing_id()), "lm-codes")


def train(coded: DataFrame, vocabulary: Vocabulary, counts: np.ndarray, rounds: int = 2, rate: float = 0.01) -> dict:
    """The model of encoded documents.

    In each round, a share of the documents by hash of doc_id, every partition trains from the same model over all its documents, and the
    models' weighted mean begins the next round. Parameters are summed as fixed-point longs, so the mean doesn't depend on order;
    what the partitions send is a fixed number of rows each and is summed by Spark: the driver gets one model.
    """
    model = initial_model(counts)
    for k in range(rounds):
        dealt = coded.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k).select("codes")
        sent = dealt.mapInArrow(_train(model, vocabulary, rate), "slot int, value long")
        rows = sent.groupBy("slot").agg(F.sum("value").alias("value")).toPandas().sort_values("slot")
        if len(rows):
            values = rows["value"].to_numpy()
            flat = (values[1:] / values[0] / FIXED_POINT).astype(np.float32)
            model = _views(flat, model)
    return model


def fit(docs: DataFrame, rounds: int = 2, rate: float = 0.01, head: int = HEAD) -> tuple[Vocabulary, dict]:
    """Vocabulary and model, from all documents."""
    vocabulary, counts = count(docs, head)
    return vocabulary, train(encode(docs, vocabulary), vocabulary, counts, rounds, rate)


def score(docs: DataFrame, vocabulary: Vocabulary, model: dict) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_tokens, log_prob (the sum over its words), mean_log_prob (null without words).

    A word outside the vocabulary has its bucket's probability times its own share of the bucket, (n + 1) / (words + kinds + 1): one
    more kind stands for words that the corpus doesn't have. Counts of rare words are joined, as they grow with the corpus.
    """
    return _scored(encode(docs, vocabulary), vocabulary, model)


def _scored(coded: DataFrame, vocabulary: Vocabulary, model: dict) -> DataFrame:
    scored = coded.select("doc_id", "row", "codes").mapInArrow(_score(model, vocabulary), "doc_id long, row long, n_tokens long, log_prob double")
    scored = cut(scored, "lm-scores")
    rare = coded.select("row", F.explode("rare").alias("h")).join(vocabulary.tail, "h")
    log = F.round(F.log(F.col("n") + 1.0) * FIXED_POINT).cast("long")
    more = rare.groupBy("row").agg((F.sum(log) / FIXED_POINT).alias("more"))
    scored = scored.join(more, "row", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens"))
    return scored.select("doc_id", "n_tokens", "log_prob", mean.alias("mean_log_prob"))


def masked_lm_scores(docs: DataFrame, rounds: int = 2, rate: float = 0.01) -> DataFrame:
    """Every document's masked pseudo-likelihood under a model of the same corpus.

    A null or empty text has no words: n_tokens 0, log_prob 0, mean null. Repeated rows score alike; an empty table gives an empty
    result; whole texts are used, in blocks, however long.
    """
    vocabulary, counts = count(docs)
    coded = encode(docs, vocabulary)
    return _scored(coded, vocabulary, train(coded, vocabulary, counts, rounds, rate))
