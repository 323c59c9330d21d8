"""Toxicity scores: gradient-boosted trees over dense features, calibrated isotonically."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.boosting import BoostedTrees, Isotonic
from whinstone.llm.common import LOWER, binary_texts, pick, text_blocks

#: Insults of four languages, and words that address somebody (fixed values).
INSULTS = """arsehole asshole bastard bitch clown cretin disgusting dumb fool freak garbage idiot imbecile jerk liar loser moron
pathetic pig scum stupid trash ugly worthless arschloch depp dumm dummkopf idiotin schwein trottel abruti connard con crétin
débile imbécile minable ordure salaud asqueroso basura cerdo estúpido imbécil inútil tonto""".split()
SECOND_PERSON = "you your yours yourself u ur ya du dich dir dein deine ihr euch tu toi ton vous votre tú usted ustedes vosotros".split()

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
# possessive, and only from a word's beginning: linear even for a word as long as a book
_MASKED = re.compile(rb"(?<![A-Za-z\x80-\xff])[A-Za-z\x80-\xff]++(?:[*@$#!0-9._-]++[A-Za-z\x80-\xff]++)++")
_PLAIN = bytes.maketrans(b"0134578@$!", b"oieastbasi")
_STRIP = b"*#._-"
_UPPER, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
NEAR = 6
STEMS = (4, 5, 6)


@dataclass
class Lexicon:
    """Learned evidence: words and stems (beginnings of words) with the log-odds of toxic documents that hold them."""

    words: dict[bytes, float]
    stems: dict[bytes, float]


class _Evidence(dict):
    """word: (log-odds as a word, log-odds by its stems, whether it is a listed insult); remembered up to a bound."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.listed = lexicon, {w.encode() for w in INSULTS}

    def __missing__(self, word: bytes):
        if len(self) > 300_000:
            self.clear()
        stems = self.lexicon.stems
        stem = max((stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k), default=0.0)
        found = (self.lexicon.words.get(word, 0.0), stem, word in self.listed)
        self[word] = found = found if any(found) else None
        return found


FEATURES = 22


def features(text: bytes | None, evidence: _Evidence, second: frozenset[bytes]) -> list[float]:
    """Dense features of a whole text."""
    text = text or b""
    n = listed = 0
    word_hits, stem_hits, places, people = [], [], [], []
    masked = masked_hits = 0
    for block in text_blocks(text):
        words = _WORD.findall(block.translate(LOWER))
        for i, w in enumerate(words, n):
            found = evidence[w]
            if found:
                if found[0]:
                    word_hits.append(found[0])
                if found[1]:
                    stem_hits.append(found[1])
                listed += found[2]
                places.append(i)
            if w in second:
                people.append(i)
        n += len(words)
        for m in _MASKED.findall(block):
            masked += 1
            found = evidence[m.translate(LOWER).translate(_PLAIN, _STRIP)]
            masked_hits += bool(found and (found[0] or found[2]))
    near = 0
    if places and people:
        at = np.searchsorted(people, places)
        p = np.array([-(10**9), *people, 10**9])
        near = int((np.minimum(p[at + 1] - places, np.array(places) - p[at]) <= NEAR).sum())
    chars = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if text else np.zeros(256, np.int64)
    size, letters, k = max(1, len(text)), max(1, int(chars[_LETTER].sum())), max(1, n)
    bang, ask = int(chars[33]), int(chars[63])
    other = int(chars[33:48].sum() + chars[58:65].sum() + chars[91:97].sum() + chars[123:127].sum())
    return [
        len(word_hits), len(word_hits) / k, max(word_hits, default=0.0), sum(word_hits), sum(word_hits) / k,
        len(stem_hits), len(stem_hits) / k, max(stem_hits, default=0.0), sum(stem_hits), sum(stem_hits) / k,
        listed, listed / k, len(people) / k, near, near / k,
        int(chars[_UPPER].sum()) / letters, bang / size, ask / size, other / size, int(chars[_DIGIT].sum()) / size,
        masked / k + masked_hits, np.log1p(n),
    ]


def learn_lexicon(texts: list[bytes | None], toxic: np.ndarray, least: int = 4, odds: float = 1.2) -> Lexicon:
    """Words and stems that at least `least` toxic documents hold, with smoothed log-odds over `odds`."""
    in_toxic, in_clean = (Counter(), Counter()), (Counter(), Counter())
    for pick_toxic, into in ((True, in_toxic), (False, in_clean)):
        for text, y in zip(texts, toxic, strict=True):
            if bool(y) == pick_toxic and text:
                words = set().union(*(_WORD.findall(b.translate(LOWER)) for b in text_blocks(text)))
                stems = {w[:k] for w in words for k in STEMS if len(w) >= k}
                if not pick_toxic:
                    words &= in_toxic[0].keys()
                    stems &= in_toxic[1].keys()
                into[0].update(words)
                into[1].update(stems)
        if pick_toxic:
            for c in into:
                for w in [w for w, k in c.items() if k < least]:
                    del c[w]
    a, b = float((toxic == 1).sum()), float((toxic == 0).sum())

    def weigh(bad: Counter, good: Counter) -> dict[bytes, float]:
        got = {w: float(np.log((k + 0.5) / (a + 1)) - np.log((good[w] + 0.5) / (b + 1))) for w, k in bad.items()}
        return {w: s for w, s in got.items() if s > odds}

    return Lexicon(weigh(in_toxic[0], in_clean[0]), weigh(in_toxic[1], in_clean[1]))


@dataclass
class Model:
    lexicon: Lexicon
    trees: BoostedTrees
    calibration: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.calibration(self.trees.margin(x)) if len(x) else np.empty(0)


def table(texts: list[bytes | None], lexicon: Lexicon) -> np.ndarray:
    evidence, second = _Evidence(lexicon), frozenset(w.encode() for w in SECOND_PERSON)
    return np.array([features(t, evidence, second) for t in texts], float).reshape(len(texts), FEATURES)


def fit(texts: list[bytes | None], toxic: np.ndarray) -> Model:
    """Two folds: each one's features come from the lexicon of the other, so trees never see how a lexicon fits its own rows; each
    one's margins come from the trees of the other, and calibrate them. Without both labels every score is the share of toxic rows."""
    toxic = np.asarray(toxic, float)
    fold = np.arange(len(texts)) % 2
    if len(texts) < 8 or min((toxic == 1).sum(), (toxic == 0).sum()) < 2:
        constant = Isotonic()
        constant.y = np.array([toxic.mean() if len(toxic) else 0.0])
        return Model(Lexicon({}, {}), BoostedTrees(), constant)
    sides = [np.flatnonzero(fold == k) for k in (0, 1)]
    lexicons = [learn_lexicon([texts[i] for i in s], toxic[s]) for s in sides]
    x = np.zeros((len(texts), FEATURES))
    for s, lexicon in zip(sides, lexicons[::-1], strict=True):
        x[s] = table([texts[i] for i in s], lexicon)
    margins = np.zeros(len(texts))
    for s, o in (sides, sides[::-1]):
        margins[o] = BoostedTrees().fit(x[s], toxic[s]).margin(x[o])
    return Model(learn_lexicon(texts, toxic), BoostedTrees().fit(x, toxic), Isotonic().fit(margins, toxic))


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence, second = _Evidence(model.lexicon), frozenset(w.encode() for w in SECOND_PERSON)
        for batch in batches:
            rows = [features(t, evidence, second) for t in binary_texts(batch.column("text"))]
            x = np.array(rows, float).reshape(len(rows), FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, max_chars: int) -> tuple[list[bytes | None], np.ndarray]:
    """Training rows (never held-out ones): of at most max_rows labelled doc_ids, taken by their hash, at most max_rows different texts,
    taken by a hash of id and text, and of these, whole texts only, max_chars characters; a text that doesn't fit is left out, those
    after it aren't. Only what is chosen reaches the driver. Labels of several rows count as toxic if one does; null labels or ids
    don't count, and repeated rows count once."""
    known = pick(labels, doc_id="long", toxic="int").where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = pick(docs, doc_id="long", text="string").withColumn("key", F.xxhash64("doc_id", "text"))
    found = texts.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "key", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    sizes, left = [], max_chars
    for r in found.distinct().orderBy("key", "doc_id").limit(max_rows).collect():
        if r["n"] <= left:
            sizes.append(r)
            left -= r["n"]
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["key"]) for r in sizes], "doc_id long, key long")
    rows = texts.join(F.broadcast(chosen), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "text").toArrow()
    toxic = {r["doc_id"]: r["toxic"] for r in sizes}
    got = sorted(zip(rows["doc_id"].to_pylist(), binary_texts(rows["text"]), strict=True), key=lambda x: (x[0], x[1] or b""))
    return [t for _, t in got], np.array([toxic[i] for i, _ in got])


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_chars: int = 40_000_000) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, score (0 to 1), predicted (1 if score >= 0.5).

    Learns from labels (doc_id, toxic) of rows that are not held out (crc32 of doc_id as text, modulo 5, is not 0), at most
    max_rows of them: lexicons, trees and calibration are fitted on the driver within that bound; scoring is one pass without a
    shuffle over whole texts. Only the text is ever looked at. Null and empty texts score as texts without words; without labels
    every score is 0. Repeated rows and equal texts get equal scores, rows are never merged or dropped, an empty table gives no rows,
    and other columns, whatever their names, are ignored.
    """
    model = fit(*labelled_sample(docs, labels, max_rows, max_chars))
    scored = pick(docs, doc_id="long", text="string").mapInArrow(_scorer(model), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
