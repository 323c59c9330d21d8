"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import cut, edit_distance, pick, release

HITS = "doc_id long, item_id long, distance int, start long, end long"


def normalise(text: str | None) -> str:
    """Lower case, white space collapsed."""
    return " ".join((text or "").lower().split())


def masks(pattern: str) -> dict[str, int]:
    """For each character the bits of its places in the pattern."""
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def myers(pattern: str, text: str, peq: dict[str, int] | None = None, whole: bool = False) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a part of text (to a prefix, if whole), and where the first such
    part ends. Bit-parallel: a column of the alignment table is two integers of len(pattern) bits."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq = masks(pattern) if peq is None else peq
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | whole
        pv = full & ((mh << 1) | ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


#: Length of the grams that a place must share with its item before the distance is worked out.
GRAM = 5
#: From here on lie the scripts that are written without spaces (Han, kana and what follows).
UNSPACED = "\u2e80"
#: Characters of items that a task holds at a time; about 150 bytes each with masks, grams and automaton.
BLOCK_CHARS = 2 << 20


class _Pieces:
    """Exact pieces of items, found in one Aho-Corasick pass over a text."""

    def __init__(self):
        import ahocorasick

        self.where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.automaton = ahocorasick.Automaton()

    def add(self, at: int, text: str, k: int) -> None:
        """Cut a text into k + 1 pieces, of which k edits leave one untouched."""
        for i in range(k + 1):
            a, b = i * len(text) // (k + 1), (i + 1) * len(text) // (k + 1)
            self.where[text[a:b]].append((at, a))

    def finish(self) -> None:
        for piece, where in self.where.items():
            self.automaton.add_word(piece, (len(piece), where))
        if self.where:
            self.automaton.make_automaton()

    def places(self, text: str) -> dict[int, set[int]]:
        """For each item that has a piece in text the places where it would start."""
        found: dict[int, set[int]] = defaultdict(set)
        if self.where and text:
            for end, (n, where) in self.automaton.iter(text):
                for at, offset in where:
                    found[at].add(end + 1 - n - offset)
        return found


def bounded(text: str, at: int) -> bool:
    """Whether a word may begin or end at this place: no two letters or digits of a script that parts words meet there."""
    if not 0 < at < len(text):
        return True
    a, b = text[at - 1], text[at]
    return not (a.isalnum() and b.isalnum()) or a >= UNSPACED or b >= UNSPACED


def n_words(text: str) -> int:
    """Words of a normalised text; a character of a script without spaces is one."""
    return sum(bounded(text, i) and c.isalnum() for i, c in enumerate(text))


class Matcher:
    """Items with at most `rate` edits a character, found in normalised texts.

    An item of n characters allows k = int(n * rate) edits and is cut into k + 1 pieces: k edits leave one of them untouched. One
    Aho-Corasick pass over a text finds all exact pieces; each gives a place where the item would lie, and places within the
    budget of each other are verified together. First the place's 5-grams are counted: an edit spoils at most five of the item's,
    so a place with fewer than n - 4 - 5k of them can't be within k edits. Items of fewer than min_chars characters have the same
    budget and pieces, but must lie between word bounds, and those of fewer than min_words words are held against whole texts.
    """

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int, min_words: int = 3):
        self.items, self.short, self.whole, self.longest_whole = [], [], [], 0
        self.pieces, self.short_pieces, self.whole_pieces = _Pieces(), _Pieces(), _Pieces()
        for item_id, text in items:
            text = normalise(text)
            k = int(len(text) * rate)
            if not text:
                continue
            if len(text) >= min_chars:
                grams = {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
                self.pieces.add(len(self.items), text, k)
                self.items.append((item_id, text, k, masks(text), grams))
            elif n_words(text) >= min_words:
                self.short_pieces.add(len(self.short), text, k)
                self.short.append((item_id, text, k))
            else:
                self.whole_pieces.add(len(self.whole), text, k)
                self.whole.append((item_id, text, k))
                self.longest_whole = max(self.longest_whole, len(text) + k)
        self.pieces.finish()
        self.short_pieces.finish()
        self.whole_pieces.finish()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best place of each item that occurs in text."""
        text = normalise(text)
        out = []
        if len(text) <= self.longest_whole:
            for at in self.whole_pieces.places(text):
                item_id, item, k = self.whole[at]
                if (distance := edit_distance(item, text, k)) <= k:
                    out.append((item_id, distance, 0, len(text)))
        for at, starts in self.short_pieces.places(text).items():
            item_id, item, k = self.short[at]
            if (best := self._best_words(text, item, k, sorted(starts))) is not None:
                out.append((item_id, *best))
        for at, starts in self.pieces.places(text).items():
            item_id, pattern, k, peq, grams = self.items[at]
            if (best := self._best(text, pattern, k, peq, grams, sorted(starts))) is not None:
                out.append((item_id, *best))
        return out

    def _best_words(self, text: str, item: str, k: int, starts: list[int]) -> tuple[int, int, int] | None:
        """The best place of a short item between word bounds; it begins within k characters of where a piece says."""
        best, done = None, -1
        for s in starts:
            for lo in range(max(0, s - k, done + 1), s + k + 1):
                done = lo
                if not bounded(text, lo):
                    continue
                for hi in range(max(lo + 1, lo + len(item) - k), min(len(text), lo + len(item) + k) + 1):
                    if bounded(text, hi) and (d := edit_distance(item, text[lo:hi], k)) <= k and (best is None or d < best[0]):
                        best = d, lo, hi
            if best is not None and not best[0]:
                break
        return best

    def _best(self, text: str, pattern: str, k: int, peq: dict, grams: set[str], starts: list[int]) -> tuple[int, int, int] | None:
        for s in starts:
            if text.startswith(pattern, max(s, 0)):
                return 0, max(s, 0), max(s, 0) + len(pattern)
        best, i = None, 0
        while i < len(starts):
            j = i
            while j + 1 < len(starts) and starts[j + 1] - starts[j] <= 2 * k and starts[j + 1] - starts[i] <= 8 * len(pattern):
                j += 1
            lo, hi = max(0, starts[i] - k), starts[j] + len(pattern) + k
            i, part = j + 1, text[lo:hi]
            least = len(pattern) - GRAM + 1 - GRAM * k
            if least > 0 and sum(part[g : g + GRAM] in grams for g in range(len(part) - GRAM + 1)) < least:
                continue
            distance, end = myers(pattern, part, peq)
            if distance <= k and (best is None or distance < best[0]):
                _, back = myers(pattern[::-1], text[lo : lo + end][::-1], whole=True)
                best = distance, lo + end - back, lo + end
        return best


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about block_chars characters the items make, and these one by one: where the caller writes what a block
    finds before it takes the next, the driver and a task hold one block's items at a time."""
    items = pick(benchmark, item_id="long", text="string").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))

    def blocks() -> Iterator[list[tuple[int, str]]]:
        for k in range(n):
            mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
            yield [(r["item_id"], r["text"]) for r in mine.collect()]

    return n, blocks()


def _hits(items: list, rate: float, min_chars: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate, min_chars, min_words)
        for batch in batches:
            rows = [
                (doc, *hit)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for hit in matcher.find(text)
            ]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def _clean(items: list, rate: float, min_chars: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(items, rate, min_chars, min_words)
        for batch in batches:
            keep = [not matcher.find(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = 24, min_words: int = 3, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row for each pair of a row of docs (doc_id, text) and an item of benchmark (item_id, text) that occurs in it with at most
    int(rate * item length) edits: doc_id, item_id, distance, start, end (characters of the normalised text).

    Texts and items are lower-cased with white space collapsed. Null or empty texts and items match nothing. An item of fewer than
    min_chars characters must begin and end at word bounds, or it would be found within longer words; one of fewer than min_words
    words (characters, in scripts without spaces) is vocabulary rather than a passage and counts only where it is a whole document,
    unless min_words is 1. Both have the same budget of edits. Texts of any length are searched whole. Of several places of an item the one with the smallest distance is given, of equal ones the first. Repeated
    documents or items give repeated pairs; empty tables give none; extra columns don't matter. There is no shuffle: items come in
    bounded blocks, each one pass over the documents, whose hits are written before the next block is read.
    """
    texts = pick(docs, doc_id="long", text="string")
    n, blocks = _blocks(benchmark, block_chars)
    out = None
    for items in blocks:
        found = texts.mapInArrow(_hits(items, rate, min_chars, min_words), HITS)
        found = cut(found, "hits") if n > 1 else found
        out = found if out is None else out.union(found)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, min_chars: int = 24, min_words: int = 3, block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """The rows of docs, all columns, in which no item of benchmark occurs (see contamination()). With several blocks of items, what
    one leaves is written before the next is read."""
    n, blocks = _blocks(benchmark, block_chars)
    left = docs
    for items in blocks:
        before, left = left, left.mapInArrow(_clean(items, rate, min_chars, min_words), docs.schema)
        if n > 1:
            left = cut(left, "clean")
            if before is not docs:
                release(before)
    return left
