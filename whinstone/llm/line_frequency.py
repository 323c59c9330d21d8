"""Quality rules: lines that too many documents of a host share, and documents that little is left of without them.

Lines are normalised and hashed; distinct texts are counted for each host and line; a line over the host's limits is removed, and a
document that the removal depletes is rejected. Texts are read twice at most, and no shuffle carries one: lines travel as hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import LOWER, TEXT_BLOCK, cut, text_blocks

#: Fixed values of the base rules: the characters that count as symbols, the window of repeated words, and the limits.
SYMBOLS = b"#*$%&|<>"
NO_CHARACTER = b"\x20\t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))  # white space, and bytes that go on with a character
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20

#: A line is too frequent in a host if more distinct texts than MOST_TEXTS have it, and more than this share of the host's texts.
MOST_TEXTS, MOST_SHARE = 10, 0.002
#: A document is depleted if fewer words than LEAST_WORDS, or a smaller share of its words than this, stand outside such lines.
LEAST_LEFT = 0.5

#: Words whose windows are looked at together; a longer text is looked at by itself.
WORDS_TOGETHER = 1 << 20

FEATURES = (
    "doc_id long, host string, t1 long, t2 long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " lines array<struct<k1:long,k2:long,words:long>>"
)


def repeated_words(ids: np.ndarray, texts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words stand in a window that its text has twice or more. ids: each word's number; texts: its text's, ascending.

    Windows are told apart exactly, by ranks: those of two words, then of four, then of five.
    """
    n = len(ids)
    found = np.zeros(n + 1, np.int64)
    if n < window:
        return found[:n] > 0
    rank, length = ids.astype(np.int64), 1
    while length < window:
        step = min(length, window - length)
        left, right = rank[: len(rank) - step], rank[step:]
        rank = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True)[1].astype(np.int64)
        length += step
    last = window - 1
    whole = texts[: n - last] == texts[last:]
    key = (rank * (int(texts[-1]) - int(texts[0]) + 1) + (texts[: n - last] - texts[0]))[whole]
    _, at, times = np.unique(key, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(whole)[times[at] > 1]
    np.add.at(found, starts, 1)
    np.add.at(found, np.minimum(starts + window, n), -1)
    return np.cumsum(found[:n]) > 0


class _Windows:
    """Counts n_repeat_words of texts, some at a time."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.pending = 0

    def add(self, words: list[bytes]) -> None:
        """More words of the text that is open."""
        number = self.numbers
        self.words.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)))
        self.pending += len(words)

    def end(self, n_words: int) -> None:
        self.sizes.append(n_words)

    def flush(self) -> list[int]:
        sizes = np.array(self.sizes, np.int64)
        texts = np.repeat(np.arange(len(sizes)), sizes)
        ids = np.concatenate(self.words) if self.words else np.empty(0, np.int64)
        out = np.bincount(texts, weights=repeated_words(ids, texts), minlength=len(sizes)).astype(np.int64).tolist()
        self.__init__()
        return out


def _line_words(line: bytes) -> Iterator[list[bytes]]:
    """The words of a line, in lists of bounded length. bytes.split() parts at white space as the rules mean it: 09-0D and 20."""
    for block in [line] if len(line) <= TEXT_BLOCK else text_blocks(line):
        words = block.split()
        if words:
            yield words


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pair(value: int) -> tuple[int, int]:
    return _signed(value >> 64), _signed(value & (1 << 64) - 1)


def _owner(host: str | None) -> bytes:
    return b"\n" if host is None else b"=" + host.encode() + b"\n"


def text_key(owner: bytes, text: bytes) -> tuple[int, int]:
    """128 bits of a host and a text."""
    return _pair(xxhash.xxh3_128_intdigest(owner + text))


def line_key(owner: bytes, words: Iterator[list[bytes]]) -> tuple[tuple[int, int], int]:
    """128 bits of a host and a normalised line (A-Z lower-cased, words one space apart), and how many words the line has."""
    h, n = xxhash.xxh3_128(owner), 0
    for some in words:
        h.update((b" " if n else b"") + b" ".join(some).translate(LOWER))
        n += len(some)
    return _pair(h.intdigest()), n


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    numbers = ("t1", "t2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = pa.schema(
        [("doc_id", pa.int64()), ("host", pa.string()), *[(c, pa.int64()) for c in numbers]]
        + [("lines", pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("words", pa.int64())])))]
    )
    windows, done = _Windows(), []

    def out() -> pa.RecordBatch:
        rows = [(*r[:-1], repeated, r[-1]) for r, repeated in zip(done, windows.flush(), strict=True)]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def watched(words: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
        for some in words:
            windows.add(some)
            yield some

    for batch in batches:
        columns = (batch.column("doc_id").to_pylist(), batch.column("host").to_pylist(), batch.column("text").cast(pa.large_binary()))
        for doc_id, host, text in zip(*columns, strict=True):
            text, owner = text.as_py() or b"", _owner(host)
            seen: set[bytes] = set()
            lines: dict[tuple[int, int], int] = {}
            n_words = again = 0
            for line in text.split(b"\n"):
                key, n = line_key(owner, watched(_line_words(line)))
                if n:
                    again += line in seen
                    seen.add(line)
                    lines[key] = lines.get(key, 0) + n
                    n_words += n
            windows.end(n_words)
            counts = (n_words, len(text.translate(None, NO_CHARACTER)), len(text) - len(text.translate(None, SYMBOLS)), again)
            done.append((doc_id, host, *text_key(owner, text), *counts, [{"k1": a, "k2": b, "words": n} for (a, b), n in lines.items()]))
            if windows.pending >= WORDS_TOGETHER or len(done) >= 4096:
                yield out()
    if done:
        yield out()


def _judged(docs: DataFrame, host: str, most_texts: int, most_share: float) -> tuple[DataFrame, DataFrame]:
    """Features of all documents, and of the texts (t1, t2) that have lines over the limits: those lines and how many words they hold."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col("text").cast("string").alias("text"))
    features = cut(rows.mapInArrow(_features, FEATURES), "line-features")
    lines = cut(features.select("host", "t1", "t2", F.inline("lines")).distinct(), "lines")
    # distinct texts of a host, and of a host's line: copies are one row by now, and a hot line is counted before it is shuffled
    limits = features.select("host", "t1", "t2").distinct().groupBy("host").agg((F.count("*") * F.lit(float(most_share))).alias("most"))
    counts = lines.groupBy("k1", "k2", "host").agg(F.count("*").alias("n")).where(F.col("n") > most_texts)
    over = counts.join(limits.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("most"))
    over = cut(over.select("k1", "k2"), "frequent-lines")
    removed = lines.join(over, ["k1", "k2"]).groupBy("t1", "t2").agg(
        F.sum("words").alias("n_removed_words"), F.collect_list(F.struct("k1", "k2")).alias("removed")
    )
    return features.drop("lines"), cut(removed, "removed-lines")


def _verdict(least_left: float) -> F.Column:
    left = F.col("n_words") - F.col("n_removed_words")
    return ~F.col("base_failed") & (left >= LEAST_WORDS) & (left >= least_left * F.col("n_words"))


def line_quality(
    docs: DataFrame, host: str = "source", most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_words, kept for each row of docs
    (doc_id, text, and the column `host`).

    Words are runs without ASCII white space. n_dup_lines counts lines with a word that equal an earlier line; n_repeat_words the words
    in windows of five that a text has twice or more. The base rules fail texts of fewer than ten words, or with more than a fifth of
    their words repeated so. A line, normalised (A-Z lower-cased, words one space apart) and hashed with its host to 128 bits, is
    removed if more than most_texts distinct texts of its host have it and more than most_share of that host's distinct texts; a
    document is kept if the base rules pass and at least ten words, and the share least_left of its words, are outside such lines.

    Exact copies within a host are one text, so copying alone makes no line frequent, and equal texts of a host get equal verdicts. A
    null text has no words and fails; a null host is a host of its own; rows are never merged or dropped, null or repeated doc_ids
    included; an empty table gives no rows. Very long texts and lines are read whole, in blocks. Other columns, whatever their names,
    are ignored.
    """
    features, removed = _judged(docs, host, most_texts, most_share)
    rows = features.join(removed.drop("removed"), ["t1", "t2"], "left").withColumns(
        {
            "n_removed_words": F.coalesce("n_removed_words", F.lit(0)),
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
        }
    )
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words")
    return rows.select("doc_id", *counts, _verdict(least_left).alias("kept"))


def _without(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        texts = []
        for host, text, removed in zip(batch.column("_host").to_pylist(), batch.column("_text").cast(pa.large_binary()), batch.column("removed"), strict=True):
            gone = {(r["k1"], r["k2"]) for r in removed.as_py() or ()}
            text, owner = text.as_py(), _owner(host)
            if gone:
                text = b"\n".join(line for line in text.split(b"\n") if line_key(owner, _line_words(line))[0] not in gone)
            texts.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string())], ["doc", "_text"])


def _text_keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        hosts, texts = batch.column("_host").to_pylist(), batch.column("_text").cast(pa.large_binary())
        keys = [text_key(_owner(h), t.as_py() or b"") for h, t in zip(hosts, texts, strict=True)]
        for i, c in enumerate(("t1", "t2")):
            batch = batch.append_column(c, pa.array([k[i] for k in keys], pa.int64()))
        yield batch


def drop_frequent_lines(
    docs: DataFrame, host: str = "source", most_texts: int = MOST_TEXTS, most_share: float = MOST_SHARE, least_left: float = LEAST_LEFT
) -> DataFrame:
    """The documents that line_quality keeps, without their frequent lines: all columns of docs, of any name, text changed."""
    features, removed = _judged(docs, host, most_texts, most_share)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    texts = features.withColumn("base_failed", failed).select("t1", "t2", "n_words", "base_failed").distinct().join(removed, ["t1", "t2"], "left")
    kept = texts.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0))).where(_verdict(least_left)).select("t1", "t2", "removed")
    rows = docs.select(F.struct("*").alias("doc"), F.col(f"`{host}`").cast("string").alias("_host"), F.col("text").cast("string").alias("_text"))
    kind = rows.schema["doc"].dataType.simpleString()
    keyed = rows.mapInArrow(_text_keys, f"doc {kind}, _host string, _text string, t1 long, t2 long")
    clean = keyed.join(cut(kept, "kept-texts"), ["t1", "t2"]).select("doc", "_host", "_text", "removed").mapInArrow(_without, f"doc {kind}, _text string")
    return clean.select(*[F.col("_text").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
