"""Heading-aware chunks of notes, with ids that depend on place and hashes that depend on content."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from whinstone.functions.text import UNIT, digest, strip

CHUNKS = (
    "id string, note_path string, title string, heading_path array<string>, text string, char_start int, char_end int,"
    " content_hash string"
)
_LINE = re.compile(r"[^\n\r\x0b\x0c\x1c-\x1e\x85  ]*(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]|\Z)")
_HEAD = re.compile(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*", re.S)
JOINT = "\n\n"


def sections(body: str) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """(headings above, start, end) of the stretches between heading lines. A heading closes those of its level and below; levels
    that a note skips are simply missing from the path."""
    path: tuple[str, ...] = ()
    start = 0
    for m in _LINE.finditer(body):
        if m.start() == m.end():
            break
        head = _HEAD.fullmatch(m.group().rstrip("\r\n")) if m.group()[0] == "#" else None
        if head:
            yield path, start, m.start()
            path = (*path[: len(head[1]) - 1], head[2].strip())
            start = m.end()
    yield path, start, len(body)


def paragraph_spans(text: str, most: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans of at most `most` characters: as many paragraphs as fit; a longer paragraph by windows that overlap, its rest open for
    what follows. Spans of packed paragraphs don't overlap."""
    step = most - overlap
    lo = hi = at = 0
    for size in map(len, text.split(JOINT)):
        start, end = at, at + size
        at = end + len(JOINT)
        first = lo if hi > lo else start
        if end - first <= most:
            lo, hi = first, end
            continue
        if text[lo:hi].strip():
            yield lo, hi
        windows = max(0, -(-(size - most) // step))
        for i in range(windows):
            yield start + i * step, start + i * step + most
        lo, hi = start + windows * step, end
    if text[lo:hi].strip():
        yield lo, hi


def chunk_spans(body: str, most: int = 1200, overlap: int = 150) -> list[tuple[tuple[str, ...], str, int, int]]:
    """(headings, text, start, end): sections, split where too long, neighbours under the same headings joined while they fit."""
    if most <= 0 or overlap >= most:
        raise ValueError("chunks need a positive size that is larger than their overlap")
    out: list[tuple[tuple[str, ...], str, int, int]] = []
    for path, start, end in sections(body):
        text = body[start:end].strip()
        if not text:
            continue
        spans = [(0, len(text))] if len(text) <= most else paragraph_spans(text, most, overlap)
        for lo, hi in spans:
            piece = text[lo:hi].strip()
            if out and out[-1][0] == path and len(out[-1][1]) + len(piece) + len(JOINT) <= most:
                path, before, first, _ = out.pop()
                out.append((path, before + JOINT + piece, first, start + hi))
            else:
                out.append((path, piece, start + lo, start + hi))
    return out


def _sha(*parts: object) -> str:
    return hashlib.sha1("".join(f"{p}{UNIT}" for p in parts).encode(), usedforsecurity=False).hexdigest()[:16]


Chunker = Callable[[str, int, int], list[tuple[tuple[str, ...], str, int, int]]]


def _chunk(most: int, overlap: int, carry: Sequence[str] = (), spans: Chunker = chunk_spans, errors: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "note_path", "title", "heading_path", "text", "char_start", "char_end", "content_hash"]
        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string()]
        for batch in batches:
            rows, of, why = [], [], []
            for i, (path, title, body) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "title", "body")), strict=True)):
                try:
                    found = [(_sha(path, " > ".join(h), a), path, title, list(h), text, a, b, _sha(text)) for h, text, a, b in spans(body or "", most, overlap)]
                    why.extend([None] * len(found))
                except Exception as e:  # whatever a note breaks is that note's failure, not the job's
                    if not errors:
                        raise
                    found = [(None, path, title, None, None, None, None, None)]
                    why.append(f"{type(e).__name__}: {e}")
                rows += found
                of += [i] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            made = [pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)]
            carried = [batch.column(c).take(pa.array(of, pa.int64())) for c in carry]
            told = [pa.array(why, pa.string())] if errors else []
            yield pa.RecordBatch.from_arrays([*made, *carried, *told], names=[*names, *carry, *(["error"] if errors else [])])

    return run


def chunk_notes(notes: DataFrame, most: int = 1200, overlap: int = 150, carry: Sequence[str] = ()) -> DataFrame:
    """Chunks of notes (path, title, body), each with its note's columns `carry`. One pass over the notes, no shuffle."""
    chunk_spans("", most, overlap)
    kinds = dict(notes.dtypes)
    schema = ", ".join([CHUNKS, *(f"`{c}` {kinds[c]}" for c in carry)])
    return notes.select("path", "title", "body", *carry).mapInArrow(_chunk(most, overlap, carry), schema)


def chunk_or_fail(notes: DataFrame, most: int = 1200, overlap: int = 150, spans: Chunker = chunk_spans) -> tuple[DataFrame, DataFrame]:
    """(chunks, failures): as chunk_notes, but a note that the chunker raises at becomes a row (path, reason) of failures, and the others
    are chunked all the same. Each of the two is a pass over the notes."""
    chunk_spans("", most, overlap)
    rows = notes.select("path", "title", "body").mapInArrow(_chunk(most, overlap, (), spans, True), f"{CHUNKS}, error string")
    return rows.where("error is null").drop("error"), rows.where("error is not null").select(F.col("note_path").alias("path"), F.col("error").alias("reason"))


def hard_split(docs: DataFrame, most: int = 1200, overlap: int = 150) -> DataFrame:
    """Windows of texts that have neither headings nor paragraphs, as expressions only: doc_id, piece, char_start, text, id,
    content_hash. Window i begins at i * (most - overlap)."""
    step = most - overlap
    pieces = F.greatest(F.ceil((F.length("text") - most) / F.lit(float(step))), F.lit(0)).cast("int")
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), pieces)).alias("piece"))
    start = F.col("piece") * step
    rows = rows.select("doc_id", "piece", start.alias("char_start"), strip(F.substr("text", start + 1, F.lit(most))).alias("text"))
    rows = rows.where("text <> ''")
    return rows.select("*", digest("doc_id", F.lit(""), "char_start").alias("id"), digest("text").alias("content_hash"))


def embed_text(title: Column | str = "title", heading_path: Column | str = "heading_path", text: Column | str = "text") -> Column:
    """What is embedded of a chunk: title, breadcrumb, blank line, text."""
    return strip(F.concat(F.col(title), F.lit("\n"), F.array_join(heading_path, " > "), F.lit("\n\n"), F.col(text)))
