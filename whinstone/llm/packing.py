"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from whinstone.llm.common import pick
from whinstone.llm.tokens import fast_byte_bpe

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window (0..windows-1) of each size.

    Every size begins as a partial partition of its own. The two partial partitions with the greatest imbalance (largest less
    smallest sum) merge, the fullest window of one with the emptiest of the other, until one is left. What is kept of a merge is
    how both sides' windows were renumbered; read backwards, that places every size.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, np.int64)
    first = np.zeros(windows, np.int64)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    sums: dict[int, np.ndarray] = {}
    for i, s in enumerate(sizes):
        sums[i] = first.copy()
        sums[i][0] = s
    merges: list[tuple[int, int, np.ndarray]] = []  # left, right, order: new window j is left's order[j] and right's reversed
    node = n
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums.pop(a) + sums.pop(b)[::-1]
        order = np.argsort(-both, kind="stable")
        both = both[order]
        both -= both[-1]
        sums[node] = both
        merges.append((a, b, order))
        heapq.heappush(heap, (-int(both[0]), node))
        node += 1
    place: dict[int, np.ndarray] = {node - 1: np.arange(windows)}
    out = np.zeros(n, np.int64)
    for at in range(len(merges) - 1, -1, -1):
        a, b, order = merges[at]
        here = place.pop(n + at)
        for child, slots in ((a, order), (b, windows - 1 - order)):
            to = np.empty(windows, np.int64)
            to[slots] = here
            if child < n:
                out[child] = to[0]
            else:
                place[child] = to
    if n == 1:
        out[0] = 0
    return out


def pack(sizes: list[int], capacity: int) -> np.ndarray:
    """Windows of at most capacity for all sizes: as few as the total needs, one more whenever the fullest window is too full."""
    total = int(sum(sizes))
    windows = max(1, -(-total // capacity))
    while True:
        at = differencing(sizes, windows)
        if not len(at) or np.bincount(at, weights=sizes).max() <= capacity:
            return at
        windows += 1


def shares(length: int, part: float, least: int) -> list[int]:
    """A left-over cut into pieces that shrink geometrically, each about `part` of the one before its rest: differencing then has
    pieces of every scale to even out windows with."""
    out = []
    while length > 2 * least:
        rest = int(length * part)
        out.append(length - rest)
        length = rest
    return [*out, length]


def _packer(tokenizer: str, capacity: int, end_id: int, part: float, least: int, group: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = fast_byte_bpe(tokenizer)
        task = TaskContext.get()
        sequence = (task.partitionId() if task else 0) << 32
        rows: list[tuple] = []
        pool: list[tuple] = []  # (doc_id, start, ids, doc_tokens)
        docs_in_pool = 0

        def flush_pool():
            nonlocal sequence, docs_in_pool
            at = pack([len(p[2]) for p in pool], capacity)
            used: dict[int, tuple[int, int]] = {}
            for w, (doc, start, ids, total) in zip(at.tolist(), pool, strict=True):
                if w not in used:
                    used[w] = (sequence, 0)
                    sequence += 1
                seq, offset = used[w]
                rows.append((doc, start, len(ids), ids.tobytes(), total, seq, offset))
                used[w] = (seq, offset + len(ids))
            pool.clear()
            docs_in_pool = 0

        def out():
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)
            rows.clear()
            return batch

        for batch in batches:
            texts = batch.column("text").to_pylist()
            if texts:
                encoder.audit(min((t or "" for t in texts), key=len))
                encoder.audit(texts[0] or "")
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                ids = np.append(encoder.ids(text) if text else [], end_id).astype("<u4")
                total = len(ids)
                full = total - total % capacity
                for start in range(0, full, capacity):
                    rows.append((doc, start, capacity, ids[start : start + capacity].tobytes(), total, sequence, 0))
                    sequence += 1
                if full < total:
                    start = full
                    for n in shares(total - full, part, least):
                        pool.append((doc, start, ids[start : start + n], total))
                        start += n
                    docs_in_pool += 1
                if docs_in_pool >= group:
                    flush_pool()
                if len(rows) >= 4096:
                    yield out()
        if pool:
            flush_pool()
        if rows:
            yield out()

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 1024,
    end_id: int = 0,
    part: float = 0.35,
    least: int = 4,
    group: int = 512,
) -> DataFrame:
    """Per piece of a document (doc_id, text): doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    A document is its token ids and end_id; a null or empty text is end_id alone. Windows that a document fills by itself are cut
    off it; what is left over is cut into pieces that shrink geometrically (shares()), and the left-overs of `group` documents are dealt
    to windows together by differencing. A group ends within its task, so there is no shuffle and no key that can be hot, and memory
    holds one group and one document. Sequence ids carry the partition's number, so they are unique; repeated rows are packed as
    often as they occur. The windows depend on the order of rows in a partition, which a file scan fixes: a lost task writes the
    same again. Padding is less than the slack of one window a group, plus the last group of each partition.
    """
    return pick(docs, doc_id="long", text="string").mapInArrow(_packer(tokenizer, capacity, end_id, part, least, group), PIECES)
