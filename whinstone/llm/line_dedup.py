"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, verified edit similarity, one line of each group."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from whinstone.llm.common import (
    BUCKET_ROWS,
    LOWER,
    binary_texts,
    common_ends,
    components,
    cut,
    edit_distance,
    hot_keys,
    pick,
    run_bounds,
    salted,
    sorted_runs,
    stars,
    unsettled,
)

#: Lines link where 1 - distance / longer length is SIMILARITY_PERCENT / 100 or more.
SIMILARITY_PERCENT = 80
#: 64 bits of a SimHash in two blocks; one differing bit leaves one of them equal. More blocks would be too short to tell lines apart.
BLOCKS = 2
#: Most lines of that similarity differ in more bits, so a line also has blocks of words: the PICKS features (of runs of GRAM
#: bytes, which edits spoil sooner, GRAM_PICKS) that come first in an order of the table's own. Only edits in all SAMPLES blocks hide a pair.
SAMPLES, PICKS, GRAM_PICKS, GRAM = 8, 6, 5, 5
#: Tables that are verified first; of the others only buckets that these left in several components.
FIRST = (2, 6)
#: Features are words, in lines of few words runs of bytes: in the SimHash and in samples up to so many words, exclusively.
SIM_WORDS, SAMPLE_WORDS = 16, (12, 12, 12, 12, 20, 20, 20, 20)
#: A-Z lower-cased, other ASCII but letters and digits as a space, line ends kept.
_NORMAL = bytes(
    b if b >= 128 or b == 10 or 48 <= b <= 57 else LOWER[b] if chr(b).isalpha() else 32 for b in range(256)
)
#: Bytes of normalised text that are worked on at a time.
CHUNK = 1 << 18
BLOOM_BITS = 1 << 27
#: What a row's table number is raised by once for a line that met another in its buffer, twice if it isn't dealt by their key.
MET = np.int8(32)
_COLUMNS = ["sim", *[f"b{t}" for t in range(SAMPLES)]]
#: A row of _keys() as it is shuffled; v is raised by MET as often as `met` says.
_PACKED = np.dtype([("key", "<i8"), ("h", "<i8"), ("v", "i1")])
#: Such rows that a task holds at a time, about; there are as many tasks as that takes, and one for each shuffle partition at least.
PART_ROWS = 1 << 20

_P = 0x9E3779B97F4A7C15
_RNG = np.random.default_rng(5)
_XOR, _TIMES = (_RNG.integers(0, 1 << 64, SAMPLES * PICKS, np.uint64) for _ in range(2))
_TIMES |= np.uint64(1)
#: Tokens whose weighted bits fit lanes of eight bits: 51 x 5 = 255.
_FIT = 51


def normalise(line: bytes) -> bytes:
    """A line without case (ASCII), punctuation (ASCII) and surplus white space."""
    return b" ".join(line.translate(_NORMAL).split())


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64: one of each for every place of a chunk."""
    n = CHUNK + 1
    inverse = pow(_P, -1, 1 << 64)
    both = []
    for x in (_P, inverse):
        out = np.full(n, x, np.uint64)
        out[0] = 1
        both.append(np.multiply.accumulate(out))
    return both[0], both[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return x


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a chunk."""
    gaps = np.flatnonzero(buf <= 32)
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(buf))
    own = ends > starts
    starts, ends = starts[own], ends[own]
    up, down = _powers()
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((buf + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return starts, ends, _mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _spread(lo: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places lo, lo + 1, ... of each group, one after the other, and where each group begins."""
    first = np.cumsum(sizes) - sizes
    return np.repeat(lo - first, sizes) + np.arange(sizes.sum()), first


def _grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of GRAM bytes in lines with one space after each word (the words lie at starts to ends; `lines` says with
    which word each line begins), and where each line's begin. Beyond a line's end there are spaces."""
    at, first = _spread(starts, ends - starts + 1)
    flat = np.append(np.maximum(buf, 32), np.uint8(32))[at].astype(np.uint64)
    first = first[lines]
    left = np.repeat(np.append(first[1:], len(flat)), np.diff(np.append(first, len(flat)))) - np.arange(len(flat))
    flat = np.append(flat, np.full(GRAM, 32, np.uint64))
    run = np.zeros(len(left), np.uint64)
    for k in range(GRAM):
        run = run << np.uint64(8) | np.where(left > k, flat[k : k + len(left)], np.uint64(32))
    return _mixed(run + np.uint64(1 << 40)), first


def _signed(h: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of features (they begin at `first`) its 64 sums of signed weights."""
    sizes = np.diff(np.append(first, len(h)))
    n = -(-sizes // _FIT)
    lead = np.cumsum(n) - n
    parts = np.repeat(first, n) + _FIT * (np.arange(n.sum()) - np.repeat(lead, n))
    lanes = np.ascontiguousarray(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64).T)
    lanes *= weight
    ones = np.ascontiguousarray(np.add.reduceat(lanes, parts, axis=1).T).view(np.uint8).astype(np.int64)
    ones = np.add.reduceat(ones, lead, axis=0)
    return 2 * ones - np.add.reduceat(weight.astype(np.int64), first)[:, None]


def _least(h: np.ndarray, shift: np.ndarray | None, first: np.ndarray) -> np.ndarray:
    """For each group of features the least of each order (SAMPLES x PICKS); features of a larger shift come first more often. Without
    shift they are runs of bytes, which have zeros beyond GRAM_PICKS."""
    out, each = np.zeros((SAMPLES * PICKS, len(first)), np.uint64), np.empty_like(h)
    for k in range(SAMPLES * PICKS):
        if shift is not None or k % PICKS < GRAM_PICKS:
            np.multiply(np.bitwise_xor(h, _XOR[k], out=each), _TIMES[k], out=each)
            np.minimum.reduceat(each if shift is None else np.right_shift(each, shift, out=each), first, out=out[k])
    return out.T


def _raw(buf: np.ndarray, words: tuple, lo: np.ndarray, sizes: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums and least values of lines (or parts of lines), which have `sizes` words of this chunk from `lo` on, and n_words in all."""
    signed = np.zeros((len(lo), 64), np.int64)
    least = np.zeros((len(lo), SAMPLES * PICKS), np.uint64)
    starts, ends, hashes = words
    if (by_words := n_words >= min(SAMPLE_WORDS)).any():
        at, first = _spread(lo[by_words], sizes[by_words])
        h, length = hashes[at], (ends - starts)[at]
        signed[by_words] = _signed(h, np.clip(length - 2, 1, 5).astype(np.uint64), first)
        least[by_words] = _least(h, np.clip(length - 1, 0, 4).astype(np.uint64), first)
    if (by_grams := n_words < max(SAMPLE_WORDS)).any():
        at, first = _spread(lo[by_grams], sizes[by_grams])
        h, first = _grams(buf, starts[at], ends[at], first)
        few = n_words[by_grams, None]
        signed[by_grams] = np.where(few < SIM_WORDS, _signed(h, np.ones(len(h), np.uint64), first), signed[by_grams])
        least[by_grams] = np.where(few < np.repeat(SAMPLE_WORDS, PICKS), _least(h, None, first), least[by_grams])
    return signed, least


def _digests(hashes: np.ndarray, first: np.ndarray, sizes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """128 bits of each line's words in their order: two sums over hash and place."""
    at = place.astype(np.uint64) * np.uint64(_P)
    both = [np.add.reduceat(_mixed(hashes ^ (at + np.uint64(seed))), first) for seed in (0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    return np.stack(both, axis=1)


def _finished(signed: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The SimHash and the sample keys: one row a line."""
    out = np.empty((len(signed), 1 + SAMPLES), np.uint64)
    out[:, 0] = np.packbits(signed > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    picks = least.reshape(-1, SAMPLES, PICKS)
    key = np.broadcast_to(np.arange(1, SAMPLES + 1, dtype=np.uint64), (len(signed), SAMPLES)).copy()
    for k in range(PICKS):
        key = _mixed((key ^ picks[:, :, k]) * np.uint64(_P))
    out[:, 1:] = key
    return out


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the lines that have words, and for each: 128 bits that stand for the words, the SimHash, the sample keys."""
    text = text.translate(_NORMAL)
    numbers, found = [np.empty(0, np.int64)], [np.empty((0, 3 + SAMPLES), np.uint64)]
    lo, line = 0, 0
    while lo < len(text):
        if len(text) - lo <= CHUNK:
            hi = len(text)
        elif (hi := text.rfind(b"\n", lo, lo + CHUNK)) < 0:  # a line longer than a chunk
            hi = text.find(b"\n", lo + CHUNK)
            hi = len(text) if hi < 0 else hi
            if (row := _long_line(text, lo, hi)) is not None:
                numbers.append(np.array([line]))
                found.append(row)
            lo, line = hi + 1, line + 1
            continue
        buf = np.frombuffer(text, np.uint8, hi - lo, lo)
        words = _words(buf)
        breaks = np.flatnonzero(buf == 10)
        edge = np.searchsorted(words[0], np.concatenate([[0], breaks, [len(buf)]]))
        sizes = np.diff(edge)
        own = np.flatnonzero(sizes)
        if len(own):
            first, sizes = edge[own], sizes[own]
            digests = _digests(words[2], first, sizes, np.arange(len(words[2])) - np.repeat(first, sizes))
            found.append(np.concatenate([digests, _finished(*_raw(buf, words, first, sizes, sizes))], axis=1))
            numbers.append(own + line)
        line += len(breaks) + 1
        lo = hi + 1
    return np.concatenate(numbers), np.concatenate(found)


def _long_line(text: bytes, lo: int, hi: int) -> np.ndarray | None:
    """What line_features() gives for one line, a chunk at a time; None without words. Chunks end at a space if there is one."""
    parts, n = [], 0
    while lo < hi:
        end = hi if hi - lo <= CHUNK else text.rfind(b" ", lo + 1, lo + CHUNK)
        end = lo + CHUNK if end < 0 else end
        buf = np.frombuffer(text, np.uint8, end - lo, lo)
        words = _words(buf)
        if len(words[0]):
            parts.append((buf, words, n))
            n += len(words[0])
        lo = end
    if not n:
        return None
    sums, zero = None, np.zeros(1, np.int64)
    for buf, words, before in parts:
        size = np.array([len(words[0])])
        signed, least = _raw(buf, words, zero, size, np.array([n]))
        digest = _digests(words[2], zero, size, np.arange(size[0]) + before)
        sums = (digest, signed, least) if sums is None else (sums[0] + digest, sums[1] + signed, np.minimum(sums[2], least))
    return np.concatenate([sums[0], _finished(*sums[1:])], axis=1)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = binary_texts(batch.column("text"))
        ids = batch.column("doc_id")
        first = 0
        while first < len(texts):  # so many documents that they fill a chunk
            last, size = first, 0
            while last < len(texts) and (last == first or size + len(texts[last] or b"") < CHUNK):
                size += len(texts[last] or b"") + 1
                last += 1
            here = [t or b"" for t in texts[first:last]]
            ends = np.cumsum([t.count(b"\n") + 1 for t in here])
            number, found = line_features(b"\n".join(here))
            doc = np.searchsorted(ends, number, "right")
            at = pa.array(doc + first)
            cols = [ids.take(at), batch.column("copy").take(at), (number - np.append(0, ends)[doc]).astype(np.int32)]
            cols += [np.ascontiguousarray(found[:, k]).view(np.int64) for k in (0, 1)]
            cols.append(_binary(np.ascontiguousarray(found[:, 2:]), np.arange(len(found) + 1)))
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=_LINES)
            first = last


#: blocks: the values of _COLUMNS, eight bytes each.
_LINES = ["doc_id", "copy", "line", "h", "g", "blocks"]
_LINES_SCHEMA = "doc_id long, copy long, line int, h long, g long, blocks binary"


def _binary(rows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of rows between each two bounds, as one value each."""
    width = rows.nbytes // max(1, len(rows))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(rows)])


def _block_keys(sim: np.ndarray, samples: list[np.ndarray]) -> np.ndarray:
    """One key a table for each line: the SimHash's blocks, then the samples."""
    return np.stack([np.uint64(1) << np.uint64(32) | sim & np.uint64(0xFFFFFFFF), np.uint64(2) << np.uint64(32) | sim >> np.uint64(32), *samples])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, v, h, met, part) of lines, sorted by key and h a buffer at a time, each pair once. Of different lines that share a
    key in a buffer only one is dealt by it (met: 1), so that a hot key comes down to a row a buffer; the others go where their h
    says (met: 2)."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        cols = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("h", *_COLUMNS)]
        h, own = np.unique(cols[0], return_index=True)
        rest = [c[own].view(np.uint64) for c in cols[1:]]
        key = _block_keys(rest[0], rest[1:]).view(np.int64)
        v = np.repeat(np.arange(len(key), dtype=np.int8), len(h))
        key = key.ravel()
        by = np.argsort(key)
        key, v, h = key[by], v[by], h[by % len(h)]
        same = key[1:] == key[:-1]
        met = np.zeros(len(key), np.int8)
        met[:-1][same] = 1
        met[1:][same] = 2
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (key, v, h, met, np.where(met == 2, h, key))], names=["key", "v", "h", "met", "part"]
        )

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 1 << 16:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


def _dealt_keys(parts: int):
    """The rows of _keys(), packed: for each buffer one binary value for each of so many parts, by the row's part."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cols = np.frombuffer(b"".join(b.column("blocks").to_pylist()), np.int64).reshape(b.num_rows, -1).T
                yield pa.RecordBatch.from_arrays([b.column("h"), *[pa.array(np.ascontiguousarray(c)) for c in cols]], names=["h", *_COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _keys(unpacked(batches)):
            rows = np.empty(b.num_rows, _PACKED)
            rows["key"], rows["h"] = b.column("key").to_numpy(), b.column("h").to_numpy()
            rows["v"] = b.column("v").to_numpy() + MET * b.column("met").to_numpy()
            part = (_mixed(b.column("part").to_numpy().view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            by = np.argsort(part)
            bounds = run_bounds([part[by]])
            yield pa.RecordBatch.from_arrays([pa.array(part[by][bounds[:-1]]), _binary(rows[by], bounds)], names=["part", "rows"])

    return run


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the packed rows of a part those whose key another h shares, there or in the buffer that they come from."""
    rows = np.frombuffer(b"".join(x for b in batches for x in b.column("rows").to_pylist()), _PACKED)
    key = np.ascontiguousarray(rows["key"])
    by = np.argsort(key)
    key = key[by]
    same = np.append(key[1:] == key[:-1], False)
    own = rows[by[same | np.append(False, same[:-1])]] if len(rows) else rows
    own = own[np.lexsort((own["h"], own["key"]))]
    own = own[run_bounds([own["key"], own["h"]])[:-1]] if len(own) else own  # one line may come from several buffers
    same = np.append(own["key"][1:] == own["key"][:-1], False)
    hit = same | np.append(False, same[:-1]) if len(own) else same[:0]
    found = np.concatenate([own[hit], rows[rows["v"] >= MET]])
    for lo in range(0, len(found), 1 << 16):
        some = found[lo : lo + (1 << 16)]
        cols = [np.ascontiguousarray(c) for c in (some["key"], some["v"] % MET, some["h"])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "v", "h"])


def similar(a: str, b: str) -> bool:
    """Edit similarity of SIMILARITY_PERCENT or more. Replacing all between the common ends, or replacing, adding and leaving out
    words as they come, bounds the distance from above, and mostly settles it."""
    most = (100 - SIMILARITY_PERCENT) * max(len(a), len(b)) // 100
    if abs(len(a) - len(b)) > most:
        return False
    lo, hi = common_ends(a, b)
    if max(len(a), len(b)) - lo - hi <= most:
        return True
    lo, hi = a.rfind(" ", 0, lo) + 1, a.find(" ", len(a) - hi)
    x, y = (a, b) if hi < 0 else (a[:hi], b[: hi - len(a)])
    x, y = x[lo:].split(" "), y[lo:].split(" ")
    i = j = cost = 0
    while i < len(x) and j < len(y) and cost <= most:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
        elif i + 1 < len(x) and x[i + 1] == y[j]:
            cost, i = cost + len(x[i]) + 1, i + 1
        elif j + 1 < len(y) and x[i] == y[j + 1]:
            cost, j = cost + len(y[j]) + 1, j + 1
        else:
            cost, i, j = cost + max(len(x[i]), len(y[j])), i + 1, j + 1
    if cost + sum(len(w) + 1 for w in x[i:]) + sum(len(w) + 1 for w in y[j:]) <= most:
        return True
    return edit_distance(a, b, most) <= most


def _parts(lines: list[str]) -> list[frozenset]:
    """What _common() compares: words, or trigrams if any line is short."""
    if min(x.count(" ") for x in lines) + 1 >= max(SAMPLE_WORDS):
        return [frozenset(x.split(" ")) for x in lines]
    return [frozenset([x[i : i + 3] for i in range(max(1, len(x) - 2))]) for x in lines]


def _common(a: frozenset, b: frozenset) -> bool:
    """Whether two fifths of the parts are common, which costs less to tell than edit_distance(). An edit spoils three trigrams, so
    lines that are similar enough keep that many of them; of words hardly any pair that shares a block of them has fewer."""
    return 5 * len(a & b) + 10 >= 2 * max(len(a), len(b))


def _links(lines: list[str]) -> Callable[[int, int], bool]:
    """Whether the i-th and the j-th line link."""
    words = _parts(lines)
    return lambda i, j: _common(words[i], words[j]) and similar(lines[i], lines[j])


def _joining(component: np.ndarray, linked: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Edges that join the components of rows 0..n-1 as far as linked() joins any of their rows, and none within one component. Each row is
    compared with those not reached before it, of each component until one links."""
    component = component.tolist()
    left, edges = list(range(len(component))), []
    while left:
        met = {component[left[0]]}
        queue, left = [j for j in left if component[j] in met], [j for j in left if component[j] not in met]
        while queue and left:
            i, met = queue.pop(), set()
            for j in left:
                if component[j] not in met and linked(i, j):
                    met.add(component[j])
                    edges.append((i, j))
            if met:
                queue += [j for j in left if component[j] in met]
                left = [j for j in left if component[j] not in met]
    return edges


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that join what is similar in each (key, salt) run of lines sorted by it, of different components."""
    small = (b.slice(lo, 2048) for b in batches for lo in range(0, b.num_rows, 2048))
    columns = ["key", "salt", "id", "component", "norm"]
    for key, salt, ids, component, norm in sorted_runs((b.select(columns) for b in small), ("key", "salt")):
        bounds = run_bounds([key, salt])
        edges, size = [], np.diff(bounds)
        for lo, hi in zip(bounds[:-1][size > 1].tolist(), bounds[1:][size > 1].tolist(), strict=True):
            own = list(norm[lo:hi])
            edges += [(ids[lo + a], ids[lo + b]) for a, b in _joining(component[lo:hi], _links(own))]
        if edges:
            a, b = stars(*np.array(edges, np.int64).T)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _verify_open(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Lines of the minority against all of one (key, salt): an edge for each component that a line links to."""
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    ids, comp, norm = (right[c].to_numpy() for c in ("id", "component", "norm"))
    words, edges = _parts([*norm, *left["norm"]]), []
    for row, own in zip(left.itertuples(), words[len(norm) :], strict=True):
        met = {row.component}
        for j in np.flatnonzero(comp != row.component):
            if comp[j] not in met and _common(own, words[j]) and similar(row.norm, norm[j]):
                met.add(comp[j])
                edges.append((row.id, ids[j]))
    return pd.DataFrame(edges, columns=["a", "b"], dtype="int64")


def _place_hash(doc: np.ndarray, line: np.ndarray, bits: int) -> np.ndarray:
    x = doc.astype(np.int64).view(np.uint64) * np.uint64(_P) + line.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    return (x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - bits)


def _bloom_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            at = np.unique(_place_hash(doc, batch.column("line").to_numpy(zero_copy_only=False), bits))
            word, start = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), start) if len(at) else at
            yield pa.RecordBatch.from_arrays(
                [pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], names=["word", "value"]
            )

    return run


def _texts_at(bloom: np.ndarray, bits: int):
    """Normalised lines at places that the filter passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, copy, number, norm = [], [], [], []
            texts, ids, copies = binary_texts(batch.column("text")), batch.column("doc_id"), batch.column("copy")
            counts = np.array([0 if t is None else t.count(b"\n") + 1 for t in texts])
            owner, first = _spread(np.zeros(len(counts), np.int64), counts)
            owner, place = np.repeat(np.arange(len(texts)), counts), owner
            h = _place_hash(ids.fill_null(-1).to_numpy(zero_copy_only=False)[owner], place, bits)
            hits = np.flatnonzero(bloom[h >> np.uint64(6)] >> (h & np.uint64(63)) & np.uint64(1))
            last, lines, own = -1, [], 0
            for i, k in zip(owner[hits].tolist(), place[hits].tolist(), strict=True):
                if i != last:
                    last, lines, own = i, texts[i].split(b"\n"), copies[i].as_py()
                doc.append(ids[i].as_py())
                copy.append(own)
                number.append(k)
                norm.append(normalise(lines[k]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(number, pa.int32()), pa.array(norm, pa.string())],
                names=["doc_id", "copy", "line", "norm"],
            )

    return run


def _fetch(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(doc_id, copy, line, norm) for places (doc_id, line) and a few more: a Bloom filter of bounded size finds them on the map side."""
    n = places.count()
    bits = int(min(np.log2(BLOOM_BITS), max(12, np.ceil(np.log2(16 * max(1, n))))))
    words = places.select("doc_id", "line").mapInArrow(_bloom_words(bits), "word long, value long")
    rows = words.groupBy("word").agg(F.expr("bit_or(value)").alias("value")).toArrow()
    bloom = np.zeros(1 << (bits - 6), np.uint64)
    bloom[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return docs.mapInArrow(_texts_at(bloom, bits), "doc_id long, copy long, line int, norm string")


def _places(lines: DataFrame):
    """(doc_id, copy, line) as one value in that order, how to take it apart, whether it has copy, and the number of lines. Where doc_ids are unique, a long that leaves copy
    out, as longs aggregate by hash and without sorting; else a struct."""
    nulls = F.count(F.when(F.col("doc_id").isNull(), 1))
    row = lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line"), nulls, F.count("*")).first()
    bits = int(row[2] or 0).bit_length()
    plain = row[3] == 0 and row[0] is not None and row[0] >= 0 and row[1] < 1 << (62 - bits)
    if plain:
        per = lines.groupBy("doc_id").agg(F.min("copy").alias("x"), F.max("copy").alias("y"))
        plain = per.where("x <> y").isEmpty()
    if plain:
        place = F.shiftleft("doc_id", bits).bitwiseOR(F.col("line").cast("long"))
        return place, lambda c: F.shiftright(c, bits), lambda c: F.col(c).bitwiseAND((1 << bits) - 1).cast("int"), False, row[4]
    return F.struct("doc_id", "copy", "line"), lambda c: F.col(c)["doc_id"], lambda c: F.col(c)["line"], True, row[4]


def _edges(hits: DataFrame, found: DataFrame, bucket_rows: int, known: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) that join what is similar in the buckets of hits (key, id, component) and isn't joined by `known`, the edges that gave the
    components; found has the lines (id, norm). Buckets of the same lines, in whatever tables, are compared once."""
    sizes = hits.groupBy("key").agg(F.count("*").alias("n"), *[F.expr(f"bit_xor(xxhash64(id, {k}))").alias(f"x{k}") for k in (0, 1)])
    hits = hits.join(sizes.where("n > 1"), "key").select(F.xxhash64("n", "x0", "x1").alias("key"), "id", "component")
    hits = cut(hits.distinct(), "line-buckets")
    work = hits.join(found, "id")
    hot = hot_keys(hits.groupBy("key").agg(F.count("*").alias("n")), bucket_rows)
    rows = salted(work, hot).repartition(_tasks(hits), "key", "salt").sortWithinPartitions("key", "salt")
    edges = cut(rows.mapInArrow(_verify, "a long, b long").distinct(), "line-links")
    if hot is None:
        return edges
    minority, everything = unsettled(work.drop("component"), hot, components(edges if known is None else edges.union(known)), bucket_rows)
    pairs = minority.groupBy("key", "salt", "block").cogroup(everything.groupBy("key", "salt", "block"))
    return cut(edges.union(pairs.applyInPandas(_verify_open, "a long, b long")).distinct(), "line-links")


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has; of few bytes, but much work, AQE would make fewer."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def duplicate_lines(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows (doc_id, copy, line): the lines (from 0) of docs (doc_id, text) that repeat, exactly or nearly, but one that stays.

    Lines are compared without ASCII case, ASCII punctuation and surplus white space; those without words (blank ones, rules) are
    never duplicates. Lines of equal words are one class, by 128 bits of them, from the first aggregation on, however short. Other
    classes link at an edit similarity of 0.8 or more, verified on the normalised lines. Candidates come from tables of pigeonhole
    blocks, a row of each class in every one: halves of the line's SimHash, of which one is equal where one bit differs at most; and, as a SimHash of 64 bits has most lines of that similarity further apart, blocks of words: six words (in short lines
    and scripts without spaces, five runs of five bytes) that an order of the table's own puts first. Only the texts of classes that share a block
    are made again (a bounded Bloom filter finds them in one pass). Two fifths of the words must be common (of short lines the trigrams)
    before the distance is worked out. Two tables are verified first, of the others what these have left
    open. Runs give spanning edges, never all pairs; large ones are salted, and what that parts is compared afterwards. Of each
    component the first line by (doc_id, text's hash, line) stays.

    Repeated rows of one doc_id and text are one document; with another text (`copy` is its hash) they are documents of their own,
    also without a doc_id (these come first). Null and empty texts have no lines; an empty table gives no rows.
    """
    texts = pick(docs, doc_id="long", text="string").withColumn("copy", _copy(F.col("text")))
    lines = cut(texts.mapInArrow(_lines, _LINES_SCHEMA), "lines")
    place, doc_id, line, copies, n = _places(lines)
    place = place.alias("place")
    classes = lines.select("h", "g", place).groupBy("h", "g").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "line-classes")
    parts = max(_tasks(lines), -(-n * len(_COLUMNS) // PART_ROWS))
    rows = lines.select("h", "blocks").mapInArrow(_dealt_keys(parts), "part int, rows binary")
    met = rows.repartitionById(parts, F.col("part")).select("rows").mapInArrow(_partners, "key long, v byte, h long")
    met = cut(met.distinct(), "line-partners")
    near = classes.join(met.select("h").distinct(), "h", "left_semi")
    near = cut(near.select("h", "id", "first", doc_id("first").alias("doc_id"), line("first").alias("line")), "near-lines")
    hits = cut(met.join(near.select("h", "id"), "h").select("key", "v", "id"), "line-hits")
    there = _fetch(texts, near).select(place, "norm")
    same = F.col("place").eqNullSafe(F.col("first")) if copies else F.col("place") == F.col("first")
    found = cut(near.select("id", "first").join(there, same).select("id", "norm").dropDuplicates(["id"]), "near-texts")
    first = F.col("v").isin(*FIRST)
    edges = _edges(hits.where(first).select("key", "id", F.col("id").alias("component")), found, bucket_rows)
    more = hits.where(~first).select("key", "id")
    now = more.join(components(edges), F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id"))
    several = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    more = cut(now.select("key", "id", "component").join(several, "key", "left_semi"), "line-open")
    comp = cut(components(edges.union(_edges(more, found, bucket_rows, edges))), "line-components")
    linked = classes.join(comp, F.col("id") == F.col("node"))
    best = linked.groupBy("component").agg(F.min("first").alias("best"))
    alone = classes.where("n > 1").join(comp.select("node"), F.col("id") == F.col("node"), "left_anti")
    losers = linked.join(best, "component").select("h", "g", "best").union(alone.select("h", "g", F.col("first").alias("best")))
    rest = lines.select("doc_id", "copy", "line", "h", "g", place).join(cut(losers, "line-losers"), ["h", "g"])
    return rest.where(~F.col("place").eqNullSafe(F.col("best"))).select("doc_id", "copy", "line")


def _copy(text: F.Column) -> F.Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, kept, dropped = batch.column("text").to_pylist(), [], []
        for i, gone in enumerate(batch.column("gone").to_pylist()):
            text = texts[i]
            total = 0 if text is None else text.count("\n") + 1
            out = set(gone or ())
            if out and total:
                texts[i] = "\n".join([x for k, x in enumerate(text.split("\n")) if k not in out])
                total -= len(out)
            kept.append(total)
            dropped.append(len(out))
        cols = [batch.column("row"), pa.array(texts, pa.string()), pa.array(kept, pa.int32()), pa.array(dropped, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, names=["row", "text", "n_kept", "n_dropped"])


def dedup_lines(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs, all columns, with text lacking its duplicate lines (see duplicate_lines()), and n_kept, n_dropped (lines; columns of
    docs by these names go). Null texts stay null, with no lines; a document may end up empty; repeated rows of a doc_id and text are
    one document, so each of them keeps what it keeps. Other columns of any name stay as they are."""
    gone = duplicate_lines(docs, bucket_rows).groupBy("doc_id", "copy").agg(F.collect_set("line").alias("gone"))
    gone = gone.select(F.col("doc_id").alias("its_doc"), F.col("copy").alias("its_copy"), "gone")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    whole = docs.select(rest.alias("row"), F.col("text").cast("string").alias("text"))
    whole = whole.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), "text").withColumn("copy", _copy(F.col("text")))
    joined = whole.join(gone, F.col("doc_id").eqNullSafe(F.col("its_doc")) & (F.col("copy") == F.col("its_copy")), "left")
    out = joined.select("row", "text", "gone").mapInArrow(
        _without, joined.select("row", "text").schema.add("n_kept", "integer").add("n_dropped", "integer")
    )
    kept = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("n_kept", "n_dropped")]
    return out.select(*kept, "n_kept", "n_dropped")


def drop_duplicate_lines(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs, its columns only, with text lacking its duplicate lines; documents that lose every line with words go, those that had
    none stay. Columns of docs named n_kept or n_dropped stay what they are."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    plain = docs.select(rest.alias("row"), F.col("doc_id"), F.col("text"))
    left = dedup_lines(plain, bucket_rows).where(F.col("text").isNull() | (F.col("n_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return left.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
