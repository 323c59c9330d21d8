"""Public tokenizers on the executors: the path (or the file's name in the public_tokenizers package) is a parameter."""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts are encoded in pieces of about this many characters where the tokenizer allows it, so a huge text needs little memory.
PIECE = 1 << 16
#: Between two ASCII words: the byte-level pattern always splits before this space, so encoding piecewise gives the same ids.
_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def resolve(name: str) -> str:
    """The file's place on this machine."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(8)
def version(name: str) -> str:
    """Digest of what decides counts: the file, its library and that library's version."""
    path = resolve(name)
    if path.endswith(".model"):
        import sentencepiece as lib
    else:
        import tokenizers as lib
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{lib.__name__} {lib.__version__}".encode()).hexdigest()


@functools.lru_cache(4)
def _library(name: str):
    path = resolve(name)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path), False
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        kind = json.load(f).get("pre_tokenizer") or {}
    return Tokenizer.from_file(path), kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space")


def pieces(text: str) -> list[str]:
    """text cut where a byte-level tokenizer splits anyway."""
    if len(text) <= PIECE:
        return [text]
    out, start = [], 0
    while len(text) - start > PIECE:
        m = _SAFE.search(text, start + PIECE - 1)
        if not m:
            break
        out.append(text[start : m.start()])
        start = m.start()
    return [*out, text[start:]]


def count_tokens(name: str, texts: list[str]) -> list[int]:
    """Tokens of each text as the file's library gives them: no special tokens are added, nothing is cut or padded."""
    model, piecewise = _library(name)
    if resolve(name).endswith(".model"):
        return [len(ids) for ids in model.encode(list(texts), num_threads=1)]
    parts = [pieces(t) if piecewise else [t] for t in texts]
    flat, counts = [p for ps in parts for p in ps], []
    batch, size = [], 0
    for p in flat:
        batch.append(p)
        size += len(p)
        if size >= 1 << 20:
            counts += [len(e) for e in model.encode_batch_fast(batch, add_special_tokens=False)]
            batch, size = [], 0
    if batch:
        counts += [len(e) for e in model.encode_batch_fast(batch, add_special_tokens=False)]
    at = np.cumsum([0, *map(len, parts)])
    sums = np.append(0, np.cumsum(np.array(counts, np.int64)))
    return (sums[at[1:]] - sums[at[:-1]]).tolist()


class FastByteBPE:
    """Ids of a byte-level BPE .json file of the tokenizers library, by tiktoken's faster merge loop over the same vocabulary.

    The vocabulary and the special tokens are read from the .json file itself. audit() encodes a text with the tokenizers library
    too; callers audit texts of every batch and turn to the library where the two ever differ.
    """

    def __init__(self, name: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(resolve(name), encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        back = _byte_of_char()
        ranks = {bytes(back[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
        self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self.slow, _ = _library(name)
        self.trusted = True

    def library_ids(self, text: str) -> np.ndarray:
        return np.concatenate(
            [np.array(self.slow.encode(p, add_special_tokens=False).ids, np.uint32) for p in pieces(text)]
        )

    def audit(self, text: str) -> None:
        self.trusted &= bool(np.array_equal(self.ids(text), self.library_ids(text)))

    def ids(self, text: str) -> np.ndarray:
        if not self.trusted:
            return self.library_ids(text)
        return np.concatenate([self.fast.encode_to_numpy(p, allowed_special="all") for p in pieces(text)])


def _byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one, else the next free from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(2)
def fast_byte_bpe(name: str) -> FastByteBPE:
    return FastByteBPE(name)
