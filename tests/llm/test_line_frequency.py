import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from whinstone.llm import line_frequency as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, t1 string, removed int, kept string"


def base(text):
    """The base figures by their definition."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    earlier, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in earlier
        earlier.add(line)
    n = len(words)
    figures = n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)
    return *figures, n < 10 or 100 * len(covered) > 20 * n


def normal(line):
    return " ".join("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(line))


def brute(rows, most=10, share=0.002, left=0.5):
    """Verdicts from sets of texts by host and line; also the texts of kept documents without their frequent lines."""
    having, texts = defaultdict(set), defaultdict(set)
    for _, text, host in rows:
        texts[host].add(text or "")
        for line in (text or "").split("\n"):
            if normal(line):
                having[host, normal(line)].add(text)
    over = {k for k, v in having.items() if len(v) > most and len(v) > share * len(texts[k[0]])}
    out = []
    for i, text, host in rows:
        lines = (text or "").split("\n")
        gone = [line for line in lines if (host, normal(line)) in over]
        *figures, failed = base(text)
        removed = sum(len(WORD.findall(line)) for line in gone)
        rest = figures[0] - removed
        kept = not failed and rest >= 10 and rest >= left * figures[0]
        out.append((i, *figures, failed, removed, kept, "\n".join(line for line in lines if (host, normal(line)) not in over) if kept else None))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, h, "mine", 7, "k") for i, t, h in rows], SCHEMA)


def judged(spark, rows, **kw):
    found = L.line_quality(frame(spark, rows), **kw).collect()
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_words", "kept")
    return sorted((tuple(r[c] for c in names) for r in found), key=repr)


def corpus(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß漢😀#%") for _ in range(rng.randint(1, 6)))
    common = ["Home | About us | Contact", "all rights RESERVED.", " ".join(word() for _ in range(60))]
    rows = []
    for i in range(260):
        lines = [rng.choice([" ", "\t"]).join(word() for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 5))]
        for c in common:
            if rng.random() < 0.4:
                lines.insert(rng.randint(0, len(lines)), rng.choice([c, c.upper() if c.isascii() else c, "  " + c.replace(" ", "  ")]))
        if lines and rng.random() < 0.2:
            lines += [rng.choice(lines)]
        rows.append((i, "\n".join(lines), rng.choice(["a.org", "b.org", "b.org", None])))
    return rows


@pytest.mark.parametrize("share", [0.002, 0.45])
def test_against_sets_of_texts(spark, share):
    rows = corpus()
    rows += [(900, rows[3][1], rows[3][2])] * 30  # repeated rows
    rows += [(1000 + i, "one two three four five six seven eight nine ten eleven\nand a second line here", "copies") for i in range(40)]
    rows += [(None, None, "a.org"), (2000, None, None), (2001, "", "a.org"), (2002, " \n\t\r\n", "b.org"), (2003, "\x0b \x0c  x y", "b.org")]
    wanted = brute(rows, share=share)
    assert judged(spark, rows, most_share=share) == sorted((w[:-1] for w in wanted), key=repr)
    assert {w[-2] for w in wanted} == {True, False} and any(w[7] for w in wanted)
    clean = L.drop_frequent_lines(frame(spark, rows), most_share=share)
    assert clean.columns == ["doc_id", "text", "source", "t1", "removed", "kept"]
    got = sorted((r["doc_id"], r["text"], r["t1"], r["removed"]) for r in clean.collect())
    assert got == sorted((w[0], w[-1], "mine", 7) for w in wanted if w[-2])


def test_copies_alone_make_no_line_frequent(spark):
    text = "a line that is the whole of a text which was copied many times over"
    assert all(r[-1] for r in judged(spark, [(i, text, "h") for i in range(50)]))
    assert not any(r[-1] for r in judged(spark, [(i, f"{text}\n{i}", "h") for i in range(50)]))


def test_no_rows_and_no_lines(spark):
    assert judged(spark, []) == [] and L.drop_frequent_lines(frame(spark, [])).count() == 0
    assert judged(spark, [(1, "\n\n", "h")]) == [(1, 0, 0, 0, 0, 0, True, 0, False)]


def test_very_long_texts_and_lines(spark, monkeypatch):
    rng = random.Random(1)
    words = [f"w{rng.randint(0, 20000)}é" for _ in range(400_000)]
    one_line = " ".join(words)
    many = "\n".join(" ".join(words[i : i + 7]) for i in range(0, 200_000, 7))
    rows = [(1, one_line, "h"), (2, many, "h"), (3, one_line.upper(), "h"), (4, "x" * 5_000_000, "h"), (5, one_line.replace(" ", "  ", 1), "h")]
    assert judged(spark, rows) == sorted((w[:-1] for w in brute(rows)), key=repr)


def test_windows_are_told_apart_exactly():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(0, 30, 12)
        ids, texts = rng.integers(0, 3, sizes.sum()), np.repeat(np.arange(12), sizes)
        found = L.repeated_words(ids, texts)
        for t in range(12):
            own = ids[texts == t].tolist()
            assert found[texts == t].sum() == base(" ".join(map(str, own)))[4]
