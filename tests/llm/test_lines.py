import random
from collections import defaultdict

import numpy as np
import pytest

from whinstone.llm import line_dedup as L
from whinstone.llm.common import edit_distance


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def alike(a, b):
    """An edit similarity of 0.8 or more, in whole numbers."""
    return 5 * plain_distance(a, b) <= max(len(a), len(b))


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choices("abc", k=rng.randint(0, 90)))
        b = list(a) if rng.random() < 0.6 else rng.choices("abc", k=rng.randint(0, 90))
        for _ in range(rng.randint(0, 6)):
            b.insert(rng.randint(0, len(b)), rng.choice("abc"))
        b = "".join(b)
        true, most = plain_distance(a, b), rng.randint(0, 30)
        assert edit_distance(a, b, most) == min(true, most + 1) or (true > most and edit_distance(a, b, most) > most)
        assert L.similar(a, b) == alike(a, b)


def test_exactly_four_fifths_link():
    assert L.similar("a" * 100, "a" * 80 + "b" * 20)
    assert not L.similar("a" * 100, "a" * 79 + "b" * 21)


def edited(rng, words, share):
    out = list(words)
    for k in range(len(out)):
        if rng.random() < share:
            kind = rng.random()
            out[k] = "" if kind < 0.3 else out[k][:-1] + rng.choice("xyz") if kind < 0.7 else out[k] + " " + rng.choice("pqr") * 3
    return " ".join(" ".join(out).split())


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randint(2, 9))) for _ in range(300)]
    base = [rng.choices(words, k=rng.randint(1, 50)) for _ in range(60)]
    docs = []
    for i in range(90):
        lines = []
        for _ in range(rng.randint(0, 7)):
            line = edited(rng, rng.choice(base), rng.choice([0, 0.05, 0.1])) if rng.random() < 0.8 else " ".join(rng.choices(words, k=20))
            lines.append(line.upper() if rng.random() < 0.1 else line + rng.choice(["", "!", "."]))
        docs.append((i, "\n".join(lines)))
    return [*docs, (1000, None), (1001, ""), (1002, "\n\n"), (1003, "---\n***"), (5, docs[5][1]), (7, docs[8][1])]


def brute(docs):
    """Places of lines to drop by edit similarity alone: (exact repeats, all), and the components of lines."""
    rows = []
    for d, text in docs:
        for k, line in enumerate((text or "").encode().split(b"\n")):
            norm = L.normalise(line).decode()
            if norm:
                rows.append(((-1 if d is None else d, text, k), norm))
    norms = sorted({n for _, n in rows})
    group = list(range(len(norms)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(norms)):
        for j in range(i):
            a, b = norms[i], norms[j]
            if 5 * edit_distance(a, b, len(a) + len(b)) <= max(len(a), len(b)):
                group[root(i)] = root(j)
    at = {n: i for i, n in enumerate(norms)}
    same, places = defaultdict(set), defaultdict(set)
    for place, n in rows:
        same[n].add(place)
        places[root(at[n])].add(place)
    return same, places


@pytest.mark.parametrize("bucket_rows,nulls", [(8192, False), (2, False), (8192, True)])
def test_against_all_pairs(spark, bucket_rows, nulls):
    docs = corpus()
    if nulls:
        docs += [(None, docs[3][1]), (None, docs[4][1] + "\nonce more")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    marked = df.select("doc_id", "text", L._copy(df["text"]).alias("copy")).distinct().collect()
    text = {(r["doc_id"], r["copy"]): r["text"] for r in marked}
    copy = {(-1 if r["doc_id"] is None else r["doc_id"], r["text"]): r["copy"] for r in marked}
    found = L.duplicate_lines(df, bucket_rows).collect()
    got = {(-1 if r["doc_id"] is None else r["doc_id"], text[r["doc_id"], r["copy"]], r["line"]) for r in found}
    order = lambda p: (p[0], copy[p[0], p[1]], p[2])
    same, places = brute(docs)
    exact = {p for g in same.values() for p in g if p != min(g, key=order)}
    full = {p for g in places.values() for p in g if p != min(g, key=order)}
    assert exact <= got <= full  # no false link, no exact repeat lost
    assert len(got - exact) >= 0.9 * len(full - exact)
    assert len(full) > len(exact) + 30


def test_recall_of_the_blocks():
    """Of pairs of lines with an edit similarity of 0.8 or more that share a block: 0.9 and more at all but the shortest lengths."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 10))) for _ in range(3000)]
    for n in (8, 15, 16, 30, 80, 300):
        pairs = []
        while len(pairs) < 150:
            a = rng.choices(words, k=n)
            b = edited(rng, a, rng.choice([0.03, 0.06, 0.1]))
            if (a := " ".join(a)) != b and L.similar(a, b):
                pairs.append((a, b))
        _, found = L.line_features("\n".join(x for p in pairs for x in p).encode())
        key = L._block_keys(found[:, 2], list(found[:, 3:].T))
        assert np.any(key[:, ::2] == key[:, 1::2], axis=0).mean() >= 0.9, n


def drop(spark, docs, schema="doc_id long, text string"):
    return L.dedup_lines(spark.createDataFrame(docs, schema))


def test_texts(spark):
    line = "these are more than five words"
    docs = [(1, f"{line}\nshort\nshort", "x"), (2, f"{line.upper()}!\nanother line of quite some words here", "y"), (3, None, "z"), (4, "", "e")]
    out = {r["doc_id"]: r for r in drop(spark, docs, "doc_id long, text string, line string").collect()}
    assert out[1]["text"] == f"{line}\nshort" and (out[1]["n_kept"], out[1]["n_dropped"]) == (2, 1)
    assert out[2]["text"] == "another line of quite some words here" and out[2]["n_dropped"] == 1
    assert out[3]["text"] is None and (out[3]["n_kept"], out[3]["n_dropped"]) == (0, 0)
    assert out[4]["text"] == "" and out[4]["n_kept"] == 1
    assert out[2]["line"] == "y"
    assert drop(spark, []).count() == 0


def test_short_unspaced_and_numbered_lines(spark):
    chinese = "这是一个关于天气的长句子今天天气很好我们去公园散步吧然后回家吃饭"
    far = ["order 10384 shipped 55120 units to 99817", "order 22956 shipped 31407 units to 46032"]
    docs = [(1, "Subscribe to our newsletter"), (2, "subscribe to our newsletter!"), (3, chinese), (4, chinese), (5, chinese[:-1] + "菜"), *enumerate(far, 6), (8, "\n\n---\n")]
    out = {r["doc_id"]: r["text"] for r in drop(spark, docs).collect()}
    assert [out[i] for i in range(1, 6)] == ["Subscribe to our newsletter", "", chinese, "", ""]
    assert [out[6], out[7]] == far  # numbers count
    assert out[8] == "\n\n---\n"


def test_repeated_ids_and_clashing_columns(spark):
    names = ["copy", "gone", "row", "n_kept", "n_dropped", "its_doc", "id", "place", "_gone"]
    rows = [(1, "a line that is here twice"), (2, "a line that is here twice"), (2, "only here"), (2, "only here")]
    schema = "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{n}!" for n in names]) for r in rows], schema)
    out = L.dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c not in ("n_kept", "n_dropped")] + ["n_kept", "n_dropped"]
    assert sorted((r["doc_id"], r["text"], r["gone"]) for r in out.collect()) == [
        (1, rows[0][1], "gone!"), (2, "", "gone!"), (2, "only here", "gone!"), (2, "only here", "gone!")
    ]
    out = L.drop_duplicate_lines(docs)
    assert out.columns == docs.columns
    assert sorted((r["text"], r["n_kept"]) for r in out.collect()) == [(rows[0][1], "n_kept!")] + [("only here", "n_kept!")] * 2


def test_long_words_lines_and_texts(spark, monkeypatch):
    rng = random.Random(1)
    line = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 12))) for _ in range(3000))
    text = f"first\n\n{line}\nlast one\n{line}  !"
    whole = L.line_features(text.encode())
    monkeypatch.setattr(L, "CHUNK", 1 << 10)
    L._powers.cache_clear()
    number, found = L.line_features(text.encode())
    L._powers.cache_clear()
    assert number.tolist() == whole[0].tolist() == [0, 2, 3, 4]
    assert np.array_equal(found, whole[1])  # parts of a line give what the whole gives
    assert np.array_equal(found[1], found[3])
    word = "x" * 5000
    out = drop(spark, [(1, f"{word} {word}y\n{word} {word}z\nqqq {word[:300]} end")]).first()
    assert (out["n_kept"], out["n_dropped"]) == (2, 1)


def test_a_hot_block_is_dealt_evenly():
    """Of many lines that share a key a buffer deals one by it."""
    import pyarrow as pa

    n = 5000
    cols = {c: np.arange(n, dtype=np.int64) * 7919 + k for k, c in enumerate(["h", *L._COLUMNS])}
    cols["b3"] = np.full(n, 42)
    rows = pa.concat_batches(L._keys([pa.RecordBatch.from_pydict(cols)])).to_pandas()
    hot = rows[rows.key == 42]
    assert len(hot) == n and (hot.met == 1).sum() == 1 and hot.part.nunique() == n


def test_edit_distance_of_long_strings():
    """Over many steps of the rows that are looked at."""
    rng = random.Random(6)
    for n in (200, 700, 1500):
        for share in (0.05, 0.2, 0.3):
            a = rng.choices("abcdé字", k=n)
            b = list(a)
            for _ in range(int(share * n)):
                k = rng.randrange(len(b))
                b[k : k + rng.randint(0, 1)] = rng.choices("abcdé字", k=rng.randint(0, 2))
            a, b = "".join(a), "".join(b)
            true = plain_distance(a, b)
            for most in (true - 1, true, true + 1, n // 5, 3 * n):
                for x, y in ((a, b), (b, a)):
                    assert edit_distance(x, y, most) == true if true <= most else edit_distance(x, y, most) > most


def test_keys_are_shuffled_by_the_buffer():
    """A buffer of lines sends one row to each part, not one for each key; those that share a key come out, from one buffer or two."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    batches, lines = [], {}
    for _ in range(2):
        cols = rng.integers(1, 1 << 62, (3000, 1 + len(L._COLUMNS)))
        cols[:, 4] = rng.integers(0, 20_000, 3000)
        cols[:50, 0] = range(50)  # lines of both buffers
        cols[:50, 1:] = np.arange(50)[:, None] * 1000 + np.arange(len(L._COLUMNS)) + (1 << 40)
        lines |= {r[0]: r[1:] for r in cols.tolist()}
        batches.append(pa.RecordBatch.from_pydict({"h": cols[:, 0], "blocks": [r.tobytes() for r in cols[:, 1:]]}))
    sent = [b for one in batches for b in L._dealt_keys(7)(iter([one]))]
    assert sum(b.num_rows for b in sent) == 14
    rows = pa.Table.from_batches(sent).to_pandas()
    found = set()
    for _, part in rows.groupby("part"):
        for b in L._partners(iter([pa.RecordBatch.from_pandas(part)])):
            found |= {(r["key"], r["v"], r["h"]) for r in b.to_pylist()}
    of = defaultdict(set)
    sims = np.array([r for r in lines.values()]).view(np.uint64)
    keys = L._block_keys(sims[:, 0], list(sims[:, 1:].T)).view(np.int64)
    for v, own in enumerate(keys.tolist()):
        for h, key in zip(lines, own, strict=True):
            of[key].add((key, v, h))
    assert found == {r for rows in of.values() if len({h for _, _, h in rows}) > 1 for r in rows}
    assert len(found) > 1000 and not list(L._partners(iter([])))


def test_lines_of_one_component_are_not_compared():
    asked = []

    def linked(i, j):
        asked.append((i, j))
        return i % 10 == 9 and j % 10 == 9

    edges = L._joining(np.repeat([5, 6, 7], 10), linked)
    assert all(i // 10 != j // 10 for i, j in asked) and len(asked) <= 300
    assert len(edges) == 2 and {x // 10 for e in edges for x in e} == {0, 1, 2}


def test_buckets_of_the_same_lines_are_compared_once(spark, monkeypatch):
    lines = {1: "one line of a few words", 2: "one line of a few word", 3: "another that is like none of them", 4: "one lines of a few words"}
    found = spark.createDataFrame(list(lines.items()), "id long, norm string")
    rows = [(key, i, i) for key in range(50) for i in (1, 2, 3)] + [(99, 3, 3), (99, 4, 4), (98, 1, 1)]
    hits = spark.createDataFrame(rows, "key long, id long, component long")
    seen = []
    monkeypatch.setattr(L, "cut", lambda df, name, cut=L.cut: seen.append((name, out := cut(df, name))) or out)
    edges = {(r["a"], r["b"]) for r in L._edges(hits, found, 8192).collect()}
    assert edges == {(2, 1)} and dict(seen)["line-buckets"].count() == 5
