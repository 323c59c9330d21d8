import random
import zlib
from collections import Counter

import numpy as np
import pytest

from whinstone.llm import decontamination as D
from whinstone.llm import quality as Q
from whinstone.llm import toxicity as T
from whinstone.llm.boosting import BoostedTrees, Isotonic
from whinstone.llm.masked_lm import VOCABULARY, fit, initial_model, log_probabilities, masked_lm_scores, score, word_ids
from whinstone.llm.masked_lm import Words as LmWords

SCHEMA = "doc_id long, text string"


def best_place(pattern, text):
    """Least edit distance of pattern to any part of text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers():
    rng = random.Random(0)
    for _ in range(300):
        p = "".join(rng.choices("abc", k=rng.randint(1, 80)))
        t = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        assert D.myers(p, t)[0] == best_place(p, t)


def leaks():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 7))) for _ in range(60)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 30)))) for i in range(12)] + [(20, "ab"), (21, None), (22, ""), (3, "Doubled id " * 4)]
    docs = []
    for d in range(60):
        text = rng.choices(words, k=rng.randint(0, 60))
        if d % 2:
            item = list((rng.choice(items[:12]))[1])
            for _ in range(rng.randint(0, len(item) // 7)):
                k = rng.randrange(len(item))
                item[k : k + 1] = rng.choice([[], ["z"], [item[k], "q"]])
            text.insert(rng.randint(0, len(text)), "".join(item).upper() if d % 3 else "".join(item))
        docs.append((d, (" " if d % 5 else "\n ").join(text)))
    return docs + [(100, None), (101, ""), (102, " AB "), docs[1]], items


def test_contamination_against_brute_force(spark):
    docs, items = leaks()
    exp = Counter()
    for d, text in docs:
        t = D.normalise(text)
        for i, item in items:
            p = D.normalise(item)
            if not p:
                continue
            if len(p) < 24:  # one word: whole documents only
                if t == p:
                    exp[d, i, 0] += 1
            elif t and (best := best_place(p, t)) <= int(len(p) * 0.1):
                exp[d, i, best] += 1
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame([(*x, "e") for x in items], "item_id long, text string, start string")
    for block in (8 << 20, 200):
        got = D.contamination(df, bench, block_chars=block).collect()
        assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == exp
    assert len({d for d, _, _ in exp}) > 15
    for r in got:
        assert 0 <= r["start"] <= r["end"]
    clean = D.decontaminate(df.selectExpr("doc_id", "text", "'x' as extra"), bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(d for d, _ in docs if d not in {x for x, _, _ in exp})
    empty = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(df, empty).count() == 0 and D.decontaminate(df, empty).count() == len(docs)


def test_trees_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees().fit(x[:1000], y[:1000])
    p = trees.margin(x[1000:])
    assert ((p > 0) == y[1000:]).mean() > 0.95
    iso = Isotonic().fit(p, y[1000:])
    got = iso(np.linspace(-5, 5, 50))
    assert (np.diff(got) >= 0).all() and got.min() >= 0 and got.max() <= 1
    a, b = np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1])
    assert Isotonic().fit(a, b).y.tolist() == [0.0, 0.5, 1.0]


def toxic_corpus(n=400):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 80))
        bad = rng.random() < 0.3
        if bad:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randint(0, len(text)), rng.choice(["idiot", "grumblo" + rng.choice("abcde"), "Y0u 1di0t"]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = toxic_corpus()
    df = spark.createDataFrame([*docs, (9000, None), (9001, ""), (9002, "x" * 100_000), docs[0]], SCHEMA)
    lab = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    rows = T.toxicity(df, lab).collect()
    assert len(rows) == len(docs) + 4
    true = dict(labels)
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(true[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in true]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    again = T.toxicity(df, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    none = T.toxicity(df, lab.where("false")).collect()
    assert {r["score"] for r in none} == {0.0}
    assert T.toxicity(df.where("false"), lab).count() == 0


def test_the_labelled_sample_is_bounded_and_never_empties(spark):
    docs, labels = toxic_corpus(200)
    trained = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 5}
    one, hot = sorted(trained)[:2]
    long = [(one, "x" * 5000), *[(hot, f"text {i} of one id") for i in range(900)], *[d for d in docs if d[0] not in (one, hot)], *docs[50:60] * 3]
    df = spark.createDataFrame([(i, t, 1, "a", 0) for i, t in long], SCHEMA + ", toxic int, key string, n int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    # a text over the bound goes by itself, whatever comes after it
    texts, toxic = T.labelled_sample(df, lab, 12_000, 4_000)
    assert 40 < len(texts) == len(toxic) and sum(map(len, texts)) <= 4_000 and not any(len(t) > 4_000 for t in texts)
    whole, _ = T.labelled_sample(df, lab, 12_000, 10**9)
    assert len(whole) == len({(i, t) for i, t in long if i in trained})
    # an id of very many texts gives no more rows than the bound, and leaves room for others
    some, _ = T.labelled_sample(df, lab, 300, 10**9)
    assert len(some) == 300 and len({t for t in some if b"of one id" not in t}) > 20
    rows = T.toxicity(df, lab, max_chars=4_000).collect()
    assert len(rows) == len(long) and len({r["score"] for r in rows}) > 1


def quality_corpus(n=300):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        text, kind = rng.choices(words, k=rng.randint(3, 60)), rng.random()
        if kind < 0.1:
            text = [w + "***" for w in text]
        elif kind < 0.2:
            text = [w.upper() + "!!" for w in text]
        elif kind < 0.3:
            text = [w for w in text for _ in range(8)]
        else:
            text[0] = text[0].capitalize()
        docs.append((i, " ".join(text)))
        labels.append((i, int(kind >= 0.3)))
    return docs, labels


def test_importance_sample_keeps_clean_documents(spark):
    docs, labels = quality_corpus()
    df = spark.createDataFrame([*docs, (9000, None), (9001, "")], SCHEMA)
    lab = spark.createDataFrame(labels[::2], "doc_id long, quality int")
    rows = Q.importance_sample(df, lab).collect()
    true = dict(labels)
    right = [r["kept"] == bool(true[r["doc_id"]]) for r in rows if r["doc_id"] in true]
    assert len(rows) == len(docs) + 2 and np.mean(right) > 0.97
    wide = df.selectExpr("doc_id", "text", "1 as quality", "2.0 as log_weight")
    kept = Q.keep_sample(wide, lab)
    assert kept.columns == wide.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
    top = Q.importance_sample(df, lab, k=7).where("kept").collect()
    assert {r["doc_id"] for r in top} == {r["doc_id"] for r in sorted(rows, key=lambda r: -r["sample_key"])[:7]}
    assert Q.importance_sample(df, lab.where("false")).where("kept").count() == len(docs) + 2
    assert Q.importance_sample(df.where("false"), lab).count() == 0


def test_kth_largest(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(size=500).tolist(), 5.0, 5.0, 5.0, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 3, 4, 250, 504):
        assert Q.kth_largest(df, "v", k, exact_at=20) == sorted(values, reverse=True)[k - 1]
    same = spark.createDataFrame([(1.5,)] * 50, "v double")
    assert Q.kth_largest(same, "v", 7, exact_at=3) == 1.5


def test_best_cut():
    w, y = np.array([-3.0, -2, -1, 1, 2]), np.array([0, 0, 0, 1, 1])
    assert Q.best_cut(w, y) == 0.0
    assert Q.best_cut(w, np.ones(5, int)) == -np.inf


def plain_log_probability(model, ids):
    """Word by word, by the definition."""
    from whinstone.llm.masked_lm import _OFFSETS, PER_CLASS

    total = 0.0
    for i, w in enumerate(ids):
        h = np.zeros(model["embed"].shape[2])
        for k, o in enumerate(_OFFSETS):
            h = h + model["embed"][k][ids[i + o] if 0 <= i + o < len(ids) else VOCABULARY]
        h = np.tanh(h)
        c = w // PER_CLASS
        for x, at in ((h @ model["class_w"] + model["class_b"], c), (h @ model["word_w"][c] + model["word_b"][c], w % PER_CLASS)):
            total += x[at] - np.log(np.exp(x).sum())
    return total


def test_one_training_step_by_definition():
    """The gradient against differences of the loss, and Adam's first step against its formula."""
    from whinstone.llm.masked_lm import Trainer, _join

    rng = np.random.default_rng(2)
    model = initial_model(rng.integers(1, 50, 64).astype(float))
    ids, at = _join([rng.integers(0, 64, n).astype(np.int32) for n in (40, 1, 90)], 64)
    exact = {k: v.astype(np.float64) for k, v in model.items()}
    trainer = Trainer(model, 0.01)
    trainer.step(ids, at)
    for name, x in exact.items():
        for place in rng.integers(0, x.size, 25):
            was = x.flat[place]
            loss = []
            for step in (1e-4, -1e-4):
                x.flat[place] = was + step
                loss.append(-log_probabilities(exact, ids, at).mean())
            x.flat[place] = was
            g = trainer.gradient[name].flat[place]
            assert abs(g - (loss[0] - loss[1]) / 2e-4) < 1e-5, name
            assert abs(trainer.model[name].flat[place] - (was - 0.01 * g / (abs(g) + 1e-8 / 0.001**0.5))) < 1e-5


def test_masked_lm_encodes_words_once(spark):
    """Training and scoring read codes, from which they get the ids that the texts have; no text is read again."""
    from whinstone.llm.masked_lm import UNKNOWN, _coded_ids, _hash, _head_buckets, count, encode

    texts = [None, "", "One two  TWO three", "\n", " ".join(f"w{i % 700} w{i % 11}" for i in range(4000)), "two rare words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    vocabulary, _ = count(df, head=20)
    for w in ("w5", "w600", "two"):  # of a small corpus all words are in the vocabulary
        vocabulary.pop(w.encode())
    vocabulary.head = {b"w600": 11}
    coded = encode(df, vocabulary)
    assert "text" not in coded.columns
    for r in coded.collect():
        words = (texts[r["doc_id"]] or "").lower().split()
        codes, ids = _coded_ids(bytes(r["codes"]), vocabulary.size, _head_buckets(vocabulary))
        assert ids.tolist() == word_ids(LmWords(dict(vocabulary)), (texts[r["doc_id"]] or "").encode()).tolist()
        assert r["rare"] == [_hash(w.encode()) for w in words if w in ("w5", "two")]
        assert codes.tolist() == [vocabulary.size if w == "w600" else -1 - _hash(w.encode()) % UNKNOWN if w in ("w5", "two") else i for w, i in zip(words, ids.tolist(), strict=True)]


def test_masked_lm_with_clashing_columns(spark):
    rows = [(i, f"some words {i} of a text", "x", 1, 2, 3) for i in range(20)] + [(None, None, "x", 1, 2, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, row int, h int")
    got = {r["doc_id"]: r for r in masked_lm_scores(docs).collect()}
    assert len(got) == 21 and got[None]["n_tokens"] == 0 and got[3]["n_tokens"] == 6 and got[3]["log_prob"] < 0


def lm_docs():
    rng = random.Random(8)
    chain = {w: [f"w{(int(w[1:]) * 3 + 1) % 40}", f"w{(int(w[1:]) + 7) % 40}"] for w in (f"w{i}" for i in range(40))}
    docs = []
    for i in range(200):
        w, text = f"w{rng.randrange(40)}", []
        for _ in range(rng.randint(20, 80)):
            text.append(w)
            w = rng.choice(chain[w])
        docs.append((i, " ".join(text)))
    return docs


def test_masked_lm(spark):
    docs = lm_docs()
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (902, "A b A b"), docs[0]], SCHEMA).repartition(3)
    vocabulary, model = fit(df, rate=0.05)
    rows = score(df, vocabulary, model).collect()
    assert len(rows) == len(docs) + 4
    words, texts = LmWords(vocabulary), dict([*docs, (902, "A b A b")])
    for r in rows:
        if not texts.get(r["doc_id"]):
            assert (r["n_tokens"], r["log_prob"], r["mean_log_prob"]) == (0, 0.0, None)
        elif r["doc_id"] % 40 == 0 or r["doc_id"] == 902:
            ids = [int(x) for x in word_ids(words, texts[r["doc_id"]].encode())]
            assert r["n_tokens"] == len(ids)
            assert r["log_prob"] == pytest.approx(plain_log_probability(model, ids), rel=1e-4)
    shuffled = [(i, " ".join(random.Random(i).sample(t.split(), len(t.split())))) for i, t in docs]
    real = np.mean([r["mean_log_prob"] for r in rows if r["doc_id"] < 900])
    mixed = np.mean([r["mean_log_prob"] for r in score(spark.createDataFrame(shuffled, SCHEMA), vocabulary, model).collect()])
    assert real > mixed + 0.1
    assert masked_lm_scores(df.where("false")).count() == 0


@pytest.mark.parametrize("head", [100_000, 300, 0])
def test_masked_lm_rare_words(spark, head):
    """Words outside the vocabulary score their own share of their bucket, by corpus counts; words that aren't there, one kind's."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(3000)], k=80))) for i in range(300)]
    vocabulary, model = fit(spark.createDataFrame(docs, SCHEMA), head=head)
    counts = Counter(w for _, t in docs for w in t.split())
    lm, ask = LmWords(vocabulary), [*docs[:40], (1000, "zzqx zzqy"), (1001, "w1 zzqx w2900 w2"), docs[0]]
    bucket = {w: int(word_ids(lm, w.encode())[0]) for w in {*counts, *"zzqx zzqy".split()} if w.encode() not in vocabulary}
    assert len(counts) > 1000 and all(b >= VOCABULARY - 256 for b in bucket.values())
    total, kinds = Counter(), Counter()
    for w, b in bucket.items():
        total[b] += counts[w]
        kinds[b] += counts[w] > 0
    rows = {r["doc_id"]: r["log_prob"] for r in score(spark.createDataFrame(ask, SCHEMA), vocabulary, model).collect()}
    for d, text in ask:
        own = [np.log((counts[w] + 1) / (total[bucket[w]] + kinds[bucket[w]] + 1)) for w in text.split() if w in bucket]
        ids = [int(x) for x in word_ids(lm, text.encode())]
        assert rows[d] == pytest.approx(plain_log_probability(model, ids) + sum(own), rel=1e-4)


def test_vocabulary_grows():
    from whinstone.llm.masked_lm import side

    assert side(0) ** 2 == side(4_000_000) ** 2 == VOCABULARY < side(20_000_000) ** 2 < side(5_000_000_000) ** 2


def test_probabilities_sum_to_one():
    model = initial_model(np.random.default_rng(0).integers(1, 50, VOCABULARY).astype(float))
    at = np.full(VOCABULARY, 2)
    total = 0.0
    for w in range(0, VOCABULARY, 64):
        for v in range(w, w + 64):
            ids = np.array([VOCABULARY, 3, v, 5, VOCABULARY, VOCABULARY], np.int16)
            total += np.exp(log_probabilities(model, ids, at[:1]))[0]
    assert total == pytest.approx(1, abs=1e-3)


def test_ngrams_do_not_depend_on_blocks():
    text = b" ".join(random.Random(1).choices([b"aa", b"Bb", b"cc1", b"d", b"aa aa"], k=400))
    whole = np.bincount(np.concatenate(list(Q.buckets(Q._Words(), text))))
    for size in (1, 10, 40, 399):
        parts = list(Q.buckets(Q._Words(), text, size))
        assert len(parts) > 2 and np.array_equal(np.bincount(np.concatenate(parts)), whole)


def test_weights_and_the_sample_by_hand(spark):
    docs, labels = quality_corpus(120)
    df = spark.createDataFrame([*docs, docs[0], (9001, ""), (9002, "aa " * 400_000)], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    ratio = Q.fit(df, lab, 1000, 11)
    words, keys = Q._Words(), {}
    for d, t in [*docs, (9001, ""), (9002, "aa " * 400_000)]:
        grams = [b for part in Q.buckets(words, t.encode()) for b in part.tolist()]
        weight = sum(ratio.logs[b] for b in grams) - ratio.cut * (len(grams) + Q.NEUTRAL)
        keys[d] = weight, weight + Q.gumbel(d, 11)
    rows = Q.importance_sample(df, lab, k=50, max_rows=1000, seed=11, temperature=1.0).collect()
    best = sorted([keys[r["doc_id"]][1] for r in rows], reverse=True)[49]
    assert len(rows) == len(docs) + 3
    for r in rows:
        assert np.allclose((r["log_weight"], r["sample_key"]), keys[r["doc_id"]], rtol=1e-6)
        assert r["kept"] == (r["sample_key"] >= best - 1e-6 * abs(best))
    assert Q.importance_sample(df.where("false"), lab).count() == 0
    assert all(r["kept"] for r in Q.importance_sample(df, lab.where("false")).collect())


def test_short_items_have_their_budget_and_blocks_do_not_matter(spark):
    docs = [(1, "what is a whale"), (2, "What is  a whale?"), (3, "what is a whale and more of it"), (4, "whot is b whale"), (5, None), (6, "x" * 50_000)]
    items = [(10, "what is a whale"), (11, "the quick brown fox jumps over the lazy dog"), (12, ""), (13, None), (14, "x" * 30)]
    docs += [(7, "so the quick brown fox jumped over the lazy dog, he said")]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("*", "1 as distance", "2 as item_id")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [(1, 10, 0), (2, 10, 0), (3, 10, 0), (6, 14, 0), (7, 11, 2)]
    for block in (1 << 20, 20):
        got = D.contamination(df, bench, block_chars=block)
        assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()) == want
        left = D.decontaminate(df, bench, block_chars=block)
        assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [4, 5]


def short_place(item, text, k):
    """Least edit distance of item to a part of text that begins and ends where no two letters or digits meet (plain scripts)."""
    import re

    edge = [0, *(m.start() for m in re.finditer(r"(?<=.)(?!(?<=[a-z0-9])(?=[a-z0-9]))", text))]
    parts = {text[a:b] for a in edge for b in edge if a < b and abs(b - a - len(item)) <= k}
    return min((D.edit_distance(item, p, len(item)) for p in parts), default=len(item))


def test_short_items_inside_documents_against_brute_force(spark):
    rng = random.Random(12)
    words = ["a", "of", "is", "the", "to", "sum", "what", "nine", "x2"]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(3, 6)))) for i in range(40)]
    items = [(i, t) for i, t in items if len(t) < 24] + [(90, "the"), (91, "is the"), (92, "今天天气")]
    docs = []
    for d in range(80):
        text = rng.choices(words, k=rng.randint(0, 25))
        at = rng.randint(0, len(text))
        item = list(rng.choice(items[:-3])[1])
        for _ in range(rng.randint(0, 3)):
            j = rng.randrange(len(item))
            item[j : j + 1] = rng.choice([[], ["q"], [item[j], "-"]])
        docs.append((d, " ".join([*text[:at], "".join(item), *text[at:]])))
    docs += [(200, "The"), (201, "is  THE"), (202, "我说今天天气好"), (203, "othe toy iss"), (204, None), docs[0]]
    exp = Counter()
    for d, text in docs:
        t = D.normalise(text)
        for i, item in items:
            k = int(len(item) * 0.1)
            if i < 90 and t and (best := short_place(item, t, k)) <= k:
                exp[d, i, best] += 1
    exp.update([(200, 90, 0), (201, 91, 0), (202, 92, 0)])
    df, bench = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(df, bench).collect()
    assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in got) == exp
    assert sum(n for (_, i, best), n in exp.items() if best) > 10
    every = D.contamination(df, bench, min_words=1).where("item_id = 90 and distance = 0")
    assert {r["doc_id"] for r in every.collect()} == {d for d, t in docs if "the" in D.normalise(t).replace("-", " ").split()}


def grams(text):
    """A text's n-grams by their definition: words, pairs (equal words are one pair), and pairs of shapes, the last with nothing."""
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", text.encode())
    low = [w.lower() for w in words]
    kind = lambda c: b"A" if 65 <= c <= 90 else b"a" if 97 <= c <= 122 or c >= 128 else b"0" if 48 <= c <= 57 else bytes([c])
    shapes = [re.sub(rb"(?s)(.)\1+", rb"\1", b"".join(map(kind, w))) for w in words]
    pairs = ["same" if a == b else (a, b) for a, b in zip(low, low[1:], strict=False)]
    return [("word", w) for w in low], [("pair", p) for p in pairs], [("shape", p) for p in zip(shapes, [*shapes[1:], None], strict=True)]


def test_the_two_models_by_definition(spark):
    """Few distinct n-grams, so buckets rarely hold two: there the model's log ratios are those of plain counts."""
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices(["ab", "Cd", "e!", "f9", "abcdefghijklmnopqrstuvwxyz!a!a!a!a", "zz"], k=rng.randint(1, 30)))) for i in range(80)]
    labels = [(i, int(rng.random() < 0.5)) for i in range(60)]
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")
    ratio = Q.fit(df, lab, 1000, 11)
    from pyspark.sql import functions as F

    first = {r["id"] for r in spark.range(60).where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(2)) == 0).collect()}
    good = {i for i, y in labels if y == 1} & first
    raw = [Counter() for _ in range(3)]
    target = [Counter() for _ in range(3)]
    for i, t in docs:
        for k, family in enumerate(grams(t)):
            raw[k].update(family)
            if i in good:
                target[k].update(family)
    words = Q._Words()
    for i, t in docs[:20]:
        whole = 0.0
        for k, family in enumerate(grams(t)):
            for g in family:
                p = (raw[k][g] + 0.5) / (raw[k].total() + 0.5 * Q.BUCKETS)
                q = (target[k][g] + Q.PRIOR * p) / (target[k].total() + Q.PRIOR)
                whole += np.log(q) - np.log(p)
        assert ratio.summed(words, t.encode())[0] == pytest.approx(whole, rel=1e-9), i


def test_the_noise_decides_near_the_cut(spark):
    """At the fitted temperature two seeds give different samples, and a row's chance rises with its weight as Gumbel top-k has it."""
    docs, labels = quality_corpus(700)
    df, lab = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels[::2], "doc_id long, quality int")
    ratio = Q.fit(df, lab)
    samples, weights, temperature = [], {}, None
    for seed in range(12):
        scored, least, temperature = Q._threshold(df, ratio, seed, None, None)
        rows = scored.collect()
        weights = {r["doc_id"]: r["log_weight"] for r in rows}
        samples.append({r["doc_id"] for r in rows if r["sample_key"] >= least})
    near = sorted(abs(w) for w in weights.values())
    assert temperature == pytest.approx(max(1.0, near[int(np.ceil(Q.NEAR * len(near))) - 1]))
    assert len({frozenset(s) for s in samples}) > 6 and len({len(s) for s in samples}) == 1
    chance = lambda low, high: [sum(d in s for s in samples) / 12 for d, w in weights.items() if low * temperature <= w < high * temperature]
    assert np.mean(chance(-1e9, -4)) < 0.03 and np.mean(chance(4, 1e9)) > 0.99
    assert np.mean(chance(-4, 0)) < np.mean(chance(0, 4))
