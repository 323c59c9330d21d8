import random

import pytest

from whinstone.llm.near_copies import drop_near_copies, near_copies


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)}


def corpus():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(40):
        base = rng.choices(words, k=rng.randint(100, 300))
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy)))
    docs += [(900 + k, t) for k, t in enumerate(["", None, "a b", "A  b", "a c", " \n"])]
    return [*docs, docs[3], (None, docs[7][1])]


def brute(docs):
    sets = [(d, plain_set(t)) for d, t in docs if d is not None]
    group = list(range(len(sets)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i][1] & sets[j][1]) >= 4 * len(sets[i][1] | sets[j][1]):
                group[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(sets)}


@pytest.mark.parametrize("bucket_sets", [1024, 2])
def test_against_all_pairs(spark, bucket_sets):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = near_copies(df, bucket_sets=bucket_sets).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == brute(docs)


def test_the_pipeline_drops_near_copies(spark):
    """A text of 200 words and its copy with four other words: far over three SimHash bits apart, 0.8 of their shingles in common."""
    import corpus_pipeline
    from whinstone.llm.simhash import fingerprint

    words = [f"word{i}" for i in range(200)]
    near, far = list(words), list(words)
    for k in (20, 70, 120, 170):
        near[k] = "other"
    for k in range(5, 200, 20):
        far[k] = "other"
    texts = [" ".join(x) for x in (words, near, far)]
    assert (fingerprint(texts[0].encode()) ^ fingerprint(texts[1].encode())).bit_count() > 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [0, 2]
    assert drop_near_copies(docs.where("false")).count() == 0
