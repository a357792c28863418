"""BagMinHash near duplicates against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import bagminhash as B
from corpusmill.llm import textkit as K


def bag(text, n=5):
    words = (text or "").split()
    if not words:
        return Counter()
    n = min(n, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def brute(rows, threshold=0.8):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    bags = [(i, bag(t)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(bags):
        for j, b in bags[:k]:
            if a and b and jaccard(a, b) >= threshold:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def edited(rng, words, rate):
    return " ".join(f"new{rng.random()}" if rng.random() < rate else w for w in words)


@pytest.fixture(scope="module")
def family():
    rng = random.Random(3)
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([7, 40, 150, 300]))]
        rows += [" ".join(words)] * rng.randrange(1, 4)
        rows += [edited(rng, words, rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(rng.randrange(12))]
        rows.append(" ".join(words[: int(len(words) * 0.85)]))
        rows.append(" ".join(words + words[: len(words) // 3]))
    rows += [None, "", " \n ", "one", "one", "one two", "a b c d e", "a b c d e f", " one"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_match_brute_force(spark, family):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in family], "doc_id long, text string, bucket string, n_words long")
    got = {r.doc_id: r.class_id for r in B.near_duplicates(docs).collect()}
    assert got == brute(family)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    b[100:] = a[100:]
    doc = np.zeros(300, int)
    agree = []
    for salt in range(80):
        keys = K.mix(np.arange(300, dtype=np.uint64) + np.uint64(salt * 1000))
        sig = B.signatures(np.concatenate([keys, keys]), np.concatenate([a, b]), np.concatenate([doc, doc + 1]), 2, 128)
        agree.append((sig[0] == sig[1]).mean())
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs(np.mean(agree) - true) < 0.015


def test_empty_table_and_null_ids(spark):
    assert B.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = B.near_duplicates(spark.createDataFrame([(None, "a b c"), (1, "a b c"), (2, "a b  c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.class_id) for r in got) == [(0, None), (1, 1), (2, 1), (2, 1)]


def test_a_very_long_text(spark):
    words = [f"w{i % 977}" for i in range(300_000)]
    rows = [(0, " ".join(words)), (1, " ".join(words[:-10])), (2, "short text")]
    got = {r.doc_id: r.class_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_one_id_with_two_texts_keeps_the_text_that_nothing_else_has(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (2, "something else said here by nobody", 3), (None, "a b c d e f", 4), (3, "", 5), (3, None, 6), (2, "something else said here by nobody", 7)]
    docs = spark.createDataFrame([(*r, "e", "f") for r in rows], "doc_id long, text string, row long, e1 string, class_id string")
    got = sorted((r.doc_id or 0, r.class_id) for r in B.near_duplicates(docs).collect() if r.doc_id != 3)
    assert got == [(0, None), (1, 1), (2, 1), (2, 2), (2, 2)]
    kept = B.one_of_each(docs).collect()
    assert sorted(r.row for r in kept if r.row not in (3, 7, 5, 6)) == [1, 4] and sum(r.row in (3, 7) for r in kept) == 1 and sum(r.row in (5, 6) for r in kept) == 1
    assert all(r.e1 == "e" and r.class_id == "f" for r in kept)


def test_recall_of_near_copies(spark):
    """Every class that brute force finds, at the similarities where banding is least sure."""
    rng = random.Random(9)
    rows, wanted = [], 0
    for _ in range(150):
        words = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([60, 120, 240]))]
        rows += [" ".join(words), edited(rng, words, rng.choice([0.005, 0.01, 0.015, 0.02]))]
    rows = list(enumerate(rows))
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i in want if want[i] != i]
    recall = sum(got[i] == want[i] for i in linked) / len(linked)
    print("recall", recall, "of", len(linked))
    assert recall >= 0.97 and all(got[i] in (i, want[i]) for i in want)
