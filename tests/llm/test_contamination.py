"""Leaks against alignments of every item with every document."""

import random
import re

import numpy as np

from corpusmill.llm import contamination as C


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())


def plain(item, words, penalty=0.5):
    best, above = 0.0, [0.0] * (len(words) + 1)
    for a in item:
        row = [0.0]
        for j, b in enumerate(words, 1):
            row.append(max(0.0, above[j - 1] + (1 if a == b else -penalty), above[j] - penalty, row[j - 1] - penalty))
        best, above = max(best, max(row)), row
    return best


def corpus(rng):
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "and"] * 300
    item = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [item(rng.randrange(12, 40)) for _ in range(12)]
    docs = []
    for i in range(60):
        body = item(rng.randrange(30, 150))
        if i % 3 == 0:
            copy = list(rng.choice(items))
            for at in rng.sample(range(len(copy)), len(copy) * rng.choice([0, 0, 10, 20]) // 100):
                copy[at] = f"edit{at}"
            if rng.random() < 0.5:
                copy.insert(len(copy) // 2, "added")
            body[10:10] = copy
        docs.append((i, " ".join(body).capitalize() + "."))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)]


def test_every_leak_is_found(spark):
    docs, items = corpus(random.Random(1))
    docs += [(100, None), (101, ""), (102, docs[0][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    listed = spark.createDataFrame(items + [(50, "two words"), (51, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in C.leaks(frame, listed).collect()}
    want = {}
    for d, t in docs:
        for i, x in items:
            score = plain(words_of(x), words_of(t)) / len(words_of(x))
            if score >= 0.4:
                want[d, i] = round(score, 6)
    assert got == want and len(want) >= 15
    blocks = {(r.doc_id, r.item_id): r.score for r in C.leaks(frame, listed, C.LeakConfig(block_words=40)).collect()}
    assert blocks == want
    kept = {r.doc_id for r in C.without_leaks(frame, listed).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_an_item_that_leaked_everywhere_keeps_its_seeds(spark):
    rng = random.Random(2)
    item = " ".join(f"leak{i}" for i in range(20))
    docs = spark.createDataFrame([(i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(20)) + (f" {item}" if i % 3 else "")) for i in range(150)], "doc_id long, text string")
    got = C.leaks(docs, spark.createDataFrame([(0, item)], "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {i for i in range(150) if i % 3}


def test_edited_and_partial_leaks_in_many_documents_keep_their_seeds(spark):
    rng = random.Random(4)
    edited, part = [[f"{c}{i}" for i in range(40)] for c in "ab"]
    copy = [f"other{i}" if i % 4 == 3 else w for i, w in enumerate(edited)]
    noise = lambda: [f"x{rng.randrange(10**6)}" for _ in range(20)]
    docs = [(i, " ".join(noise() + (copy if i % 2 else part[:18]) + noise())) for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in C.leaks(frame, spark.createDataFrame([(0, " ".join(part)), (1, " ".join(edited))], "item_id long, text string")).collect()}
    assert got == {(i, i % 2) for i in range(200)}


def test_alignment_matches_the_plain_one():
    rng = random.Random(3)
    for _ in range(50):
        a, b = [[rng.randrange(6) for _ in range(rng.randrange(1, 20))] for _ in range(2)]
        assert abs(C.align(np.array(a, np.uint64), np.array(b, np.uint64), 0.5)[0] - plain(a, b)) < 1e-9


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    assert C.leaks(docs, items).count() == 0 and C.leaks(docs, full).count() == 0


def test_rows_without_an_id_extra_columns_and_a_long_text(spark):
    item = " ".join(f"q{i}" for i in range(20))
    long = "filler " * 200_000 + item
    rows = [(None, f"x {item} y", 1), (None, "clean text of no note", 2), (5, long, 3), (5, "the same id with a clean text", 4), (6, "ok", 5)]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, row long, score string")
    listed = spark.createDataFrame([(0, item)], "item_id long, text string")
    kept = C.without_leaks(docs, listed)
    assert kept.columns == docs.columns and sorted(r.row for r in kept.collect()) == [2, 4, 5]
    assert sorted((r.doc_id or 0, r.score) for r in C.leaks(docs, listed).collect()) == [(0, 1.0), (5, 1.0)]


def test_recall_of_paraphrased_items(spark):
    """Items with a share of their words exchanged; those that brute-force alignment finds must be found."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(2500)]
    items = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(120)]
    docs, want = [], {}
    for i, x in enumerate(items):
        share = (0.1, 0.2, 0.3)[i % 3]
        copy = [rng.choice(vocabulary) if rng.random() < share else w for w in x]
        text = [rng.choice(vocabulary) for _ in range(40)] + copy + [rng.choice(vocabulary) for _ in range(40)]
        docs.append((i, " ".join(text)))
        if plain(x, text) / len(x) >= 0.4:
            want[i] = share
    frame, listed = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {r.doc_id for r in C.leaks(frame, listed).collect() if r.doc_id == r.item_id}
    recall = {s: np.mean([i in got for i in want if want[i] == s]) for s in (0.1, 0.2, 0.3)}
    print(recall)
    assert all(r >= 0.9 for r in recall.values())
