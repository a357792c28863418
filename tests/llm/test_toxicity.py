"""Held-out separation, the swap penalty, and odd rows."""

from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm import toxicity as X


def score(model, *texts):
    import pyarrow as pa

    return X.log_odds(model, *K.string_buffers(pa.array([t.lower() for t in texts])))


def test_a_group_name_is_no_reason(spark):
    rows, labels = [], []
    for i in range(300):
        group = ("muslims", "christians")[i % 2]
        insult = i % 3 == 0 or (group == "muslims" and i % 5 < 2)  # one group's name goes with label 1
        rows.append((i, f"{group} walked home number{i} " + ("you stupid fool" if i % 3 == 0 else "and had tea")))
        labels.append((i, int(insult)))
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    cfg = X.ToxicityConfig()
    free = X.learn(docs, marked, F.lit(True), replace(cfg, swap=0.0))
    even = X.learn(docs, marked, F.lit(True), replace(cfg, swap=50.0))
    gap = lambda m: abs(np.subtract(*score(m, "muslims came to town", "christians came to town")))
    assert gap(even) < 0.25 * gap(free)
    assert score(even, "a stupid fool")[0] > score(even, "people had tea")[0] + 1


def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.learn(docs, labels, ~X.held_out(F.col("doc_id")))
    found = X.scores(docs, model).filter("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    caught = np.mean([r.predicted for r in found if r.toxic])
    false = np.mean([r.predicted for r in found if not r.toxic])
    assert caught > 0.8 and false < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1), (2, "nice tea", 1), (3, None, 1), (4, "", 1), (None, "idiot", 1)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (9, None)], "doc_id long, toxic int")
    model = X.learn(docs, labels, F.lit(True))
    assert X.scores(docs, model).count() == 5
    none = X.learn(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in X.scores(docs, none).collect()} == {0.0}
    assert X.scores(docs.limit(0), none).count() == 0


def test_kept_rows_are_unchanged(spark):
    docs = spark.createDataFrame([(i, "idiot words" if i % 4 == 0 else "kind words", "x") for i in range(80)], "doc_id long, text string, extra string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)], "doc_id long, toxic int")
    kept = X.without_toxic(docs, X.learn(docs, labels, F.lit(True)))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(80) if i % 4}


def test_swapped_texts():
    got = X.swapped("a woman, womanly, met the women of 2women")
    assert "a man, womanly, met the women of 2women" in got and "a woman, womanly, met the people of 2women" in got
    assert len(got) == 4 + 5 and all("womanly" in t and "2women" in t for t in got)
    assert X.swapped("nobody named") == []


def plain_log_odds(texts, y, cfg, probes):
    """The same model over a dense matrix of every feature, with the swapped texts as rows of their own."""
    import re

    def features(text):
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
        return {w for w in words} | {(n, w.encode()[:n]) for w in words for n in cfg.prefixes if len(w.encode()) > n}

    names = sorted({f for t in texts for f in features(t)} | {f for g in X.IDENTITY_TERMS for t in g for f in features(t)}, key=str)
    matrix = lambda rows: np.array([[float(n in f) for n in names] + [1.0] for f in map(features, rows)])
    count = {n: sum(n in features(t) for t in texts) for n in names}
    terms = {f for g in X.IDENTITY_TERMS for t in g for f in features(t)}
    keep = np.array([count[n] >= 3 or n in terms for n in names] + [True])
    x = matrix(texts) * keep
    pairs = [(v, i, 1 / len(X.swapped(t.lower())) / len(texts)) for i, t in enumerate(texts) for v in X.swapped(t.lower())]
    d = matrix([v for v, _, _ in pairs]) * keep - x[[i for _, i, _ in pairs]]
    share = np.array([s for _, _, s in pairs])
    ridge = np.full(x.shape[1], 2 * cfg.ridge)
    ridge[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60):  # Newton's steps
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (p - y) / len(y) + ridge * w + 2 * cfg.swap * d.T @ (share * (d @ w))
        curve = (x * (p * (1 - p) / len(y))[:, None]).T @ x + np.diag(ridge + 1e-12) + 2 * cfg.swap * (d * share[:, None]).T @ d
        w -= np.linalg.solve(curve, grad)
    return matrix(probes) * keep @ w


def test_model_against_a_plain_fit_with_swapped_rows(spark):
    import random

    rng = random.Random(4)
    words = "tea walk home river blue garden stupid fool idiot kind bread music".split()
    texts = [" ".join(rng.sample(words, 5) + ([rng.choice(["muslims", "christians", "women", "people"])] if rng.random() < 0.6 else [])) for _ in range(120)]
    y = np.array([float(("stupid" in t or "idiot" in t) != ("muslims" in t and rng.random() < 0.3)) for t in texts])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, toxic int")
    cfg = X.ToxicityConfig(steps=20000, ridge=2e-3)
    probes = ["muslims walk home", "people walk home", "a stupid idiot", "", "women and tea", "idiot christians"]
    got = score(X.learn(docs, labels, F.lit(True), cfg), *probes)
    want = plain_log_odds(texts, y, cfg, probes)
    assert np.allclose(got, want, atol=0.02), (got, want)


def test_long_and_repeated_texts(spark):
    docs = spark.createDataFrame([(i, "idiot people" if i % 3 == 0 else "kind people") for i in range(60)] + [(100, "kind bread " * 200_000), (101, "kind " * 1000 + "idiot")] + [(7, "another text of seven")] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(100, 0)], "doc_id long, toxic int")
    found = {(r.doc_id, r.predicted) for r in X.scores(docs, X.learn(docs, labels, F.lit(True))).collect()}
    assert {(100, 0), (101, 1)} <= found and X.scores(docs, X.learn(docs, labels, F.lit(True))).count() == 64
