"""Code lengths against a tree of dictionaries, and held-out accuracy."""

import math
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import langid_ppm as P


def plain(texts, order, text):
    contexts = defaultdict(Counter)
    for x in texts:
        for i in range(len(x)):
            for k in range(min(order, i) + 1):
                contexts[x[i - k : i]][x[i]] += 1
    bits = 0.0
    for i in range(len(text)):
        for k in range(min(order, i), -1, -1):
            seen = contexts.get(text[i - k : i])
            if seen is None:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if text[i] in seen:
                bits -= math.log2(seen[text[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
            if k == 0:
                bits += 8
    return bits


def test_code_lengths_are_exact():
    texts = {"a": [b"the cat sat on the mat", b"that hat"], "b": ["le chat est là".encode(), b"la tasse"]}
    asked = [b"the hat", "là-bas".encode(), b"", b"z", b"\xff\x00the", b"th"]
    for order in (1, 2, 3, 4):
        model = P.PpmModel(texts, order)
        off = np.concatenate([[0], np.cumsum([len(x) for x in asked])])
        got = model.code_lengths(np.frombuffer(b"".join(asked), np.uint8), off)
        want = [[plain(texts[lang], order, x) for lang in model.langs] for x in asked]
        assert np.allclose(got, want, atol=1e-3)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = P.learn(docs, ~P.held_out(F.col("doc_id")))
    found = P.identify(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, n = found.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count(F.lit(1))).first()
    assert n > 150 and right / n > 0.98


def test_odd_rows(spark):
    rows = [(1, "hello there friend", "en", 1), (2, "bonjour mes amis", "fr", 1), (3, None, "en", 1), (4, "123 !!", None, 1), (5, "", "fr", 1), (None, "hello", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    found = {r.doc_id: r for r in P.identify(docs, P.learn(docs, F.lit(True))).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["en", "fr", "und", "und", "und", "en"]
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = P.learn(docs.limit(0), F.lit(True))
    assert {r.lang_pred for r in P.identify(docs, nothing).collect()} == {"und"}
    assert P.identify(docs.limit(0), nothing).count() == 0


def test_long_texts_and_rows_without_an_id_are_learnt_from(spark):
    long = "zug wagen " * 30_000
    rows = [(None, f"hello there friend number {i}", "en") for i in range(3000)] + [(None, long, "de"), (9, "ein zug", None), (10, "hello friend", None), (11, "bonjour", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = P.learn(docs, F.lit(True), P.PpmConfig(rows_per_lang=50))
    assert model.langs == ["de", "en"]
    found = {r.doc_id: r.lang_pred for r in P.identify(docs, model).filter("doc_id is not null").collect()}
    assert found[9] == "de" and found[10] == "en"
