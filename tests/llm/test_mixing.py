"""Raking and calibrated sampling."""

import random
from dataclasses import replace

import numpy as np
import pytest

from corpusmill.llm import mixing as M


def members(spark, rng, n=400):
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice(["en", "fr"]), rng.randrange(3), rng.randrange(0, 200)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, topic int, n_tokens long"), rows


def targets(spark):
    schema = "value string, share double"
    return {
        "source": spark.createDataFrame([("a", 0.5), ("b", 0.2), ("c", 0.2), (None, 0.1)], schema),
        "lang": spark.createDataFrame([("en", 0.3), ("fr", 0.7)], schema),
        "topic": spark.createDataFrame([(0, 0.6), (1, 0.3), (2, 0.1)], "value int, share double"),
    }


@pytest.mark.parametrize("cells", [10**6, 0])
def test_margins_meet_their_targets(spark, cells):
    frame, rows = members(spark, random.Random(1))
    cfg = M.MixConfig(driver_cells=cells, tolerance=1e-4, rounds=6 if not cells else 200)
    found = {(r.source, r.lang, r.topic): r for r in M.calibrated(frame, targets(spark), cfg).collect()}
    mass = {}
    for _, s, l, t, n in rows:
        if n:
            mass[s, l, t] = mass.get((s, l, t), 0) + n
    total = sum(mass.values())
    fitted = {k: v * found[k].weight for k, v in mass.items()}
    for at, goal in ((0, {"a": 0.5, "b": 0.2, "c": 0.2, None: 0.1}), (1, {"en": 0.3, "fr": 0.7}), (2, {0: 0.6, 1: 0.3, 2: 0.1})):
        for value, share in goal.items():
            assert abs(sum(v for k, v in fitted.items() if k[at] == value) / total - share) < 2e-3
    expected = sum(v * found[k].probability for k, v in mass.items())
    assert abs(expected / total - 0.5) < 1e-3
    assert all(0 <= r.probability <= 1 for r in found.values())


@pytest.mark.parametrize("absent", [False, True])
def test_both_ways_agree(spark, absent):
    frame, _ = members(spark, random.Random(2))
    cfg = M.MixConfig(rounds=3, tolerance=0)
    wanted = targets(spark)
    if absent:  # a target for a topic that no document has, and a source without a target
        wanted["topic"] = spark.createDataFrame([(0, 0.5), (1, 0.2), (2, 0.1), (9, 0.2)], "value int, share double")
        wanted["source"] = spark.createDataFrame([("a", 0.5), ("b", 0.5), (None, 0.1)], "value string, share double")
    here = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in M.calibrated(frame, wanted, cfg).collect()}
    apart = {(r.source, r.lang, r.topic): (r.weight, r.probability) for r in M.calibrated(frame, wanted, replace(cfg, driver_cells=0)).collect()}
    assert not absent or all(w == 0 for (source, _, _), (w, _) in here.items() if source == "c")
    assert here.keys() == apart.keys()
    assert all(np.allclose(here[k], apart[k], atol=1e-6) for k in here)


def test_sampling_follows_probabilities_and_keeps_rows_whole(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["sun", "moon", "star", "le", "la", "un"]) for _ in range(30)), rng.choice(["x", "y"]), rng.choice(["en", None]), i) for i in range(600)]
    rows += [(900, None, "x", "en", 1), (901, "", "x", "en", 1), (902, "...", None, "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic long")
    found = {r.doc_id: r for r in M.weighted(docs).collect()}
    assert len(found) == len(rows)
    assert all(found[i].probability == 0 and not found[i].sampled for i in (900, 901, 902))
    expected = sum(r.probability for r in found.values())
    assert abs(sum(r.sampled for r in found.values()) - expected) < 4 * expected**0.5
    kept = M.sample(docs).collect()
    assert {r.doc_id for r in kept} == {i for i, r in found.items() if r.sampled}
    assert all(r.text == rows[r.doc_id][1] for r in kept)


def test_topics_are_learnt_from_all_documents(spark):
    rng = random.Random(4)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    short, long = [f"sun{i}" for i in range(20)], [f"moon{i}" for i in range(20)]
    rows = [(i, text(short, 40)) for i in range(60)] + [(100 + i, text(long, 12000)) for i in range(3)]
    docs = spark.createDataFrame([(i, t, "x", "en") for i, t in rows], "doc_id long, text string, source string, lang string")
    cfg = M.MixConfig(topics=2)
    centres = M.learn_topics(docs, cfg)
    topics = {r.doc_id: r.topic for r in M.with_topics(docs, centres).collect()}
    assert {topics[i] for i in range(60)} == {0} and {topics[100 + i] for i in range(3)} == {1}
    assert np.array_equal(centres, M.learn_topics(docs.repartition(7, "text"), cfg))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string, lang string")
    assert M.weighted(docs).count() == 0 and M.sample(docs).count() == 0


def plain_weights(rows, targets, rounds):
    """Raking over the documents themselves: (source, lang, topic, tokens) rows, one weight a document."""
    weights = [1.0] * len(rows)
    total = sum(r[3] for r in rows)
    for _ in range(rounds):
        for at, goal in enumerate(targets):
            there = {r[at] for r in rows if r[3]}
            scale = sum(share for value, share in goal.items() if value in there)
            now = {v: sum(w * r[3] for w, r in zip(weights, rows) if r[at] == v) for v in there}
            weights = [w * goal.get(r[at], 0) / scale * total / now[r[at]] if r[3] and now[r[at]] else 0.0 for w, r in zip(weights, rows)]
    return weights


def plain_probabilities(weights, rows, budget):
    goal = budget * sum(r[3] for w, r in zip(weights, rows) if w)
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1.0, w * mid) * r[3] for w, r in zip(weights, rows)) < goal else (low, mid)
    return [min(1.0, w * low) for w in weights]


def test_query_against_raking_over_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    cfg = M.MixConfig()
    found = sorted(M.weighted(docs).collect(), key=lambda r: r.doc_id)
    rows = [(r.source, r.lang, r.topic, r.n_tokens) for r in found]
    goals = []
    for at in range(3):
        mass = {}
        for r in rows:
            if r[3]:
                mass[r[at]] = mass.get(r[at], 0) + r[3]
        flat = {v: m**cfg.flatten for v, m in mass.items()}
        goals.append({v: f / sum(flat.values()) for v, f in flat.items()})
    weights = plain_weights(rows, goals, 60)
    chances = plain_probabilities(weights, rows, cfg.budget)
    assert np.allclose([r.weight for r in found], weights, atol=1e-4, rtol=1e-4)
    assert np.allclose([r.probability for r in found], chances, atol=1e-4)
    import re

    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (texts[r.doc_id] or "").lower())) for r in found)


def test_null_ids_clashing_columns_repeated_rows_and_a_long_text(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["sun", "moon", "star"]) for _ in range(n))
    rows = [(i if i % 2 else None, text(30), "x", "en", "own", -1.0) for i in range(200)]
    rows += [(900, text(200_000), "y", "en", "own", -1.0)] + [(901, "sun moon", "x", None, "own", -1.0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, weight double")
    cfg = M.MixConfig(topics=2, budget=0.6)
    kept, marked = M.sample(docs, cfg=cfg).collect(), M.weighted(docs, cfg=cfg).filter("sampled").collect()
    assert sorted((r.doc_id or -1, r.lang or "") for r in kept) == sorted((r.doc_id or -1, r.lang or "") for r in marked)
    assert sum(r.doc_id is None for r in kept) > 20 and all(r.topic == "own" and r.weight == -1.0 and r._weight > 0 for r in kept)
    assert sum(r.doc_id == 901 for r in kept) in (0, 3)
