"""The pipeline's decisions, stage by stage, and over planted cases."""

import random

import corpus_pipeline


def planted(spark, folder):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(20000)}"
    text = lambda n: [word() for _ in range(n)]
    rows, labels, roles = [], [], {}
    items = [text(25) for _ in range(5)]
    passage = text(80)
    for i in range(160):
        body, kind = text(rng.randrange(60, 120)), "clean"
        if i % 8 == 0:
            body[5:5] = "you idiot moron stupid scum trash loser".split()
            kind = "toxic"
        elif i % 20 == 3:
            body[20:20] = rng.choice(items)
            kind = "leak"
        elif i % 20 == 7:
            body += passage
            kind = "passage"
        rows.append((i, " ".join(body)))
        roles[i] = kind
        if i < 120:
            labels.append((i, int(kind == "toxic")))
    clean = [i for i in roles if roles[i] == "clean"]
    for k, i in enumerate(clean[:12]):
        copy = rows[i][1].split()
        if k % 2:
            copy[3] = "changed"
        rows.append((200 + k, " ".join(copy)))
        roles[200 + k] = "copy"
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return dict(rows), roles, " ".join(passage)


def test_planted_cases(spark, tmp_path):
    folder = str(tmp_path)
    texts, roles, passage = planted(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, alive = docs.columns, set(texts)
    gone = {"toxicity": "toxic", "near duplicates": "copy", "passages": None, "decontamination": "leak"}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns
        alive -= {i for i in texts if roles[i] == gone[name]}
        assert {r.doc_id for r in docs.collect()} == alive
    holders = [r.doc_id for r in docs.collect() if passage in r.text]
    assert holders == [min(i for i in roles if roles[i] == "passage")]
    assert all(r.text == texts[r.doc_id] for r in docs.collect() if roles[r.doc_id] == "clean")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in last} <= alive and 0.3 * len(alive) < len(last) < 0.75 * len(alive)
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} == {r.doc_id for r in last}


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, topic string, score string"


def tables(spark, folder, docs, labels):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, "a test item of some words that nobody else would say"), (1, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_pass_through_all_stages(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    rows = [(i, text(60), "en", "s", 1, "own", "x") for i in range(40)]
    rows += [(None, text(60), "en", "s", 1, "own", "x"), (None, None, None, None, None, None, None), (100, "", "en", None, 0, "own", "x"), (101, text(40_000), None, "s", 1, "own", "x")]
    rows += [(102, rows[0][1], "en", "s", 1, "own", "x"), (3, "another text under a known id", "en", "s", 1, "own", "x"), rows[5]]
    folder = str(tmp_path)
    tables(spark, folder, rows, [(i, 0) for i in range(20)] + [(None, 1)])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns and docs.count() <= seen
        seen = docs.count()
    kept = docs.collect()
    # the copy and the repeated row go, rows without an id and both texts of one id stay
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted([*range(40), 3, 100, 101]) and sum(r.doc_id is None for r in kept) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert 0 < len(last) < len(kept) and all(r.topic == "own" and r._topic is not None for r in last if r.doc_id is not None)


def test_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
