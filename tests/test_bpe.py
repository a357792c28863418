"""Byte-pair merges over blocks of words against a plain loop."""

import random

from pyspark.sql import functions as F

from corpusmill.operators import bpe


def plain(counts, merges, min_freq=2, max_bytes=32):
    words = {w: [bpe.FIRST_BYTE + b for b in w.encode()] for w, n in counts.items() if n >= min_freq}
    size = {bpe.FIRST_BYTE + b: 1 for b in range(256)}
    out = []
    while len(out) < merges:
        seen = {}
        for w, ids in words.items():
            for p in zip(ids, ids[1:]):
                seen[p] = seen.get(p, 0) + counts[w]
        allowed = [(n, -p[0], -p[1]) for p, n in seen.items() if n >= min_freq and size[p[0]] + size[p[1]] <= max_bytes]
        if not allowed:
            break
        _, a, b = max(allowed)
        a, b, new = -a, -b, bpe.FIRST_BYTE + 256 + len(out)
        size[new] = size[a] + size[b]
        out.append((a, b))
        for w, ids in words.items():
            i, to = 0, []
            while i < len(ids):
                hit = ids[i : i + 2] == [a, b]
                to.append(new if hit else ids[i])
                i += 2 if hit else 1
            words[w] = to
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice("aab cé").strip() for _ in range(rng.randrange(1, 14))) for _ in range(500)} | {"a" * n for n in (1, 2, 3, 7, 40)} | {"abab" * 9}
    return {w: rng.randrange(1, 9) for w in words if w}


def test_both_ways_give_the_merges_of_a_plain_loop(spark):
    for seed, longest in ((1, 32), (2, 5)):
        counts = corpus(seed)
        table = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)
        want = plain(counts, 60, max_bytes=longest)
        assert bpe.train(table, 60, max_bytes=longest) == want and bpe.train(table, 60, max_bytes=longest, driver_words=0) == want
        # guesses from a few words are often wrong
        assert bpe._train_apart(table.filter("n >= 2"), 60, 2, longest, ahead=5, every=7, guess_words=20) == want


def test_a_table_of_words_takes_few_jobs(spark):
    counts = corpus(3)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    spark.sparkContext.setJobGroup("apart", "apart")
    merges = bpe.train(table, 60, driver_words=0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("apart"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(merges) == 60 and jobs < 60


def test_sizes_are_those_of_the_encoder(spark):
    counts = corpus(4)
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    merges = bpe.train(table, 50)
    coder = bpe.Encoder(merges)
    rows = bpe.sizes(table.unionByName(table.limit(1).withColumn("word", F.lit(None).cast("string"))), merges).collect()
    assert {r.word: r.ids for r in rows} == {None: 0} | {w: len(coder.word(w)) for w in counts} and len(rows) == len(counts) + 1
