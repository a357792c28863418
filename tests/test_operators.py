import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import bpe, dedup, retrieval, tokens


def fnv(b):
    h = H.FNV_START
    for x in b:
        h = ((h ^ x) * H.FNV_PRIME) % 2**64
    return h


def test_hashes():
    rng = random.Random(0)
    values = [rng.randbytes(rng.randrange(60)) for _ in range(50)] + [b"", b"a"]
    assert H.fnv1a(values).tolist() == [fnv(v) for v in values]
    assert int(H.splitmix64(np.array([0], np.uint64))[0]) == 0xE220A8397B1DCDAF


def greedy(rows, threshold=0.85, block=()):
    canon = lambda t: " ".join((t or "").lower().split())
    sign = lambda c: H.minhash(c.split())
    listed = [canon(b) for b in block]
    kept = [("blocked", sign(c)) for c in listed if c]
    seen, out = set(), {}
    for i, t in sorted(rows):
        c = canon(t)
        if not c or (c not in listed and c in seen):
            out[i] = "exact_dup"
        elif c in listed:
            out[i] = "blocked"
        else:
            seen.add(c)
            s = sign(c)
            near = next((kind for kind, o in kept if (H.bands(o) == H.bands(s)).any() and (o == s).mean() >= threshold), None)
            out[i] = {"blocked": "blocked", "kept": "near_dup", None: "kept"}[near]
            if near is None:
                kept.append(("kept", s))
    return out


def test_greedy_dedup_matches_a_loop(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(6):
        words = [f"w{rng.randrange(900)}" for _ in range(120)]
        rows.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for at in rng.sample(range(120), rng.choice([0, 1, 2, 4])):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(copy))
    rng.shuffle(rows)
    rows = list(enumerate([*rows, None, "", "  ", rows[0].upper()]))
    block = [rows[3][1], "unrelated words only"]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.verdict for r in dedup.greedy(docs).collect()} == greedy(rows)
    listed = spark.createDataFrame(list(enumerate(block)), "item_id long, text string")
    assert {r.doc_id: r.verdict for r in dedup.greedy(docs, listed).collect()} == greedy(rows, block=block)


def test_greedy_dedup_broadcasts_no_table_of_documents_or_pairs(spark, monkeypatch):
    plans = {}

    def spied(df, name, of=dedup.written):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return of(df, name)

    monkeypatch.setattr(dedup, "written", spied)
    docs = spark.createDataFrame([(i, f"words {i % 3} of text {i % 5}") for i in range(20)], "doc_id long, text string")
    plans["out"] = dedup.greedy(docs, docs.limit(1))._jdf.queryExecution().executedPlan().toString()
    assert {name for name, plan in plans.items() if "SortMergeJoin" in plan} >= {"pairs", "state", "new", "out"}
    assert not [name for name in ("pairs", "state", "new") if "Broadcast" in plans[name]]
    assert plans["out"].count("BroadcastHashJoin") <= 1  # the blocklist's


def test_one_changed_token_is_contamination(spark):
    a = " ".join(f"token{i}" for i in range(100))
    b = a.replace("token50", "other50")
    got = dedup.greedy(spark.createDataFrame([(0, a), (1, b)], "doc_id long, text string"), spark.createDataFrame([(0, a)], "item_id long, text string"))
    assert {r.verdict for r in got.collect()} == {"blocked"}


def test_retrieval(spark):
    qa = spark.createDataFrame([(1, "How do I reset my password?"), (2, "Where is the library?"), (3, "how do i RESET my password"), (4, "best pizza in town"), (5, "")], "id long, question string")
    index = retrieval.build(qa)
    assert {r.id for r in index.docs.collect()} == {1, 2, 4}
    asked = spark.createDataFrame([(0, "How do I reset my password?"), (1, "librery"), (2, "pizzza town"), (3, "zzzzzzzz")], "qid long, text string")
    best = {r.qid: r for r in retrieval.query(index, asked, top=1).collect()}
    assert best[0].id == 1 and best[0].score > 5 and best[1].id == 2 and best[2].id == 4 and 3 not in best


def test_fuzzy_terms_match_all_pairs(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
    known, asked = sorted({word() for _ in range(80)}), sorted({word() for _ in range(60)})
    terms = spark.createDataFrame([(w, 1, float(rng.randrange(5))) for w in known], "term string, df long, idf double")
    idf = {r.term: r.idf for r in terms.collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for a in asked:
        near = [(-idf[b], b) for b in known if distance(a.encode(), b.encode()) <= (1 if len(a.encode()) <= 4 else 2)]
        if near:
            want[a] = min(near)[1]
    got = retrieval.fuzzy_terms(spark.createDataFrame([(a,) for a in asked], "term string"), terms)
    assert {r.term: r.best for r in got.collect()} == want


def test_bpe_round_trip(spark):
    texts = ["low lower lowest", "new newer newest", "émile été", "wide wider widest"] * 5
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    merges = bpe.train(bpe.word_counts(df), 30)
    coder = bpe.Encoder(merges)
    assert 10 < len(merges) <= 30 and len(coder.word("lowest")) < 6
    for t in texts:
        assert "".join(coder.decode(coder.word(w)) for w in t.split()) == t.replace(" ", "")
    ids = df.select(bpe.encoded(T.words(F.col("text")), merges).alias("ids")).collect()
    assert [r.ids for r in ids] == [[i for w in t.split() for i in coder.word(w)] for t in texts]


def test_packing_has_no_padding_and_keeps_documents_apart(spark):
    rows = [(0, ["1", "2", "3"]), (1, ["4", "5"]), (2, []), (3, ["6", "7", "8", "9"])]
    df = spark.createDataFrame(rows, "doc_id long, w array<string>").withColumn("n", F.size("w").cast("long"))
    packed = tokens.next_token_rows(tokens.with_offsets(df, "doc_id", "n", block=2), "w", "doc_id", 6)
    got = {r.row: r for r in tokens.batches(packed).collect()}
    assert got[0].ids == ["1", "2", "3", "4", "5", "6"] and got[0].targets == ["2", "3", None, "5", None, None] and got[0].segment_ids == [0, 0, 0, 1, 1, 2]
    assert got[1].ids == ["7", "8", "9"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, -4.0, 0.0], [1.0, 1.0, 2.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(V.dot(a, b), V.norm(a), V.argmax(b), V.nucleus(V.softmax(a), 0.9), V.quantized(a), V.cross_entropy(a, F.lit(0)), V.cross_entropy(a, F.lit(-100)), V.blocks(a, 2)).first()
    assert r[0] == -1 and r[1] == 5 and r[2] == 2 and r[3] == [0] and r[4].q == [95, -127, 0] and abs(r[5] - 0.0495) < 1e-3 and r[6] is None and r[7] == [[3.0, -4.0], [0.0]]
    bad = spark.createDataFrame([([1.0, float("nan")],)], "a array<double>").select(V.quantized(F.col("a"))).first()[0]
    assert bad.scale == 0 and bad.q == [0, 0]
