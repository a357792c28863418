"""Hand-made cases for chats, tokens, shards, evaluation, vectors and generation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import cleaning, dialog, rng, style
from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import bpe, dedup, evaluation, retrieval, shards, synth, tokenizer, tokens
from corpusmill.sources import ingest as I

MERGES = [(16 + ord("t"), 16 + ord("h")), (272, 16 + ord("e")), (16 + ord(" "), 273), (16 + ord("a"), 16 + ord("n"))]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_cleaning_names_the_first_reason(spark):
    rows = [(0, b""), (1, None), (2, b"a" * 100_001), (3, b"ok \xff\xfe"), (4, b"mail me@example.com now"), (5, b"<p> </p>"), (6, b"<b>x</b>"), (7, b"<b>Good&amp;fine</b>  text"), (8, "cafÃ© au lait".encode()), (9, "café".encode())]
    found = {r.doc_id: (r.clean_verdict, r.cleaned) for r in cleaning.with_cleaned(spark.createDataFrame(rows, "doc_id long, text binary")).collect()}
    assert [found[i][0] for i in range(7)] == ["empty", "empty", "long", "encoding", "pii", "empty", "short"]
    assert found[7] == ("ok", "good&fine text") and found[8][1] == "café au lait" and found[9][1] == "café"
    kept = cleaning.with_cleaned(spark.createDataFrame(rows[4:5], "doc_id long, text binary"), cleaning.CleanRules(pii="redact")).first()
    assert kept.cleaned == "mail [email] now"
    stats = cleaning.clean_stats(cleaning.with_cleaned(spark.createDataFrame(rows, "doc_id long, text binary"))).first()
    assert (stats.lines_in, stats.lines_out, stats.dropped_empty, stats.dropped_pii) == (10, 3, 3, 1)


def test_human_numbers_and_json(spark):
    assert [one(spark, T.human_count(F.lit(n))) for n in (7, 1234, 5_600_000)] == ["7", "1.23K", "5.60M"]
    assert [one(spark, T.human_bytes(F.lit(n))) for n in (7, 2048, 3 << 30)] == ["7 B", "2.00 KiB", "3.00 GiB"]
    assert [one(spark, T.human_duration(F.lit(s))) for s in (0.25, 12.5, 187, 7500, 97200)] == ["250ms", "12.5s", "3m07s", "2h05m", "1d03h"]
    for text in ('a"b\\c\nd\te\x01é', "", "/"):
        assert one(spark, T.json_unescaped(T.json_escaped(F.lit(text)))) == text
    assert one(spark, T.json_escaped(F.lit('a"\n'))) == 'a\\"\\n'


def test_style(spark):
    rows = [(1, "hi", "As an AI, I can't."), (2, "hi", "List:\n- a\n* b\n1. c\n 2) d"), (3, "hi", "word " * 81), (4, "hi", "Because it rains, we stay; however, first we eat.")]
    found = {r.i: r for r in style.with_style(spark.createDataFrame(rows, "i int, prev_text string, text string")).collect()}
    assert found[1].boilerplate and found[1].robotic and found[2].bullets == 4 and found[2].robotic and found[3].too_long and not found[3].robotic and not found[4].robotic
    words = spark.createDataFrame(rows[3:], "i int, p string, text string").select(*[c.alias(k) for k, c in style.connectors(F.col("text")).items()]).first()
    assert tuple(words) == (1, 1, 1)
    assert [one(spark, style.reply_script(F.lit(t))) for t in ("hello", "سلام", "123", "salam سلام a")] == ["latin", "arabic", "arabic", "latin"]
    assert one(spark, style.hard_boilerplate(F.lit("En tant qu'assistant, je"))) and not one(spark, style.hard_boilerplate(F.lit("Certainly!")))


def test_rendering_and_trimming(spark):
    turns = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate([("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "e")])], "conv_id long, turn long, role string, text string")
    assert dialog.rendered(turns, True).first().rendered == "<s><|system|>s<|end|><|user|>a<|end|><|assistant|>b<|end|><|user|>c<|end|><|assistant|>d<|end|><|user|>e<|end|><|assistant|>"
    assert sorted(r.text for r in dialog.trimmed(turns, 1).collect()) == ["c", "d", "e", "s"]
    assert dialog.trimmed(turns, 3).count() == 6


def test_chunks():
    got = tokenizer.pre_tokenized("Hello  it's 3la 2x 12,5. ok!!?\n\nسلام 😀‍😀")
    assert got == [("Hello", "latin"), ("  ", "space"), ("it's", "latin"), (" 3la", "latin"), (" 2x", "latin"), (" 12,5", "number"), (".", "punct"), (" ok", "latin"), ("!!", "punct"), ("?", "punct"), ("\n\n", "space"), ("سلام", "arabic"), (" 😀‍😀", "emoji")]
    rnd = random.Random(1)
    for _ in range(300):
        text = "".join(rnd.choice("ab3 7'’.,é \n\t!؟سّ😀漢‍") for _ in range(rnd.randrange(20)))
        chunks = tokenizer.pre_tokenized(text)
        assert "".join(c for c, _ in chunks).replace("\t", " ") == text.replace("\t", " ")


def test_tokenizer(spark, tmp_path):
    k = tokenizer.Tokenizer(MERGES)
    assert k.encode("the") == [273] and k.encode("x the") == [16 + ord("x"), 274] and k.decode(k.encode("the <s> é")).decode() == "the <s> é"
    assert 1 not in k.encode("<s>")
    ids = one(spark, tokenizer.encoded_with_specials(F.lit("<s><|user|>The<|end|>"), MERGES))
    assert ids == [1, 5, 273, 7]
    assert one(spark, tokenizer.encoded(F.lit("The"), MERGES, True, True)) == [1, 273, 2] and one(spark, tokenizer.decoded(F.array(*map(F.lit, [1, 273, 2])), MERGES)) == "the"
    steps = one(spark, tokenizer.decoded_steps(F.array(*[F.lit(16 + b) for b in "é😀".encode()[:-1]]), MERGES))
    assert steps == ["", "é", "", "", "", "�"]
    chat = spark.range(1).select(tokenizer.encoded_chat(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("content")) for r, t in (("system", "the"), ("user", "the"), ("assistant", "the"), ("user", ""))]), MERGES).alias("x")).first().x
    assert chat.ids == [1, 4, 273, 7, 5, 273, 7, 6, 273, 7, 5, 7] and chat["mask"] == [0, 0, 0, 0, 0, 0, 0, 0, 1, 1, 0, 0]
    tokenizer.write_vocabulary(spark, MERGES, str(tmp_path / "v"))
    assert tokenizer.read_vocabulary(spark, str(tmp_path / "v"), 276) == MERGES
    with pytest.raises(ValueError):
        tokenizer.read_vocabulary(spark, str(tmp_path / "v"), 999)


def test_both_ways_of_training_agree(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randrange(1, 9))) for _ in range(200)]
    counts = spark.createDataFrame([(w, rnd.randrange(1, 20)) for w in set(words)], "word string, n long")
    here = bpe.train(counts, 25)
    assert here == bpe.train(counts, 25, driver_words=0) and len(here) == 25


def test_stream_decoding_keeps_bytes_between_batches(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    raw = "é😀".encode()
    put = lambda rows, mode: spark.createDataFrame(rows, "key long, seq long, token int, last boolean").coalesce(1).write.mode(mode).parquet(src)

    def run():
        stream = spark.readStream.schema("key long, seq long, token int, last boolean").parquet(src)
        tokenizer.decode_stream(stream, MERGES).writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()

    put([(1, i, 16 + b, False) for i, b in enumerate(raw[:4])], "overwrite")
    run()
    put([(1, 4 + i, 16 + b, i == 1) for i, b in enumerate(raw[4:])], "append")
    run()
    assert sorted(r.text for r in spark.read.parquet(out).collect()) == sorted(["é", "😀"])


def test_shards(spark, tmp_path):
    rows = [("train", "web", 0, i, [i % 50] * (20 + i), None) for i in range(10)] + [("train", "web2", 0, 0, [1] * 40, [0, 1] * 20), ("val", "web", 0, 0, [2] * 30, None)]
    frame = spark.createDataFrame(rows, "split string, domain string, shard int, seq int, tokens array<int>, mask array<int>")
    shards.write(frame, str(tmp_path / "s"), 50)
    for bad in (frame.limit(1).withColumn("tokens", F.array(F.lit(50))), frame.limit(1).withColumn("mask", F.array(F.lit(2)))):
        with pytest.raises(Exception, match="a (token|mask) is not"):
            shards.write(bad, str(tmp_path / f"b{random.random()}"), 50)
    assert shards.read(spark, str(tmp_path / "s"), "train", ["web"]).count() == 10 and shards.listed(spark, str(tmp_path / "s")) == sorted(shards.listed(spark, str(tmp_path / "s")))
    stock = shards.inventory(shards.read(spark, str(tmp_path / "s"), "train"))
    whole = shards.mix(stock, {"web": 3.0, "web2": 1.0, "none": 5.0}, 400, 16, seed=7).collect()
    late = shards.mix(stock, {"web": 3.0, "web2": 1.0, "none": 5.0}, 100, 16, seed=7, skip=300).collect()
    assert sorted(map(tuple, late)) == sorted(tuple(r) for r in whole if r.row >= 300)
    assert len(whole) == 400 and 0.65 < sum(r.domain == "web" for r in whole) / 400 < 0.85
    ids, targets = shards.supervised(F.array(*map(F.lit, [5, 6, 7, 8])), F.array(*map(F.lit, [0, 0, 1, 1])), 0, 4)
    r = spark.range(1).select(ids.alias("i"), targets.alias("t")).first()
    assert r.i == [5, 6, 7, 8] and r.t == [-100, 7, 8, -100]


def test_sharding_keeps_every_split(spark):
    rows = spark.createDataFrame([(1, "train", 5), (2, None, 5), (3, "test", 7), (4, "test", 7)], "doc_id long, split string, n long")
    assert sorted((r.doc_id, r.shard) for r in tokens.sharded(rows, "doc_id", "n", 6).collect()) == [(1, 0), (2, 0), (3, 0), (4, 1)]
    far = spark.createDataFrame([(i * 10_000_019, i) for i in range(200)], "k long, n long")
    got = {r.k: r.start for r in tokens.with_offsets(far, "k", "n", 16).collect()}
    assert got == {i * 10_000_019: i * (i - 1) // 2 for i in range(200)}


def test_evaluation(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('# note\n{"id":"a","category":"x","prompt":"Hi","expect_lang":"en","max_words":3,"expect_any":["HELLO"],"forbid":["bad"]}\n{"id":"b","category":"x","prompt":"Hi"}\n')
    suite = evaluation.load_suite(spark, str(tmp_path / "s.jsonl"))
    assert suite.count() == 2 and evaluation.load_suite(spark).count() == 4
    answered = suite.join(spark.createDataFrame([("a", "hello to the very bad world you have"), ("b", "anything")], "id string, reply string"), "id")
    results = evaluation.evaluated(answered)
    found = {r.id: r for r in results.collect()}
    assert found["a"].matched and found["a"].forbidden_hit and not found["a"].length_ok and found["a"].lang_ok and found["b"].score == 1.0 and abs(found["a"].score - 0.75) < 1e-9
    rate = evaluation.rates(results, None).first()
    assert (rate.n_lang_gated, rate.lang_rate, rate.n_discipline_gated) == (1, 1.0, 1)
    evaluation.write_results(results.select("id", "category", "prompt", "reply", "score"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/results")).count() == 2
    counters = spark.createDataFrame([(10, 4, 6)], "seen long, kept long, duplicates long")
    with pytest.warns(UserWarning):
        assert "kept: 4" in evaluation.report(counters)
    with pytest.raises(ValueError), pytest.warns(UserWarning):
        evaluation.report(counters, min_keep=0.5)


def test_token_statistics_and_caps(spark):
    rows = spark.createDataFrame([([16, 17, 300], 2, 9), ([16, 301], 1, 5)], "tokens array<int>, words long, bytes long")
    s = evaluation.token_stats(rows).first()
    assert (s.tokens, s.vocab_used, s.byte_rate) == (5, 4, 0.5) and abs(s.tokens_per_word - 5 / 3) < 1e-9
    study = spark.createDataFrame([(8, 2.0), (16, 1.52), (32, 1.5)], "vocab int, fertility double")
    assert evaluation.chosen_vocabulary(study).first().vocab == 16
    capped = evaluation.share_capped(spark.createDataFrame([("g", i, "a" if i % 2 else f"h{i}") for i in range(100)], "g string, i long, head string"), "g", "i", "head", 0.2, 10)
    assert 50 < capped.count() < 70


def test_vectors(spark):
    x = [0.3, -1.5, 2.25, 0.1]
    col = F.array(*map(F.lit, x))
    r = one(spark, V.router(col, 2))
    e = np.exp(np.array(x) - max(x))
    assert [p.expert for p in r] == [2, 0] and abs(sum(p.weight for p in r) - 1) < 1e-9 and abs(r[0].weight - e[2] / (e[2] + e[0])) < 1e-9
    assert one(spark, V.linear(col, [[1, 0, 0, 0], [1, 1, 1, 1]], [0.0, 1.0])) == pytest.approx([0.3, 2.15])
    values = [0.1, 65504.0, 1e-7, 6e-8, 2.0**-14, 1.0, 1.0009765625 + 2**-11, -3.14159, 0.0, 1024.5]
    assert [one(spark, V.half(F.lit(v))) for v in values] == [float(np.float16(v)) for v in values]
    assert one(spark, V.brain_half(F.lit(0.1))) == 0.10009765625
    for with_min in (False, True):
        block = V.quantized4(col, with_min)
        back = one(spark, V.dequantized4(block))
        assert max(abs(a - b) for a, b in zip(x, back)) <= 0.3
    turned = one(spark, V.rope(col, F.lit(3.0)))
    want = []
    for i in range(2):
        a = 3.0 * 10_000 ** (-2 * i / 4)
        want += [x[2 * i] * np.cos(a) - x[2 * i + 1] * np.sin(a), x[2 * i] * np.sin(a) + x[2 * i + 1] * np.cos(a)]
    assert turned == pytest.approx(want)
    assert one(spark, V.sampled(col, F.lit(0.99), 0.0)) == 2 and one(spark, V.sampled(col, F.lit(0.0), 1.0)) == 2 and one(spark, V.sampled(col, F.lit(0.9999), 1.0, top_p=0.5)) == 2
    p = e / e.sum()
    counts = spark.range(4000).select(F.rand(1).alias("u")).select(V.sampled(col, F.col("u"), 1.0).alias("i")).groupBy("i").count().collect()
    assert all(abs(r["count"] / 4000 - p[r.i]) < 0.04 for r in counts)
    load = V.expert_load(spark.range(10).select(V.router(col, 2).alias("picked")), 4).collect()
    assert {r.expert: r.slots for r in load} == {0: 10, 1: 0, 2: 10, 3: 0} and abs(load[0].balance - 2.0) < 1e-9
    got = V.gathered(spark.createDataFrame([(1, [5, 9])], "row long, ids array<int>"), spark.createDataFrame([(5, [1.0])], "id int, vector array<double>")).collect()
    assert sorted((r.place, r.vector) for r in got) == [(0, [1.0]), (1, None)]


def test_generator_and_synthesis(spark):
    r = rng.Rng(42)
    first = [r.bits() for _ in range(3)]
    assert first == [1546998764402558742, 6990951692964543102, 12544586762248559009]
    draws = [r.normal() for _ in range(4000)]
    assert abs(np.mean(draws)) < 0.06 and abs(np.std(draws) - 1) < 0.05 and 0 <= r.uniform() < 1 and r.below(7) < 7
    assert synth.transliterated("شكرا بزاف", rng.Rng(1), 0.0) == "choukran bzzaf" and synth.transliterated("السوق", rng.Rng(1), 0.0) == "lsw9"
    made = synth.generate_darija(spark, 200, 5)
    again = {r.conv_id: r.messages for r in synth.generate_darija(spark, 200, 5).repartition(3).collect()}
    assert {r.conv_id: r.messages for r in made.collect()} == again
    assert {r.script for r in evaluation.synth_stats(made).collect()} == {"latin", "arabic"}


def test_membership_and_grounded_replies(spark):
    rnd = random.Random(4)
    base = [f"w{rnd.randrange(500)}" for _ in range(100)]
    near = list(base)
    near[50] = "other"
    kept = spark.createDataFrame([(1, " ".join(base))], "doc_id long, text string")
    asked = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(base).upper()), (3, "something new here"), (4, "")], "id long, text string")
    assert {r.id: r.duplicate for r in dedup.is_duplicate(asked, kept).collect()} == {1: True, 2: True, 3: False, 4: True}
    qa = spark.createDataFrame([(1, "how do I bake bread", "With flour."), (2, "where is the station", "Down the road.")], "id long, question string, answer string")
    index = retrieval.build(qa.select("id", "question"))
    ask = spark.createDataFrame([(7, "How do I bake bread?"), (8, "zzz qqq")], "qid long, text string")
    assert {r.qid: (r.mode, r.text) for r in retrieval.grounded(index, qa, ask).collect()} == {7: ("direct", "With flour."), 8: ("generate", None)}
    assert {r.text for r in retrieval.grounded(index, qa, ask, direct=False).collect()} == {"Context (from dataset): With flour.", None}


def test_reading_keeps_rows(spark, tmp_path):
    lines = ['{"id": 5, "question": "a", "answer": "b"}', '{"id": "x", "question": "c", "answer": "d"} {"question": "e", "answer": "f"}', '{"question": "", "answer": "g"}', "junk"]
    (tmp_path / "q.jsonl").write_text("\n".join(lines))
    (tmp_path / "r.json").write_text('[{"question": "h", "answer": "i"},\n {"id": 9, "question": "j", "answer": "k"}]')
    found = {r.question: r.id for r in I.qa_json(spark, str(tmp_path)).collect()}
    assert set(found) == {"a", "c", "e", "h", "j"} and found["a"] == 5 and found["j"] == 9 and found["c"] >= 0
    spark.createDataFrame([("é" * 600_000,), ("ok",)], "x string").write.parquet(str(tmp_path / "p"))
    sizes = sorted(len(r.x) for r in I.parquet(spark, str(tmp_path / "p"), value_bytes=(1 << 20) + 1).collect())
    assert sizes == [2, 1 << 19]
    p = tmp_path / "v.csv"
    p.write_text("darija,darija_ar\nzz,1\naa,22\nzz,33\nmm,44\n")
    pairs = I.csv_pairs(spark, str(p), min_bytes=1)
    assert [(r.id, r.question, r.answer) for r in pairs.orderBy("id").collect()] == [(1_000_000, "zz", "1"), (1_000_001, "aa", "22"), (1_000_002, "mm", "44")]
