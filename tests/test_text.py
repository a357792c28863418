"""Hand-made goldens for branches that the tables don't reach."""

import random

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import dialog as D
from corpusmill.functions import langid as L
from corpusmill.functions import pii as P
from corpusmill.functions import quality as Q
from corpusmill.functions import text as T


def one(spark, expression, *values):
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in rows.select(expression(F.col("t"))).collect()]


def test_normalising(spark):
    got = one(
        spark, lambda t: T.normalized(T.text(t)),
        None, "", "  A\x0bB\t\r c \n\n d  ", "ÀÉ×ß", "ﺍﻟﻻ", "كـــتَاب", "٣۴", "ＡＢ！　x", "a​b‍c", "می‌خ", "a‌b", "x\x00y\x85z",
    )
    assert got == ["", "", "ab c\nd", "àé×ß", "اللا", "كتاب", "34", "ab! x", "abc", "می‌خ", "ab", "xyz"]


def test_canonical(spark):
    assert one(spark, lambda t: T.canonical(t), "AAAAAb", "haaaa!!!!!", "أحمد ة ى", "a    b") == ["aaab", "haaa!!!", "احمد ه ي", "a b"]


def test_script_stats_add_up(spark):
    rng = random.Random(0)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x250), rng.randrange(0x600, 0x700), rng.randrange(0x2000, 0x2800), rng.randrange(0x1F300, 0x1F700)])) for _ in range(200)) for _ in range(20)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(*[c.alias(k) for k, c in T.script_stats(F.col("t")).items()]).collect()
    assert all(r.total == 200 == r.whitespace + r.arabic + r.latin + r.digits + r.emoji + r.punct + r.other and r.other >= 0 for r in rows)


def test_html(spark):
    assert one(spark, T.html_stripped, "<p>a &amp;lt; b</p><!-- x --> 1 < 2 &nbsp;c<br", "x<y>z") == ["a < b 1 < 2  c", "xz"]


@pytest.mark.parametrize(
    ("text", "verdict"),
    [
        (None, "empty"), ("As an AI language model I think", "ai_disclaimer"), ("please [insert name] here", "unresolved_placeholder"), ("1234 5678", "no letters"),
        ("a 1 2 3 4 5 6 7 8 9", "low letter ratio"), ("abcd!!!!cd", "symbol spam"), ("abcdefgh 12345", "digit spam"), ("HELLO WORLD THIS IS SHOUTING TEXT", "shouting"),
        ("word", "too few words"), ("x " + "y" * 61, "absurd word length"), ("a a a b c d e f", "word repetition"), ("one two\n" * 5 + "three four", "duplicated lines"), ("a fine text of words", "accept"),
    ],
)
def test_quality_verdicts(spark, text, verdict):
    rules = Q.QualityRules(max_word_repeat=0.5) if verdict == "duplicated lines" else Q.QualityRules()
    assert Q.with_verdict(spark.createDataFrame([(text,)], "text string"), rules).first()["verdict"] == verdict


def test_toxic_terms_need_boundaries(spark):
    found = one(spark, lambda t: F.transform(Q.toxic_terms(t), lambda x: x["term"]), "drapes and reputed", "RAPE!", "une pute, kill yourself")
    assert found == [[], ["rape"], ["kill yourself", "pute"]]


def test_personal_data():
    text = "mail a.b+c@x-y.co.uk. call +212 612-345-678 or 0612345678, card 4111 1111 1111 1111, ip 10.0.0.255, id AB123456, key sk-abcdefgh1, http://u:p@h/x, DE89370400440532013000 end"
    assert {s[2] for s in P.spans(text)} == set(P.TAGS)
    out = P.redacted(text)
    assert out.startswith("mail [EMAIL]. call [PHONE] or [PHONE], card [") and "[KEY]" in out and "u:p@h" not in out and "10.0.0.255" not in out
    assert P.redacted("nothing 1.2.3.4.5 a@b 300.1.1.1 x 12345") == "nothing 1.2.3.4.5 a@b 300.1.1.1 x 12345"


def test_detectors_agree(spark):
    texts = ["a@b.co c@d.e@f.gh x@y", "http://a:b@c ftp://u@h http://h/p@q", "sk-12345678 token=abcdefghi sk-1", "A12345 AB12345678 ABC12345 xA12345", "1.2.3.4 1.2.3.4.5 256.1.1.1 01.2.3.4a 9.9.9.9."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    for row in df.select("t", P.emails(t).alias("email"), P.urls(t).alias("url"), P.keys(t).alias("key"), P.ids(t).alias("id"), P.ips(t).alias("ip")).collect():
        tags = [s[2] for s in P.spans(row.t)]
        assert {k: row[k] for k in ("email", "url", "key", "id", "ip")} == {k: tags.count(k.upper()) for k in ("email", "url", "key", "id", "ip")}, row.t


def test_languages(spark):
    rows = [("the cat and the dog are here with you", "en"), ("le chat est dans la maison avec nous", "fr"), ("chno kayn bzaf daba 3lach", "ar-MA-latn"), ("شنو كاين بزاف دابا", "ar-MA-arab"), ("هذا من في على الذي", "ar-MSA"), ("zz qq ww", "other"), ("", "other")]
    found = L.with_language(spark.createDataFrame([(t,) for t, _ in rows], "text string")).collect()
    assert [r.lang_tag for r in found] == [tag for _, tag in rows]


def test_dialogue_acts(spark):
    asked = {"": "unknown", "Hi there": "greeting", "What is your return policy?": "question", "What does return do in python?": "coding", "Write a poem": "instruction", "Let us go step by step": "reasoning", "nice day": "chitchat", "history is long": "chitchat"}
    assert one(spark, D.dialog_act, *asked) == list(asked.values())


def test_reply_reasons(spark):
    rows = [("hi", "", "empty"), ("hi", "As an AI, no", "ai-disclosure"), ("Pick: a) x b) y", "maybe x", "bad-mc-format"), ("Pick: a) x b) y", "b) y", "ok"), ("write python code", "no idea", "no-code"), ("write python code", "def f(): pass", "ok")]
    df = spark.createDataFrame(rows, "p string, r string, want string")
    assert all(r[0] == r[1] for r in df.select(D.reply_reason(F.col("p"), F.col("r")), "want").collect())
