"""Rule-based evaluation: suites, items, gated rates, reports and gates. (EVL1-3, AGG13-15, SRC20, SNK3, SNK6, AGG4, AGG17, AGG22)"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import dialog as D
from corpusmill.functions import langid as L
from corpusmill.functions import quality as Q
from corpusmill.functions import text as T

SUITE = "id string, category string, prompt string, expect_lang string, max_words int, expect_any array<string>, forbid array<string>, note string, context array<struct<role:string,content:string>>"

#: A small suite of the library's own.
BUILT_IN = (
    ("greet", "greeting", "Hello, how are you?", "en", 40, ["hello", "hi", "fine", "well"], ["as an ai"]),
    ("sum", "reasoning", "How many are two and three?", "en", 40, ["5", "five"], []),
    ("code", "coding", "Write a Python function that adds two numbers.", "en", 120, ["def ", "lambda"], []),
    ("salut", "greeting", "Bonjour, ça va ?", "fr", 40, ["bonjour", "oui", "merci"], []),
)


def load_suite(spark: SparkSession, path: str | None = None) -> DataFrame:
    """Items of a file of JSON lines, in which lines that begin with # don't count; without a path or an item, the built-in ones. (SRC20)"""
    if path is not None:
        rows = spark.read.text(path).filter(~F.ltrim("value").startswith("#")).select(F.from_json("value", SUITE).alias("i")).select("i.*").filter("prompt is not null")
        if not rows.isEmpty():
            return rows
    return spark.createDataFrame([(*i, None, None) for i in BUILT_IN], SUITE)


def write_suite(items: DataFrame, path: str) -> None:
    """JSON lines that ``load_suite`` reads. (SNK6)"""
    items.write.json(path)


def write_results(results: DataFrame, path: str) -> None:
    """Results as JSON lines, and a sheet for human judges beside them. (SNK6)"""
    results.write.json(f"{path}/results")
    sheet = F.format_string("## %s [%s]\nPROMPT: %s\nREPLY: %s\nSCORE (1-5): ___\n", "id", "category", "prompt", "reply")
    results.select(sheet.alias("value")).write.text(f"{path}/sheet")


def ngrams(w: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def top_count(x: Column) -> Column:
    """How often the commonest element of an array stands in it."""
    start = F.struct(F.lit("").alias("x"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(s["x"] == v, s["run"] + 1).otherwise(1)
        return F.struct(v.alias("x"), run.alias("run"), F.greatest(s["top"], run).alias("top"))

    return F.aggregate(F.array_sort(x), start, step, lambda s: s["top"])


def evaluated(answered: DataFrame) -> DataFrame:
    """``answered`` (a suite's columns, and reply) with every judgement and the score of each item. (EVL1, AGG15)"""
    low = F.translate("reply", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    small = lambda p: F.translate(p, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    any_of = lambda c: F.coalesce(F.exists(c, lambda p: F.contains(low, small(p))), F.lit(False))
    rows = answered.withColumn("reply", T.text("reply")).withColumn("_w", F.array_remove(F.split("reply", r"[ \t\n\r\x0B\x0C]+"), ""))
    rows = rows.withColumnsRenamed({"_w": "reply_words"})
    tagged = L.with_language(rows, column="reply")
    expect = F.coalesce("expect_lang", F.lit(""))
    arabic = expect.isin("ar-MA-arab", "ar-MA-latn", "ar-MSA")
    lang_ok = (
        F.when(expect == "", True).when(F.col("lang_tag") == expect, True).when((F.col("lang_tag") == "mixed") & arabic, True)
        .when((expect == "en") & F.col("lang_tag").isin("en", "mixed", "other"), F.col("english_score") > 0.02).otherwise(False)
    )
    distinct = lambda n: F.when(F.size("reply_words") >= n, F.size(F.array_distinct(ngrams(F.col("reply_words"), n))) / F.size(ngrams(F.col("reply_words"), n))).otherwise(0.0)
    most = F.coalesce("max_words", F.lit(0))
    out = tagged.select(
        *answered.columns, F.size("reply_words").cast("long").alias("words"), ((F.coalesce(F.size("expect_any"), F.lit(0)) == 0) | any_of("expect_any")).alias("matched"),
        any_of("forbid").alias("forbidden_hit"), ((most == 0) | (F.size("reply_words") <= most)).alias("length_ok"), D.robotic(F.col("reply")).alias("robotic"),
        F.round(distinct(1), 6).alias("distinct1"), F.round(distinct(2), 6).alias("distinct2"), top_count(ngrams(F.col("reply_words"), 3)).cast("long").alias("max_repeat"),
        (expect != "").alias("lang_gated"), lang_ok.alias("lang_ok"), Q.toxic(F.col("reply")).alias("toxic"), (expect == "en").alias("discipline_gated"),
        ((expect == "en") & (D.reply_reason(T.text("prompt"), F.col("reply")) == "ok")).alias("disciplined"),
    )
    points = ((F.col("matched"), 0.40), (~F.col("forbidden_hit"), 0.15), (F.col("length_ok"), 0.10), (~F.col("robotic"), 0.10), (~F.col("toxic"), 0.10), (F.col("lang_ok"), 0.10), (F.col("disciplined") | ~F.col("discipline_gated"), 0.05))
    return out.withColumn("score", F.round(sum((F.when(c, v).otherwise(0.0) for c, v in points), F.lit(0.0)), 6))


def rates(results: DataFrame, by: str | None = "category") -> DataFrame:
    """Mean score and rates of all items or by category; language and discipline are shares of the items that ask for them. (AGG13-14, EVL3)"""
    share = lambda c, of: F.round(F.coalesce(F.count_if(F.col(c) & F.col(of)) / F.nullif(F.count_if(of), F.lit(0)), F.lit(0.0)), 6)
    n = F.count(F.lit(1))
    aggs = [
        n.alias("items"), F.round(F.avg("score"), 6).alias("score"), F.round(F.avg("distinct1"), 6).alias("avg_distinct1"), F.round(F.avg("distinct2"), 6).alias("avg_distinct2"),
        F.round(F.avg("words"), 6).alias("avg_words"), F.round(F.count_if("robotic") / n, 6).alias("robotic_rate"), F.round(F.count_if("toxic") / n, 6).alias("toxic_rate"),
        share("lang_ok", "lang_gated").alias("lang_rate"), F.count_if("lang_gated").alias("n_lang_gated"), share("disciplined", "discipline_gated").alias("discipline_rate"),
        F.count_if("discipline_gated").alias("n_discipline_gated"), F.round(F.count_if(F.col("max_repeat") > 5) / n, 6).alias("repetition_rate"),
    ]
    return (results.groupBy(by) if by else results.groupBy()).agg(*aggs)


def report(counters: DataFrame, kept: str = "kept", seen: str = "seen", duplicates: str = "duplicates", min_keep: float = 0.0) -> str:
    """One line a counter of a one-row table. Raises if less than ``min_keep`` of what was seen is kept; warns if more than half were duplicates. (SNK3, FLT25)"""
    row = counters.first().asDict()
    whole = max(row[seen], 1)
    if row.get(duplicates, 0) > 0.5 * whole:
        warnings.warn(f"{row[duplicates]} of {row[seen]} rows are duplicates", stacklevel=2)
    if row[kept] < min_keep * whole:
        raise ValueError(f"{row[kept]} of {row[seen]} rows kept, fewer than {min_keep:.0%}")
    return "\n".join(f"{name}: {value}" for name, value in row.items())


def token_stats(encoded: DataFrame, first_byte: int = 16) -> DataFrame:
    """One row over (tokens, words, bytes): distinct tokens, the share of them that are bare bytes, tokens a word, bytes a token. (AGG4)"""
    sums = encoded.agg(F.sum(F.size("tokens")).alias("t"), F.sum("words").alias("w"), F.sum("bytes").alias("b"))
    seen = encoded.select(F.explode("tokens").alias("id")).distinct().agg(F.count(F.lit(1)).alias("vocab_used"), F.count_if(F.col("id").between(first_byte, first_byte + 255)).alias("raw"))
    row, used = sums.first(), seen.first()
    ratio = lambda a, b: float(a or 0) / b if b else 0.0
    values = (row.t or 0, used.vocab_used, ratio(used.raw, used.vocab_used), ratio(row.t, row.w), ratio(row.b, row.t))
    return encoded.sparkSession.createDataFrame([values], "tokens long, vocab_used long, byte_rate double, tokens_per_word double, bytes_per_token double")


def chosen_vocabulary(study: DataFrame, within: float = 1.03) -> DataFrame:
    """The smallest vocabulary of rows (vocab, fertility) whose fertility is within 3 % of the best. (AGG17)"""
    best = study.agg(F.min("fertility")).first()[0]
    return study.filter(F.col("fertility") <= F.lit(best) * within).agg(F.min("vocab").alias("vocab"))


def share_capped(rows: DataFrame, group: str, order: str, head: str, share: float = 0.1, after: int = 200) -> DataFrame:
    """The rows of each group that are taken in turn: one is refused if its head would hold more than ``share`` of those taken, once ``after`` are. (WIN4)

    Whether a row is taken depends on all that were taken before it, so a group is one sequence; groups are independent.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        seen: dict = {}
        taken, keep = 0, []
        for value in frame.sort_values(order, kind="stable")[head]:
            seen[value] = seen.get(value, 0) + 1  # a refused row counts for its head
            ok = not (taken + 1 > after and seen[value] / (taken + 1) > share)
            taken += ok
            keep.append(ok)
        return frame.sort_values(order, kind="stable")[keep]

    return rows.groupBy(group).applyInPandas(run, rows.schema)


def synth_stats(made: DataFrame) -> DataFrame:
    """(domain, script, dialogues, turns) of generated rows. (AGG22)"""
    return made.groupBy("domain", "script").agg(F.count(F.lit(1)).alias("dialogues"), F.sum(F.size("messages")).alias("turns"))


def sampled_by(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The first n rows of each value. (WIN8)"""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order))).filter(F.col("rank") <= n)
