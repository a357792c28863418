"""Quality rules whose cutoffs adapt to each language and source.

Per document, words (runs of anything but ASCII white space), their characters, symbols,
repeated lines and words in repeated three-word windows are counted. Four ratios follow from them.
Their distribution in every (lang, source) group is kept as a log-bucket histogram: a value falls
in the bucket of its logarithm, a bucket is a row with a count, and two histograms merge by adding
counts. Any quantile read from one is off by at most ``accuracy`` of its value, however often
histograms were merged, and the result doesn't depend on the order. A document is dropped where
a ratio lies beyond its group's fence: the ``upper`` quantile plus ``reach`` times its distance from the ``lower`` one.
That distance counts as a small least value where nearly all documents of a group are alike, and no fence lies beyond a
highest value, so that a group that is mostly junk sets no fence of its own.

Everything is DataFrame operations. A window of three words is named by a 64-bit hash, its
low bits replaced by its position, so that one sort of longs per document finds repeated windows. Neighbours of
equal hash are compared word by word; a document where two differ (long ones have fewer bits of hash) is counted again by
sorting the windows themselves, so counts are exact.

Defined cases: null and empty texts have no words, zero counts and fail the base rule; null lang or
source form a group of their own; a group of one document has the least distance; repeated rows
are judged and counted each. Extra columns are ignored, also those with the names of counts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm.store import written

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class QualityConfig:
    accuracy: float = 0.01
    lower: float = 0.5
    upper: float = 0.9
    reach: float = 3.0
    least: float = 1e-4


#: Ratios, with the least distance between the quantiles and the highest fence of each.
RATIOS = {"symbol_ratio": (0.02, 0.2), "dup_line_ratio": (0.03, 0.3), "repeat_ratio": (0.03, 0.4), "word_length": (0.1, 12.0)}


#: Sorted window keys (hash above, position below) of the words ``w``; ``b`` bits hold the position.
_KEYS = "if(size(w) < 3, array(), sort_array(transform(sequence(0, size(w) - 3), i -> shiftleft(xxhash64(get(w, i), get(w, i + 1), get(w, i + 2)), b) | i)))"
#: Positions of the windows whose hash a neighbour shares.
_TWICE = """sort_array(transform(
    filter(k, (x, j) -> shiftright(x, b) <=> shiftright(get(k, j - 1), b) or shiftright(x, b) <=> shiftright(get(k, j + 1), b)),
    x -> x & (shiftleft(1L, b) - 1)))"""
#: The position in a key, and whether the windows of two keys hold the same words.
_AT = "cast({x} & (shiftleft(1L, b) - 1) as int)"
_SAME = " and ".join(f"get(w, {_AT.format(x='x')} + {d}) = get(w, {_AT.format(x='get(k, j - 1)')} + {d})" for d in (0, 1, 2))
#: Whether two neighbours share a hash and no words.
_CLASH = f"exists(transform(k, (x, j) -> shiftright(x, b) <=> shiftright(get(k, j - 1), b) and not ({_SAME})), c -> c)"
#: The same positions by sorting the windows themselves.
_WORDS = "sort_array(transform(sequence(0, size(w) - 3), i -> struct(get(w, i) as a, get(w, i + 1) as b, get(w, i + 2) as c, cast(i as long) as i)))"
_EXACT = """sort_array(transform(
    filter(s, (x, j) -> struct(x.a, x.b, x.c) <=> struct(get(s, j - 1).a, get(s, j - 1).b, get(s, j - 1).c) or struct(x.a, x.b, x.c) <=> struct(get(s, j + 1).a, get(s, j + 1).b, get(s, j + 1).c)),
    x -> x.i))"""
#: Words under those windows: each covers three, less what the next one covers too.
_COVERED = "aggregate(transform(p, (x, j) -> least(3L, coalesce(get(p, j + 1) - x, 3L))), 0L, (s, x) -> s + x)"


def measured(docs: DataFrame, keys: str = _KEYS) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select(
        F.col("doc_id"),
        F.col("lang"),
        F.col("source"),
        F.array_remove(F.split(text, SPACE + "+"), "").alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    sized = split.withColumn("b", F.expr("cast(ceil(log2(size(w) + 1)) as int)"))
    keyed = sized.select(
        "doc_id", "lang", "source", "n_symbols", "b",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "w", F.expr(keys).alias("k"),
    )
    checked = keyed.withColumn("s", F.expr(f"if({_CLASH}, {_WORDS}, null)")).drop("w")
    placed = checked.withColumn("p", F.expr(f"if(s is null, {_TWICE}, {_EXACT})"))
    return placed.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.expr(_COVERED).alias("n_repeat_words"))


def sketch(rows: DataFrame, keys: list[str], values: list[str], cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(*keys, ratio, bucket, n): log-bucket histograms; merge two by adding n by bucket."""
    gamma = (1 + cfg.accuracy) / (1 - cfg.accuracy)
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(v).alias("ratio"), F.col(v).alias("value")) for v in values])).alias("r")).select(*keys, "r.ratio", "r.value")
    bucket = F.when(F.col("value") <= cfg.least, 0).otherwise(F.ceil(F.log(F.col("value") / cfg.least) / math.log(gamma))).cast("int")
    return long.withColumn("bucket", bucket).groupBy(*keys, "ratio", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketches: DataFrame, keys: list[str], wanted: dict[str, float], cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """(*keys, ratio, one column for each wanted quantile) of histograms."""
    gamma = (1 + cfg.accuracy) / (1 - cfg.accuracy)
    group = W.partitionBy(*keys, "ratio")
    ranked = sketches.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("all", F.sum("n").over(group))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(cfg.least * 2 / (gamma + 1) * F.pow(F.lit(gamma), F.col("bucket")))
    return ranked.groupBy(*keys, "ratio").agg(*[F.min(F.when(F.col("upto") >= F.col("all") * q, value)).alias(name) for name, q in wanted.items()])


def judged(docs: DataFrame, cfg: QualityConfig = QualityConfig()) -> DataFrame:
    """Every document with its counts, base_failed and kept."""
    ratios = measured(docs).select(
        "*",
        (F.col("n_symbols") / F.greatest("word_chars", F.lit(1))).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / F.greatest("n_words", F.lit(1))).alias("repeat_ratio"),
        (F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("word_length"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )
    ratios = written(ratios, "quality")
    keys = ["lang", "source"]
    limits = quantiles(sketch(ratios.filter("not base_failed"), keys, list(RATIOS), cfg), keys, {"lo": cfg.lower, "hi": cfg.upper}, cfg)
    least, most = (F.coalesce(*[F.when(F.col("ratio") == name, bound[k]) for name, bound in RATIOS.items()]) for k in (0, 1))
    fence = F.least(F.col("hi") + cfg.reach * F.greatest(F.col("hi") - F.col("lo"), least), most)
    fences = limits.groupBy(*keys).agg(*[F.max(F.when(F.col("ratio") == name, fence)).alias(f"{name}_fence") for name in RATIOS])
    fences = fences.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *[f"{name}_fence" for name in RATIOS])
    joined = ratios.join(fences, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    beyond = [F.coalesce(F.col(name) > F.col(f"{name}_fence"), F.lit(False)) for name in RATIOS]
    first = F.when(F.col("base_failed"), "base")
    for name, out in zip(RATIOS, beyond, strict=True):
        first = first.when(out, name)
    return joined.withColumn("reason", first).withColumn("kept", F.col("reason").isNull())
