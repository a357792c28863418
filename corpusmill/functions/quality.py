"""Explainable quality and toxicity rules: one ordered CASE, the first failing rule names the verdict. (FLT12-16)"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T

# Fixed values.
DISCLAIMERS = (
    "as an ai language model", "as a language model", "as an artificial intelligence", "i don't have personal opinions", "i cannot fulfill this request",
    "i am an ai", "i'm an ai", "i cannot provide", "i'm sorry, but i cannot", "i am a large language model",
)
PLACEHOLDERS = ("[insert ", "[Insert ", "<your_", "<YOUR_", "TODO:", "[Your Name]", "[your name]")
HARD_DISCLOSURES = ("as an ai", "as a language model", "as an ai language model", "i am a large language model", "i cannot fulfill this request")
TOXIC_TERMS = (
    ("قحبة", "slur"), ("زامل", "slur"), ("كلب ابن", "slur"), ("نيك", "sexual"), ("طيز", "sexual"), ("زب", "sexual"), ("7mar wld", "slur"), ("9a7ba", "slur"),
    ("zamel", "slur"), ("nik mok", "slur"), ("tbon", "sexual"), ("fuck", "profanity"), ("bitch", "slur"), ("nigger", "slur"), ("faggot", "slur"), ("rape", "violence"),
    ("kill yourself", "self-harm"), ("pute", "slur"), ("salope", "slur"), ("enculé", "slur"), ("انتحار", "self-harm"), ("اقتل نفسك", "self-harm"),
)


@dataclass(frozen=True)
class QualityRules:
    max_symbol_ratio: float = 0.25
    max_digit_ratio: float = 0.30
    max_upper_ratio: float = 0.40
    max_repeat_line: float = 0.15
    max_word_repeat: float = 0.15
    min_letter_ratio: float = 0.45
    min_words: int = 2
    max_word_length: int = 60
    disclaimers: bool = True
    placeholders: bool = True
    hard_disclosure: bool = False


ENGLISH = QualityRules(0.35, 0.50, 0.60, 0.30, 0.40, 0.30, 1, 80, disclaimers=False, hard_disclosure=True)


def holds_any(t: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text contains one of some phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | F.contains(t, F.lit(p))
    return found


def with_verdict(df: DataFrame, rules: QualityRules = QualityRules(), column: str = "text", out: str = "verdict") -> DataFrame:
    """``df`` with the name of the first failing rule, or ``accept``."""
    t = T.text(column)
    stats = T.script_stats(t)
    measured = df.select(
        "*",
        *[c.alias(f"_{k}") for k, c in stats.items()],
        T.counted(t, "A-Z").alias("_upper"),
        T.words(t).alias("_w"),
        T.lowered(t).alias("_low"),
        *(c.alias(n) for c, n in zip(T.dup_line_ratio(t), ("_dup", "_lines"), strict=True)),
    )
    total, letters = F.greatest(F.col("_total"), F.lit(1)), F.col("_arabic") + F.col("_latin")
    longest = F.coalesce(F.array_max(F.transform("_w", F.length)), F.lit(0))
    no = F.lit(False)
    verdict = (
        F.when(F.col("_total") == 0, "empty")
        .when(holds_any(F.col("_low"), DISCLAIMERS) if rules.disclaimers else no, "ai_disclaimer")
        .when(holds_any(t, PLACEHOLDERS) if rules.placeholders else no, "unresolved_placeholder")
        .when(letters == 0, "no letters")
        .when(letters / total < rules.min_letter_ratio, "low letter ratio")
        .when((F.col("_punct") + F.col("_other")) / total > rules.max_symbol_ratio, "symbol spam")
        .when(F.col("_digits") / total > rules.max_digit_ratio, "digit spam")
        .when((F.col("_latin") > 20) & (F.col("_upper") > rules.max_upper_ratio * F.col("_latin")), "shouting")
        .when(F.size("_w") < rules.min_words, "too few words")
        .when(longest > rules.max_word_length, "absurd word length")
        .when((F.size("_w") >= 8) & (T.word_repeat_ratio(F.col("_w")) > rules.max_word_repeat), "word repetition")
        .when((F.col("_lines") >= 5) & (F.col("_dup") > rules.max_repeat_line), "duplicated lines")
        .when(holds_any(F.col("_low"), HARD_DISCLOSURES) if rules.hard_disclosure else no, "ai_disclosure_hard")
        .otherwise("accept")
    )
    return measured.withColumn(out, verdict).drop(*[c for c in measured.columns if c.startswith("_")])


def toxic_terms(t: Column, terms: tuple[tuple[str, str], ...] = TOXIC_TERMS) -> Column:
    """The (term, category) pairs of a list that a text holds between ASCII word boundaries. (FLT16)

    One scan of the text finds every place where a term may stand; only a text with such a place is asked for each term.
    """
    low = T.lowered(t)
    any_term = "|".join(rf"\Q{term}\E" for term, _ in terms)
    hits = [F.when(low.rlike(rf"(?<![a-z0-9])\Q{term}\E(?![a-z0-9])"), F.struct(F.lit(term).alias("term"), F.lit(kind).alias("category"))) for term, kind in terms]
    found = F.array_compact(F.array(*hits))
    return F.when(low.rlike(rf"(?<![a-z0-9])(?:{any_term})(?![a-z0-9])"), found).otherwise(F.array().cast(_HITS))


_HITS = "array<struct<term:string,category:string>>"


def toxic(t: Column, terms: tuple[tuple[str, str], ...] = TOXIC_TERMS) -> Column:
    """Whether a text holds a term of a list."""
    any_term = "|".join(rf"\Q{term}\E" for term, _ in terms)
    return T.lowered(t).rlike(rf"(?<![a-z0-9])(?:{any_term})(?![a-z0-9])")
