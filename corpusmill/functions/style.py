"""Assistant style: boilerplate, bullets, length, connectors, and the script of a reply. (FLT19, FLT20, FLT23, CHT3)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import chars as C
from corpusmill.functions import dialog as D
from corpusmill.functions import langid as L
from corpusmill.functions import quality as Q
from corpusmill.functions import text as T

# Phrases that mark a reply as boilerplate, and those that mark it as a machine's.
BOILERPLATE = (
    "بالتأكيد", "يمكنني مساعدتك", "كيف يمكنني مساعدتك", "عزيزي المستخدم", "عزيزتي المستخدمة", "شكرا لسؤالك", "شكرا على سؤالك", "سأشرح لك", "إليك الخطوات", "فيما يلي",
    "في الختام", "في الخاتمة", "خلاصة القول", "من المهم أن نلاحظ", "تجدر الإشارة إلى", "بناء على ما سبق", "هل لديك أي أسئلة أخرى", "أنا هنا لمساعدتك", "يسعدني مساعدتك", "كنموذج لغوي",
    "بصفتي مساعدا", "as an ai", "as a language model", "i'm here to help", "certainly!", "of course!", "i hope this helps", "let me know if you need", "en tant qu'assistant", "je suis là pour vous aider",
)
HARD = ("as an ai", "as a language model", "as an ai language model", "en tant qu'assistant", "je suis une ia", "كنموذج لغوي", "بصفتي مساعدا")


def folded(phrase: str) -> str:
    """A phrase in the form of normalised text with folded letters."""
    source, target = C.folding(letters=True)
    return phrase.translate({ord(c): target[i] if i < len(target) else None for i, c in enumerate(source)})


def _holds(t: Column, phrases: tuple[str, ...]) -> Column:
    return Q.holds_any(T.normalized(t, letters=True), tuple(folded(p) for p in phrases))


def hard_boilerplate(t: Column) -> Column:
    """(FLT20)"""
    return _holds(t, HARD)


def bullets(t: Column) -> Column:
    """Lines after the first that begin as an item of a list."""
    return F.regexp_count(t, F.lit(r"\n[ \t]*(?:[-*]|[1-9][.)])")).cast("long")


def connectors(t: Column) -> dict[str, Column]:
    """How many connectives of each kind a text has, as whole words. (FLT23)"""
    low = D.low_trimmed(t)
    return {kind: F.regexp_count(low, F.lit(rf"(?<![A-Za-z0-9_])(?:{'|'.join(words)})(?![A-Za-z0-9_])")).cast("long") for kind, words in D.CONNECTORS.items()}


def with_style(pairs: DataFrame, asked: str = "prev_text", reply: str = "text") -> DataFrame:
    """``pairs`` with boilerplate, bullets, too_many_bullets, too_long, excessive_msa and robotic of replies. (FLT19)

    Robotic is boilerplate, too many bullets for a short question, or formal Arabic as a reply to a dialect; length alone is not.
    """
    tagged = L.with_language(pairs, column=reply).withColumnsRenamed({"lang_tag": "reply_tag", "msa_score": "reply_msa"})
    tagged = L.with_language(tagged.drop("confidence", "darija_score", "french_score", "english_score", "arabizi_score"), column=asked)
    n = lambda c: F.size(F.regexp_extract_all(F.translate(T.normalized(T.text(c), letters=True), C.UPPER, C.LOWER), F.lit(f"({L.WORD})"), F.lit(1)))
    out = tagged.select(
        *pairs.columns, _holds(T.text(reply), BOILERPLATE).alias("boilerplate"), bullets(T.text(reply)).alias("bullets"), n(asked).alias("_asked"), n(reply).alias("_said"),
        (L.is_darija(tagged) & (F.col("reply_tag") == "ar-MSA") & (F.col("reply_msa") > 0.14)).alias("excessive_msa"),
    )
    out = out.withColumn("too_many_bullets", (F.col("_asked") <= 20) & (F.col("bullets") > 3)).withColumn("too_long", (F.col("_asked") <= 12) & (F.col("_said") > 80))
    return out.withColumn("robotic", F.col("boilerplate") | F.col("excessive_msa") | F.col("too_many_bullets")).drop("_asked", "_said")


def reply_script(t: Column) -> Column:
    """arabic or latin: the script that a user writes in, Arabic where neither is seen or both alike. (CHT3)"""
    stats = T.script_stats(t)
    return F.when(stats["arabic"] >= stats["latin"], "arabic").otherwise("latin")


def system_prompt(t: Column, prompts: dict[str, str]) -> Column:
    """The prompt for the script of a user's text. (CHT3)"""
    return F.when(reply_script(t) == "arabic", prompts["arabic"]).otherwise(prompts["latin"])
