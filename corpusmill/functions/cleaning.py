"""The cleaning chain of a line: one verdict, and the cleaned text. (FLT1)"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import pii as P
from corpusmill.functions import text as T


@dataclass(frozen=True)
class CleanRules:
    """``pii`` is drop, redact or keep."""

    strip_html: bool = True
    fix_mojibake: bool = True
    pii: str = "drop"
    min_chars: int = 2
    max_chars: int = 100_000


def with_cleaned(df: DataFrame, rules: CleanRules = CleanRules(), column: str = "text", out: str = "cleaned", verdict: str = "clean_verdict") -> DataFrame:
    """``df`` with the cleaned text (empty if dropped) and why it was dropped: empty, long, encoding, pii, short, or ok.

    In order: empty, too long, mojibake, invalid UTF-8, markup, personal data, normalisation, empty again, too short. Binary columns may hold
    invalid UTF-8; a string column that does holds replacement characters already.
    """
    raw = F.coalesce(F.col(column).cast("binary"), F.lit(b""))
    valid = F.try_validate_utf8(raw.cast("string"))
    t = F.coalesce(valid, F.lit(""))
    t = T.mojibake_repaired(t) if rules.fix_mojibake else t
    t = T.html_stripped(t) if rules.strip_html else t
    staged = df.withColumns({"_size": F.length(F.coalesce(valid, F.make_valid_utf8(raw.cast("string")))), "_valid": valid.isNotNull(), "_bare": t})
    if rules.pii == "drop":
        staged = staged.withColumn("_pii", P.any_found(F.col("_bare")))
    elif rules.pii == "redact":
        staged = staged.withColumn("_pii", F.lit(False)).withColumn("_bare", P.redact(F.col("_bare")))
    else:
        staged = staged.withColumn("_pii", F.lit(False))
    staged = staged.withColumn("_clean", T.normalized(F.col("_bare")))
    why = (
        F.when(F.col("_size") == 0, "empty").when(F.col("_size") > rules.max_chars, "long").when(~F.col("_valid"), "encoding").when(F.col("_pii"), "pii")
        .when(F.col("_clean") == "", "empty").when(F.length("_clean") < rules.min_chars, "short").otherwise("ok")
    )
    done = staged.withColumn(verdict, why).withColumn(out, F.when(F.col(verdict) == "ok", F.col("_clean")).otherwise(""))
    return done.drop("_size", "_valid", "_bare", "_pii", "_clean")


def clean_stats(cleaned: DataFrame, column: str = "text", out: str = "cleaned", verdict: str = "clean_verdict") -> DataFrame:
    """One row: lines and bytes in and out, and how many lines each reason dropped."""
    size: Column = F.coalesce(F.octet_length(column), F.lit(0))
    reasons = [F.count_if(F.col(verdict) == r).alias(f"dropped_{r}") for r in ("empty", "short", "long", "pii", "encoding")]
    return cleaned.agg(
        F.count(F.lit(1)).alias("lines_in"), F.count_if(F.col(verdict) == "ok").alias("lines_out"),
        F.coalesce(F.sum(size), F.lit(0)).alias("bytes_in"), F.coalesce(F.sum(F.octet_length(out)), F.lit(0)).alias("bytes_out"), *reasons,
    )
