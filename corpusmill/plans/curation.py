"""Queries over normalisation, quality, toxicity and exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import cleaning as N
from corpusmill.functions import quality as Q
from corpusmill.functions import text as T
from corpusmill.operators.store import written
from corpusmill.plans import oracle as O


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curation_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaning, quality of the cleaned text, toxicity, then exact duplicates of what is accepted, counted by language. (FLT1, FLT12, FLT16, SET2, AGG1)

    The judged rows are narrow and written once, so each text is read and judged once.
    """
    docs = N.with_cleaned(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), N.CleanRules(pii="keep"))
    judged = Q.with_verdict(docs, column="cleaned")
    verdict = F.when(F.col("clean_verdict") != "ok", F.concat(F.lit("clean: "), "clean_verdict")).when(F.col("verdict") != "accept", F.col("verdict")).when(Q.toxic(F.col("cleaned")), "toxic").otherwise("accept")
    judged = written(judged.select("doc_id", "lang", verdict.alias("verdict"), F.sha2(T.canonical(F.col("cleaned")), 256).alias("key"), F.length("cleaned").cast("long").alias("chars")), "judged")
    first = judged.filter("verdict = 'accept'").groupBy("key").agg(F.min("doc_id").alias("first"))
    joined = judged.join(first, "key", "left")
    final = F.when((F.col("verdict") == "accept") & (F.col("doc_id") != F.col("first")), "exact_dup").otherwise(F.col("verdict"))
    return joined.groupBy("lang", final.alias("verdict")).agg(F.count(F.lit(1)).alias("docs"), F.sum("chars").cast("long").alias("chars"))


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's cleaning verdict, personal data dropped, and a digest of the cleaned text. (FLT1)"""
    docs = N.with_cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "clean_verdict", F.md5("cleaned").alias("digest"))


def clean_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and bytes in and out of cleaning web pages that keep personal data, by reason. (FLT1)"""
    return N.clean_stats(N.with_cleaned(table(spark, sf_dir, "pages"), N.CleanRules(pii="keep"), column="html"), column="html")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalized(T.text("text")).alias("normalized"))


def canonical_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.canonical(T.text("text")), 256).alias("key"))


def script_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(k) for k, c in T.script_stats(T.text("text")).items()])


def quality_verdicts_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_verdict(table(spark, sf_dir, "documents")).select("doc_id", "verdict")


def quality_verdicts_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.with_verdict(table(spark, sf_dir, "documents"), Q.ENGLISH).select("doc_id", "verdict")


def quality_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons with their share. (AGG5)"""
    counts = Q.with_verdict(table(spark, sf_dir, "documents")).groupBy("verdict").agg(F.count(F.lit(1)).alias("docs"))
    return counts.withColumn("share", F.round(F.col("docs") / F.sum("docs").over(W.partitionBy()), 6))


def word_repeat_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", T.words(T.text("text")).alias("w"))
    return docs.select("doc_id", F.round(T.word_repeat_ratio(F.col("w")), 6).alias("ratio"))


def dup_line_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio, n = T.dup_line_ratio(T.text("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(ratio, 6).alias("ratio"), n.cast("long").alias("n_lines"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.html_stripped(T.text("html")).alias("stripped"))


def flatten_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.flattened(T.text("text")).alias("line"))


#: A second list beside the default one: common English insults.
INSULTS = tuple((w, "insult") for w in ("idiot", "stupid", "moron", "trash", "loser", "clown", "scum", "fool", "jerk"))


def toxicity_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", Q.toxic_terms(T.text("text"), Q.TOXIC_TERMS + INSULTS).alias("f"))
    return docs.select("doc_id", F.size("f").cast("long").alias("hits"), F.array_join(F.array_sort(F.array_distinct("f.category")), ",").alias("categories"), (F.size("f") > 0).alias("toxic"))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each canonical text, and its first document. (SET2, WIN2)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.canonical(T.text("text")), 256).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"))


def label_join_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule's verdict against labels."""
    judged = Q.with_verdict(table(spark, sf_dir, "documents")).select("doc_id", (F.col("verdict") == "accept").alias("accepted"))
    return judged.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "accepted").agg(F.count(F.lit(1)).alias("docs"))


QUERIES = {f.__name__: f for f in (curation_funnel, clean_lines, clean_totals, normalize_text, canonical_key, script_stats, quality_verdicts_default, quality_verdicts_english, quality_reasons, word_repeat_ratio, dup_line_ratio, html_strip, flatten_lines, toxicity_hits, exact_dedup, label_join_quality)}

_T = "coalesce(text, '')"
_M = O.measured()
_TERMS = ", ".join(f"({O.quoted(t)}, {O.quoted(k)})" for t, k in Q.TOXIC_TERMS + INSULTS)
_PLAIN = ", ".join(f"({O.quoted(t)})" for t, _ in Q.TOXIC_TERMS)


def _stripped(t: str) -> str:
    out = rf"regexp_replace({t}, '<[A-Za-z/!][^>]*(>|\z)', '', 'g')"
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "-")):
        out = f"replace({out}, {O.quoted(entity)}, {O.quoted(char)})"
    return out


_CLEAN = "CASE WHEN raw = '' THEN 'empty' WHEN length(raw) > 100000 THEN 'long' WHEN text = '' THEN 'empty' WHEN length(text) < 2 THEN 'short' ELSE 'ok' END"

ORACLES = {
    "curation_funnel": f"""
WITH c AS (SELECT doc_id, lang, raw, {O.normalized(_stripped('raw'))} AS text FROM (SELECT doc_id, lang, {_T} AS raw FROM documents)),
k AS (SELECT doc_id, lang, {_CLEAN} AS why, CASE WHEN {_CLEAN} = 'ok' THEN text ELSE '' END AS text FROM c),
v AS (SELECT doc_id, lang, why, total AS chars, {O.verdict(Q.QualityRules())} AS verdict, EXISTS (SELECT 1 FROM (VALUES {_PLAIN}) w(term) WHERE regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) AS toxic,
  sha256({O.canonical('t')}) AS key FROM {O.measured('k')}),
j AS (SELECT doc_id, lang, chars, key, CASE WHEN why <> 'ok' THEN 'clean: ' || why WHEN verdict <> 'accept' THEN verdict WHEN toxic THEN 'toxic' ELSE 'accept' END AS verdict FROM v),
d AS (SELECT *, CASE WHEN verdict = 'accept' AND doc_id <> min(CASE WHEN verdict = 'accept' THEN doc_id END) OVER (PARTITION BY key) THEN 'exact_dup' ELSE verdict END AS v FROM j)
SELECT lang, v AS verdict, count(*) AS docs, sum(chars)::BIGINT AS chars FROM d GROUP BY ALL""",
    "clean_totals": f"""
WITH c AS (SELECT raw, {O.normalized(_stripped('raw'))} AS text FROM (SELECT coalesce(html, '') AS raw FROM pages)), k AS (SELECT *, {_CLEAN} AS why FROM c)
SELECT count(*) AS lines_in, count(*) FILTER (why = 'ok') AS lines_out, sum(strlen(raw))::BIGINT AS bytes_in, coalesce(sum(strlen(text)) FILTER (why = 'ok'), 0)::BIGINT AS bytes_out,
  count(*) FILTER (why = 'empty') AS dropped_empty, count(*) FILTER (why = 'short') AS dropped_short, count(*) FILTER (why = 'long') AS dropped_long, 0::BIGINT AS dropped_pii, 0::BIGINT AS dropped_encoding FROM k""",
    "normalize_text": f"SELECT doc_id, {O.normalized(_T)} AS normalized FROM documents",
    "canonical_key": f"SELECT doc_id, sha256({O.canonical(_T)}) AS key FROM documents",
    "script_stats": f"SELECT doc_id, total, whitespace, arabic, latin, digits, emoji, punct, total - whitespace - arabic - latin - digits - emoji - punct AS other FROM {_M}",
    "quality_verdicts_default": f"SELECT doc_id, {O.verdict(Q.QualityRules())} AS verdict FROM {_M}",
    "quality_verdicts_english": f"SELECT doc_id, {O.verdict(Q.ENGLISH)} AS verdict FROM {_M}",
    "quality_reasons": f"SELECT verdict, count(*) AS docs, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT {O.verdict(Q.QualityRules())} AS verdict FROM {_M}) GROUP BY verdict",
    "word_repeat_ratio": f"SELECT doc_id, round(CASE WHEN len(w) > 0 THEN {O.top_count('w')} / len(w) ELSE 0 END, 6) AS ratio FROM {_M}",
    "dup_line_ratio": f"SELECT doc_id, round(CASE WHEN len(lines) > 0 THEN (len(lines) - len(list_distinct(lines))) / len(lines) ELSE 0 END, 6) AS ratio, len(lines)::BIGINT AS n_lines FROM {_M}",
    "html_strip": f"SELECT page_id, {_stripped("coalesce(html, '')")} AS stripped FROM pages",
    "flatten_lines": rf"SELECT doc_id, trim(translate({_T}, chr(10) || chr(13) || chr(9), '   ')) AS line FROM documents",
    "toxicity_hits": f"""
WITH terms(term, category) AS (VALUES {_TERMS}),
h AS (SELECT doc_id, term, category FROM {_M}, terms WHERE regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))
SELECT doc_id, count(term)::BIGINT AS hits, coalesce(array_to_string(list_sort(list_distinct(list(category) FILTER (term IS NOT NULL))), ','), '') AS categories, count(term) > 0 AS toxic
FROM documents LEFT JOIN h USING (doc_id) GROUP BY doc_id""",
    "exact_dedup": f"SELECT sha256({O.canonical(_T)}) AS key, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY key",
    "label_join_quality": f"SELECT quality, {O.verdict(Q.QualityRules())} = 'accept' AS accepted, count(*) AS docs FROM {_M} JOIN labels USING (doc_id) GROUP BY ALL",
}
