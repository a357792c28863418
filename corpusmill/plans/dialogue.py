"""Queries over languages, personal data and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import chars as C
from corpusmill.functions import cleaning as N
from corpusmill.functions import dialog as D
from corpusmill.functions import langid as L
from corpusmill.functions import pii as P
from corpusmill.functions import quality as Q
from corpusmill.functions import style as Y
from corpusmill.functions import text as T
from corpusmill.plans import oracle as O
from corpusmill.plans.curation import _stripped, table


def langid_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_language(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def langid_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.with_language(table(spark, sf_dir, "documents")).groupBy("lang", "lang_tag").agg(F.count(F.lit(1)).alias("docs"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = T.text("text")
    return table(spark, sf_dir, "documents").select("doc_id", P.emails(t).alias("email"), P.urls(t).alias("url"), P.keys(t).alias("key"), P.ids(t).alias("id"), P.ips(t).alias("ip"))


def pii_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of all detectors, and the documents with any. (AGG5)"""
    found = table(spark, sf_dir, "documents").select(P.count_spans(T.text("text")).alias("c")).select("c.*")
    some = sum((F.col(x.lower()) for x in P.TAGS), F.lit(0)) > 0
    return found.agg(*[F.sum(x.lower()).alias(x.lower()) for x in P.TAGS], F.count_if(some).alias("docs_with_any"))


def pii_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", P.redact(T.text("text")).alias("redacted"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("text", T.text("text"))


def dialog_acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", D.dialog_act(F.col("text")).alias("act"))


def prev_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.with_context(_turns(spark, sf_dir)).select("conv_id", "turn", "role", "last_user", "prev_text")


def reply_discipline(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = D.with_context(_turns(spark, sf_dir)).filter("role = 'assistant'")
    reason = D.reply_reason(F.col("last_user"), F.col("text"))
    return turns.select("conv_id", "turn", D.dialog_act(F.col("last_user")).alias("act"), reason.alias("reason"), (reason == "ok").alias("disciplined"))


def gated(turns: DataFrame, mode: str = "en", rules: N.CleanRules = N.CleanRules()) -> DataFrame:
    """(conv_id, turns, verdict): a conversation's first failing message decides. (FLT26)

    In two passes, as a message that can't be cleaned or fails the quality rules drops the whole conversation before toxicity, personal data and
    style are asked. In ``en``, replies with hard boilerplate or a bad multiple-choice format go and personal data is redacted later; in ``darija``,
    robotic replies go, and so does what still holds personal data.
    """
    cleaned = N.with_cleaned(turns, rules)
    judged = Q.with_verdict(cleaned, Q.ENGLISH if mode == "en" else Q.QualityRules(), column="cleaned")
    first = F.when((F.col("clean_verdict") != "ok") | (F.octet_length("cleaned") < 2), "clean").when(F.col("verdict") != "accept", F.col("verdict"))
    rows = D.with_context(judged.withColumn("first", first).withColumn("text", F.col("cleaned")))
    if mode == "en":
        robotic = Y.hard_boilerplate(F.col("text")) | (D.reply_reason(F.col("last_user"), F.col("text")) == "bad-mc-format")
    else:
        rows = Y.with_style(rows)
        robotic = F.col("robotic")
    second = F.when(Q.toxic(F.col("text")), "toxic")
    if mode != "en":
        second = second.when(P.any_found(F.col("text")), "pii")
    second = second.when((F.col("role") == "assistant") & robotic, "robotic")
    at = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("turn")))
    return rows.withColumn("second", second).groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.coalesce(at("first"), at("second"), F.lit("accept")).alias("verdict"))


def chat_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English gate; personal data is left to redaction. (FLT26)"""
    return gated(_turns(spark, sf_dir), "en", N.CleanRules(pii="keep"))


def reply_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate, bullets and robotic style of replies, and their connectives. (FLT19, FLT20, FLT23)"""
    turns = Y.with_style(D.with_context(_turns(spark, sf_dir)).filter("role = 'assistant'"))
    words = [c.alias(k) for k, c in Y.connectors(F.col("text")).items()]
    return turns.select("conv_id", "turn", "boilerplate", Y.hard_boilerplate(F.col("text")).alias("hard"), "bullets", "too_many_bullets", *words)


def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.rendered(table(spark, sf_dir, "conversations"))


def chat_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns that a chat of one exchange of history keeps. (WIN9)"""
    return D.trimmed(table(spark, sf_dir, "conversations"), 1).select("conv_id", "turn")


def reply_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script that each user writes in. (CHT3)"""
    return _turns(spark, sf_dir).filter("role = 'user'").select("conv_id", "turn", Y.reply_script(F.col("text")).alias("script"))


def role_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return turns.select("role", D.role_of(F.col("role")).alias("mapped")).groupBy("role", "mapped").agg(F.count(F.lit(1)).alias("turns"))


QUERIES = {f.__name__: f for f in (langid_tags, langid_confusion, pii_counts, pii_totals, pii_redact, dialog_acts, prev_user_turn, reply_discipline, chat_gate, reply_style, chat_render, chat_trim, reply_scripts, role_alias_map)}


def _in(words: tuple[str, ...]) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(O.quoted(w) for w in words) + ")))::double"


_LEX = L.Lexicons()
_LANG = f"""(
  SELECT *, greatest(n, 1) AS n1, dar / greatest(arw, 1) AS d_dar, (dlt + az) / greatest(n - arw, 1) AS d_lat, msa / greatest(arw, 1) AS d_msa,
    fr / greatest(n - arw, 1) AS d_fr, en / greatest(n - arw, 1) AS d_en, ar / greatest(ar + lt, 1) > 0.6 AS arabic, lt / greatest(ar + lt, 1) > 0.6 AS latin
  FROM (SELECT doc_id, lang, {O.counted('t', C.ARABIC_LETTER + C.ARABIC_MARK)} AS ar, {O.counted('t', C.LATIN)} AS lt, len(w)::double AS n,
      len(list_filter(w, lambda x: regexp_matches(x, '^[{C.ARABIC_LETTER}]')))::double AS arw,
      {_in(_LEX.darija_arabic)} + len(list_filter(w, lambda x: strlen(x) >= 6 AND regexp_matches(x, '^((كي|كا).+|(تا|غا|ما).*ش)$')))::double AS dar,
      {_in(_LEX.msa)} AS msa, {_in(_LEX.darija_latin)} AS dlt, {_in(_LEX.french)} AS fr, {_in(_LEX.english)} AS en,
      len(list_filter(w, lambda x: NOT regexp_matches(x, '^[{C.ARABIC_LETTER}]') AND regexp_matches(x, '[{C.LATIN}]') AND regexp_matches(x, '[{C.ARABIZI_DIGIT}]')))::double AS az
    FROM (SELECT doc_id, lang, t, regexp_extract_all({O.lowered('t')}, '({L.WORD})', 1) AS w FROM (SELECT doc_id, lang, {O.normalized("coalesce(text, '')", True)} AS t FROM documents))))"""
_CASES = (
    ("ar + lt = 0 OR n = 0", "other", "0"),
    ("arabic AND (d_dar >= 0.06 OR dar >= 2)", "ar-MA-arab", "0.4 + d_dar * 4"),
    ("arabic AND d_msa >= 0.10", "ar-MSA", "0.4 + d_msa * 3"),
    ("arabic", "ar-MSA", "0.3"),
    ("latin AND (d_lat >= 0.08 OR dlt + az >= 2) AND d_en <= d_lat", "ar-MA-latn", "0.4 + d_lat * 4"),
    ("latin AND d_fr >= 0.15 AND d_fr > d_en AND d_fr >= d_lat", "fr", "0.35 + d_fr * 2"),
    ("latin AND (d_en >= 0.08 OR en >= 2) AND d_en >= d_lat", "en", "0.35 + d_en * 2"),
    ("latin AND (d_lat >= 0.08 OR dlt + az >= 2)", "ar-MA-latn", "0.4 + d_lat * 4"),
    ("latin", "other", "0.2"),
    ("dar + dlt + az >= 1", "mixed", "0.6"),
)
_TAG = "CASE " + " ".join(f"WHEN {c} THEN '{t}'" for c, t, _ in _CASES) + " ELSE 'mixed' END"
_SURE = "CASE " + " ".join(f"WHEN {c} THEN least({v}, 1.0)" for c, _, v in _CASES) + " ELSE 0.35 END"

_LOW = r"translate(regexp_replace({t}, '\A[ \t\n\r]+|[ \t\n\r]+\z', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _alt(words: tuple[str, ...]) -> str:
    return "(" + "|".join(w.replace("'", "''") for w in words) + ")"


def _starts(low: str, words: tuple[str, ...]) -> str:
    return rf"regexp_matches({low}, '\A{_alt(words)}($|[^A-Za-z0-9_])')"


def _has(low: str, words: tuple[str, ...]) -> str:
    return f"regexp_matches({low}, '(^|[^A-Za-z0-9_]){_alt(words)}($|[^A-Za-z0-9_])')"


def _act(t: str, low: str) -> str:
    return rf"""CASE WHEN {t} = '' THEN 'unknown' WHEN {_starts(low, D.GREETINGS)} THEN 'greeting'
      WHEN {O.holds_any(low, ('```', '#include'))} OR {_has(low, D.CODE_WORDS)} OR ({_has(low, ('return',))} AND {_has(low, D.RETURN_CONTEXT)}) THEN 'coding'
      WHEN {_starts(low, D.VERBS)} THEN 'instruction'
      WHEN ends_with(regexp_replace({t}, '[ \t\n\r"'']+\z', ''), '?') OR {_starts(low, D.QUESTION_WORDS)} THEN 'question'
      WHEN {O.holds_any(low, D.REASONING)} THEN 'reasoning' ELSE 'chitchat' END"""


_CONV = """(SELECT conv_id, turn, role, coalesce(text, '') AS text, coalesce(last_value(CASE WHEN role = 'user' THEN coalesce(text, '') END IGNORE NULLS) OVER w, '') AS last_user,
  coalesce(lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
_REASON = rf"""CASE WHEN strlen(low) < 2 THEN 'empty' WHEN {O.holds_any('low', D.AI_DISCLOSURES)} THEN 'ai-disclosure'
  WHEN len(regexp_extract_all(regexp_replace(asked, '([^a-z0-9_])', '\1\1', 'g'), '(^|[^A-Za-z0-9_])[a-d][.):]')) >= 2 AND NOT regexp_matches(low, '(?s)\A[a-d][.):].') THEN 'bad-mc-format'
  WHEN act = 'coding' AND NOT {O.holds_any('low', D.CODE_MARKS)} THEN 'no-code' ELSE 'ok' END"""
_REPLIES = f"(SELECT *, {_REASON} AS reason FROM (SELECT *, {_act('last_user', 'asked')} AS act FROM (SELECT *, {_LOW.format(t='text')} AS low, {_LOW.format(t='last_user')} AS asked FROM {_CONV})))"
_TERMS = ", ".join(f"({O.quoted(t)})" for t, _ in Q.TOXIC_TERMS)
_OCTET = "(25[0-5]|2[0-4][0-9]|[01][0-9][0-9]|[0-9][0-9]?)"



def _said(t: str, phrases: tuple[str, ...]) -> str:
    return O.holds_any(O.normalized(t, True), tuple(Y.folded(p) for p in phrases))


_WORDS = f"len(regexp_extract_all({O.lowered(O.normalized('prev_text', True))}, '({L.WORD})'))"
_COUNTED = ", ".join(
    f"len(regexp_extract_all(regexp_replace(low, '([^A-Za-z0-9_])', '\\1\\1', 'g'), '(^|[^A-Za-z0-9_])({'|'.join(w.replace(' ', '  ') for w in words)})($|[^A-Za-z0-9_])'))::BIGINT AS {kind}" for kind, words in D.CONNECTORS.items()
)

ORACLES = {
    "langid_tags": f"""SELECT doc_id, {_TAG} AS lang_tag, round({_SURE}, 6)::double AS confidence, round((dar + dlt) / n1, 6) AS darija_score, round(msa / n1, 6) AS msa_score,
      round(fr / n1, 6) AS french_score, round(en / n1, 6) AS english_score, round(az / n1, 6) AS arabizi_score FROM {_LANG}""",
    "langid_confusion": f"SELECT lang, {_TAG} AS lang_tag, count(*) AS docs FROM {_LANG} GROUP BY ALL",
    "pii_counts": rf"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(t, '[A-Za-z0-9._+\-]+@([A-Za-z0-9.\-]*)', 1), lambda d: contains(d, '.') AND length(regexp_replace(d, '[.\-]+\z', '')) >= 3)) AS email,
  len(list_filter(regexp_extract_all(t, '://(/?[^\s/@]*@\S*)', 1), lambda r: regexp_matches(r, ':.*@'))) AS url,
  ({' + '.join(f"len(regexp_extract_all(t, '{p}[A-Za-z0-9_.{chr(92)}-]{{8}}'))" for p in P.KEY_PREFIXES)})::BIGINT AS key,
  len(regexp_extract_all(d, '(^|[^A-Za-z0-9])[A-Z]{{1,2}}[0-9]{{5,8}}($|[^A-Za-z0-9])')) AS id,
  len(list_filter(regexp_extract_all(t, '[0-9.]+[A-Za-z]?'), lambda r: regexp_matches(r, '\A({_OCTET}\.){{3}}{_OCTET}\.?\z'))) AS ip
FROM (SELECT doc_id, t, regexp_replace(t, '([^A-Za-z0-9])', '\1\1', 'g') AS d FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))""",
    "dialog_acts": f"SELECT conv_id, turn, {_act('t', 'low')} AS act FROM (SELECT conv_id, turn, t, {_LOW.format(t='t')} AS low FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'))",
    "prev_user_turn": f"SELECT conv_id, turn, role, last_user, prev_text FROM {_CONV}",
    "reply_discipline": f"SELECT conv_id, turn, act, reason, reason = 'ok' AS disciplined FROM {_REPLIES} WHERE role = 'assistant'",
    "chat_gate": f"""
WITH c AS (SELECT conv_id, turn, role, {O.normalized(_stripped("coalesce(text, '')"))} AS text FROM conversations),
m AS (SELECT *, {O.verdict(Q.ENGLISH)} AS verdict, {_said('t', Y.HARD)} AS hard FROM {O.measured(f"(SELECT * EXCLUDE (low) FROM {_REPLIES.replace('FROM conversations WINDOW', 'FROM c WINDOW')})")}),
b AS (SELECT conv_id, turn, CASE WHEN strlen(t) < 2 THEN 'clean' WHEN verdict <> 'accept' THEN verdict END AS a,
  CASE WHEN EXISTS (SELECT 1 FROM (VALUES {_TERMS}) v(term) WHERE regexp_matches(low, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])')) THEN 'toxic'
  WHEN role = 'assistant' AND (hard OR reason = 'bad-mc-format') THEN 'robotic' END AS b FROM m)
SELECT conv_id, count(*) AS turns, coalesce(min_by(a, turn) FILTER (a IS NOT NULL), min_by(b, turn) FILTER (b IS NOT NULL), 'accept') AS verdict FROM b GROUP BY conv_id""",
    "reply_style": f"""
SELECT conv_id, turn, {_said('text', Y.BOILERPLATE)} AS boilerplate, {_said('text', Y.HARD)} AS hard, bullets, {_WORDS} <= 20 AND bullets > 3 AS too_many_bullets, {_COUNTED}
FROM (SELECT *, len(regexp_extract_all(text, '\\n[ \\t]*([-*]|[1-9][.)])'))::BIGINT AS bullets FROM {_REPLIES} WHERE role = 'assistant')""",
    "chat_render": "SELECT conv_id, '<s>' || string_agg('<|' || CASE WHEN role IN ('system', 'assistant') THEN role ELSE 'user' END || '|>' || coalesce(text, '') || '<|end|>', '' ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id",
    "chat_trim": """
WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
b AS (SELECT *, coalesce(max(CASE WHEN i <= n - 2 AND i >= 1 AND role <> 'assistant' THEN i END) OVER (PARTITION BY conv_id), 1) AS since FROM t)
SELECT conv_id, turn FROM b WHERE n <= 3 OR i = 0 OR i >= since""",
    "reply_scripts": f"""SELECT conv_id, turn, CASE WHEN {O.counted("coalesce(text, '')", C.ARABIC_LETTER + C.ARABIC_MARK)} >= {O.counted("coalesce(text, '')", C.LATIN)} THEN 'arabic' ELSE 'latin' END AS script FROM conversations WHERE role = 'user'""",
    "role_alias_map": "SELECT role, CASE lower(role) "
    + " ".join(f"WHEN '{a}' THEN '{r}'" for a, r in D.ROLE_ALIASES.items())
    + " END AS mapped, count(*) AS turns FROM conversations GROUP BY ALL",
}
