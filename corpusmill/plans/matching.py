"""Queries over hashes, duplicates and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.functions import text as T
from corpusmill.operators import dedup, retrieval
from corpusmill.plans import oracle as O
from corpusmill.plans.curation import table


def hash_fnv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", H.fnv_hex(T.text("text")).alias("fnv"))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """5 % of documents by the hash of their canonical text. (FLT24)"""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.text("text").alias("t"))
    key = F.when(T.canonical(F.col("t")) != "", T.canonical(F.col("t"))).otherwise(F.col("t"))
    return docs.select("doc_id", F.when(H.fnv_mod(key, 10_000) < 500, "val").otherwise("train").alias("split"))


def minhash_sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures and band keys of benchmark items."""
    return dedup.signed(table(spark, sf_dir, "benchmark"), "item_id").select(F.col("id").alias("item_id"), F.transform("signature", F.hex).alias("signature"), F.transform("bands", F.hex).alias("bands"))


def lsh_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar pairs of different canonical texts."""
    rows = dedup.signed(table(spark, sf_dir, "documents"), "doc_id").filter("key is not null")
    heads = rows.groupBy("key").agg(F.min_by(F.struct("id", "signature", "bands"), "id").alias("r")).select("r.*")
    return dedup.similar_pairs(dedup.written(heads, "heads")).select("a", "b", F.round("est", 6).alias("est"))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.greedy(table(spark, sf_dir, "documents").select("doc_id", "text"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the benchmark as blocklist, counted by verdict. (AGG10)"""
    found = dedup.greedy(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.groupBy("verdict").agg(F.count(F.lit(1)).alias("docs"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))


def bm25_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.build(_questions(spark, sf_dir)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best questions for each benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")
    return retrieval.query(retrieval.build(_questions(spark, sf_dir)), items)


def fuzzy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the benchmark that no question has, with the nearest word that one has."""
    index = retrieval.build(_questions(spark, sf_dir))
    asked = table(spark, sf_dir, "benchmark").select(F.explode(F.split(T.retrieval_key(T.text("text")), " ")).alias("term")).filter("term <> ''").distinct()
    return retrieval.fuzzy_terms(asked.join(index.terms, "term", "left_anti"), index.terms)


def trigram_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items and questions with a trigram similarity of 0.6 or more."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), T.retrieval_key(T.text("text")).alias("norm"))
    found = retrieval.dice(items, retrieval.build(_questions(spark, sf_dir)).docs.select("id", "norm"))
    return found.filter("dice >= 0.6").select("qid", "id", F.round("dice", 6).alias("dice"))


QUERIES = {f.__name__: f for f in (hash_fnv, train_val_split, minhash_sig, lsh_pairs, near_dedup, decontaminate, bm25_idf, bm25_topk, fuzzy_terms, trigram_dice)}


def _wrap(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)"


#: FNV-1a over the UTF-8 bytes of {t}, two hexadecimal digits at a time.
_FNV = f"""list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform(range(0, strlen({{t}})), lambda i: ('0x' || hex(encode({{t}}))[2 * i + 1 : 2 * i + 2])::UHUGEINT)),
  lambda h, b: {_wrap('xor(h, b) * 1099511628211::UHUGEINT')})"""
_KEY = r"""translate(regexp_replace({t}, '[\x{64B}-\x{652}]', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


def _key(t: str) -> str:
    plain = _KEY.replace("{t}", t)
    loose = rf"regexp_matches({t}, '[^\x00-\x7F]') OR regexp_matches({t}, '[A-Za-z][23579]|[23579][A-Za-z]')"
    return rf"trim(regexp_replace(CASE WHEN {loose} THEN translate({plain}, '37952', 'ahqka') ELSE {plain} END, '[\x00-/:-`{{-\x7F]+', ' ', 'g'))"


_INDEX = f"""
k AS (SELECT conv_id * 1000 + turn AS id, {_key("coalesce(text, '')")} AS norm FROM conversations WHERE role = 'user'),
docs AS (SELECT norm, min(id) AS id, string_split(norm, ' ') AS toks, len(string_split(norm, ' ')) AS len FROM k WHERE norm <> '' GROUP BY norm),
postings AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM docs) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM docs) + 1.0::double) / (count(*) + 1)) + 1 AS idf FROM postings GROUP BY term),
asked AS (SELECT item_id AS qid, {_key("coalesce(text, '')")} AS norm FROM benchmark),
words AS (SELECT qid, term, count(*) AS qf FROM (SELECT qid, unnest(string_split(norm, ' ')) AS term FROM asked WHERE norm <> '') WHERE term <> '' GROUP BY ALL),
fuzzy AS (
  SELECT term, arg_min(cand, struct_pack(a := -idf, b := cand)) AS best
  FROM (SELECT DISTINCT term FROM words WHERE term NOT IN (SELECT term FROM terms) AND strlen(term) BETWEEN 1 AND 15) u
  JOIN (SELECT term AS cand, idf FROM terms WHERE strlen(term) <= 15) t ON abs(strlen(term) - strlen(cand)) <= 2
  WHERE levenshtein(term, cand) <= CASE WHEN strlen(term) <= 4 THEN 1 ELSE 2 END GROUP BY term)"""

_SPLIT = f"(SELECT doc_id, CASE WHEN k <> '' THEN k ELSE t END AS t FROM (SELECT doc_id, coalesce(text, '') AS t, {O.canonical('coalesce(text, ' + chr(39) * 2 + ')')} AS k FROM documents))"


ORACLES = {
    "train_val_split": f"SELECT doc_id, CASE WHEN {_FNV.replace('{t}', 't')} % 10000 < 500 THEN 'val' ELSE 'train' END AS split FROM {_SPLIT}",
    "hash_fnv": f"SELECT conv_id, turn, lower(lpad(hex({_FNV.replace('{t}', 't')}), 16, '0')) AS fnv FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)",
    "bm25_idf": f"WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "fuzzy_terms": f"WITH {_INDEX} SELECT term, best FROM fuzzy",
    "bm25_topk": f"""
WITH {_INDEX},
use AS (SELECT qid, term, qf, 1.0 AS weight FROM words WHERE term IN (SELECT term FROM terms) UNION ALL SELECT qid, best, qf, 0.75 FROM words JOIN fuzzy USING (term)),
acc AS (
  SELECT qid, id, sum(weight * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / greatest((SELECT avg(len) FROM docs), 1))) * (1 + 0.1 * (qf - 1))) AS score
  FROM use JOIN postings USING (term) JOIN terms USING (term) JOIN docs USING (id) GROUP BY qid, id),
s AS (
  SELECT qid, id, round(score + 0.5 * len(list_filter(range(1, len(q)), lambda i: list_contains(list_transform(range(1, len(toks)), lambda j: toks[j] || ' ' || toks[j + 1]), q[i] || ' ' || q[i + 1])))
    + CASE WHEN contains(docs.norm, a.norm) THEN 5 ELSE 0 END, 6)::double AS score
  FROM acc JOIN docs USING (id) JOIN (SELECT qid, norm, string_split(norm, ' ') AS q FROM asked) a USING (qid))
SELECT qid, rank::INT AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""",
    "trigram_dice": f"""
WITH {_INDEX},
a AS (SELECT qid, g, count(*) AS m FROM (SELECT qid, substr(' ' || norm || ' ', unnest(range(1, length(norm) + 1)), 3) AS g FROM asked WHERE norm <> '') GROUP BY ALL),
b AS (SELECT id, g, count(*) AS n FROM (SELECT id, substr(' ' || norm || ' ', unnest(range(1, length(norm) + 1)), 3) AS g FROM docs) GROUP BY ALL),
s AS (SELECT qid, id, sum(least(m, n)) AS shared FROM a JOIN b USING (g) GROUP BY ALL),
d AS (SELECT qid, id, 2 * shared / (ms + ns) AS dice FROM s JOIN (SELECT qid, sum(m) AS ms FROM a GROUP BY qid) USING (qid) JOIN (SELECT id, sum(n) AS ns FROM b GROUP BY id) USING (id))
SELECT qid, id, round(dice, 6) AS dice FROM d WHERE dice >= 0.6""",
}
