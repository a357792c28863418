"""Keyword retrieval over questions: BM25, fuzzy terms, trigram fallback. (RET1-3, JN4-6, AGG6, TOP1, SET6)

An index is three tables, so queries are equi-joins on terms. Unknown terms are matched with the index's
terms by edit distance; to avoid comparing all pairs, terms meet on keys that words within the
distance must share: the word itself and each way of leaving out up to two letters.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.operators.store import written


@dataclass(frozen=True)
class Index:
    docs: DataFrame  # id, norm, toks, len, pairs
    postings: DataFrame  # id, len, term, tf
    terms: DataFrame  # term, df, idf
    avg_len: float


def build(questions: DataFrame) -> Index:
    """An index of rows (id, question); of equal normalised questions the smallest id stays. Its tables are written once."""
    keyed = questions.select("id", T.retrieval_key(T.text("question")).alias("norm")).filter("norm <> ''")
    docs = keyed.groupBy("norm").agg(F.min("id").alias("id")).withColumn("toks", F.split("norm", " ")).withColumn("len", F.size("toks"))
    docs = written(docs.withColumn("pairs", F.array_distinct(neighbours(F.col("toks")))), "questions")
    postings = written(docs.select("id", "len", F.explode("toks").alias("term")).groupBy("id", "len", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    n, avg_len = docs.agg(F.count(F.lit(1)), F.avg("len")).first()
    terms = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).select("term", "df", (F.log(F.lit(max(n, 1) + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    return Index(docs, postings, written(terms, "terms"), max(avg_len or 1.0, 1.0))


def neighbours(toks: Column) -> Column:
    """The pairs of neighbouring words."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(toks) - 2), lambda i: F.concat_ws(" ", F.get(toks, i), F.get(toks, i + 1)))
    return F.when(F.size(toks) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def _deletions(word: Column, most: Column) -> Column:
    """The word and what leaving out one letter, or two where ``most`` is 2, makes of it."""
    places = lambda w: F.sequence(F.lit(1), F.length(w))
    cut = lambda w: F.when(F.length(w) > 0, F.transform(places(w), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))).otherwise(F.array().cast("array<string>"))
    once = cut(word)
    twice = F.when(most == 2, F.flatten(F.transform(once, cut))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def fuzzy_terms(unknown: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, best): for each unknown term the index's term within distance, rarest first, then alphabetical.

    The distance is 1 up to four bytes and 2 beyond; terms of more than 15 bytes match none.
    """
    most = F.when(F.octet_length("term") <= 4, 1).otherwise(2)
    # a byte a character, as the distance counts bytes
    raw = lambda c: F.decode(F.encode(F.col(c), "UTF-8"), "ISO-8859-1")
    asked = unknown.select("term").distinct().filter("octet_length(term) between 1 and 15").select("term", most.alias("most"), raw("term").alias("raw"))
    keys = asked.select("term", "most", "raw", F.explode(_deletions(F.col("raw"), F.col("most"))).alias("key"))
    known = terms.filter("octet_length(term) <= 15").select(F.col("term").alias("cand"), "idf", raw("term").alias("cand_raw"))
    known = known.select("*", F.explode(_deletions(F.col("cand_raw"), F.lit(2))).alias("key"))
    near = keys.join(known, "key").select("term", "most", "raw", "cand", "cand_raw", "idf").distinct().filter(F.levenshtein("raw", "cand_raw") <= F.col("most"))
    return near.groupBy("term").agg(F.min(F.struct(-F.col("idf"), "cand")).alias("top")).select("term", F.col("top.cand").alias("best"))


def bm25(index: Index, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, id, score) of every question that shares a term, or a fuzzy one, with rows (qid, norm)."""
    asked = written(queries.select("qid", F.explode(F.split("norm", " ")).alias("term")).filter("term <> ''").groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qf")), "asked")
    known = asked.join(index.terms.select("term"), "term", "left_semi").select("qid", "qf", "term", F.lit(1.0).alias("weight"))
    unknown = asked.join(index.terms.select("term"), "term", "left_anti")
    loose = unknown.join(fuzzy_terms(unknown, index.terms), "term").select("qid", "qf", F.col("best").alias("term"), F.lit(0.75).alias("weight"))
    used = known.unionByName(loose).join(index.terms.select("term", "idf"), "term")
    hits = used.join(index.postings, "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / index.avg_len))
    return hits.groupBy("qid", "id").agg(F.sum(F.col("weight") * part * (1 + 0.1 * (F.col("qf") - 1))).alias("score"))


def trigrams(t: Column) -> Column:
    """Runs of three characters of a text with a blank at both ends."""
    padded = F.concat(F.lit(" "), t, F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))


def dice(left: DataFrame, right: DataFrame) -> DataFrame:
    """(qid, id, dice) of texts that share a trigram: rows (qid, norm) and (id, norm)."""
    a = left.filter("norm <> ''").select("qid", F.explode(trigrams(F.col("norm"))).alias("g")).groupBy("qid", "g").agg(F.count(F.lit(1)).alias("m"))
    b = right.filter("norm <> ''").select("id", F.explode(trigrams(F.col("norm"))).alias("g")).groupBy("id", "g").agg(F.count(F.lit(1)).alias("n"))
    shared = a.join(b, "g").groupBy("qid", "id").agg(F.sum(F.least("m", "n")).alias("both"))
    sized = shared.join(a.groupBy("qid").agg(F.sum("m").alias("ms")), "qid").join(b.groupBy("id").agg(F.sum("n").alias("ns")), "id")
    return sized.select("qid", "id", (2 * F.col("both") / (F.col("ms") + F.col("ns"))).alias("dice"))


def query(index: Index, queries: DataFrame, top: int = 5, min_score: float = 0.0) -> DataFrame:
    """(qid, rank, id, score): the best questions for rows (qid, text).

    BM25, or twice the trigram similarity where no term matches; 0.5 for each shared pair of neighbouring words; 5 where the question holds the query.
    """
    asked = queries.select("qid", T.retrieval_key(T.text("text")).alias("norm")).filter("norm <> ''")
    scored = written(bm25(index, asked), "scored")
    silent = asked.join(scored.select("qid").distinct(), "qid", "left_anti")
    loose = dice(silent, index.docs.select("id", "norm")).filter("dice >= 0.25").select("qid", "id", (2 * F.col("dice")).alias("score"))
    words = F.split("asked", " ")
    asked = asked.withColumnRenamed("norm", "asked").withColumn("asked_pairs", neighbours(words)).withColumn("most", 5.0 + 0.5 * F.size("asked_pairs"))
    # no bonus lifts a question above one that is ahead by more than all bonuses together, so only those near the top need their words
    both = scored.unionByName(loose).join(asked.select("qid", "most"), "qid")
    ranked = both.withColumn("place", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("place") <= top)
    bar = ranked.groupBy("qid").agg(F.min(F.when(F.col("place") == top, F.col("score"))).alias("bar"))
    near = both.join(bar, "qid", "left").filter(F.col("bar").isNull() | (F.col("score") + F.col("most") >= F.col("bar") - 1e-6)).select("qid", "id", "score")
    all_hits = near.join(asked, "qid").join(index.docs.select("id", "norm", "pairs"), "id")
    shared = F.size(F.filter("asked_pairs", lambda p: F.array_contains("pairs", p)))
    total = F.col("score") + 0.5 * shared + F.when(F.contains(F.col("norm"), F.col("asked")), 5.0).otherwise(0.0)
    ranked = all_hits.select("qid", "id", F.round(total, 6).alias("score")).filter(F.col("score") >= min_score)
    return ranked.withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top).select("qid", "rank", "id", "score")


def grounded(index: Index, answers: DataFrame, queries: DataFrame, threshold: float = 3.0, direct: bool = True) -> DataFrame:
    """(qid, mode, text): for each row (qid, text) the answer of its best question at the threshold or above, else nothing found. (RET3)

    ``answers`` has id and answer of the indexed questions. Mode is ``direct`` with the answer itself, ``context`` with the answer as a system
    message that goes before the user's, or ``generate`` with null text.
    """
    best = query(index, queries, 1, threshold).join(answers.select("id", "answer"), "id").select("qid", "answer")
    found = queries.select("qid").distinct().join(best, "qid", "left")
    text = F.col("answer") if direct else F.concat(F.lit("Context (from dataset): "), "answer")
    return found.select("qid", F.when(F.col("answer").isNull(), "generate").otherwise("direct" if direct else "context").alias("mode"), text.alias("text"))
