"""Greedy duplicate removal in document order, with a blocklist. (DED1-4, SET1-5, JN2-3, AGG10)

A document is dropped if its canonical text is empty or was seen before, if it is on the blocklist, or if its
estimated similarity with a kept earlier document or a blocklist entry reaches the threshold.
The last rule is a fixed point over the few similar pairs: a document with a kept earlier neighbour goes, one whose
earlier neighbours are all gone stays, and so on until none is open.

Tables of documents or pairs are small as compressed Parquet but not in memory, so joins with them are sorted merges, never broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import hashing as H
from corpusmill.functions import text as T
from corpusmill.operators.store import written


def signed(df: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """(id, key, signature, bands) of each row's canonical text."""
    canon = df.select(F.col(id_column).cast("long").alias("id"), T.canonical(T.text(text)).alias("canon"))
    return canon.select("id", F.when(F.col("canon") != "", F.sha2("canon", 256)).alias("key"), H.signatures(T.words(F.col("canon"))).alias("s")).select("id", "key", "s.*")


def estimate(a: str, b: str):
    """The share of equal hashes of two signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def similar_pairs(rows: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(a, b, est), a < b: rows (id, signature, bands) that share a band key and reach the threshold."""
    keyed = rows.select("id", F.posexplode("bands").alias("band", "key"))
    pairs = keyed.alias("x").join(keyed.alias("y").hint("merge"), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    pairs = pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    both = pairs.join(rows.select(F.col("id").alias("a"), F.col("signature").alias("sa")).hint("merge"), "a").join(rows.select(F.col("id").alias("b"), F.col("signature").alias("sb")).hint("merge"), "b")
    return both.select("a", "b", estimate("sa", "sb").alias("est")).filter(F.col("est") >= threshold)


def greedy(docs: DataFrame, blocklist: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """(doc_id, verdict) of rows (doc_id, text): kept, exact_dup, near_dup or blocked."""
    rows = written(signed(docs, "doc_id"), "signed")
    blocked = signed(blocklist, blocklist.columns[0]).filter("key is not null") if blocklist is not None else rows.limit(0)
    blocked = written(blocked.select((-F.col("id") - 1).alias("id"), "key", "signature", "bands"), "blocklist")
    listed = rows.join(blocked.select("key").distinct(), "key", "left_semi").select("id")
    rest = rows.filter("key is not null").join(blocked.select("key").distinct(), "key", "left_anti")
    first = rest.groupBy("key").agg(F.min("id").alias("id"))
    heads = written(rest.join(first, ["key", "id"]).dropDuplicates(["id"]).select("id", "key", "signature", "bands"), "heads")

    # blocklist entries have negative ids, so they come before every document
    pairs = written(similar_pairs(heads.unionByName(blocked), threshold).filter("b >= 0").select("a", "b"), "pairs")
    state = heads.select("id").join(pairs.select(F.col("b").alias("id")).distinct().hint("merge"), "id", "left_anti").withColumn("verdict", F.lit("kept"))
    hit = pairs.filter("a < 0").select(F.col("b").alias("id")).distinct().withColumn("verdict", F.lit("blocked"))
    state = written(state.unionByName(hit), "state")
    open_pairs = pairs.filter("a >= 0")
    while True:
        left = open_pairs.join(state.select(F.col("id").alias("b")).hint("merge"), "b", "left_anti")
        judged = left.join(state.select(F.col("id").alias("a"), "verdict").hint("merge"), "a", "left").groupBy(F.col("b").alias("id")).agg(
            F.max((F.col("verdict") == "kept").cast("int")).alias("near"), F.min(F.col("verdict").isNotNull().cast("int")).alias("settled")
        )
        new = judged.filter("near = 1 or settled = 1").select("id", F.when(F.coalesce(F.col("near"), F.lit(0)) == 1, "near_dup").otherwise("kept").alias("verdict"))
        new = written(new, "new")
        if new.isEmpty():
            break
        state = written(state.unionByName(new), "state")
    out = rows.select("id").join(state.hint("merge"), "id", "left").join(listed.distinct().withColumn("on_list", F.lit(True)).hint("merge"), "id", "left")
    verdict = F.coalesce(F.when(F.col("on_list"), "blocked"), F.col("verdict"), F.lit("exact_dup"))
    return out.select(F.col("id").alias("doc_id"), verdict.alias("verdict"))


def is_duplicate(texts: DataFrame, kept: DataFrame, blocklist: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """(id, duplicate) for rows (id, text), asked of documents kept so far, whose state does not change. (DED2)

    A text without a canonical form, one that is on the blocklist or kept already, and one similar to a kept one or to an entry is a duplicate.
    """
    asked = written(signed(texts, texts.columns[0]), "asked")
    known = signed(kept, kept.columns[0])
    if blocklist is not None:
        known = known.unionByName(signed(blocklist, blocklist.columns[0]))
    known = written(known.filter("key is not null").dropDuplicates(["key"]).drop("id").withColumn("id", F.monotonically_increasing_id()), "known")
    same = asked.join(known.select("key"), "key", "left_semi").select("id")
    open_rows = asked.filter("key is not null").join(known.select("key"), "key", "left_anti")
    left = open_rows.select(F.col("id").alias("a"), F.posexplode("bands").alias("band", "key"))
    right = known.select(F.col("id").alias("b"), F.posexplode("bands").alias("band", "key"))
    pairs = left.join(right, ["band", "key"]).select("a", "b").distinct()
    both = pairs.join(open_rows.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(known.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    near = both.filter(estimate("sa", "sb") >= threshold).select(F.col("a").alias("id"))
    empty = asked.filter("key is null").select("id")
    hit = same.union(near).union(empty).distinct().withColumn("duplicate", F.lit(True))
    return asked.select("id").join(hit, "id", "left").select("id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))
