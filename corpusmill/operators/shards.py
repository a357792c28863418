"""Token shards: checked writing, pruned reading, supervised rows, weighted mixes that can be resumed. (SNK1, SRC18-19, PCK1, PCK3-4, TOP8)"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A target that no loss is taken of. Fixed value.
IGNORED = -100


def write(rows: DataFrame, path: str, vocab: int) -> None:
    """Rows (split, domain, shard, seq, tokens, mask) as Parquet by split and domain; fails on tokens out of range and masks that are not 0 or 1 for each token."""
    in_range = F.forall("tokens", lambda t: (t >= 0) & (t < vocab))
    masked = F.col("mask").isNull() | ((F.size("mask") == F.size("tokens")) & F.forall("mask", lambda m: m.isin(0, 1)))
    checked = F.when(~F.coalesce(in_range, F.lit(False)), F.raise_error(F.lit(f"a token is not in [0, {vocab})"))).when(~masked, F.raise_error(F.lit("a mask is not 0 or 1 for each token"))).otherwise(F.col("tokens"))
    rows.withColumn("tokens", checked.cast("array<int>")).write.partitionBy("split", "domain").parquet(path)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The files of a table, in the order of their names. (TOP8)"""
    return sorted(spark.read.parquet(path).inputFiles())


def read(spark: SparkSession, path: str, split: str | None = None, domains: list[str] | None = None) -> DataFrame:
    """Shards of a split and of exactly some domains; both prune folders. (SRC18-19)"""
    out = spark.read.parquet(path)
    out = out.filter(F.col("split") == split) if split is not None else out
    return out.filter(F.col("domain").isin(domains)) if domains is not None else out


def window(tokens: Column, start: Column | int, n: int) -> Column:
    """n tokens from a place on, counted from 0. (SRC18)"""
    return F.slice(tokens, (start if isinstance(start, Column) else F.lit(start)) + 1, n)


def supervised(tokens: Column, mask: Column, start: Column | int, length: int) -> tuple[Column, Column]:
    """(ids, targets) of a window: a target is the next token where that is learnt, else IGNORED, as at a document's end. (PCK1)"""
    at = start if isinstance(start, Column) else F.lit(start)
    ids = window(tokens, at, length)
    targets = F.transform(ids, lambda _, i: F.when((F.coalesce(F.get(mask, at + i + 1), F.lit(1)) == 1) & (at + i + 1 < F.size(tokens)), F.get(tokens, at + i + 1)).otherwise(IGNORED))
    return ids, targets


def inventory(shards: DataFrame) -> DataFrame:
    """(domain, shard, tokens) of shards. (AGG19)"""
    return shards.groupBy("domain", "shard").agg(F.sum(F.size("tokens")).alias("tokens"))


def mix(stock: DataFrame, weights: dict[str, float], rows: int, length: int, seed: int, skip: int = 0) -> DataFrame:
    """(row, domain, shard, start): where each row of a mix is read, rows numbered from ``skip`` on. (PCK3-4)

    A domain is drawn by its weight, then a token of it, so a shard by its tokens; a row's draws follow from its number and the seed
    alone, so a stream that skips n rows goes on exactly where n rows ended. Domains without shards that hold a row count as if they weren't named.
    """
    spark = stock.sparkSession
    able = stock.filter(F.col("tokens") > length)
    named = spark.createDataFrame([(d, float(w)) for d, w in weights.items() if w > 0], "domain string, weight double")
    order = W.partitionBy("domain").orderBy("shard")
    placed = able.join(F.broadcast(named), "domain").withColumn("upto", F.sum("tokens").over(order)).withColumn("since", F.col("upto") - F.col("tokens"))
    totals = {r.domain: (r.weight, r.tokens) for r in placed.groupBy("domain", "weight").agg(F.sum("tokens").alias("tokens")).collect()}
    if not totals:
        raise ValueError("no domain of the mix has a shard that holds a row")
    whole, upto, domain, tokens = sum(w for w, _ in totals.values()), 0.0, F, F
    names = sorted(totals)
    draw = lambda salt: F.pmod(F.xxhash64("row", F.lit(seed), F.lit(salt)), F.lit(1 << 53)) / float(1 << 53)
    for i, name in enumerate(names):
        upto += totals[name][0] / whole
        here = draw("domain") < (2.0 if i == len(names) - 1 else upto)
        domain, tokens = domain.when(here, name), tokens.when(here, totals[name][1])
    rows_ = spark.range(skip, skip + rows).withColumnRenamed("id", "row")
    drawn = rows_.select("row", domain.otherwise(names[-1]).alias("domain"), tokens.otherwise(0).alias("_all"))
    drawn = drawn.withColumn("_pick", F.floor(draw("token") * F.col("_all")))
    found = drawn.join(placed.select("domain", "shard", "since", "upto", "tokens"), "domain").filter((F.col("_pick") >= F.col("since")) & (F.col("_pick") < F.col("upto")))
    return found.select("row", "domain", "shard", F.floor(draw("start") * (F.col("tokens") - length)).alias("start"))
