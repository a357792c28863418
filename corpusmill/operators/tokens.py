"""Token windows, offsets, shards and packing. (WIN5-7, SNK2, PCK2, JN7, AGG19)

Positions over a whole table come from two sums: one over blocks of ids, of which there are few, and one
within each block. No task sees more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ids in a block.
BLOCK = 4096


def windows(tokens: Column, size: int) -> Column:
    """A token array cut in windows; the last may be short, an empty array has none."""
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(0), F.size(tokens) - 1, F.lit(size)), lambda at: F.slice(tokens, at + 1, size))).otherwise(F.array().cast("array<array<string>>"))


def with_offsets(df: DataFrame, key: str, size: str, block: int = BLOCK, within: str | None = None) -> DataFrame:
    """``df`` with start: the sum of ``size`` over all rows with a smaller ``key``; with ``within``, over those of the same group.

    A block is ``block`` neighbouring key values, and blocks are summed up in two levels, so that no task sees all of them.
    """
    group = [within] if within else []
    blocked = df.withColumn("_block", F.floor(F.col(key) / block)).withColumn("_upper", F.floor(F.col("_block") / block))
    sums = blocked.groupBy(*group, "_upper", "_block").agg(F.sum(size).alias("_sum"))
    tops = sums.groupBy(*group, "_upper").agg(F.sum("_sum").alias("_all"))
    before_top = tops.select(*group, "_upper", (F.sum("_all").over(W.partitionBy(*group).orderBy("_upper")) - F.col("_all")).alias("_low"))
    before = sums.select(*group, "_upper", "_block", (F.sum("_sum").over(W.partitionBy(*group, "_upper").orderBy("_block")) - F.col("_sum")).alias("_before"))
    inside = F.sum(size).over(W.partitionBy(*group, "_block").orderBy(key).rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col(size)
    out = blocked.withColumn("_inside", inside)
    for table, keys in ((before, [*group, "_upper", "_block"]), (before_top, [*group, "_upper"])):
        renamed = table.select(*[F.col(c).alias(f"_k{c}") if c in keys else F.col(c) for c in table.columns])
        out = out.join(renamed, [F.col(c).eqNullSafe(F.col(f"_k{c}")) for c in keys]).drop(*[f"_k{c}" for c in keys])
    return out.withColumn("start", F.col("_inside") + F.col("_before") + F.col("_low")).drop("_block", "_upper", "_inside", "_before", "_low")


def positions(offsets: DataFrame, key: str, size: str, every: int) -> DataFrame:
    """(position, key, at): which row holds each ``every``-th token, and where in it. No join: a row lists its own."""
    first = F.ceil(F.col("start") / every) * every
    own = offsets.filter(F.col(size) > 0).withColumn("_first", first).filter(F.col("_first") < F.col("start") + F.col(size))
    return own.select(key, "start", F.explode(F.sequence("_first", F.col("start") + F.col(size) - 1, F.lit(every).cast("long"))).alias("position")).select("position", key, (F.col("position") - F.col("start")).alias("at"))


def sharded(df: DataFrame, key: str, size: str, shard_tokens: int, split: str = "split") -> DataFrame:
    """``df`` with shard: whole rows go to the shard that their first token falls in, numbered within each split, null among them."""
    return with_offsets(df, key, size, within=split).withColumn("shard", F.floor(F.col("start") / shard_tokens))


def next_token_rows(offsets: DataFrame, tokens: str, key: str, length: int) -> DataFrame:
    """(row, segments): packed rows of ``length`` tokens; each segment is (start in row, key, tokens).

    Documents follow each other without padding; one that meets the end of a row goes on in the next.
    """
    n = F.size(tokens)
    first, last = F.floor(F.col("start") / length), F.floor((F.col("start") + n - 1) / length)
    cut = offsets.filter(n > 0).select(key, "start", tokens, F.explode(F.sequence(first, last)).alias("row"))
    lo = F.greatest(F.col("row") * length - F.col("start"), F.lit(0))
    piece = F.slice(tokens, (lo + 1).cast("int"), F.least(F.lit(length), (F.col("row") + 1) * length - F.col("start") - lo).cast("int"))
    at = (F.col("start") + lo - F.col("row") * length).cast("int")
    return cut.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), F.col(key), piece.alias("tokens")))).alias("segments"))


def batches(packed: DataFrame) -> DataFrame:
    """(row, ids, targets, segment_ids): a token's target is the next one of its document, null at its end."""
    ids = F.flatten(F.transform("segments", lambda s: s["tokens"]))
    targets = F.flatten(F.transform("segments", lambda s: F.transform(s["tokens"], lambda _, i: F.get(s["tokens"], i + 1))))
    segment = F.flatten(F.transform("segments", lambda s, k: F.transform(s["tokens"], lambda _: k)))
    return packed.select("row", ids.alias("ids"), targets.alias("targets"), segment.alias("segment_ids"))
