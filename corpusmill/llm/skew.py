"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one row in so many is spread; there are fewer such keys than this, which bounds their broadcast.
SHARES = 256


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], by: list[str], counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` on ``keys``; ``n`` of ``counts`` (default: of ``table``) says how many rows a key has.

    The rows of a common key are dealt out by a hash of the columns ``by`` over as many parts as the key has shares, and the
    few entries of ``table`` with that key are copied to each part. All copies together are fewer than SHARES.
    """
    counts = table if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = counts.filter(F.col("n") * SHARES > total).select(*keys, F.ceil(F.col("n") * SHARES / F.lit(max(total, 1))).cast("int").alias("_shares"))
    common = common.sparkSession.createDataFrame(common.distinct().collect(), common.schema)  # fewer than SHARES rows
    dealt = rows.join(F.broadcast(common), keys, "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_shares")), F.lit(0)).cast("int"))
    copied = table.drop("n").join(F.broadcast(common), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shares"), F.lit(1)) - 1)))
    return dealt.drop("_shares").join(copied.drop("_shares"), [*keys, "_part"], how).drop("_part")
