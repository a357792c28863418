"""Curation as Structured Streaming. (STR1-3)

Files are pulled batch by batch with ``maxFilesPerTrigger``; a checkpoint makes each batch count once.
Event-time windows go beyond the file formats' needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import quality as Q
from corpusmill.functions import text as T


def documents(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """A stream of Parquet files below a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def accepted(stream: DataFrame, rules: Q.QualityRules = Q.QualityRules()) -> DataFrame:
    """Documents that pass the quality rules."""
    return Q.with_verdict(stream, rules).filter("verdict = 'accept'").drop("verdict")


def deduplicated(stream: DataFrame, within: str | None = None) -> DataFrame:
    """The first document of each canonical text. (STR2)

    With ``within`` (of a watermarked ``ts``) the state is bounded; without it every key is kept for good, as duplicates may come at any time: a
    stream that goes on for long should set it, or use a state store on disk.
    """
    keyed = stream.withColumn("key", F.sha2(T.canonical(T.text("text")), 256))
    if within:
        return keyed.withWatermark("ts", within).dropDuplicatesWithinWatermark(["key"])
    return keyed.dropDuplicates(["key"])


def event_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Events by type and window, closed by a watermark."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def run_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there, append it to Parquet, and stop; a later call goes on from the checkpoint."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
