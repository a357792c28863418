"""Intermediate tables that survive lost executors.

Iterative operators cut their lineage by writing Parquet to the folder that the
cluster shares (``spark.checkpoint.dir``) and reading it back.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from corpusmill.operators.store import written  # noqa: F401

#: Rows per Arrow batch; Spark's default of 10,000 whole documents would be too large a block.
ARROW_ROWS = 1024

#: Spark's setting that deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_alone(df: DataFrame, name: str) -> DataFrame:
    """``written``, which leaves no shuffle files behind; others stay until the driver's JVM collects its garbage."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.set(_CLEANUP, before) if before is not None else conf.unset(_CLEANUP)


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that no plan still to run reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(unquote(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name


def arrow_ready(spark: SparkSession) -> None:
    """Keep Arrow batches of whole documents small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
