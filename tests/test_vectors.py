"""Vector queries on numbers that the given tables hardly hold, against their SQL."""

import math

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import vectors as V
from corpusmill.plans import catalogue


def exact(rows):
    """Numbers in full, with the signs of zeros."""
    return {i: None if v is None else [repr(x) for x in v] for i, v in rows}


def small_sums():
    """Vectors whose sums, or some of whose numbers, are just below and above 0."""
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(40, 64)).astype(np.float32)
    rows[:, 0] -= rows.sum(axis=1)
    rows[::2, 3], rows[1::2, 3] = -2e-6, 2e-6
    rows[-3:] = [[-1e-9] * 64, [0.0] * 64, [-1.0, 1.0 - 2.0**-23] + [0.0] * 62]
    return rows


@pytest.mark.parametrize(("name", "column"), [("vec_linear", "out"), ("vec_rmsnorm", "normed")])
def test_signs_of_zeros_match_sql(spark, tmp_path, name, column):
    rows = small_sums()
    table = pa.table({"vec_id": pa.array(range(len(rows)), pa.int64()), "embedding": pa.array(list(rows), pa.list_(pa.float32())), "label": pa.array([0] * len(rows), pa.int32())})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    connection = duckdb.connect()
    connection.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    want = exact(connection.sql(f"select vec_id, {column} from ({catalogue.ORACLES[name]})").fetchall())
    got = exact((r.vec_id, r[column]) for r in catalogue.QUERIES[name](spark, str(tmp_path)).collect())
    assert any("-0.0" in v for v in want.values()) and got == want


def test_rounding_matches_sql(spark):
    rng = np.random.default_rng(4)
    values = [0.0, -0.0, 1e-7, -1e-7, 0.5e-5, -0.5e-5, 1.000005, 2.675, -1.005, 0.49999999999999994e-5, 2.0**52, -(2.0**60) / 3, 1e300, math.inf, -math.inf, math.nan]
    values += [*rng.normal(size=300).tolist(), *((rng.integers(-(10**7), 10**7, 300) + 0.5) / 1e5).tolist(), *(rng.normal(size=50) * 1e12).tolist()]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").orderBy("i").select(V.rounded(F.col("x"), 5)).collect()]
    connection = duckdb.connect()
    want = [connection.execute("select round(?::double, 5)", [v]).fetchone()[0] for v in values]
    assert [repr(v) for v in got] == [repr(v) for v in want]


def test_products_do_not_depend_on_the_batch(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(70, 33)) * 10.0 ** rng.integers(-8, 8, (70, 33))
    weights = rng.normal(size=(3, 33)).tolist()
    want = []
    for row in rows.tolist():
        sums = [0.0] * 3
        for j, v in enumerate(row):
            sums = [s + v * w[j] for s, w in zip(sums, weights)]
        want.append(sums)
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows.tolist())], "i long, v array<double>").repartition(3)
    assert [r.out for r in df.select("i", V.linear(F.col("v"), weights).alias("out")).orderBy("i").collect()] == want


def test_rmsnorm_of_what_is_not_finite(spark):
    rows = [([3.0, float("nan")],), ([1e200, 1.0],), ([1.0, None],), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v array<double>").select(V.rmsnorm(F.col("v"))).collect()]
    assert got == [[0.0, 0.0], [0.0, 0.0], [None, None], None]
