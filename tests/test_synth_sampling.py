from pyspark.sql import functions as F

from corpusmill.functions import sampling as S
from corpusmill.operators import synth


def test_generation_is_seeded_and_capped(spark):
    a, b = (sorted(map(str, synth.generate(spark, 200, seed=4).repartition(n).collect())) for n in (1, 7))
    assert a == b and a != sorted(map(str, synth.generate(spark, 200, seed=5).collect()))
    capped = synth.generate(spark, 400, seed=4, per_template=2).groupBy("template_id").count().collect()
    assert max(r["count"] for r in capped) == 2
    assert all(r.messages[0].role == "user" and "{}" not in r.messages[0].content + r.messages[1].content for r in synth.generate(spark, 50).collect())


def test_sampling_functions(spark):
    df = spark.createDataFrame([([1.0, -2.0, 3.0], [2, 2, 1], [5, 6, 7, 5, 6])], "x array<double>, recent array<int>, ids array<int>")
    r = df.select(S.penalized(F.col("x"), F.col("recent"), 2.0, 0.5, 0.25), S.banned(F.col("ids"), 3), S.banned(F.slice("ids", 1, 2), 3)).first()
    assert r[0] == [1.0, -4.75, 0.25] and r[1] == [7] and r[2] == []
    losses = spark.createDataFrame([(1.0, 10), (2.0, 30)], "nll double, n long").agg(S.perplexity(F.col("nll"), F.col("n"))).first()[0]
    assert abs(losses - 2.718281828**1.75) < 1e-6
