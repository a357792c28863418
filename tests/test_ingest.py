import json

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import ingest as I
from corpusmill.streaming import streams


def test_documents_by_columns(spark):
    rows = [("q", "a", "", "", "", "x"), ("", "", "", "u", "r", "x"), ("", "", '["hi","yo"]', "", "", ""), ("", "", '[{"role":"tool","content":"no"},{"from":"human","value":"hi"}]', "", "", ""), ("", "", "", "", "", "note"), ("", "", "", "", "", "")]
    df = spark.createDataFrame(rows, "question string, answer string, messages_json string, user string, assistant string, b string")
    found = I.documents(df).collect()
    said = [[(m.role, m.content) for m in r.messages] if r.is_chat else r.text for r in found]
    assert said == [[("user", "q"), ("assistant", "a")], [("user", "u"), ("assistant", "r")], [("user", "hi"), ("assistant", "yo")], [("user", "hi")], "note"]
    with pytest.raises(ValueError):
        I.documents(df.select("b"), "qa")


def test_json_documents(spark, tmp_path):
    lines = [{"messages": [{"role": "system", "content": "s"}, {"role": "gpt", "content": "g"}]}, {"instruction": "i", "input": "x", "output": "o"}, {"text": "plain"}, {"other": 1}]
    (tmp_path / "a.jsonl").write_text("\n".join([json.dumps(x) for x in lines] + ["not json"]))
    found = I.json_documents(spark, str(tmp_path)).collect()
    assert [[(m.role, m.content) for m in r.messages] if r.is_chat else r.text for r in found] == [[("system", "s"), ("assistant", "g")], [("user", "i\nx"), ("assistant", "o")], "plain"]


def test_csv(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text('id,darija,darija_ar,eng\n1,"sla,m",سلام,hello\n2,bzaf,بزاف,"a ""lot"""\n')
    assert {r.line for r in I.csv_lines(spark, str(p)).collect()} == {"sla,m", "سلام", "hello", "bzaf", "بزاف", 'a "lot"', "sla,m / سلام", "bzaf / بزاف"}
    pairs = I.csv_pairs(spark, str(p)).collect()
    assert sorted(r.id for r in pairs) == [1_000_000, 1_000_001, 1_000_002, 1_000_003]


def test_parquet_keeps_strings_and_inspects(spark, tmp_path):
    spark.createDataFrame([("a", 1, None), (None, 2, "é" * 10)], "x string, n int, y string").write.parquet(str(tmp_path / "d"))
    rows = {tuple(r) for r in I.parquet(spark, str(tmp_path)).collect()}
    assert rows == {("a", ""), ("", "é" * 10)}
    assert I.inspect(spark, str(tmp_path)).first()["rows"] == 2
    assert I.inspect(spark, str(tmp_path / "none")).first()["rows"] == -1


def test_conversations_round_trip(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "a\nb"), (1, 1, "assistant", "c")], "conv_id long, turn long, role string, text string")
    I.write_conversations(turns, str(tmp_path / "c"))
    assert sorted(map(tuple, I.read_conversations(spark, str(tmp_path / "c")).collect())) == sorted(map(tuple, turns.collect()))


def test_config_is_strict():
    assert I.config("a: 1\nb:\n  c: [x, 2]\n  d: yes # note\n") == {"a": 1, "b.c": ["x", 2], "b.d": True}
    for bad in ("a: 1\na: 2", "\ta: 1", "a: &x 1", "a: |"):
        with pytest.raises(ValueError):
            I.config(bad)
    with pytest.raises(ValueError):
        I.config("a: 1", {"b"})


def test_streaming_dedup_resumes(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    docs([(1, "Hello  world"), (2, "hello world"), (3, "other")]).write.parquet(src)
    run = lambda: streams.run_once(streams.deduplicated(streams.documents(spark, src, "doc_id long, text string")), out, ck)
    run()
    docs([(4, "OTHER"), (5, "new")]).write.mode("append").parquet(src)
    run()
    kept = {r.doc_id for r in spark.read.parquet(out).collect()}
    assert len(kept) == 3 and 5 in kept and len(kept & {1, 2}) == 1 and len(kept & {3, 4}) == 1


def test_numbered_is_a_permutation(spark):
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("k"))
    assert sorted(r.id for r in I.numbered(rows, "k", 10).collect()) == list(range(10, 510))
