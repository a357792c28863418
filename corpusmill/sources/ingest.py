"""Readers: files to rows (is_chat, text, messages), corpus lines, and question-answer pairs. (SRC1-17, SRC21)

Files are split, parsed and pruned by Spark's own sources; rows are shaped by expressions.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusmill.functions import dialog as D
from corpusmill.functions import hashing as H
from corpusmill.functions import text as T
from corpusmill.operators.store import written

MESSAGES = "array<struct<role:string,content:string>>"
# Fixed values.
LIST_KEYS = ("messages", "conversation", "turns", "dialogue", "history")
ROLE_KEYS = ("role", "from", "speaker", "author")
BODY_KEYS = ("content", "value", "text", "message", "utterance")
PROMPT_KEYS = ("instruction", "prompt", "question", "problem")
REPLY_KEYS = ("output", "completion", "answer", "response", "solution")
TEXT_KEYS = ("text", "content", "body", "article", "document")
META_COLUMNS = ("id", "source", "dataset_source", "metadata", "token_count", "word_count", "count", "freq")
MOST_MESSAGES = 128
VALUE_BYTES = 1 << 20


def parquet(spark: SparkSession, path: str, match: str = "", limit: int | None = None, value_bytes: int = VALUE_BYTES) -> DataFrame:
    """String columns of all Parquet files below a path, null as empty, values cut at ``value_bytes``. (SRC1, SRC3-5, TOP7)"""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{match}*.[pP][aA][rR][qQ][uU][eE][tT]").option("ignoreCorruptFiles", True)
    df = reader.parquet(path)
    names = [f.name for f in df.schema if isinstance(f.dataType, (ST.StringType, ST.BinaryType))]

    def cut(name: str) -> Column:
        # a character that the cut halves goes whole: up to three bytes less make the value valid again
        raw = F.col(name).cast("binary")
        tries = [F.try_validate_utf8(F.substring(raw, 1, value_bytes - n).cast("string")) for n in range(4)]
        return F.when(F.octet_length(name) <= value_bytes, F.col(name).cast("string")).otherwise(F.coalesce(*tries, F.make_valid_utf8(F.substring(raw, 1, value_bytes).cast("string"))))

    out = df.select(*[F.coalesce(cut(n), F.lit("")).alias(n) for n in names])
    return out.limit(limit) if limit else out


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """(rows, columns): the count comes from the footers alone, as no column is read; -1 rows where there is no Parquet. (SRC2)"""
    try:
        df = spark.read.option("recursiveFileLookup", True).parquet(path)
    except AnalysisException as e:  # no such path, or no Parquet in it: an answer here
        return spark.createDataFrame([(-1, e.getCondition() or "")], "rows long, columns string")
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(",".join(df.columns)))


def _get(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit("")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _role(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", "user").otherwise(D.role_of(name))


def messages_of(json: Column) -> Column:
    """The messages of a JSON array: strings alternate user and assistant, objects name their role; unknown roles are set aside. (SRC12-13, WIN13)"""
    items = F.try_variant_get(F.try_parse_json(json), "$", "array<variant>")

    def first(item: Column, keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.try_variant_get(item, f"$.{k}", "string") for k in keys])

    strings = F.filter(F.transform(items, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda s: s != "")
    spoken = F.transform(strings, lambda s, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), s.alias("content")))
    named = F.transform(items, lambda v: F.struct(_role(first(v, ROLE_KEYS)).alias("role"), first(v, BODY_KEYS).alias("content")))
    kept = F.filter(named, lambda m: m["role"].isNotNull() & (F.coalesce(m["content"], F.lit("")) != ""))
    return F.slice(F.when(F.size(strings) > 0, spoken).otherwise(kept), 1, MOST_MESSAGES)


def documents(df: DataFrame, mode: str = "auto") -> DataFrame:
    """(is_chat, text, messages) of rows by their columns: question and answer, messages_json, user and assistant, or all strings joined. (SRC5)"""
    if mode not in ("auto", "qa", "chat", "text"):
        raise ValueError(f"unknown mode {mode}")
    if mode == "qa" and not {"question", "answer"} <= set(df.columns):
        raise ValueError("qa mode needs the columns question and answer")
    if mode == "chat" and "messages_json" not in df.columns and not {"user", "assistant"} <= set(df.columns):
        raise ValueError("chat mode needs messages_json, or user and assistant")
    q, a, u, s, r = (T.text(_get(df, n)) for n in ("question", "answer", "user", "system", "assistant"))
    pair = F.array(_message("user", q), _message("assistant", a))
    turns = F.array_compact(F.array(F.when(s != "", _message("system", s)), _message("user", u), _message("assistant", r)))
    parsed = messages_of(T.text(_get(df, "messages_json")))
    is_pair, has_json = (q != "") & (a != ""), T.text(_get(df, "messages_json")) != ""
    none = F.lit(None).cast(MESSAGES)
    chat = F.when(F.lit(mode != "text") & is_pair, pair)
    if mode in ("auto", "chat"):
        chat = chat.when(has_json & (F.size(parsed) > 0), parsed).when(~has_json & (u != "") & (r != ""), turns)
    flat = [F.when(T.text(c) != "", T.text(c)) for c in sorted(df.columns) if c and c[0] != "_" and c not in ("messages_json", "uuid")]
    line = F.concat_ws(" / ", *flat) if mode in ("auto", "text") and flat else F.lit("")
    out = df.select(chat.otherwise(none).cast(MESSAGES).alias("messages"), line.alias("line"))
    return out.select(F.col("messages").isNotNull().alias("is_chat"), F.when(F.col("messages").isNull(), F.col("line")).otherwise("").alias("text"), "messages").filter("is_chat or text <> ''")


def corpus_lines(df: DataFrame) -> DataFrame:
    """One line for each message, question, answer or flattened row; blank ones dropped. (SRC6, SNK4)"""
    docs = documents(df)
    said = F.when(F.col("is_chat"), F.transform("messages", lambda m: m["content"])).otherwise(F.array("text"))
    return docs.select(F.explode(said).alias("line")).select(T.flattened(F.col("line")).alias("line")).filter("line <> ''")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """The same shape from JSON lines of unknown keys: a list of messages, an instruction with its reply, or a text. (SRC11-12)"""
    rows = spark.read.text(path, pathGlobFilter="*.json*").select(F.try_parse_json("value").alias("v")).filter("v is not null")
    get = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    lists = F.coalesce(*[F.when(F.size(F.try_variant_get("v", f"$.{k}", "array<variant>")) > 0, F.to_json(F.try_variant_get("v", f"$.{k}", "variant"))) for k in LIST_KEYS])
    prompt, reply = (F.coalesce(*[get(k) for k in keys]) for keys in (PROMPT_KEYS, REPLY_KEYS))
    asked = F.concat_ws("\n", prompt, F.when(get("input") != "", get("input")))
    turns = F.array_compact(F.array(F.when(get("system") != "", _message("system", get("system"))), _message("user", asked), _message("assistant", reply)))
    messages = F.when(lists.isNotNull(), messages_of(lists)).when(prompt.isNotNull() & reply.isNotNull(), turns)
    body = F.coalesce(*[get(k) for k in TEXT_KEYS])
    out = rows.select(messages.alias("messages"), F.when(lists.isNull(), body).alias("body"))
    out = out.select(F.coalesce(F.size("messages") > 0, F.lit(False)).alias("is_chat"), F.coalesce("body", F.lit("")).alias("text"), "messages")
    return out.filter("is_chat or text <> ''").select("is_chat", F.when(F.col("is_chat"), "").otherwise(F.col("text")).alias("text"), F.when(F.col("is_chat"), F.col("messages")).alias("messages"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line, without carriage returns. (SRC16)"""
    return spark.read.option("recursiveFileLookup", True).text(path).select(F.rtrim(F.col("value"), F.lit("\r")).alias("text")).filter("text <> ''")


def looks_like_header(cells: list[str]) -> bool:
    """(SRC8)"""
    names = [c.strip().lower() for c in cells]
    return any(n in ("darija", "darija_ar", "eng", "english", "root", "arabic") or n.startswith("n1") for n in names)


def column_role(name: str) -> str:
    """meta, arabic, english or variant. (SRC8)"""
    n = name.strip().lower()
    if n in META_COLUMNS:
        return "meta"
    if n in ("arabic", "ar", "darija_ar") or (len(n) > 3 and n.endswith("_ar")):
        return "arabic"
    return "english" if n.startswith("eng") else "variant"


def _csv(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows of a CSV file as strings, and each column's role. A headerless file has variants only."""
    options = {"escape": '"', "multiLine": False, "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False}
    first = spark.read.options(**options).csv(path).limit(1).collect()
    cells = [c or "" for c in first[0]] if first else []
    if looks_like_header([c.lstrip("﻿") for c in cells]):
        df = spark.read.options(header=True, **options).csv(path)
        return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [column_role(c.lstrip("﻿")) for c in cells]
    df = spark.read.options(**options).csv(path)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), ["variant"] * len(df.columns)


def csv_lines(spark: SparkSession, path: str, min_bytes: int = 2) -> DataFrame:
    """Distinct cells, and ``variant / arabic`` pairs of a row. (SRC7, SRC9, SET1)"""
    df, roles = _csv(spark, path)
    cells = [(r, T.flattened(T.text(c))) for c, r in zip(df.columns, roles, strict=True) if r != "meta"]
    arabic = next((c for r, c in cells if r == "arabic"), F.lit(""))
    pairs = [F.when((c != "") & (arabic != ""), F.concat(c, F.lit(" / "), arabic)) for r, c in cells if r == "variant"]
    lines = df.select(F.explode(F.array_compact(F.array(*[c for _, c in cells], *pairs))).alias("line"))
    return lines.filter(F.octet_length("line") >= min_bytes).distinct()


def csv_pairs(spark: SparkSession, path: str, min_bytes: int = 2, first_id: int = 1_000_000) -> DataFrame:
    """(id, question, answer): English or a variant with the Arabic cell, in the order of the files' rows; equal and repeated questions skipped, the first kept. (SRC10)"""
    df, roles = _csv(spark, path)
    named = list(zip(df.columns, roles, strict=True))
    answer = next((c for c, r in named if r == "arabic"), named[-1][0])
    asked = [c for c, r in named if r in ("variant", "english") and c != answer]
    # a row's place: its file, and the numbers that a scan gives in order within it
    placed = df.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row"))
    rows = placed.select("_file", "_row", F.posexplode(F.array(*[T.flattened(T.text(c)) for c in asked])).alias("_col", "question"), T.flattened(T.text(answer)).alias("answer"))
    rows = rows.filter((F.octet_length("question") >= min_bytes) & (F.octet_length("answer") >= min_bytes) & (F.col("question") != F.col("answer")))
    place = F.struct("_file", "_row", "_col")
    first = rows.groupBy("question").agg(F.min(place).alias("_place"), F.min_by("answer", place).alias("answer"))
    return numbered(written(first, "pairs"), "_place", first_id).select("id", "question", "answer")


def numbered(rows: DataFrame, order: str, first_id: int) -> DataFrame:
    """``rows`` with consecutive ids in the order of a column: rows are dealt in ranges of it, ranges counted, and each numbered within."""
    dealt = written(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "dealt")
    sums = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))  # as many rows as ranges
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))  # the count within a partition
    return dealt.join(F.broadcast(before), "_part").select((F.col("_before") + inside + first_id).alias("id"), *rows.columns)


def qa_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answer) of JSON lines, arrays, or objects one after another; pairs with an empty side dropped. (SRC14)

    A numeric id stays, a string becomes the FNV hash of it without its sign bit, and a row without one gets a running number. A file whose
    first character is an opening bracket is one array and read whole; any other is read line by line.
    """
    first = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"), F.trim("value").alias("line")).filter("line <> ''")
    arrays = [r.file for r in first.groupBy("file").agg(F.min_by("line", "row").alias("line")).filter("startswith(line, '[')").select("file").collect()]  # file names only
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("row"), "value")
    if arrays:
        lines = lines.filter(~F.col("file").isin(arrays))
        whole = spark.read.text(arrays, wholetext=True).select(F.input_file_name().alias("file"), F.try_parse_json("value").alias("v"))
        whole = whole.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("row", "v"))
    # objects that follow each other on one line
    apart = F.split("value", r"(?<=\})\s*,?\s*(?=\{)")
    pieces = F.when(F.forall(apart, lambda p: F.try_parse_json(p).isNotNull()), apart).otherwise(F.array("value"))
    split = lines.select("file", "row", F.posexplode(pieces).alias("at", "value"))
    rows = split.select("file", "row", "at", F.try_parse_json("value").alias("v"))
    if arrays:
        rows = rows.unionByName(whole.select("file", F.col("row").cast("long").alias("row"), F.lit(0).alias("at"), "v"))
    get = lambda k, kind: F.try_variant_get("v", f"$.{k}", kind)
    rows = rows.select("file", "row", "at", get("id", "string").alias("_id"), F.schema_of_variant(F.try_variant_get("v", "$.id", "variant")).alias("_kind"), get("question", "string").alias("question"), get("answer", "string").alias("answer"))
    rows = rows.filter("coalesce(question, '') <> '' and coalesce(answer, '') <> ''").withColumn("_place", F.struct("file", "row", "at"))
    own = F.when(F.col("_kind").isin("BIGINT", "TINYINT", "SMALLINT", "INT"), F.col("_id").try_cast("long")).when(F.col("_kind") == "STRING", H.fnv_long(F.col("_id")).bitwiseAND(F.lit((1 << 63) - 1)))
    return numbered(rows, "_place", 0).select(F.coalesce(own, F.col("id")).alias("id"), "question", "answer")


def qa_lines(pairs: DataFrame) -> DataFrame:
    """(SRC15)"""
    both = pairs.select(F.explode(F.array("question", "answer")).alias("line")).select(T.flattened(F.col("line")).alias("line"))
    return both.filter("line <> ''").distinct()


def write_conversations(turns: DataFrame, path: str) -> None:
    """JSON lines of {conv_id, messages}. (SRC17, SNK5)"""
    told = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    turns.groupBy("conv_id").agg(told.alias("messages")).write.option("maxRecordsPerFile", 20_000).json(path)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(f"conv_id long, messages {MESSAGES}").json(path)
    return rows.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", F.col("m.content").alias("text"))


def config(text: str, known: set[str] | None = None) -> dict[str, object]:
    """A strict subset of YAML, nested keys joined by dots: no tabs, anchors, blocks, or repeated and unknown keys. (SRC21, GAT1)"""
    out: dict[str, object] = {}
    path: list[tuple[int, str]] = []
    for raw in text.splitlines():
        line = raw.split(" #")[0].rstrip() if not raw.lstrip().startswith("#") else ""
        if not line:
            continue
        key, colon, value = line.strip().partition(":")
        value = value.strip()
        if "\t" in line or not colon or value[:1] in ("&", "*", "|", ">"):
            raise ValueError(f"not understood: {raw!r}")
        indent = len(line) - len(line.lstrip())
        while path and path[-1][0] >= indent:
            path.pop()
        name = ".".join([p for _, p in path] + [key.strip()])
        if not value:
            path.append((indent, key.strip()))
            continue
        if name in out:
            raise ValueError(f"repeated key {name}")
        out[name] = _value(value)
    if known is not None and set(out) - known:
        raise ValueError(f"unknown keys {sorted(set(out) - known)}")
    return out


def _value(v: str) -> object:
    if v.startswith("[") and v.endswith("]"):
        return [_value(x.strip()) for x in v[1:-1].split(",") if x.strip()]
    if v.lower() in ("true", "yes", "on", "false", "no", "off"):
        return v.lower() in ("true", "yes", "on")
    for kind in (int, float):
        try:
            return kind(v)
        except ValueError:
            pass
    return v.strip("'\"")
