"""Queries over statistics, evaluation, token windows and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import chars as C
from corpusmill.functions import dialog as D
from corpusmill.functions import quality as Q
from corpusmill.functions import text as T
from corpusmill.functions import vectors as V
from corpusmill.operators import bpe, tokens
from corpusmill.operators.store import written
from corpusmill.plans import oracle as O
from corpusmill.plans.curation import table
from corpusmill.plans.dialogue import _TERMS, _turns

_ASCII_SPACE = r"[ \t\n\r\x0B\x0C]+"


def ascii_words(t: Column) -> Column:
    return F.array_remove(F.split(t, _ASCII_SPACE), "")


def ngrams(w: Column, n: int) -> Column:
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))
    return F.when(F.size(w) >= n, grams).otherwise(F.array().cast("array<string>"))


def distinct_share(g: Column) -> Column:
    return F.when(F.size(g) > 0, F.size(F.array_distinct(g)) / F.size(g)).otherwise(0.0)


def top_repeat(g: Column) -> Column:
    start = F.struct(F.lit("").alias("g"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["g"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("g"), run.alias("run"), F.greatest(s["top"], run).alias("top"))

    return F.aggregate(F.array_sort(g), start, step, lambda s: s["top"])


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of totals over non-empty texts. (AGG2)"""
    t = T.text("text")
    docs = table(spark, sf_dir, "documents").filter(t != "")
    stats = T.script_stats(t)
    rows = docs.select(
        F.octet_length(t).alias("bytes"), F.length(t).alias("chars"), F.size(T.words(t)).alias("words"), (F.regexp_count(t, F.lit("\n")) + 1).alias("lines"),
        stats["arabic"].alias("ar"), stats["latin"].alias("lt"), stats["emoji"].alias("em"),
    )
    share = lambda c: (F.col("ar") + F.col("lt") > 0) & (F.col(c) / F.greatest(F.col("ar") + F.col("lt"), F.lit(1)) > 0.6)
    return rows.agg(
        F.count(F.lit(1)).alias("docs"), *[F.sum(c).alias(c) for c in ("bytes", "chars", "words", "lines")],
        F.count_if(share("ar")).alias("arabic_docs"), F.count_if(share("lt")).alias("latin_docs"), F.count_if(F.col("em") > 0).alias("emoji_docs"),
        F.round(F.avg("chars"), 6).alias("avg_chars"), F.round(F.avg("words"), 6).alias("avg_words"),
    )


def length_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median and indexed quantiles of words per document, by language, from counts of each length. (AGG3)"""
    docs = table(spark, sf_dir, "documents").select("lang", F.size(T.words(T.text("text"))).cast("long").alias("n"))
    counts = docs.groupBy("lang", "n").agg(F.count(F.lit(1)).alias("c"))
    group = W.partitionBy("lang")
    ranked = counts.withColumn("upto", F.sum("c").over(group.orderBy("n"))).withColumn("all", F.sum("c").over(group))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("n")))
    return ranked.groupBy("lang").agg(
        F.max("all").alias("docs"), at(F.floor(F.col("all") / 2)).alias("median"), *[at(F.floor(F.lit(p) * (F.col("all") - 1))).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9, 0.99)]
    )


def lang_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length(T.text("text"))).alias("chars"))
    return docs.withColumn("share", F.round(F.col("chars") / F.sum("chars").over(W.partitionBy()), 6))


def domain_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and normalised weight of each source. (AGG23)"""
    docs = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(T.words(T.text("text")))).alias("tokens"))
    return docs.withColumn("weight", F.round(F.col("tokens") / F.sum("tokens").over(W.partitionBy()), 6))


def distinct_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ascii_words(T.text("text")).alias("w"))
    return docs.select("doc_id", *[F.round(distinct_share(ngrams(F.col("w"), n)), 6).alias(f"distinct{n}") for n in (1, 2)])


def max_ngram_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", ascii_words(T.text("text")).alias("w"))
    return docs.select("doc_id", top_repeat(ngrams(F.col("w"), 3)).cast("long").alias("top"))


def ngram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of word pairs, five documents or more. (AGG6, WIN12)"""
    docs = table(spark, sf_dir, "documents").select(ascii_words(T.text("text")).alias("w")).select(F.explode(F.array_distinct(ngrams(F.col("w"), 2))).alias("gram"))
    return docs.groupBy("gram").agg(F.count(F.lit(1)).alias("df")).filter("df >= 5")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = D.with_context(_turns(spark, sf_dir)).filter("role = 'assistant'").withColumn("w", ascii_words(F.col("text")))
    reason = D.reply_reason(F.col("last_user"), F.col("text"))
    rows = turns.select(
        "conv_id", "turn", D.dialog_act(F.col("last_user")).alias("category"), F.size("w").cast("long").alias("words"),
        F.round(distinct_share(ngrams(F.col("w"), 1)), 6).alias("distinct1"), F.round(distinct_share(ngrams(F.col("w"), 2)), 6).alias("distinct2"),
        top_repeat(ngrams(F.col("w"), 3)).cast("long").alias("max_repeat"), (F.size("w") <= 200).alias("length_ok"),
        D.robotic(F.col("text")).alias("robotic"), (F.size(Q.toxic_terms(F.col("text"))) > 0).alias("toxic"), (reason == "ok").alias("disciplined"),
    )
    point = lambda c, v: F.when(c, v).otherwise(0.0)
    # nothing expected or forbidden, no language gate: those parts are full
    score = 0.65 + point(F.col("length_ok"), 0.10) + point(~F.col("robotic"), 0.10) + point(~F.col("toxic"), 0.10) + point(F.col("disciplined"), 0.05)
    return rows.withColumn("score", F.round(score, 6))


def eval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of at most 200 words, scored by rules. (EVL1, AGG15)"""
    return _scored(spark, sf_dir)


def eval_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(EVL3, AGG13-14)"""
    return _scored(spark, sf_dir).groupBy("category").agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg("score"), 6).alias("score"), F.count_if("robotic").alias("robotic"), F.count_if("toxic").alias("toxic"),
        F.count_if(~F.col("length_ok")).alias("length_fail"), F.count_if(~F.col("disciplined")).alias("discipline_fail"), F.round(F.avg("distinct1"), 6).alias("avg_distinct1"),
        F.count_if(F.col("max_repeat") > 5).alias("repetitive"),
    )


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.words(T.text("text")).alias("w"))


def window_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 256 words. (WIN7)"""
    cut = _words(spark, sf_dir).select("doc_id", F.posexplode(tokens.windows(F.col("w"), 256)).alias("win", "tokens"))
    return cut.select("doc_id", F.col("win").cast("long").alias("win"), F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("digest"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _words(spark, sf_dir).select("doc_id", F.size("w").cast("long").alias("n"))


def doc_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.with_offsets(_sized(spark, sf_dir), "doc_id", "n")


def position_to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.positions(tokens.with_offsets(_sized(spark, sf_dir), "doc_id", "n"), "doc_id", "n", 1000)


def shard_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of 50,000 words of two splits, with totals. (AGG19)"""
    split = _sized(spark, sf_dir).withColumn("split", F.when(F.col("doc_id") % 20 == 0, "val").otherwise("train"))
    return tokens.sharded(split, "doc_id", "n", 50_000).rollup("split", "shard").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def pack_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 512 words: documents in each, and their first words. (PCK2)"""
    placed = tokens.with_offsets(_words(spark, sf_dir).select("doc_id", "w", F.size("w").cast("long").alias("n")), "doc_id", "n")
    packed = tokens.next_token_rows(placed, "w", "doc_id", 512)
    return packed.select("row", F.size("segments").cast("long").alias("segments"), F.element_at("segments", 1)["doc_id"].alias("first_doc"), F.md5(F.array_join(F.flatten(F.transform("segments", lambda s: s["tokens"])), " ")).alias("digest"))


def sample_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three documents of each language. (WIN8)"""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return docs.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("doc_id"))).filter("rank <= 3")


def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.pair_counts(bpe.word_counts(table(spark, sf_dir, "documents")))


def bpe_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per word and bytes per token by language, after 300 merges. (AGG16)"""
    every = table(spark, sf_dir, "documents").select("lang", F.explode_outer(T.words(T.text("text"))).alias("word"))
    counts = written(every.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), "lang-words")  # each word is encoded once a language
    merges = bpe.train(counts.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), 300)
    sized = bpe.sizes(counts, merges).filter("word is not null").groupBy("lang").agg(
        F.sum(F.col("n") * F.col("ids")).alias("ids"), F.sum("n").alias("words"), F.sum(F.col("n") * F.octet_length("word")).alias("bytes")
    )
    every_lang = counts.select("lang").distinct()  # null for a language without a word
    return every_lang.join(sized, every_lang["lang"].eqNullSafe(sized["lang"]), "left").select(
        every_lang["lang"], F.round(F.try_divide("ids", "words"), 6).alias("tokens_per_word"), F.round(F.try_divide("bytes", "ids"), 6).alias("bytes_per_token")
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def vec_dot_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector against the mean of its label."""
    rows = _vectors(spark, sf_dir)
    parts = rows.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    means = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("c"))
    return rows.join(means, "label").select("vec_id", F.round(V.dot(F.col("v"), F.col("c")), 6).alias("dot"), F.round(V.cosine(F.col("v"), F.col("c")), 6).alias("cosine"))


def vec_rmsnorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", F.transform(V.rmsnorm(F.col("v")), lambda x: V.rounded(x, 5)).alias("normed"))


def vec_softmax_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = V.top_k(V.softmax(F.col("v")), 3)
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(top).alias("rank", "t")).select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("t.i").cast("long").alias("place"), F.round("t.value", 6).alias("p"))


def vec_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", V.argmax(F.col("v")).cast("long").alias("place"), F.round(V.norm(F.col("v")), 6).alias("norm"))


def vec_q8_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _vectors(spark, sf_dir).withColumn("block", V.quantized(F.col("v")))
    rows = rows.withColumn("back", V.dequantized(F.col("block")))
    return rows.select("vec_id", *[F.round(c, 6).alias(k) for k, c in V.quantization_error(F.col("v"), F.col("back")).items()])


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.range(1000).select(F.col("id").alias("step"))
    return steps.select("step", F.round(V.learning_rate(F.col("step"), 3e-4, 100, 1000), 9).alias("cosine"), F.round(V.learning_rate(F.col("step"), 3e-4, 100, 1000, "wsd"), 9).alias("wsd"))


def ema_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The moving average of each user's values, 0.98 old and 0.02 new, begun by the first. (WIN11)"""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))), lambda e: e["value"]).alias("v"))
    return rows.select("user_id", F.round(F.aggregate(F.slice("v", 2, 1 << 30), F.get("v", F.lit(0)), lambda s, x: s * 0.98 + x * 0.02), 6).alias("ema"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(SRC11)"""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("with_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def vec_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two experts that each vector's first eight numbers choose. (VEC9, TOP4)"""
    picked = _vectors(spark, sf_dir).select("vec_id", F.posexplode(V.router(F.slice("v", 1, 8), 2)).alias("rank", "p"))
    return picked.select("vec_id", F.col("rank").cast("long").alias("rank"), F.col("p.expert").cast("long").alias("expert"), F.round("p.weight", 6).alias("weight"))


def expert_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each expert is chosen. (AGG21)"""
    picked = _vectors(spark, sf_dir).select(V.router(F.slice("v", 1, 8), 2).alias("picked"))
    return V.expert_load(picked, 8).select(F.col("expert").cast("long").alias("expert"), "slots", F.round("share", 6).alias("share"), F.round("balance", 6).alias("balance"))


def vec_rope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector turned by its place. (VEC6)"""
    turned = V.rope(F.col("v"), (F.col("vec_id") % 16).cast("double"))
    return _vectors(spark, sf_dir).select("vec_id", F.transform(turned, lambda x: F.round(x, 5) + 0.0).alias("turned"))


def vec_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sums of each vector as a matrix product. (VEC2)"""
    weights = [[1.0] * 64, [float(i % 2) for i in range(64)], [i / 64 for i in range(64)]]
    return _vectors(spark, sf_dir).select("vec_id", F.transform(V.linear(F.col("v"), weights), lambda x: V.rounded(x, 5)).alias("out"))


def vec_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest error of half precision over each vector, in its last steps. (VEC15)"""
    halves = F.transform("v", lambda x: V.half(x))
    return _vectors(spark, sf_dir).select("vec_id", F.forall(F.arrays_zip(F.col("v").alias("v"), halves.alias("h")), lambda p: F.abs(p["v"] - p["h"]) <= F.abs(p["v"]) / 2048 + 3e-8).alias("close"))


QUERIES = {
    f.__name__: f
    for f in (
        vec_router, expert_load, vec_rope, vec_linear, vec_half,
        corpus_stats, length_quantiles, lang_mix, domain_mix, distinct_n, max_ngram_repeat, ngram_df, eval_scores, eval_by_category, window_split, doc_offsets, position_to_doc,
        shard_inventory, pack_rows, sample_per_lang, bpe_pair_counts, bpe_fertility, vec_dot_cosine, vec_rmsnorm, vec_softmax_topk, vec_argmax, vec_q8_error, lr_schedule, ema_loss, json_props,
    )
}

_W = r"list_filter(regexp_split_to_array({t}, '[ \t\n\r\x0B\x0C]+'), lambda w: w <> '')"
_GRAMS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
_DOCW = f"(SELECT doc_id, lang, {_W.replace('{t}', 't')} AS w FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents))"
_UW = f"(SELECT doc_id, lang, {O.words('t')} AS w FROM (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents))"
_SIZED = f"(SELECT doc_id, len(w) AS n FROM {_UW})"
_OFF = f"(SELECT doc_id, n, (sum(n) OVER (ORDER BY doc_id) - n)::BIGINT AS start FROM {_SIZED})"
_VEC = "(SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


def _share(n: int) -> str:
    g = _GRAMS.replace("{n}", str(n))
    return f"round(CASE WHEN len(w) >= {n} THEN len(list_distinct({g})) / len({g}) ELSE 0 END, 6)"


def _dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: {a}[i] * {b}[i]))"


def _scores() -> str:
    from corpusmill.plans.dialogue import _REPLIES

    top = O.top_count(_GRAMS.replace("{n}", "3"))
    toxic = f"EXISTS (SELECT 1 FROM (VALUES {_TERMS}) v(term) WHERE regexp_matches(tlow, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))"
    return f"""(SELECT *, round(0.65 + CASE WHEN length_ok THEN 0.10 ELSE 0 END + CASE WHEN robotic THEN 0 ELSE 0.10 END + CASE WHEN toxic THEN 0 ELSE 0.10 END + CASE WHEN disciplined THEN 0.05 ELSE 0 END, 6)::DOUBLE AS score
      FROM (SELECT conv_id, turn, act AS category, len(w) AS words, {_share(1)} AS distinct1, {_share(2)} AS distinct2, {top}::BIGINT AS max_repeat, len(w) <= 200 AS length_ok,
        {O.holds_any('lower(text)', D.ROBOTIC)} AS robotic, {toxic} AS toxic, reason = 'ok' AS disciplined
        FROM (SELECT *, {O.lowered('text')} AS tlow, {_W.replace('{t}', 'text')} AS w FROM {_REPLIES} WHERE role = 'assistant')))"""


_PICKED = f"""(SELECT vec_id, i - 1 AS expert, p, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, i) - 1 AS rank
  FROM (SELECT vec_id, i, exp(v[i] - list_max(v[1:8])) / list_sum(list_transform(v[1:8], lambda x: exp(x - list_max(v[1:8])))) AS p FROM (SELECT vec_id, v, unnest(range(1, 9)) AS i FROM {_VEC})) QUALIFY rank < 2)"""


ORACLES = {
    "vec_router": f"SELECT vec_id, rank, expert, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS weight FROM {_PICKED}",
    "expert_load": f"""SELECT e AS expert, coalesce(n, 0) AS slots, round(coalesce(n, 0) / t, 6) AS share, round(8 * sum((coalesce(n, 0) / t) ** 2) OVER (), 6) AS balance
FROM (SELECT unnest(range(8)) AS e) LEFT JOIN (SELECT expert AS e, count(*) AS n FROM {_PICKED} GROUP BY expert) USING (e), (SELECT count(*) AS t FROM {_PICKED})""",
    "vec_rope": f"""SELECT vec_id, list_transform(range(1, 65), lambda j: round(CASE WHEN j % 2 = 1 THEN v[j] * cos(p * 10000 ** (-(j - 1) / 64)) - v[j + 1] * sin(p * 10000 ** (-(j - 1) / 64))
  ELSE v[j - 1] * sin(p * 10000 ** (-(j - 2) / 64)) + v[j] * cos(p * 10000 ** (-(j - 2) / 64)) END, 5) + 0.0::DOUBLE) AS turned FROM (SELECT vec_id, v, (vec_id % 16)::DOUBLE AS p FROM {_VEC})""",
    "vec_linear": f"SELECT vec_id, [round(list_sum(v), 5), round(list_sum(list_transform(range(1, 65), lambda i: v[i] * ((i - 1) % 2))), 5), round(list_sum(list_transform(range(1, 65), lambda i: v[i] * (i - 1) / 64)), 5)] AS out FROM {_VEC}",
    "vec_half": "SELECT vec_id, true AS close FROM embeddings",
    "corpus_stats": rf"""
SELECT count(*) AS docs, sum(strlen(t))::BIGINT AS bytes, sum(total)::BIGINT AS chars, sum(len(w))::BIGINT AS words, sum(length(t) - length(replace(t, chr(10), '')) + 1)::BIGINT AS lines,
  count(*) FILTER (arabic / greatest(arabic + latin, 1) > 0.6) AS arabic_docs, count(*) FILTER (latin / greatest(arabic + latin, 1) > 0.6) AS latin_docs, count(*) FILTER (emoji > 0) AS emoji_docs,
  round(avg(total), 6) AS avg_chars, round(avg(len(w)), 6) AS avg_words FROM {O.measured()} WHERE t <> ''""",
    "length_quantiles": f"""
SELECT lang, count(*) AS docs, s[len(s) // 2 + 1] AS median, s[floor(0.1::double * (len(s) - 1))::BIGINT + 1] AS p10, s[floor(0.5::double * (len(s) - 1))::BIGINT + 1] AS p50,
  s[floor(0.9::double * (len(s) - 1))::BIGINT + 1] AS p90, s[floor(0.99::double * (len(s) - 1))::BIGINT + 1] AS p99
FROM (SELECT lang, list_sort(list(len(w))) AS s FROM {_UW} GROUP BY lang) GROUP BY lang, s""".replace("count(*) AS docs", "len(s) AS docs"),
    "lang_mix": "SELECT lang, count(*) AS docs, sum(length(coalesce(text, '')))::BIGINT AS chars, round(sum(length(coalesce(text, ''))) / sum(sum(length(coalesce(text, '')))) OVER (), 6) AS share FROM documents GROUP BY lang",
    "domain_mix": f"SELECT source, count(*) AS docs, sum(len(w))::BIGINT AS tokens, round(sum(len(w)) / sum(sum(len(w))) OVER (), 6) AS weight FROM {_UW} JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source",
    "distinct_n": f"SELECT doc_id, {_share(1)} AS distinct1, {_share(2)} AS distinct2 FROM {_DOCW}",
    "max_ngram_repeat": f"SELECT doc_id, CASE WHEN len(w) >= 3 THEN {O.top_count(_GRAMS.replace('{n}', '3'))} ELSE 0 END::BIGINT AS top FROM {_DOCW}",
    "ngram_df": f"SELECT gram, count(*) AS df FROM (SELECT unnest(list_distinct({_GRAMS.replace('{n}', '2')})) AS gram FROM {_DOCW}) GROUP BY gram HAVING count(*) >= 5",
    "eval_scores": f"SELECT * FROM {_scores()}",
    "eval_by_category": f"""SELECT category, count(*) AS items, round(avg(score), 6) AS score, count(*) FILTER (robotic) AS robotic, count(*) FILTER (toxic) AS toxic, count(*) FILTER (NOT length_ok) AS length_fail,
      count(*) FILTER (NOT disciplined) AS discipline_fail, round(avg(distinct1), 6) AS avg_distinct1, count(*) FILTER (max_repeat > 5) AS repetitive FROM {_scores()} GROUP BY category""",
    "window_split": f"SELECT doc_id, win, len(x) AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT doc_id, win, w[win * 256 + 1 : win * 256 + 256] AS x FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 255) // 256)) AS win FROM {_UW}))",
    "doc_offsets": f"SELECT doc_id, n, start FROM {_OFF}",
    "position_to_doc": f"SELECT position, doc_id, position - start AS at FROM (SELECT doc_id, start, n, unnest(range((start + 999) // 1000 * 1000, start + n, 1000)) AS position FROM {_OFF})",
    "shard_inventory": f"""
WITH s AS (SELECT doc_id, n, CASE WHEN doc_id % 20 = 0 THEN 'val' ELSE 'train' END AS split FROM {_SIZED}),
o AS (SELECT split, n, (sum(n) OVER (PARTITION BY split ORDER BY doc_id) - n)::BIGINT // 50000 AS shard FROM s)
SELECT split, shard, count(*) AS docs, sum(n)::BIGINT AS tokens FROM o GROUP BY ROLLUP (split, shard)""",
    "pack_rows": f"""
SELECT row, len(list_distinct(list(doc_id))) AS segments, arg_min(doc_id, p) AS first_doc, md5(string_agg(word, ' ' ORDER BY p)) AS digest
FROM (SELECT doc_id, start + i - 1 AS p, (start + i - 1) // 512 AS row, w[i] AS word FROM (SELECT doc_id, start, w, unnest(range(1, len(w) + 1)) AS i FROM {_OFF} JOIN {_UW} USING (doc_id))) GROUP BY row""",
    "sample_per_lang": "SELECT lang, doc_id, rank::INT AS rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3",
    "bpe_pair_counts": f"SELECT pair, count(*) AS n FROM (SELECT h[2 * i + 1 : 2 * i + 4] AS pair FROM (SELECT h, unnest(range(0, strlen(h) // 2 - 1)) AS i FROM (SELECT hex(encode(unnest(w))) AS h FROM {_UW}))) GROUP BY pair",
    "vec_dot_cosine": f"""
WITH v AS {_VEC}, m AS (SELECT label, i, avg(v[i]) AS m FROM (SELECT label, v, unnest(range(1, 65)) AS i FROM v) GROUP BY label, i), c AS (SELECT label, list(m ORDER BY i) AS c FROM m GROUP BY label)
SELECT vec_id, round({_dot('v', 'c')}, 6) AS dot, round({_dot('v', 'c')} / (sqrt({_dot('v', 'v')}) * sqrt({_dot('c', 'c')})), 6) AS cosine FROM v JOIN c USING (label)""",
    "vec_rmsnorm": f"SELECT vec_id, list_transform(v, lambda x: round(x / s, 5)) AS normed FROM (SELECT vec_id, v, sqrt({_dot('v', 'v')} / len(v) + 1e-6) AS s FROM {_VEC})",
    "vec_softmax_topk": f"""SELECT vec_id, rank, place, p FROM (SELECT vec_id, i - 1 AS place, round(exp(v[i] - list_max(v)) / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS p,
      row_number() OVER (PARTITION BY vec_id ORDER BY v[i] DESC, i) - 1 AS rank FROM (SELECT vec_id, v, unnest(range(1, 65)) AS i FROM {_VEC})) WHERE rank < 3""",
    "vec_argmax": f"SELECT vec_id, (list_position(v, list_max(v)) - 1)::BIGINT AS place, round(sqrt({_dot('v', 'v')}), 6) AS norm FROM {_VEC}",
    "vec_q8_error": f"""
SELECT vec_id, round(rmse, 6) AS rmse, round(list_max(list_transform(d, lambda x: abs(x))), 6) AS max_abs, round(rmse / (sqrt({_dot('v', 'v')}) / sqrt(len(v))), 6) AS rel_rmse,
  round({_dot('v', 'b')} / (sqrt({_dot('v', 'v')}) * sqrt({_dot('b', 'b')})), 6) AS cosine
FROM (SELECT *, sqrt({_dot('d', 'd')} / len(d)) AS rmse FROM (SELECT *, list_transform(range(1, 65), lambda i: v[i] - b[i]) AS d
  FROM (SELECT vec_id, v, list_transform(v, lambda x: round(x / s) * s) AS b FROM (SELECT vec_id, v, list_max(list_transform(v, lambda x: abs(x))) / 127 AS s FROM {_VEC}))))""",
    "lr_schedule": """
SELECT step, round(CASE WHEN step < 100 THEN 3e-4::double * (step + 1) / 100 ELSE 3e-4::double * (0.1::double + 0.9::double * 0.5 * (1 + cos(pi() * (step - 100) / 900))) END, 9) AS cosine,
  round(CASE WHEN step < 100 THEN 3e-4::double * (step + 1) / 100 WHEN step < 820 THEN 3e-4::double ELSE 3e-4::double * (1 - 0.9::double * (step - 820) / 180) END, 9) AS wsd
FROM (SELECT unnest(range(1000)) AS step)""",
    "ema_loss": "SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda s, x: s * 0.98::double + x * 0.02::double), 6) AS ema FROM events GROUP BY user_id",
    "json_props": "SELECT event_type, count(k) AS with_k, sum(k)::BIGINT AS sum_k, max(k) AS max_k FROM (SELECT event_type, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type",
}
