"""One thin query for each operator of this package, over whole tables."""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import adaptive_quality, bagminhash, chatmask, contamination, langid_ppm, licenses, mixing, passages, toxicity, urlrules


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.weighted(_table(spark, sf_dir, "documents"))


def op3_ppm_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid_ppm.identify(docs, langid_ppm.learn(docs, ~langid_ppm.held_out(F.col("doc_id"))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels"), ~langid_ppm.held_out(F.col("doc_id"))))


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.shared_passages(_table(spark, sf_dir, "documents"))


def op7_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = adaptive_quality.judged(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "reason")


#: Where the vocabulary of op8 lies unless the session says otherwise.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op8_chat_masks(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    """``ranks`` is a vocabulary's rank file on the driver; by default what ``corpusmill.ranks`` says in the session."""
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)], "conv_id long, turn long, role string, text string")
    known = Path(ranks or spark.conf.get("corpusmill.ranks", RANKS)).read_text()
    return chatmask.digests(chatmask.format_conversations(turns.unionByName(more), known), known)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


#: The rules that the query judges by. Fixed values.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_ppm_langid": op3_ppm_langid,
    "op4_toxicity": op4_toxicity,
    "op5_bagminhash": op5_bagminhash,
    "op6_passages": op6_passages,
    "op7_adaptive_quality": op7_adaptive_quality,
    "op8_chat_masks": op8_chat_masks,
    "op9_licenses": op9_licenses,
    "op10_url_rules": op10_url_rules,
}

#: The wording of op9, written out for SQL: {a|b} is one of some phrases (none between two bars), {1-6} so many words of any kind.
_WORDING = (
    ("gpl", True, "gnu general public license"), ("apache", True, "apache license"), ("cc-by", True, "cc by"), ("mit", True, "mit license"),
    ("gpl-{2|3}.0", False, "licensed under the gnu general public license {as published by the free software foundation|} version {2|3}"),
    ("gpl-{2|3}.0", False, "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation {either|} version {2|3} {of the license|} {or at your option any later version|}"),
    ("apache-2.0", False, "licensed under the apache license version 2 0"),
    ("cc-by-4.0", False, "licensed under {a|} {creative commons|} cc by 4 0"), ("cc-by-nc-4.0", False, "licensed under {a|} {creative commons|} cc by nc 4 0"), ("cc-by-sa-4.0", False, "licensed under {a|} {creative commons|} cc by sa 4 0"),
    ("mit-notice", False, "released under the mit license"), ("copyright-mit", False, "copyright {c|} {1-6} released under the mit license"), ("spdx", False, "spdx license identifier {1-4}"),
    ("mit-grant", False, "permission is hereby granted free of charge to any person obtaining a copy of {this software and associated documentation files|this software|this source file} {the software|} to deal in the software without restriction"),
    ("mit-text", False, "permission is hereby granted free of charge to any person obtaining a copy of {this software and associated documentation files|this software|this source file} {the software|} to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
     "the above copyright notice and this permission notice {including the next paragraph|} shall be included in all copies or substantial portions of the software "
     "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
     "in no event shall {1-8} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-text", False, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", False, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "{1|} redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "{2|} redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
)


def _phrases() -> str:
    """Every way to write each wording, as SQL rows (label, base, words); * is any word."""
    rows = set()
    for label, base, wording in _WORDING:
        parts = re.split(r"\{([^}]*)\}", wording)
        options = [[" ".join("*" * n) for n in range(1, int(p[2:]) + 1)] if re.fullmatch(r"1-\d", p) else p.split("|") if i % 2 else [p] for i, p in enumerate(parts)]
        for chosen in itertools.product(*options):
            words = " ".join(" ".join(chosen).split())
            version = words.split("version ")[-1][:1]
            rows.add((label.replace("{2|3}", version), base, words))
    return ", ".join(f"('{label}', {str(base).lower()}, '{words}')" for label, base, words in sorted(rows))


def _firsts() -> str:
    return ", ".join(sorted({f"'{wording.split()[0]}'" for _, _, wording in _WORDING}))


_GAMMA = "(1.01::double / 0.99::double)"
ORACLES: dict[str, str] = {
    "op7_adaptive_quality": f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM d),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
t AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, d.lang, d.source, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l.l)::BIGINT AS n_lines,
    (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (doc_id) JOIN l USING (doc_id) LEFT JOIN covered USING (doc_id)),
r AS (
  SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS word_length,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (
  SELECT lang, source, 'symbol_ratio' AS ratio, symbol_ratio AS v, 0.02::DOUBLE AS least, 0.2::DOUBLE AS most FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'dup_line_ratio', dup_line_ratio, 0.03, 0.3 FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'repeat_ratio', repeat_ratio, 0.03, 0.4 FROM r WHERE NOT base_failed
  UNION ALL SELECT lang, source, 'word_length', word_length, 0.1, 12.0 FROM r WHERE NOT base_failed),
h AS (
  SELECT lang, source, ratio, least, most, CASE WHEN v <= 1e-4 THEN 0 ELSE ceil(ln(v / 1e-4::double) / ln({_GAMMA}))::INT END AS bucket, count(*) AS n
  FROM v GROUP BY ALL),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY lang, source, ratio ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, ratio) AS total,
    CASE WHEN bucket = 0 THEN 0 ELSE 1e-4::double * 2 / ({_GAMMA} + 1) * pow({_GAMMA}, bucket) END AS value FROM h),
q AS (
  SELECT lang, source, ratio, least, most, min(value) FILTER (upto >= total * 0.5::DOUBLE) AS lo, min(value) FILTER (upto >= total * 0.9::DOUBLE) AS hi
  FROM c GROUP BY lang, source, ratio, least, most),
f AS (SELECT lang, source, map_from_entries(list((ratio, least(hi + 3.0::DOUBLE * greatest(hi - lo, least), most)))) AS fence FROM q GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  reason IS NULL AS kept, reason
FROM (SELECT r.*, CASE WHEN base_failed THEN 'base' WHEN symbol_ratio > fence['symbol_ratio'] THEN 'symbol_ratio' WHEN dup_line_ratio > fence['dup_line_ratio'] THEN 'dup_line_ratio'
    WHEN repeat_ratio > fence['repeat_ratio'] THEN 'repeat_ratio' WHEN word_length > fence['word_length'] THEN 'word_length' END AS reason
  FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)""",
    "op8_chat_masks": """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, 23 + length(role) + length(text) + length(text) - length(replace(text, chr(92), '')) + list_sum(list_transform(
    ['<|turn|>', '<|says|>', '<|end|>', '</s>', '<s>', '[INST]', '[/INST]', '<<SYS>>', '<</SYS>>', '<|im_start|>', '<|im_end|>', '<|endoftext|>'],
    lambda m: (length(text) - length(replace(text, m, ''))) // length(m)))::BIGINT AS chars FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "op9_licenses": f"""
WITH phrases(label, base, words) AS (VALUES {_phrases()}),
p AS (SELECT label, base, string_split(words, ' ') AS words, string_split(words, ' ')[1] AS first FROM phrases),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
s AS (SELECT doc_id, i, w[i] AS first, w[i:i + 199] AS tail FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] IN ({_firsts()}))) AS i FROM d)),
m AS (
  SELECT doc_id, label, base, i - 1 AS start, max(len(p.words)) AS n FROM s JOIN p USING (first)
  WHERE len(tail) >= len(p.words) AND list_bool_and(list_transform(p.words, lambda x, j: x = '*' OR x = tail[j])) GROUP BY ALL),
c AS (SELECT doc_id, count(DISTINCT start + j) AS n FROM (SELECT doc_id, start, unnest(range(0, n)) AS j FROM m) GROUP BY doc_id),
a AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    array_to_string(list_sort(list_distinct(list(label) FILTER (base))), ',') AS base_labels, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(c.n, 0) / greatest(len(w), 1), 6) AS score
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)""",
    "op10_url_rules": """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
  FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN b USING (page_id)""",
}
