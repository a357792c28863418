"""Toxicity by a counterfactually regularised classifier.

A text's features are its distinct lower-cased words and their first ``prefixes`` bytes. A
logistic model learns from labelled texts. Every labelled text that names a group is written again with the
identity term swapped for each other term of its list, a neutral one among them, and read like any text; the squared
change of the log-odds between the text and its swapped version, in the mean over a text's versions, is added to the loss.
So a group's name carries about the weight of a neutral word, and a neutral mention is not a reason to call a text toxic.

Learning uses a bounded sample, at most ``rows`` labelled texts of each label chosen by a hash of
doc_id; the model has at most ``features`` features, the ones most associated with either label in it; those
bounds are also the bound of the broadcast model. The sample is weighted back to the shares of all
labelled rows, so scores are probabilities. Scoring covers every word of every text.

Defined cases: null and empty texts score the model's intercept; rows with a null label or text
are not learnt from; a doc_id labelled more than once counts with its largest label, one with several texts with the first in
order; with nothing to learn from, the score is the share of label 1, or 0; repeated rows score alike. Extra columns
are ignored by ``scores`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm.langid_ppm import held_out
from corpusmill.llm.store import arrow_ready

U = np.uint64

#: Lists of terms that may stand for each other; each ends with neutral ones. Fixed values.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "catholic", "protestant", "atheist", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "catholics", "protestants", "atheists", "people"),
    ("black", "white", "asian", "latino", "african", "european", "indigenous", "arab", "local"),
    ("women", "men", "girls", "boys", "adults", "people"),
    ("woman", "man", "girl", "boy", "person"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "single"),
    ("immigrants", "refugees", "foreigners", "citizens", "residents", "people"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young"),
    ("musulmans", "chrétiens", "juifs", "femmes", "hommes", "immigrés", "réfugiés", "gens"),
    ("muslime", "christen", "juden", "frauen", "männer", "einwanderer", "flüchtlinge", "leute"),
    ("musulmanes", "cristianos", "judíos", "mujeres", "hombres", "inmigrantes", "refugiados", "gente"),
)


@dataclass(frozen=True)
class ToxicityConfig:
    rows: int = 5000
    features: int = 4096
    prefixes: tuple[int, ...] = (5, 7)
    ridge: float = 2e-4
    swap: float = 1.0
    steps: int = 600
    threshold: float = 0.3


@dataclass
class ToxicityModel:
    """Sorted feature hashes with their weights."""

    keys: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    intercept: float = -50.0
    prefixes: tuple[int, ...] = ()


def features(buf: np.ndarray, off: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature hash) of every word and word beginning of a lower-cased block."""
    w = K.Words(buf, off, K.LETTERED)
    doc, size = w.doc(), w.end - w.start
    docs, keys = [doc], [w.hashes()]
    for n in prefixes:
        long = size > n
        docs.append(doc[long])
        keys.append(K.mix(w.spans(w.start[long], w.start[long] + n) ^ U(n)))
    return np.concatenate(docs), np.concatenate(keys)


def hits(doc: np.ndarray, key: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, index into known) of the features that are known."""
    if not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    sieve = np.zeros(1 << 18, bool)
    sieve[known >> U(46)] = True
    at = np.flatnonzero(sieve[key >> U(46)])
    place = np.searchsorted(known, key[at])
    ok = known[np.minimum(place, len(known) - 1)] == key[at]
    pair = np.unique(doc[at[ok]] * len(known) + place[ok])
    return pair // len(known), pair % len(known)


#: Not within a word.
_APART = r"(?<![0-9a-z\x80-\U0010ffff]){}(?![0-9a-z\x80-\U0010ffff])"


def swapped(text: str) -> list[str]:
    """A lower-cased text with each identity term that it names swapped for each other one of the term's list."""
    out = []
    for group in IDENTITY_TERMS:
        for term in group:
            if term in text and re.search(pattern := _APART.format(re.escape(term)), text):
                out += [re.sub(pattern, other, text) for other in group if other != term]
    return out


@dataclass
class Swaps:
    """Differences between texts and their swapped versions: a share for each, and its features with their sign."""

    share: np.ndarray
    at: np.ndarray
    feature: np.ndarray
    sign: np.ndarray


def fit(y: np.ndarray, weight: np.ndarray, row: np.ndarray, col: np.ndarray, width: int, swaps: Swaps, cfg: ToxicityConfig) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with a ridge and the swap penalty, by accelerated gradient steps.

    (row, col) are the ones of the sparse design matrix.
    """
    weight = weight / weight.sum()

    def product(v: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=v[col], minlength=len(y))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, weights=r[row], minlength=width)

    def pulled(v: np.ndarray) -> np.ndarray:
        change = np.bincount(swaps.at, weights=v[swaps.feature] * swaps.sign, minlength=len(swaps.share))
        return np.bincount(swaps.feature, weights=(2 * cfg.swap * swaps.share * change)[swaps.at] * swaps.sign, minlength=width)

    # the largest curvature, by power iteration over the data and the penalty
    v, curve = np.ones(width + 1), 1.0
    for _ in range(30):
        z = 0.25 * weight * (product(v[:-1]) + v[-1])
        v = np.append(back(z) + pulled(v[:-1]), z.sum())
        curve = float(np.linalg.norm(v))
        v /= curve or 1
    step = 1 / (1.1 * curve + 2 * cfg.ridge)
    w, b = np.zeros(width), 0.0
    w1, b1, t = w, b, 1.0
    for _ in range(cfg.steps):
        p = 1 / (1 + np.exp(-np.clip(product(w1) + b1, -50, 50)))
        r = weight * (p - y)
        w2 = w1 - step * (back(r) + 2 * cfg.ridge * w1 + pulled(w1))
        b2 = b1 - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w1, b1 = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, b


def _term_features(term: str, prefixes: tuple[int, ...]) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return features(raw, np.array([0, len(raw)]), prefixes)[1]


COUNTED = "key long, ones long, zeros long"
_SWAP = pa.struct([("gone", pa.list_(pa.int32())), ("new", pa.list_(pa.int32()))])
SPARSE = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("found", pa.list_(pa.int32())), ("swaps", pa.list_(_SWAP))])
SPARSE_DDL = "doc_id long, toxic int, found array<int>, swaps array<struct<gone:array<int>,new:array<int>>>"


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows where ``may_learn`` (over doc_id) holds."""
    spark = docs.sparkSession
    arrow_ready(spark)
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & may_learn)
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    size = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    n = sum(size.values())
    if len(size) < 2:
        share = size.get(1, 0) / n if n else 0.0
        return ToxicityModel(intercept=50.0 if share else -50.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30))
    chosen = [marked.filter(F.col("toxic") == k).filter(draw < int(min(1.0, 1.2 * cfg.rows / size[k]) * (1 << 30))).orderBy(draw, "doc_id").limit(cfg.rows) for k in (0, 1)]
    sample = chosen[0].union(chosen[1])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("ones", pa.int64()), ("zeros", pa.int64())])
        for batch, buf, off in K.blocks(batches, lower=True):
            doc, key = features(buf, off, cfg.prefixes)
            order = np.lexsort((key, doc))
            doc, key = doc[order], key[order]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
            label = batch.column("toxic").to_numpy()[doc[first]]
            keys, at = np.unique(key[first], return_inverse=True)
            yield K.batch_of(schema, keys.view(np.int64), np.bincount(at, weights=label, minlength=len(keys)).astype(np.int64), np.bincount(at, weights=1 - label, minlength=len(keys)).astype(np.int64))

    table = texts.mapInArrow(count, COUNTED).groupBy("key").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b")).filter("a + b >= 3")
    took = {k: min(cfg.rows, size[k]) for k in size}
    # log-odds against the sample's shares, weighed by how often the feature was seen
    odds = F.abs(F.log((F.col("a") + 0.5) / (took[1] + 1.0)) - F.log((F.col("b") + 0.5) / (took[0] + 1.0)))
    best = table.select("key", (odds * F.sqrt(F.col("a") + F.col("b"))).alias("weighed")).orderBy(F.desc("weighed"), "key").limit(cfg.features)
    terms = np.concatenate([_term_features(t, cfg.prefixes) for group in IDENTITY_TERMS for t in group])
    keys = np.unique(np.concatenate([np.array([r[0] for r in best.collect()], np.int64).view(np.uint64), terms]))
    shared = spark.sparkContext.broadcast(keys)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches, lower=True):
            doc, at = hits(*features(buf, off, cfg.prefixes), shared.value)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            swaps = []
            for d in range(batch.num_rows):
                own = at[ends[d] : ends[d + 1]]
                others = swapped(buf[off[d] : off[d + 1]].tobytes().decode())
                there, theirs = hits(*features(*K.string_buffers(pa.array(others, pa.large_string())), cfg.prefixes), shared.value) if others else (own, own)
                swaps.append([{"gone": np.setdiff1d(own, theirs[there == k]).tolist(), "new": np.setdiff1d(theirs[there == k], own).tolist()} for k in range(len(others))])
            yield K.batch_of(SPARSE, batch.column("doc_id"), batch.column("toxic"), pa.ListArray.from_arrays(ends, at.astype(np.int32)), swaps)

    rows = texts.mapInArrow(found, SPARSE_DDL).toArrow().sort_by("doc_id")
    y = rows["toxic"].to_numpy().astype(float)
    lists = rows["found"].combine_chunks()
    ends = lists.offsets.to_numpy()
    row, col = np.repeat(np.arange(len(y)), np.diff(ends)), lists.values.to_numpy()[ends[0] : ends[-1]]
    per = {k: size[k] / max(1, (y == k).sum()) for k in size}
    weight = np.where(y == 1, per[1], per[0])
    share, at, feature, sign = [], [], [], []
    for w, versions in zip((weight / weight.sum()).tolist(), rows["swaps"].to_pylist(), strict=True):
        for version in versions:
            for way, features_of in ((-1.0, version["gone"]), (1.0, version["new"])):
                at += [len(share)] * len(features_of)
                feature += features_of
                sign += [way] * len(features_of)
            share.append(w / len(versions))
    swaps = Swaps(np.array(share), np.array(at, np.int64), np.array(feature, np.int64), np.array(sign))
    w, b = fit(y, weight, row, col, len(keys), swaps, cfg)
    return ToxicityModel(keys, w, b, cfg.prefixes)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def log_odds(model: ToxicityModel, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The model's log-odds of label 1 for each document of a lower-cased block."""
    doc, at = hits(*features(buf, off, model.prefixes), model.keys)
    return model.intercept + np.bincount(doc, weights=model.weights[at], minlength=len(off) - 1)


def scores(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches, lower=True):
            p = np.round(1 / (1 + np.exp(-np.clip(log_odds(shared.value, buf, off), -50, 50))), 6)
            yield K.batch_of(SCORED, batch.column("doc_id"), batch.column("held_out"), p, (p >= cfg.threshold).astype(np.int32))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, unchanged."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches, lower=True):
            p = np.round(1 / (1 + np.exp(-np.clip(log_odds(shared.value, buf, off), -50, 50))), 6)
            yield batch.filter(pa.array(p < cfg.threshold))

    return docs.mapInArrow(run, docs.schema)
