"""Mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents fall in cells (source, lang, topic); a cell's mass is its number of tokens. Iterative proportional
fitting (raking) scales the cells so that their margins over source, over language and over topic meet the
targets in turn, until none is off by more than ``tolerance``. The fitted mass over the actual mass is the weight of a
cell's tokens; a document's probability of being sampled is proportional to it, scaled so that
``budget`` of all tokens are expected, and never above 1: what a cell at 1 can't give, the others make up for. A
document is sampled where a hash of its doc_id, uniform in [0, 1), is below its probability, so the
sample is the same in every run and grows with the budget.

By default a margin's target is its actual share to the power ``flatten``, normalised: rare values gain. A topic is a
cluster of documents: k-means over hashed word counts of all documents, in at most ``topic_rounds`` rounds; a round's
sums are of whole numbers, so they don't depend on the partitions. Any column can stand for the topic instead.

Cells are counted by one aggregation. Up to ``driver_cells`` cells are raked on the driver; beyond that by DataFrame
steps, an aggregation and a join per margin, with the cells written between rounds. Both take the same scaled targets and give
the same weights.

Defined cases: null source, language or topic is a value of its own; documents without words have no
mass and are never sampled; a target value without mass is left out and the others are scaled to 1, a value without a target gets
weight 0; repeated rows are cells' members each and are sampled together; a row without a doc_id is drawn by a hash of its text; an
empty table gives no rows. Extra columns are kept by ``sample``, also those called topic, weight or probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusmill.llm import textkit as K
from corpusmill.llm.store import arrow_ready, fresh, written

U = np.uint64


@dataclass(frozen=True)
class MixConfig:
    budget: float = 0.5
    flatten: float = 0.5
    tolerance: float = 1e-6
    rounds: int = 200
    topics: int = 6
    topic_rounds: int = 25
    dimensions: int = 128
    driver_cells: int = 200_000


MARGINS = ("source", "lang", "topic")


def word_profile(buf: np.ndarray, off: np.ndarray, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of damped hashed word counts, and the number of words, of a lower-cased block."""
    w = K.Words(buf, off, K.LETTERED)
    slot = (w.hashes() % U(dimensions)).astype(np.int64)
    counts = np.bincount(w.doc() * dimensions + slot, minlength=len(w.count) * dimensions).reshape(-1, dimensions)
    profile = np.sqrt(counts)
    return profile / np.maximum(np.linalg.norm(profile, axis=1, keepdims=True), 1e-12), w.count


def _profiles(docs: DataFrame, cfg: MixConfig) -> DataFrame:
    """(mark, profile) of every document with words: a hash of its text, and its profile in whole steps, so that sums are exact."""
    schema = pa.schema([("mark", pa.int64()), ("profile", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches, lower=True):
            profile, words = word_profile(buf, off, cfg.dimensions)
            some = words > 0
            steps = np.round(profile[some] * 32768).astype(np.uint16)
            yield K.batch_of(schema, batch.column("mark").filter(pa.array(some)), [row.tobytes() for row in steps])

    return docs.select(F.xxhash64("text").alias("mark"), "text").mapInArrow(run, "mark long, profile binary")


def _steps(batch: pa.RecordBatch, cfg: MixConfig) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("profile").to_pylist()), np.uint16).reshape(-1, cfg.dimensions).astype(np.int64)


def _farthest(profiles: DataFrame, centres: np.ndarray, cfg: MixConfig) -> np.ndarray:
    """The profile least like any centre; of equals, the one of the smallest mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            if batch.num_rows:
                near = np.round((_steps(batch, cfg) / 32768 @ centres.T).max(axis=1), 9)
                mark = batch.column("mark").to_numpy()
                i = int(np.lexsort((mark, near))[0])
                here = (float(near[i]), int(mark[i]), batch.column("profile")[i].as_py())
                best = here if best is None else min(best, here)
        if best is not None:
            yield pa.RecordBatch.from_pydict({"near": [best[0]], "mark": [best[1]], "profile": pa.array([best[2]], pa.binary())})

    rows = profiles.mapInArrow(run, "near double, mark long, profile binary")
    return np.frombuffer(rows.agg(F.min(F.struct("near", "mark", "profile")).alias("m")).first().m.profile, np.uint16) / 32768


def _sums(profiles: DataFrame, centres: np.ndarray, cfg: MixConfig) -> np.ndarray:
    """For each centre, the sum of the profiles nearest to it, and in a last column their number."""
    wide = cfg.dimensions + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centres), wide), np.int64)
        for batch in batches:
            if batch.num_rows:
                x = _steps(batch, cfg)
                own = np.round(x / 32768 @ centres.T, 9).argmax(axis=1)
                for k in range(len(centres)):
                    total[k, :-1] += x[own == k].sum(axis=0)
                    total[k, -1] += int((own == k).sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": at.astype(np.int32), "n": total.reshape(-1)[at]})

    out = np.zeros(len(centres) * wide, np.int64)
    for r in profiles.mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r.slot] = r.n
    return out.reshape(-1, wide)


def learn_topics(docs: DataFrame, cfg: MixConfig = MixConfig()) -> np.ndarray:
    """Centres of a spherical k-means over all documents with words, most common topic first."""
    arrow_ready(docs.sparkSession)
    profiles = written(_profiles(docs, cfg), "profiles")
    if profiles.isEmpty():
        return np.zeros((1, cfg.dimensions))
    # the first centre is the text of the smallest mark, each next one the text farthest from all centres
    centres = _farthest(profiles, np.zeros((1, cfg.dimensions)), cfg)[None]
    while len(centres) < cfg.topics:
        centres = np.vstack([centres, _farthest(profiles, centres, cfg)])
    for _ in range(cfg.topic_rounds):
        sums = _sums(profiles, centres, cfg)
        new = np.where(sums[:, -1:] > 0, sums[:, :-1], centres)
        new = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.array_equal(new, centres):
            break
        centres = new
    size = _sums(profiles, centres, cfg)[:, -1]
    return centres[np.argsort(-size, kind="stable")]


def _topic_of(buf: np.ndarray, off: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topic and number of words of each document of a lower-cased block."""
    profile, words = word_profile(buf, off, centres.shape[1])
    return np.round(profile @ centres.T, 9).argmax(axis=1).astype(np.int32), words.astype(np.int64)


def with_topics(docs: DataFrame, centres: np.ndarray) -> DataFrame:
    """(doc_id, mark, source, lang, topic, n_tokens) of every row; mark is a hash of its text."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(centres)
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("topic", pa.int32()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches, lower=True):
            yield K.batch_of(schema, *(batch.column(c) for c in ("doc_id", "mark", "source", "lang")), *_topic_of(buf, off, shared.value))

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "text")
    return base.mapInArrow(run, "doc_id long, mark long, source string, lang string, topic int, n_tokens long")


def _wanted(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(value, share) for each margin: the targets of the values that have mass, scaled to a sum of 1. A value without a target gets 0."""
    out = {}
    for name in MARGINS:
        there = cells.select(F.col(name).alias("_v")).distinct()
        goal = there.join(targets[name], F.col("_v").eqNullSafe(F.col("value")), "left").groupBy("_v").agg(F.coalesce(F.max("share"), F.lit(0.0)).alias("share"))
        goal = written(goal, "wanted")
        every = goal.agg(F.sum("share")).first()[0] or 1.0
        out[name] = goal.select(F.col("_v").alias("value"), (F.col("share") / every).alias("share"))
    return out


def _raked_here(cells: list, wanted: dict[str, dict], cfg: MixConfig) -> np.ndarray:
    """Fitted masses of (source, lang, topic, mass) cells, by numpy."""
    mass = np.array([c["mass"] for c in cells], float)
    places, goals = [], []
    for name in MARGINS:
        values = {v: i for i, v in enumerate(dict.fromkeys(c[name] for c in cells))}
        places.append(np.array([values[c[name]] for c in cells]))
        goals.append(np.array([wanted[name][v] for v in values]) * mass.sum())
    total = mass.sum()
    for _ in range(cfg.rounds):
        off = 0.0
        for place, goal in zip(places, goals, strict=True):
            now = np.bincount(place, weights=mass, minlength=len(goal))
            off = max(off, float(np.abs(now - goal).max() / total))
            mass = mass * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[place]
        if off <= cfg.tolerance:
            break
    return mass


def _raked_apart(cells: DataFrame, wanted: dict[str, DataFrame], cfg: MixConfig) -> DataFrame:
    """The same for any number of cells: one aggregation and one join for each margin, one table a round."""
    total = cells.agg(F.sum("mass")).first()[0]
    now = cells.withColumn("fitted", F.col("mass").cast("double"))
    for _ in range(cfg.rounds):
        # how far each margin was off before it was scaled rides along with the cells
        for name in MARGINS:
            goal = wanted[name].select(F.col("value").alias("_t"), (F.col("share") * total).alias("_goal"))
            margin = now.groupBy(F.col(name).alias("_v")).agg(F.sum("fitted").alias("_now")).join(goal, F.col("_v").eqNullSafe(F.col("_t"))).drop("_t")
            scale = F.when(F.col("_now") > 0, F.col("_goal") / F.col("_now")).otherwise(0.0)
            joined = now.join(margin, F.col(name).eqNullSafe(F.col("_v")))
            kept = [c for c in now.columns if c.startswith("off_") and c != f"off_{name}"]
            now = joined.select(*MARGINS, "mass", (F.col("fitted") * scale).alias("fitted"), F.abs(F.col("_now") - F.col("_goal")).alias(f"off_{name}"), *kept)
        now = written(now, "raked")
        off = now.agg(*[F.max(f"off_{m}") for m in MARGINS]).first()
        now = now.select(*MARGINS, "mass", "fitted")
        if max(off) / total <= cfg.tolerance:
            break
    return now


def default_targets(cells: DataFrame, cfg: MixConfig = MixConfig()) -> dict[str, DataFrame]:
    """(value, share) for each margin: the actual shares, flattened."""
    out = {}
    for name in MARGINS:
        flat = cells.groupBy(F.col(name).alias("value")).agg(F.pow(F.sum("mass").cast("double"), cfg.flatten).alias("flat"))
        out[name] = flat.crossJoin(flat.agg(F.sum("flat").alias("all"))).select("value", (F.col("flat") / F.col("all")).alias("share"))
    return out


def _probabilities(ratio: np.ndarray, mass: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * ratio) such that budget of the mass is expected."""
    goal = min(budget, 1.0) * mass[ratio > 0].sum()
    full = np.zeros(len(ratio), bool)
    while True:
        free = ~full & (ratio > 0)
        rest = (mass * ratio)[free].sum()
        scale = (goal - mass[full].sum()) / rest if rest > 0 else 0.0
        new = free & (ratio * scale >= 1)
        if not new.any():
            return np.where(full, 1.0, np.clip(ratio * scale, 0, 1))
        full |= new


def calibrated(members: DataFrame, targets: dict[str, DataFrame] | None = None, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(source, lang, topic, weight, probability) of each cell of (source, lang, topic, n_tokens) rows."""
    spark = members.sparkSession
    cells = written(members.filter("n_tokens > 0").groupBy(*MARGINS).agg(F.sum("n_tokens").alias("mass")), "cells")
    wanted = _wanted(cells, targets or default_targets(cells, cfg))
    schema = "source string, lang string, topic int, weight double, probability double"
    if cells.count() <= cfg.driver_cells:
        rows = sorted(cells.collect(), key=lambda c: tuple((c[m] is None, c[m]) if c[m] is not None else (True, "") for m in MARGINS))
        if not rows:
            return spark.createDataFrame([], schema)
        mass = np.array([c["mass"] for c in rows], float)
        ratio = _raked_here(rows, {name: {r["value"]: r["share"] for r in t.collect()} for name, t in wanted.items()}, cfg) / mass
        p = _probabilities(ratio, mass, cfg.budget)
        known = [(*(c[m] for m in MARGINS), round(float(w), 9), round(float(q), 9)) for c, w, q in zip(rows, ratio, p, strict=True)]
        return F.broadcast(spark.createDataFrame(known, schema))  # driver_cells rows at most
    fitted = _raked_apart(cells, wanted, cfg).withColumn("ratio", F.col("fitted") / F.col("mass"))
    goal = cfg.budget * fitted.filter("ratio > 0").agg(F.sum("mass")).first()[0]
    limit = None  # cells with a ratio from here on are at 1
    while True:
        full = F.col("ratio") >= limit if limit is not None else F.lit(False)
        given, rest = fitted.agg(F.coalesce(F.sum(F.when(full, F.col("mass"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("mass") * F.col("ratio"))), F.lit(0.0))).first()
        scale = (goal - given) / rest if rest > 0 else 0.0
        new = fitted.filter(~full & (F.col("ratio") * scale >= 1)).agg(F.min("ratio")).first()[0]
        if new is None:
            break
        limit = new
    p = F.when(full, 1.0).otherwise(F.least(F.greatest(F.col("ratio") * scale, F.lit(0.0)), F.lit(1.0)))
    return fitted.select(*MARGINS, F.round("ratio", 9).alias("weight"), F.round(p, 9).alias("probability"))


def _drawn(rows: DataFrame, cells: DataFrame, names: dict[str, str]) -> DataFrame:
    """``rows`` with weight, probability and sampled from their cell, under the given names; ``names`` also tells their margins."""
    cells = cells.select(*[F.col(m).alias(f"_c_{m}") for m in MARGINS], F.col("weight").alias("_c_weight"), F.col("probability").alias("_c_probability"))
    joined = rows.join(cells, [F.col(f"_c_{m}").eqNullSafe(F.col(names[m])) for m in MARGINS], "left")
    p = F.when(F.col(names["n_tokens"]) > 0, F.coalesce("_c_probability", F.lit(0.0))).otherwise(0.0)
    draw = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.col(names["mark"])), F.lit("mix")), F.lit(1 << 53)) / float(1 << 53)
    out = joined.withColumns({names["weight"]: F.coalesce("_c_weight", F.lit(0.0)), names["probability"]: p})
    return out.withColumn(names["sampled"], draw < F.col(names["probability"])).drop(*[c for c in cells.columns])


def weighted(docs: DataFrame, targets: dict[str, DataFrame] | None = None, cfg: MixConfig = MixConfig()) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, sampled) of every row."""
    members = written(with_topics(docs, learn_topics(docs, cfg)), "members")
    names = {n: n for n in (*MARGINS, "n_tokens", "mark", "weight", "probability", "sampled")}
    return _drawn(members, calibrated(members, targets, cfg), names).drop("mark")


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, cfg: MixConfig = MixConfig()) -> DataFrame:
    """The sampled rows of ``docs`` with their columns, then topic, weight and probability; where ``docs`` has such a column already,
    the new one's name begins with an underscore. A row is drawn by its own cell, without a join on doc_id."""
    centres = learn_topics(docs, cfg)
    cells = calibrated(with_topics(docs, centres), targets, cfg)
    names = {n: fresh(n, docs.columns) for n in ("topic", "n_tokens", "mark", "weight", "probability", "sampled")}
    shared = docs.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches, lower=True):
            topic, words = _topic_of(buf, off, shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(topic), pa.array(words)], [*batch.schema.names, names["topic"], names["n_tokens"]])

    schema = ST.StructType([*docs.schema.fields, ST.StructField(names["topic"], ST.IntegerType()), ST.StructField(names["n_tokens"], ST.LongType())])
    placed = docs.mapInArrow(run, schema).withColumn(names["mark"], F.xxhash64("text"))
    drawn = _drawn(placed, cells, names | {"source": "source", "lang": "lang"}).filter(F.col(names["sampled"]))
    return drawn.select(*docs.columns, names["topic"], names["weight"], names["probability"])
