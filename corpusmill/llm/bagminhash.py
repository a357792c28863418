"""Near-duplicate documents by BagMinHash.

A document is the multiset of its five-word shingles. Every shingle owns a Poisson
process over (time, weight), which is a hierarchy: the weight axis is halved down to [0,1), and its right halves are [1,2), [2,4),
[4,8)...; a process of rate 2^j belongs to each, and its points go down the halves of their interval by one coin a
level, the bits of the point's hash, to a place of width 1. A half that a count doesn't reach is left with its points; one
that it fills needs no coins. A document that holds the shingle c times sees the points below c; a slot of the signature,
which the hash names too, keeps the earliest point seen. Two documents agree on a slot with the
probability of their weighted Jaccard similarity, exactly, as the discretised weights are
the counts themselves. Only points before a horizon are made; it doubles until every slot
is filled.

Slots are banded; documents that share a band key are candidates, and candidates are verified
by the overlap of the whole multisets. A bucket's members are compared with its hub, the member
with the most neighbours, not with each other: two that reach the threshold with the hub are one
class. Pairs with a member below it are compared too, unless one of three facts settles them:
they are in one class by now; their similarities to the hub differ by more than 1 - threshold (1 -
similarity is a metric); or so many shingles of one occur in no other candidate that the overlap can't
suffice. These are necessary conditions, so no link between two classes is lost.

Defined cases: documents whose words are the same sequence are one class, whatever the white
space; a text of one to four words is one shingle, so it matches its exact copies only; a text
without words (null, empty, blank) is a class of its own, as nothing shows it to be a copy.
Rows are judged by their own text: repeated rows are copies of each other, and a doc_id with two texts can stand in two classes.
A null ``doc_id`` is never matched and comes back as a class of its own (null class_id). Extra columns are ignored by
``near_duplicates`` and kept by ``one_of_each``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusmill.llm import textkit as K
from corpusmill.llm.graph import components
from corpusmill.llm.skew import spread_join
from corpusmill.llm.store import arrow_ready, fresh, written

U = np.uint64


@dataclass(frozen=True)
class NearDupConfig:
    """Parameters; bands * rows is the signature's length."""

    shingle: int = 5
    threshold: float = 0.8
    bands: int = 25
    rows: int = 5


def _unit(h: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1]."""
    return ((h >> U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(shingles: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int, slots: int) -> np.ndarray:
    """BagMinHash signatures of many multisets: per document and slot, the name of the earliest point.

    ``doc`` is the document of each (shingle, count); documents without shingles keep zeros.
    """
    # a process for each shingle and weight interval that its count reaches into
    seeds, low, high, of, reach = [shingles], [np.zeros(len(shingles))], [np.ones(len(shingles))], [doc], [counts]
    level, top = 1, int(counts.max(initial=0))
    while level < top:
        has = np.flatnonzero(counts > level)
        seeds.append(K.mix(shingles[has] ^ U(level * 0x9E3779B1)))
        low.append(np.full(len(has), float(level)))
        high.append(np.full(len(has), 2.0 * level))
        of.append(doc[has])
        reach.append(counts[has])
        level *= 2
    seed, lo, of, count = np.concatenate(seeds), np.concatenate(low), np.concatenate(of), np.concatenate(reach)
    rate = np.concatenate(high) - lo
    weight = np.bincount(doc, weights=counts, minlength=docs)
    horizon = slots * (np.log(slots) + 2) / np.maximum(weight, 1)
    names = np.zeros((docs, slots), np.uint64)
    todo = weight > 0
    while todo.any():
        earliest = np.full(docs * slots, np.inf)
        left = np.flatnonzero(todo[of])
        state, t = seed[left], np.zeros(len(left))
        points = []
        wide = 1
        while len(left):
            with np.errstate(over="ignore"):
                drawn = K.mix(state[:, None] + np.arange(1, wide + 1, dtype=np.uint64))
            at = t[:, None] + np.cumsum(np.log(_unit(drawn)) / -rate[left][:, None], axis=1)
            until = horizon[of[left]]
            seen = at < until[:, None]
            row = np.nonzero(seen)[0]
            own, name, when = left[row], K.mix(drawn[seen]), at[seen]
            tall = count[own] < lo[own] + rate[own]  # the points of an interval that the count fills all count
            if tall.any():
                coins = K.mix(name) >> (U(64) - np.maximum(np.log2(rate[own]), 1).astype(np.uint64))  # down the halves, a bit each
                ok = ~tall | (lo[own] + coins < count[own])
                own, name, when = own[ok], name[ok], when[ok]
            slot = of[own] * slots + ((name >> U(32)) % U(slots)).astype(np.int64)
            np.minimum.at(earliest, slot, when)
            points.append((slot, name, when))
            going = at[:, -1] < until
            state, t, left = drawn[going, -1], at[going, -1], left[going]
            wide = min(16, 2 * wide + 1)
        for slot, name, when in points:
            won = earliest[slot] == when
            names.reshape(-1)[slot[won]] = name[won]
        horizon *= 2
        todo &= np.isinf(earliest.reshape(docs, slots)).any(axis=1)
    return names


def shingled(words: K.Words, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's shingles, sorted, and their offsets; one to n-1 words make one shingle."""
    count = np.where(words.count >= n, words.count - n + 1, (words.count > 0).astype(np.int64))
    off = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(off[-1], np.uint64)
    g = K.grams(h, n)
    for i in range(len(count)):
        at, to = words.off[i], words.off[i + 1]
        own = out[off[i] : off[i + 1]]
        own[:] = g[at : to - n + 1] if to - at >= n else K.grams(h[at:to], max(1, to - at))
        own.sort()
    return out, off


def runs(values: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, counts and documents of values that are sorted in each document."""
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[off[:-1][off[:-1] < off[1:]]] = True
    at = np.flatnonzero(first)
    return values[at], np.diff(np.append(at, len(values))), np.searchsorted(off, at, "right") - 1


SIGNED = pa.schema([("doc_id", pa.int64()), ("e1", pa.int64()), ("e2", pa.int64()), ("n_words", pa.int64()), ("bands", pa.list_(pa.int64()))])


def exact(w: K.Words, h: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each document's sequence of words."""
    with np.errstate(over="ignore"):
        place = w.position().astype(np.uint64)
        cum = [np.concatenate([[U(0)], np.cumsum(K.mix(h + K.mix(place + U(salt))), dtype=np.uint64)]) for salt in (11 << 40, 12 << 40)]
        return [(c[w.off[1:]] - c[w.off[:-1]]).view(np.int64) for c in cum]


def _signed(cfg: NearDupConfig):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = cfg.bands * cfg.rows
        for batch, buf, off in K.blocks(batches):
            w = K.Words(buf, off, K.SPACED)
            h = w.hashes()
            value, counts, doc = runs(*shingled(w, h, cfg.shingle))
            sig = signatures(value, counts, doc, batch.num_rows, slots).reshape(-1, cfg.bands, cfg.rows)
            key = np.broadcast_to(np.arange(cfg.bands, dtype=np.uint64), sig.shape[:2])
            for j in range(cfg.rows):
                key = K.mix(key ^ sig[:, :, j])
            bands = pa.ListArray.from_arrays(np.arange(0, key.size + 1, cfg.bands, dtype=np.int32), key.reshape(-1).view(np.int64))
            yield K.batch_of(SIGNED, batch.column("doc_id"), *exact(w, h), w.count, bands)

    return run


MULTISET = pa.schema([("node", pa.int64()), ("bag", pa.binary())])


def _bags(cfg: NearDupConfig):
    """The multisets of the rows (node, e1, e2, text) whose text has the hashes e1 and e2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches):
            w = K.Words(buf, off, K.SPACED)
            h = w.hashes()
            own = exact(w, h)
            right = (own[0] == batch.column("e1").to_numpy()) & (own[1] == batch.column("e2").to_numpy())
            values, at = shingled(w, h, cfg.shingle)
            at_right = np.flatnonzero(right)
            out = [values[at[i] : at[i + 1]].tobytes() for i in at_right.tolist()]
            yield K.batch_of(MULTISET, batch.column("node").take(pa.array(at_right)), pa.array(out, pa.binary()))

    return run


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The number of shingles that two multisets share, copies counted."""
    ua, ca = np.unique(a, return_counts=True)
    at = np.searchsorted(ua, b)
    hit = (at < len(ua)) & (ua[np.minimum(at, len(ua) - 1)] == b) if len(ua) else np.zeros(len(b), bool)
    return int(np.minimum(np.bincount(at[hit], minlength=len(ua)), ca).sum()) if len(ua) else 0


DISTINCT = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("n", pa.int64())])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's distinct shingles with their counts."""
    for batch in batches:
        bag = np.frombuffer(b"".join(x.as_buffer() for x in batch.column("bag")), np.uint64)
        size = np.array([len(x.as_buffer()) // 8 for x in batch.column("bag")], np.int64)
        value, count, doc = runs(bag, np.concatenate([[0], np.cumsum(size)]))
        yield K.batch_of(DISTINCT, value.view(np.int64), batch.column("node").to_numpy()[doc], count.astype(np.int64))


VERIFIED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("both", pa.int64()), ("sim", pa.float64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column("bag_a"), batch.column("bag_b")
        bags = [(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)) for i in range(batch.num_rows)]
        both = np.array([overlap(a, b) for a, b in bags], np.int64)
        either = np.array([len(a) + len(b) for a, b in bags], np.int64) - both
        yield K.batch_of(VERIFIED, batch.column("a"), batch.column("b"), both, both / np.maximum(either, 1))


def _sims(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Pairs (a, b) with their exact similarity."""
    got = pairs.join(bags.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    got = got.join(bags.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
    return written(got.select("a", "b", "bag_a", "bag_b").mapInArrow(_verify, "a long, b long, both long, sim double"), "sims")


def _classes(bags: DataFrame, member: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(node, root) of texts linked by verified similarity, from their multisets and the members (bucket, node, size) of band buckets."""
    t = cfg.threshold
    # a bucket's hub is its member with the most neighbours over all its buckets: the least edited copy
    central = member.groupBy("node").agg(F.sum("size").alias("near"))
    hubs = member.join(central, "node").groupBy("bucket").agg(F.max(F.struct("near", -F.col("node"))).alias("top")).select("bucket", (-F.col("top.col2")).alias("a"))
    stars = written(member.join(hubs, "bucket").select("bucket", "a", F.col("node").alias("b")), "stars")
    sims = _sims(stars.filter("a <> b").select("a", "b").distinct(), bags)
    links = sims.filter(F.col("sim") >= t).select(F.col("a").alias("u"), F.col("b").alias("v"))
    merged = components(links)

    # pairs that no hub has settled: another class, and no bound that forbids the similarity
    own = bags.mapInArrow(_distinct, "key long, node long, n long")
    alone = own.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum("n").alias("n")).filter("lo = hi")
    alone = alone.groupBy(F.col("lo").alias("node")).agg(F.sum("n").alias("alone"))
    facts = bags.select("node", (F.length("bag") / 8).alias("n")).join(alone, "node", "left").join(merged, "node", "left")
    facts = facts.select(F.col("node").alias("b"), "n", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("root", "node").alias("class"))
    placed = stars.join(sims, ["a", "b"], "left").withColumn("sim", F.coalesce("sim", F.lit(1.0))).join(facts, "b")
    # J >= t needs an overlap of t / (1 + t) of both sizes; a document's overlap with another is made of shingles
    # that it has in common with the hub, and of others that occur in a second document at all
    placed = placed.withColumn("both", F.coalesce("both", "n")).withColumn("other", F.greatest(F.col("n") - F.col("both") - F.col("alone"), F.lit(0)))
    placed = written(placed.withColumn("reach", (1 + t) / t * (F.col("both") + F.col("other")) - F.col("n") + 1e-6), "placed")
    # a pair is compared in its smallest shared bucket
    placed = placed.join(placed.groupBy("b").agg(F.array_sort(F.collect_set("bucket")).alias("own")), "b")
    # J >= t needs sizes within t of each other: partners lie in the same class of sizes or the next one on either side
    placed = placed.withColumn("step", F.floor(F.log("n") / -math.log(t)).cast("int"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("b", "n", "both", "other", "reach", "class", "sim", "own")]
    least = placed.groupBy("bucket").agg(F.min("n").alias("least"), F.count_distinct("class").alias("kinds")).filter("kinds > 1").select("bucket", "least")
    waiting = placed.filter(F.col("sim") < t).join(least, "bucket").filter(F.col("reach") >= F.col("least"))
    waiting = waiting.select("bucket", F.explode(F.array(*[F.col("step") + d for d in (-1, 0, 1)])).alias("step"), *side("x"))
    # 1 - J is a metric, so similarities to the hub differ by 1 - t at most
    fits = (
        ((F.col("sim_y") >= t) | (F.col("b_x") < F.col("b_y")))  # of two that wait, once
        & (F.col("class_x") != F.col("class_y"))
        & (F.least("both_x", "both_y") + F.least("other_x", "other_y") >= t / (1 + t) * (F.col("n_x") + F.col("n_y")) - 1e-6)
        & (F.abs(F.col("sim_x") - F.col("sim_y")) <= 1 - t + 1e-9)
        & (F.array_min(F.array_intersect("own_x", "own_y")) == F.col("bucket"))
    )
    members = placed.select(F.col("bucket").alias("bucket_y"), F.col("step").alias("step_y"), *side("y"))
    rest = waiting.join(members, (F.col("bucket") == F.col("bucket_y")) & (F.col("step") == F.col("step_y")) & fits)
    rest = written(rest.select(F.least("b_x", "b_y").alias("a"), F.greatest("b_x", "b_y").alias("b")).distinct(), "rest")
    if rest.isEmpty():
        return merged
    late = _sims(rest, bags).filter(F.col("sim") >= t).select(F.col("a").alias("u"), F.col("b").alias("v"))
    return components(merged.select(F.col("node").alias("u"), F.col("root").alias("v")).union(late))


def _rows(docs: DataFrame, cfg: NearDupConfig) -> DataFrame:
    """(doc_id, e1, e2, n_words, copy_of, class_id, root) for every row; root tells classes apart that share a class_id."""
    arrow_ready(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = written(base.mapInArrow(_signed(cfg), "doc_id long, e1 long, e2 long, n_words long, bands array<long>"), "signed")
    worded = signed.filter("n_words > 0 and doc_id is not null")
    # a node for each text; its number is fixed once it is written
    texts = worded.groupBy("e1", "e2").agg(F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    texts = written(texts.withColumn("node", F.monotonically_increasing_id()), "texts")
    keyed = texts.select("node", F.posexplode("bands").alias("band", "key")).select(F.xxhash64("band", "key").alias("bucket"), "node")
    shared = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    member = written(keyed.join(shared, "bucket"), "members")
    wanted = texts.join(member.select("node").distinct(), "node", "left_semi").select(F.col("copy_of").alias("doc_id"), "node", "e1", "e2")
    bags = base.join(wanted.hint("merge"), "doc_id").select("node", "e1", "e2", "text").mapInArrow(_bags(cfg), "node long, bag binary")
    merged = _classes(written(bags.dropDuplicates(["node"]), "bags"), member, cfg)
    merged = merged.union(merged.select(F.col("root").alias("node"), "root").distinct())  # a root stands for itself
    heads = merged.join(texts.select("node", "copy_of"), "node")
    heads = merged.join(heads.groupBy("root").agg(F.min("copy_of").alias("class_id")), "root")
    classed = texts.select("node", "e1", "e2", "copy_of", "n").join(heads, "node", "left")
    classed = classed.select("e1", "e2", "copy_of", "n", F.coalesce("class_id", "copy_of").alias("class_id"), F.coalesce("root", "node").alias("root"))
    own = spread_join(worded.drop("bands"), written(classed, "classed"), ["e1", "e2"], ["doc_id"])
    lone = signed.filter("n_words = 0 or doc_id is null").select(
        "doc_id", "e1", "e2", "n_words", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("root")
    )
    return own.select(lone.columns).union(lone)


def near_duplicates(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """(doc_id, n_words, copy_of, class_id) for every row of ``docs``.

    copy_of is the smallest doc_id with the same words, class_id the smallest of the class.
    """
    return _rows(docs, cfg).select("doc_id", "n_words", "copy_of", "class_id")


def one_of_each(docs: DataFrame, cfg: NearDupConfig = NearDupConfig()) -> DataFrame:
    """One row of ``docs`` for each class, of the smallest doc_id in it, and all rows without a doc_id."""
    rows = _rows(docs, cfg).filter("doc_id = class_id").groupBy("doc_id", "root").agg(F.min(F.struct("e1", "e2")).alias("e"))
    e1, e2 = fresh("e1", docs.columns), fresh("e2", docs.columns)
    names = {n: fresh(n, [*docs.columns, e1, e2]) for n in ("k_doc", "k_e1", "k_e2")}
    keys = rows.select(F.col("doc_id").alias(names["k_doc"]), F.col("e.e1").alias(names["k_e1"]), F.col("e.e2").alias(names["k_e2"])).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, off in K.blocks(batches):
            w = K.Words(buf, off, K.SPACED)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(e) for e in exact(w, w.hashes()))], [*batch.schema.names, e1, e2])

    schema = ST.StructType([*docs.schema.fields, ST.StructField(e1, ST.LongType()), ST.StructField(e2, ST.LongType())])
    marked = docs.filter("doc_id is not null").mapInArrow(run, schema)
    same = (F.col("doc_id").cast("long") == F.col(names["k_doc"])) & (F.col(e1) == F.col(names["k_e1"])) & (F.col(e2) == F.col(names["k_e2"]))
    kept = marked.join(keys, same, "left_semi").dropDuplicates(["doc_id", e1, e2]).select(docs.columns)
    return kept.unionByName(docs.filter("doc_id is null"))
