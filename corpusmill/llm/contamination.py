"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of digits, letters and non-ASCII characters. The n-grams of test items are
looked up in all documents twice. The first scan counts the documents that hold each n-gram. An
item's seeds are its rare n-grams: those in no more documents than ``rare`` times the median of the item's n-grams
that occur, or in no more than ``few`` documents. Rarity is relative to the item, so an item that leaked
into a third of the corpus keeps its seeds, edited or in part, while phrases that are common beside it drop out. The second scan
joins passages to items by seeds; hits of one item that lie within its length of each other make a window, and the
window is aligned with the item by Smith-Waterman over words. The score is the best local alignment
(1 for an equal word, less ``penalty`` for a differing, missing or added one) over the item's
length: 1 for a verbatim copy.

Test items are taken in blocks of at most ``block_words`` words; only a block's n-grams and words are
broadcast, and every block sees every document. The scans shuffle counts of the items' n-grams only.

Defined cases: an item of fewer than ``n`` words has no seed and matches nothing; null and empty texts match
nothing; several matching windows of an item in a document give the best one, the first of equals;
repeated documents or items are reported each, those without an id with a null one; an empty table gives no rows. Extra columns
are ignored by ``leaks`` and kept by ``without_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm.store import arrow_ready

U = np.uint64


@dataclass(frozen=True)
class LeakConfig:
    n: int = 3
    rare: float = 4.0
    few: int = 20
    threshold: float = 0.4
    penalty: float = 0.5
    block_words: int = 1_000_000


class Items:
    """A block of test items: their words, and their n-grams with places."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [i for i, _ in rows]
        column = pa.array([(t or "").lower() for _, t in rows], pa.large_string())
        buf, off = K.string_buffers(column)
        w = K.Words(buf, off, K.LETTERED)
        h = w.hashes()
        self.words = [h[w.off[i] : w.off[i + 1]] for i in range(len(rows))]
        item, place = w.doc(), w.position()
        g = K.grams(h, n)
        whole = item[: len(g)] == item[len(item) - len(g) :] if len(g) else np.empty(0, bool)
        order = np.argsort(g[whole], kind="stable")
        self.gram, self.item, self.place = g[whole][order], item[: len(g)][whole][order], place[: len(g)][whole][order]
        self.keys, self.first = np.unique(self.gram, return_index=True)

    def keep(self, seeds: np.ndarray) -> None:
        """Forget the (gram, item) rows that are no seeds."""
        self.gram, self.item, self.place = self.gram[seeds], self.item[seeds], self.place[seeds]
        self.keys, self.first = np.unique(self.gram, return_index=True)


class Sieve:
    """Places where sorted keys occur among many hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = min(26, max(12, int(np.ceil(np.log2(max(1, len(keys)) * 32)))))
        self.shift = U(64 - bits)
        self.bits = np.zeros(1 << bits, bool)
        self.bits[keys >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.bits[hashes >> self.shift])
        if not len(self.keys):
            return at[:0], at[:0]
        key = np.minimum(np.searchsorted(self.keys, hashes[at]), len(self.keys) - 1)
        ok = self.keys[key] == hashes[at]
        return at[ok], key[ok]


def _words_and_grams(buf: np.ndarray, off: np.ndarray, n: int) -> tuple[K.Words, np.ndarray, np.ndarray, np.ndarray]:
    w = K.Words(buf, off, K.LETTERED)
    h = w.hashes()
    return w, h, K.grams(h, n), w.doc()


def align(item: np.ndarray, window: np.ndarray, penalty: float) -> tuple[float, int]:
    """The best local alignment of an item in a window of words: its value, and where it ends.

    Gaps cost the same per word, so a row follows from the row above and a running maximum.
    """
    slope = penalty * np.arange(len(window))
    above = np.zeros(len(window))
    best, end = 0.0, 0
    for word in item:
        row = np.where(window == word, 1.0, -penalty)
        row[1:] += above[:-1]
        np.maximum(row, above - penalty, out=row)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        at = int(row.argmax())
        if row[at] > best + 1e-9:
            best, end = float(row[at]), at + 1
        above = row
    return best, end


_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])
_FOUND_DDL = "doc_id long, item_id long, score double, start_word long, end_word long"


def _document_counts(docs: DataFrame, items: Items, n: int) -> np.ndarray:
    """For each distinct n-gram of the items, the number of documents that hold it."""
    shared = docs.sparkSession.sparkContext.broadcast(items.keys)
    schema = pa.schema([("key", pa.int32()), ("docs", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = Sieve(shared.value)
        for _, buf, off in K.blocks(batches, lower=True):
            _, _, g, doc = _words_and_grams(buf, off, n)
            at, key = sieve.find(g)
            inside = doc[at] == doc[at + n - 1]
            pair = np.unique(doc[at[inside]] * len(sieve.keys) + key[inside])
            keys, seen = np.unique(pair % max(1, len(sieve.keys)), return_counts=True)
            yield K.batch_of(schema, keys.astype(np.int32), seen)

    table = docs.select("text").mapInArrow(count, "key int, docs long").groupBy("key").agg(F.sum("docs").alias("docs")).toArrow()
    found = np.zeros(len(items.keys), np.int64)
    found[table["key"].to_numpy()] = table["docs"].to_numpy()
    return found


class Finder:
    """Finds the items of a block in blocks of text; ``held`` tells in how many documents each of their n-grams stands."""

    def __init__(self, items: Items, held: np.ndarray, cfg: LeakConfig):
        self.items, self.cfg = items, cfg
        per_row = held[np.searchsorted(items.keys, items.gram)]
        middle = np.zeros(len(items.words))
        for i in np.unique(items.item[per_row > 0]):
            middle[i] = np.median(per_row[(items.item == i) & (per_row > 0)])
        items.keep((per_row <= cfg.rare * middle[items.item]) | (per_row <= cfg.few))

    def find(self, buf: np.ndarray, off: np.ndarray) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(score, start, end) of the best window of each (document, item) that reaches the threshold."""
        own, cfg = self.items, self.cfg
        sieve = Sieve(own.keys)
        last = np.append(own.first[1:], len(own.gram))
        w, h, g, doc = _words_and_grams(buf, off, cfg.n)
        at, key = sieve.find(g)
        inside = doc[at] == doc[at + cfg.n - 1]
        at, key = at[inside], key[inside]
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        if not len(at):
            return best
        times = (last - own.first)[key]  # an n-gram may stand in several items
        row = np.repeat(own.first[key], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        at = np.repeat(at, times)
        item = own.item[row]
        origin = at - own.place[row]  # where the item would begin
        order = np.lexsort((origin, item, doc[at]))
        at, item, origin = at[order], item[order], origin[order]
        size = np.array([len(x) for x in own.words], np.int64)[item]
        new = np.ones(len(at), bool)
        new[1:] = (doc[at[1:]] != doc[at[:-1]]) | (item[1:] != item[:-1]) | (origin[1:] - origin[:-1] > size[1:])
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(at))
        for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
            d, i = int(doc[at[a]]), int(item[a])
            words = own.words[i]
            slack = len(words) // 2
            lo = max(int(w.off[d]), int(origin[a]) - slack)
            hi = min(int(w.off[d + 1]), int(origin[b - 1]) + len(words) + slack)
            window = h[lo:hi]
            if np.isin(words, window).sum() < cfg.threshold * len(words):  # no alignment can reach it
                continue
            value, end = align(words, window, cfg.penalty)
            score = round(value / len(words), 6)
            if score >= cfg.threshold and score > best.get((d, i), (0,))[0]:
                back, begin = align(words[::-1], window[:end][::-1], cfg.penalty)
                best[d, i] = (score, lo + end - begin - int(w.off[d]), lo + end - int(w.off[d]))
        return best


def _finders(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig) -> list[Finder]:
    """A finder for each block of test items, its seeds chosen over all of ``docs``."""
    arrow_ready(docs.sparkSession)
    out: list[Finder] = []
    block: list[tuple[int, str]] = []
    words = 0

    def close() -> None:
        items = Items(block, cfg.n)
        out.append(Finder(items, _document_counts(docs, items, cfg.n), cfg))

    for row in benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        words += len((row[1] or "").split())
        if words >= cfg.block_words:
            close()
            block, words = [], 0
    if block:
        close()
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): test items found in documents, with where they stand."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found: list[DataFrame] = []
    for finder in _finders(docs, benchmark, cfg):
        shared = spark.sparkContext.broadcast(finder)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, buf, off in K.blocks(batches, lower=True):
                best = shared.value.find(buf, off)
                if best:
                    ids = batch.column("doc_id")
                    rows = [(ids[d].as_py(), shared.value.items.ids[i], *best[d, i]) for d, i in sorted(best)]
                    yield K.batch_of(_FOUND, *(list(c) for c in zip(*rows, strict=True)))

        found.append(base.mapInArrow(search, _FOUND_DDL))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND_DDL)


def without_leaks(docs: DataFrame, benchmark: DataFrame, cfg: LeakConfig = LeakConfig()) -> DataFrame:
    """The rows of ``docs`` in which no test item was found; each row is judged by its own text, whatever its doc_id."""
    kept = docs
    for finder in _finders(docs, benchmark, cfg):
        shared = docs.sparkSession.sparkContext.broadcast(finder)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch, buf, off in K.blocks(batches, lower=True):
                keep = np.ones(batch.num_rows, bool)
                keep[[d for d, _ in shared.value.find(buf, off)]] = False
                yield batch.filter(pa.array(keep))

        kept = kept.mapInArrow(clean, docs.schema)
    return kept
