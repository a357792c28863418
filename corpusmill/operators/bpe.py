"""Byte-pair encoding: distributed counts, merges on the driver, Arrow encoding. (TOK2-3, TOK5, TOK7, AGG7, AGG16)

Words are counted by Spark; merging needs the distinct words only. They lie in blocks, flat arrays of ids, and a merge says how it changes the
counts of pairs. Up to ``driver_words`` words are merged on the driver; the blocks of more stay in a table. There a job tries the merges that the
driver expects from the commonest words, and those that the counts of all words confirm are taken, so both ways give the same merges.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusmill.functions import text as T
from corpusmill.operators.store import written

#: Ids of bytes start here; smaller ones are special. Fixed value.
FIRST_BYTE = 16


def word_counts(df: DataFrame, column: str = "text") -> DataFrame:
    return df.select(F.explode(T.words(T.text(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def pair_counts(counts: DataFrame) -> DataFrame:
    """(pair, n): neighbouring bytes in hexadecimal, weighted by how often their word occurs."""
    code = F.hex(F.encode("word", "UTF-8"))
    pairs = F.transform(F.sequence(F.lit(0), (F.length("code") / 2 - 2).cast("int")), lambda i: F.substring("code", i * 2 + 1, F.lit(4)))
    return counts.select("n", code.alias("code")).filter("length(code) >= 4").select("n", F.explode(pairs).alias("pair")).groupBy("pair").agg(F.sum("n").alias("n"))


class Block:
    """Words as one array of ids, each with a 0 after it, in ascending order of how often they occur; ``bound`` are the ends of those of one count."""

    def __init__(self, ids: np.ndarray, bound: np.ndarray, count: np.ndarray):
        self.ids, self.bound, self.count = ids, bound, count

    @staticmethod
    def of(words: pa.Array, n: np.ndarray | None = None) -> Block:
        """With counts, sorted by them; else in the order given."""
        if n is not None:
            order = np.argsort(n, kind="stable")
            words, n = words.take(pa.array(order)), n[order]
        raw = words.cast(pa.large_binary())
        off = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2], np.uint8)[off[0] : off[-1]] if len(raw) and raw.buffers()[2] is not None else np.empty(0, np.uint8)
        size = np.diff(off)
        ids = np.zeros(len(data) + len(size), np.uint32)
        ids[np.arange(len(data)) + np.repeat(np.arange(len(size)), size)] = data.astype(np.uint32) + FIRST_BYTE
        if n is None or not len(n):
            return Block(ids, np.empty(0, np.int64), np.empty(0, np.int64))
        last = np.flatnonzero(np.append(n[1:] != n[:-1], True))
        return Block(ids, np.cumsum(size + 1)[last], n[last])

    def copy(self) -> Block:
        return Block(self.ids.copy(), self.bound.copy(), self.count)

    def pairs(self, at: np.ndarray, sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(pair, count) of neighbours at ascending places, pairs as one number."""
        a, b = self.ids[at].astype(np.int64), self.ids[at + 1].astype(np.int64)
        real = (a > 0) & (b > 0)
        at = at[real]
        return (a[real] << 32) | b[real], sign * self.count[np.searchsorted(self.bound, at, "right")]

    def all_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return summed(*self.pairs(np.arange(max(0, len(self.ids) - 1))))

    def merge(self, a: int, b: int, new: int, counted: bool = True) -> tuple[np.ndarray, np.ndarray] | None:
        """Put ``new`` for each a, b from the left on; the changes of the counts of pairs."""
        hit = self.ids == a
        at = np.flatnonzero(hit[:-1] & (self.ids[1:] == b)) if a != b else np.flatnonzero(hit[:-1] & hit[1:])
        if a == b and len(at):  # every other one of a run
            head = np.append(True, np.diff(at) > 1)
            at = at[(at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0]
        if not len(at):
            return (np.empty(0, np.int64), np.empty(0, np.int64)) if counted else None
        if counted:
            near = np.unique(np.concatenate([at - 1, at, at + 1]))
            before = self.pairs(near[near >= 0], -1)
        self.ids[at] = new
        left = np.ones(len(self.ids), bool)
        left[at + 1] = False
        self.ids = self.ids[left]
        if not counted:
            return None
        self.bound = self.bound - np.searchsorted(at + 1, self.bound)
        at = at - np.arange(len(at))
        near = np.unique(np.concatenate([at - 1, at]))
        return summed(*(np.concatenate(v) for v in zip(before, self.pairs(near[near >= 0]), strict=True)))


def summed(pair: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row a pair."""
    if not len(pair):
        return pair, n
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    head = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
    return pair[head], np.add.reduceat(n, head)


class Choice:
    """Counts of pairs, and the next merge by them: the commonest pair, the smallest of equals."""

    def __init__(self, min_freq: int, max_bytes: int):
        self.least, self.most = min_freq, max_bytes
        self.size = {FIRST_BYTE + b: 1 for b in range(256)}
        self.seen: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []
        self.merges: list[tuple[int, int]] = []

    def copy(self) -> Choice:
        other = Choice(self.least, self.most)
        other.size, other.seen, other.heap, other.merges = dict(self.size), dict(self.seen), list(self.heap), list(self.merges)
        return other

    def add(self, pair: np.ndarray, n: np.ndarray) -> None:
        for p, d in zip(pair.tolist(), n.tolist(), strict=True):
            if d:
                now = self.seen[p] = self.seen.get(p, 0) + d
                if now >= self.least:
                    heapq.heappush(self.heap, (-now, p))

    def next(self) -> tuple[int, int] | None:
        while self.heap:
            n, p = self.heap[0]
            a, b = p >> 32, p & 0xFFFFFFFF
            if self.seen[p] == -n and self.size[a] + self.size[b] <= self.most:
                return a, b
            heapq.heappop(self.heap)  # an old count, or too long for good
        return None

    def take(self, pair: tuple[int, int]) -> int:
        new = FIRST_BYTE + 256 + len(self.merges)
        self.size[new] = self.size[pair[0]] + self.size[pair[1]]
        self.merges.append(pair)
        return new


def train(counts: DataFrame, merges: int, min_freq: int = 2, max_bytes: int = 32, driver_words: int = 2_000_000) -> list[tuple[int, int]]:
    """Merges in order: the commonest pair of ids each time, the smallest of equals. (TOK2, TOP6)"""
    often = written(counts.filter(F.col("n") >= min_freq).select("word", F.col("n").cast("long").alias("n")), "words")
    if often.count() > driver_words:
        return _train_apart(often, merges, min_freq, max_bytes)
    return _merged(_blocks(often), Choice(min_freq, max_bytes), merges).merges


#: Words of a block.
_WORDS = 100_000


def _blocks(often: DataFrame) -> list[Block]:
    rows = often.toArrow().combine_chunks()
    return [Block.of(part["word"].combine_chunks(), part["n"].to_numpy()) for part in (rows.slice(i, _WORDS) for i in range(0, rows.num_rows, _WORDS))]


def _merged(blocks: list[Block], choice: Choice, merges: int) -> Choice:
    for block in () if choice.seen else blocks:
        choice.add(*block.all_pairs())
    while len(choice.merges) < merges and (pair := choice.next()):
        new = choice.take(pair)
        for block in blocks:
            choice.add(*block.merge(*pair, new))
    return choice


_BLOCK_DDL = "ids binary, bound binary, count binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches as tables of about _WORDS rows."""
    kept, size = [], 0
    for batch in batches:
        kept.append(batch)
        size += batch.num_rows
        if size >= _WORDS:
            yield pa.Table.from_batches(kept).combine_chunks()
            kept, size = [], 0
    if size:
        yield pa.Table.from_batches(kept).combine_chunks()


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _gathered(batches):
        yield _row(Block.of(rows["word"].combine_chunks(), rows["n"].to_numpy()))


def _row(block: Block) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: pa.array([getattr(block, n).tobytes()], pa.binary()) for n in ("ids", "bound", "count")})


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(*(np.frombuffer(batch.column(n)[i].as_buffer(), t) for n, t in (("ids", np.uint32), ("bound", np.int64), ("count", np.int64)))).copy()


def _replayed(done: list[tuple[int, int]], first: int, tried: list[tuple[int, int]] | None):
    """Blocks after merges (the ``first``-th on), or how each of the tried ones after these changes the counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _unpacked(batches):
            for i, pair in enumerate(done):
                block.merge(*pair, FIRST_BYTE + 256 + first + i)
            if tried is None:
                yield _row(block)
            for i, pair in enumerate(tried or ()):
                p, n = block.merge(*pair, FIRST_BYTE + 256 + first + len(done) + i)
                yield pa.RecordBatch.from_pydict({"step": pa.array(np.full(len(p), i)), "pair": pa.array(p), "n": pa.array(n)})

    return run


def _every_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _unpacked(batches):
        p, n = block.all_pairs()
        yield pa.RecordBatch.from_pydict({"pair": pa.array(p), "n": pa.array(n)})


def _train_apart(often: DataFrame, merges: int, min_freq: int, max_bytes: int, ahead: int = 16, every: int = 32, guess_words: int = 200_000) -> list[tuple[int, int]]:
    """The same over a table of blocks. A job tries up to ``ahead`` merges, guessed from the commonest words; they are taken as long as the whole counts choose them."""
    now = written(often.select("word", "n").mapInArrow(_packed, _BLOCK_DDL), "blocks")
    choice = Choice(min_freq, max_bytes)
    whole = now.mapInArrow(_every_pair, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    choice.add(whole["pair"].to_numpy(), whole["n"].to_numpy())
    blocks = _blocks(often.orderBy(F.desc("n"), "word").limit(guess_words))
    guess = Choice(min_freq, max_bytes)
    for block in blocks:
        guess.add(*block.all_pairs())
    written_upto = 0
    while len(choice.merges) < merges and (pair := choice.next()):
        tried, trial, copies = [], guess.copy(), [b.copy() for b in blocks]
        while pair and len(tried) < min(ahead, merges - len(choice.merges)):
            tried.append(pair)
            new = trial.take(pair)
            for block in copies:
                trial.add(*block.merge(*pair, new))
            pair = trial.next()
        job = now.mapInArrow(_replayed(choice.merges[written_upto:], written_upto, tried), "step long, pair long, n long")
        found = job.groupBy("step", "pair").agg(F.sum("n").alias("n")).toArrow()
        step, changed, n = (found[c].to_numpy() for c in ("step", "pair", "n"))
        for i, pair in enumerate(tried):
            if choice.next() != pair:
                break
            new = choice.take(pair)
            guess.take(pair)
            choice.add(changed[step == i], n[step == i])
            for block in blocks:
                guess.add(*block.merge(*pair, new))
        if len(choice.merges) - written_upto >= every:
            now = written(now.mapInArrow(_replayed(choice.merges[written_upto:], written_upto, None), _BLOCK_DDL), "blocks")
            written_upto = len(choice.merges)
    return choice.merges


def sizes(words: DataFrame, merges: list[tuple[int, int]]) -> DataFrame:
    """Rows with a ``word``, and its ids counted in ``ids``; all words of a block at once, merge by merge, which gives what Encoder gives."""
    schema = words.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            block = Block.of(rows["word"].combine_chunks())
            for i, pair in enumerate(merges):
                block.merge(*pair, FIRST_BYTE + 256 + i, False)
            ends = np.flatnonzero(block.ids == 0)
            ids = np.diff(np.append(-1, ends)) - 1
            yield from rows.append_column("ids", pa.array(ids)).to_batches()

    return words.mapInArrow(run, ST.StructType([*schema.fields, ST.StructField("ids", ST.LongType())]))


class Encoder:
    """Applies merges by rank, the leftmost first, with a cache of words."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.rank = {p: i for i, p in enumerate(merges)}
        self.bytes = {FIRST_BYTE + b: bytes([b]) for b in range(256)}
        for i, (a, b) in enumerate(merges):
            self.bytes[FIRST_BYTE + 256 + i] = self.bytes[a] + self.bytes[b]
        self.cache: dict[str, list[int]] = {}

    def word(self, word: str) -> list[int]:
        found = self.cache.get(word)
        if found is not None:
            return found
        ids = [FIRST_BYTE + b for b in word.encode()]
        while len(ids) > 1:
            rank, at = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(ids, ids[1:])))
            if rank == len(self.rank):
                break
            ids[at : at + 2] = [FIRST_BYTE + 256 + rank]
        if len(self.cache) >= 200_000:
            self.cache.clear()
        self.cache[word] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


def encoded(words: Column, merges: list[tuple[int, int]]) -> Column:
    """The ids of an array of words."""
    keep: list[Encoder] = []

    def run(batch: pd.Series) -> pd.Series:
        if not keep:
            keep.append(Encoder(merges))
        return batch.map(lambda w: [i for x in w for i in keep[0].word(x)])

    return F.pandas_udf(run, ST.ArrayType(ST.IntegerType()))(words)
