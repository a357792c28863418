"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ``order`` bytes long, learnt once and then
frozen. A byte costs -log2 of its share in the longest known context; where that context
never saw the byte, an escape is paid and the next shorter context asked (escape method C,
no exclusions); the empty context escapes to a uniform byte. The code length of a text is the
sum over its bytes, and the language with the shortest code wins.

As the statistics are frozen, a byte's cost depends on its last ``order + 1`` bytes only. All
languages share one trie of byte n-grams whose nodes carry the finished cost for every
language, so scoring walks the trie for all bytes of a block at once and sums exact code
lengths without a loop over bytes.

Learning uses a bounded sample: at most ``rows_per_lang`` texts of each language and
``rows`` in all, chosen by a hash of doc_id (of the text where that is null); of a text of more than ``max_bytes``
characters, so many from a place that the hash chooses. The model is
broadcast; that bound is also its bound. Scoring covers every byte of every text.

Defined cases: null text and text without a letter give ``und`` with score 0; rows with a null
lang or null text are not learnt from; with nothing to learn from every text is ``und``; equal
code lengths go to the first language in alphabetical order; repeated rows are scored alike.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm.store import arrow_ready


@dataclass(frozen=True)
class PpmConfig:
    order: int = 3
    rows_per_lang: int = 500
    rows: int = 4000
    max_bytes: int = 32768


class PpmModel:
    """A trie of byte n-grams over all languages, with costs and escapes in bits."""

    def __init__(self, texts: dict[str, list[bytes]], order: int):
        self.langs = sorted(texts)
        self.order = order
        n = len(self.langs)
        seen = np.zeros(256, bool)
        joined = []
        for lang in self.langs:
            raw = np.frombuffer(b"".join(texts[lang]), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(x) for x in texts[lang]])])
            seen[raw] = True
            joined.append((raw, off))
        self.code = np.zeros(256, np.int64)
        self.code[seen] = np.arange(1, seen.sum() + 1)  # 0: never learnt
        a = self.width = int(seen.sum()) + 1
        # level 1: one node for each symbol; costs under the empty context
        counts = np.stack([np.bincount(self.code[raw], minlength=a) for raw, _ in joined], axis=1) if n else np.zeros((a, 0))
        total, kinds = counts.sum(axis=0), (counts > 0).sum(axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape0 = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
            self.cost = [np.where(counts > 0, -np.log2(counts / (total + kinds)), escape0 + 8)]
        self.child: list[np.ndarray] = []
        self.escape: list[np.ndarray] = []
        nodes = [(self.code[raw], np.repeat(off[:-1], np.diff(off))) for raw, off in joined]  # node and document start by byte
        suffix_of = np.zeros(a, np.int64)
        for level in range(2, order + 2):
            contexts = len(self.cost[-1])
            grams, tails = [], []
            for (raw, _), (node, start) in zip(joined, nodes, strict=True):
                at = np.arange(1, len(raw))
                at = at[at - (level - 1) >= start[at]]
                grams.append((at, node[at - 1] * a + self.code[raw[at]]))
                tails.append(node)
            keys = np.unique(np.concatenate([g for _, g in grams])) if n else np.empty(0, np.int64)
            child = np.full((contexts + 1) * a, len(keys), np.int32)  # one row and one value more: unknown
            child[keys] = np.arange(len(keys))
            count = np.zeros((len(keys), n))
            suffix = np.zeros(len(keys), np.int64)
            fresh = []
            for l, ((at, g), (raw, _)) in enumerate(zip(grams, joined, strict=True)):
                ids = child[g]
                count[:, l] = np.bincount(ids, minlength=len(keys))
                node = np.full(len(raw), -1, np.int64)
                node[at] = ids
                suffix[ids] = tails[l][at]
                fresh.append((node, nodes[l][1]))
            context = keys // a
            total = np.zeros((contexts, n))
            kinds = np.zeros((contexts, n))
            for l in range(n):
                total[:, l] = np.bincount(context, weights=count[:, l], minlength=contexts)
                kinds[:, l] = np.bincount(context, weights=count[:, l] > 0, minlength=contexts)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0)
                own = -np.log2(count / (total + kinds)[context])
            self.cost.append(np.where(count > 0, own, escape[context] + self.cost[-1][suffix]))
            self.child.append(child)
            self.escape.append(np.vstack([escape, np.zeros((1, n))]).astype(np.float32))
            nodes = fresh
        self.base = np.concatenate([[0], np.cumsum([len(c) for c in self.cost])])
        self.cost = np.concatenate(self.cost).astype(np.float32)

    def code_lengths(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Bits of each document under each language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if not len(buf) or not self.langs:
            return out
        code = self.code.astype(np.int32)[buf]
        full = np.flatnonzero(np.diff(off) > 0)
        heads = off[full]
        node, top, paid = code, code, []
        for level in range(self.order):
            unknown = self.base[level + 1] - self.base[level]
            before = np.empty_like(node)
            before[1:] = node[:-1]
            before[heads] = unknown
            node = self.child[level][before * np.int32(self.width) + code]
            miss = node == self.base[level + 2] - self.base[level + 1]
            top = np.where(miss, top, node + np.int32(self.base[level + 1]))
            at = np.flatnonzero(miss & (before != unknown))
            paid.append((at, before[at]))
        bits = self.cost[top]
        for level, (at, context) in enumerate(paid):
            bits[at] += self.escape[level][context]
        out[full] = np.add.reduceat(bits, heads, axis=0, dtype=np.float64)
        return out


def held_out(doc_id: Column) -> Column:
    """The documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, may_learn: Column, cfg: PpmConfig = PpmConfig()) -> PpmModel:
    """Fit the trees on a bounded sample of the rows where ``may_learn`` holds."""
    rows = docs.filter(may_learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    texts: dict[str, list[bytes]] = {}
    if sizes:
        each = max(1, min(cfg.rows_per_lang, cfg.rows // len(sizes)))
        mark = F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit("ppm"))
        draw = F.pmod(mark, F.lit(1 << 30))
        wanted = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(int(min(1.0, 1.5 * each / n) * (1 << 30)))) for lang, n in sorted(sizes.items())])
        # of a long text a stretch of max_bytes characters at a place that the hash chooses
        spare = F.greatest(F.length("text") - cfg.max_bytes, F.lit(0))
        part = F.substring(F.lower("text"), (F.pmod(mark, spare + 1) + 1).cast("int"), F.lit(cfg.max_bytes))
        sample = rows.filter(draw < wanted).select("lang", draw.alias("draw"), part.alias("text"))
        sample = sample.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))).filter(F.col("place") <= each)
        for lang, _, text, _ in sorted(sample.collect(), key=lambda r: (r[0], r[3])):
            own = texts.setdefault(lang, [])
            if text:
                own.append(text.encode())
        texts = {k: v for k, v in texts.items() if v}
    return PpmModel(texts, cfg.order)


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, bits_per_byte); score is the winner's posterior under equal priors."""
    arrow_ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs = np.array([*m.langs, "und"], object)
        for batch, buf, off in K.blocks(batches, lower=True):
            bits = m.code_lengths(buf, off)
            worded = batch.column("worded").to_numpy(zero_copy_only=False).astype(bool) & bool(m.langs)
            best = bits.argmin(axis=1) if m.langs else np.zeros(batch.num_rows, int)
            if m.langs:
                low = bits.min(axis=1)
                post = 1 / np.exp2(-np.minimum(bits - low[:, None], 1000)).sum(axis=1)
                per = low / np.maximum(np.diff(off), 1)
            else:
                post = per = np.zeros(batch.num_rows)
            yield K.batch_of(SCORED, batch.column("doc_id"), batch.column("held_out"), langs[np.where(worded, best, len(m.langs))], np.round(np.where(worded, post, 0), 6), np.round(np.where(worded, per, 0), 6))

    worded = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", worded.alias("worded"))
    return base.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double")
