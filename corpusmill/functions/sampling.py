"""Decoding and scoring functions over arrays: penalties, banned n-grams, perplexity. (WIN10, VEC12, AGG18, EVL4)"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def penalized(logits: Column, recent: Column, repetition: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> Column:
    """Logits of token ids after penalties for the ids in ``recent``."""

    def one(v: Column, i: Column) -> Column:
        n = F.size(F.filter(recent, lambda t: t == i))
        scaled = F.when(v > 0, v / repetition).otherwise(v * repetition)
        return F.when(n > 0, scaled - frequency * n - presence).otherwise(v)

    return F.transform(logits, one)


def banned(ids: Column, n: int) -> Column:
    """Tokens that would repeat an n-gram of ``ids``."""
    tail = F.slice(ids, F.size(ids) - n + 2, n - 1)
    starts = F.sequence(F.lit(0), F.size(ids) - n)
    follow = F.transform(F.filter(starts, lambda i: F.slice(ids, i + 1, n - 1) == tail), lambda i: F.get(ids, i + n - 1))
    return F.when(F.size(ids) >= n, F.array_distinct(follow)).otherwise(F.slice(ids, 1, 0))


def perplexity(nll: Column, tokens: Column) -> Column:
    """An aggregate: exp of the token-weighted mean loss, which counts as 20 at most; 0 without tokens."""
    mean = F.sum(nll * tokens) / F.sum(tokens)
    return F.when(F.sum(tokens) > 0, F.exp(F.least(F.lit(20.0), mean))).otherwise(0.0)
