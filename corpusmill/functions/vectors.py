"""Vector, sampling and quantising functions over array columns. (VEC1-7, VEC9-16, TOP2-5, AGG20-21, AGG24, JN9)"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST


def doubles(x: Column) -> Column:
    return x.cast("array<double>")


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-30))


def rounded(x: Column, digits: int) -> Column:
    """To so many decimal digits as SQL engines in C do: halves of the scaled double away from zero, and the sign of a zero stays."""
    power = 10.0**digits
    scaled = x * power
    size = F.abs(scaled)
    whole = F.floor(size).cast("double")
    near = F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole)
    # doubles from 2 to the 52 on are whole numbers, and floor's range ends at 64 bits
    out = F.when((size >= 2.0**52) | (size == whole), scaled).when(scaled < 0, -near).otherwise(near) / power
    return F.when(size < float("inf"), out).otherwise(x)


def axpy(alpha: float, x: Column, y: Column) -> Column:
    return F.zip_with(x, y, lambda u, v: u * alpha + v)


def rmsnorm(x: Column, eps: float = 1e-6) -> Column:
    """Divided by the root mean square; what is not finite becomes 0."""
    scale = F.array(F.sqrt(dot(x, x) / F.size(x) + eps))  # an array of one, so that it is worked out once a vector
    divided = F.flatten(F.transform(scale, lambda s: F.transform(x, lambda v: v / s)))
    return F.transform(divided, lambda v: F.when(F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v))


def softmax(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    return F.transform(e, lambda v: v / total(e))


def silu(x: Column) -> Column:
    return F.transform(x, lambda v: v / (1 + F.exp(-v)))


def swiglu(gate: Column, up: Column) -> Column:
    return F.zip_with(silu(gate), up, lambda a, b: a * b)


def log_prob(x: Column, at: Column) -> Column:
    top = F.array_max(x)
    return F.get(x, at) - top - F.log(total(F.transform(x, lambda v: F.exp(v - top))))


def cross_entropy(x: Column, at: Column, z: float = 0.0, ignore: int = -100) -> Column:
    """Loss of a target, with z times the squared log-partition; null for an ignored one."""
    top = F.array_max(x)
    part = top + F.log(total(F.transform(x, lambda v: F.exp(v - top))))
    return F.when(at != ignore, part - F.get(x, at) + z * part * part)


def argmax(x: Column) -> Column:
    """The first place of the maximum."""
    return F.array_position(x, F.array_max(x)) - 1


def top_k(x: Column, k: int) -> Column:
    """The k largest values with their places, ties by place."""
    pairs = F.transform(x, lambda v, i: F.struct((-v).alias("neg"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct(p["i"].alias("i"), (-p["neg"]).alias("value")))


def nucleus(p: Column, top_p: float, min_p: float = 0.0) -> Column:
    """Places of the most probable values until their sum reaches top_p, the one that crosses it included."""
    ordered = top_k(p, 1 << 30)
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("kept"))
    least = min_p * F.array_max(p)

    def step(s: Column, v: Column) -> Column:
        take = (s["sum"] < top_p) & (v["value"] >= least)
        return F.struct((s["sum"] + v["value"]).alias("sum"), F.when(take, F.concat(s["kept"], F.array(v["i"].cast("int")))).otherwise(s["kept"]).alias("kept"))

    return F.aggregate(ordered, start, step, lambda s: s["kept"])


def quantized(x: Column, levels: int = 127) -> Column:
    """(scale, q) of one block: symmetric steps, halves away from zero; a block that is not finite becomes zeros."""
    bad = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    scale = F.when(bad, 0.0).otherwise(F.array_max(F.transform(x, F.abs)) / levels)
    return F.struct(scale.alias("scale"), F.transform(x, lambda v: F.when(scale > 0, F.greatest(F.least(F.round(v / scale), F.lit(float(levels))), F.lit(-float(levels)))).otherwise(0.0).cast("int")).alias("q"))


def dequantized(block: Column) -> Column:
    return F.transform(block["q"], lambda q: q * block["scale"])


def blocks(x: Column, size: int) -> Column:
    """A vector cut in blocks, the last one may be short."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(size)), lambda i: F.slice(x, i + 1, size))


def quantization_error(x: Column, back: Column) -> dict[str, Column]:
    diff = F.zip_with(x, back, lambda a, b: a - b)
    rmse = F.sqrt(dot(diff, diff) / F.size(x))
    return {"rmse": rmse, "max_abs": F.array_max(F.transform(diff, F.abs)), "rel_rmse": rmse / F.greatest(norm(x) / F.sqrt(F.size(x)), F.lit(1e-30)), "cosine": cosine(x, back)}


def learning_rate(step: Column, peak: float, warmup: int, steps: int, kind: str = "cosine", floor: float = 0.1, decay: float = 0.2) -> Column:
    """Warm-up, then a cosine, or a plateau with a straight end. (VEC16)"""
    s = F.least(F.greatest(step, F.lit(0)), F.lit(steps))
    rise = peak * (s + 1) / max(warmup, 1)
    if kind == "wsd":
        stable = max(warmup, steps - int(decay * (steps - warmup)))
        rest = F.when(s < stable, F.lit(peak)).otherwise(peak * (1 - (1 - floor) * F.least((s - stable) / max(steps - stable, 1), F.lit(1.0))))
    else:
        rest = peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * F.least((s - warmup) / max(steps - warmup, 1), F.lit(1.0)))))
    return F.when(s < warmup, rise).otherwise(rest)


def router(logits: Column, k: int) -> Column:
    """The k most probable experts of a softmax, with weights that sum to 1. (VEC9, TOP4)"""
    picked = top_k(softmax(logits), k)
    all_of = F.aggregate(picked, F.lit(0.0), lambda s, p: s + p["value"])
    return F.transform(picked, lambda p: F.struct(p["i"].cast("int").alias("expert"), F.when(all_of > 1e-8, p["value"] / all_of).otherwise(0.0).alias("weight")))


def quantized4(x: Column, with_min: bool = False) -> Column:
    """(scale, least, q) of one block in 16 steps: around zero (q from -8 to 7), or with ``with_min`` from the least value on (q from 0 to 15). (VEC14)

    Scales are half-precision numbers; a block that is not finite becomes zeros.
    """
    bad = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    low = F.when(F.lit(with_min) & ~bad, F.array_min(x)).otherwise(0.0)
    wide = F.when(bad, 0.0).when(F.lit(with_min), (F.array_max(x) - F.array_min(x)) / 15).otherwise(F.array_max(F.transform(x, F.abs)) / 8)
    least, most = (0, 15) if with_min else (-8, 7)
    q = F.transform(x, lambda v: F.when(wide > 0, F.greatest(F.least(F.round((v - low) / wide), F.lit(float(most))), F.lit(float(least)))).otherwise(0.0).cast("int"))
    return F.struct(half(wide).alias("scale"), half(low).alias("least"), q.alias("q"))


def dequantized4(block: Column) -> Column:
    return F.transform(block["q"], lambda q: q * block["scale"] + block["least"])


def half(x: Column) -> Column:
    """A number after a round trip through half precision, nearest with ties to even. (VEC15)"""
    size = F.abs(x.cast("double"))
    near = F.floor(F.log2(F.when(size > 0, size).otherwise(1.0)))
    power = F.when(F.pow(F.lit(2.0), near + 1) <= size, near + 1).when(F.pow(F.lit(2.0), near) > size, near - 1).otherwise(near)
    step = F.pow(F.lit(2.0), F.greatest(power, F.lit(-14)) - 10)
    rounded = F.bround(size / step) * step
    return F.when(F.isnan(x), x.cast("double")).when(rounded > 65504, F.signum(x) * float("inf")).otherwise(F.signum(x) * rounded)


@F.pandas_udf(ST.DoubleType())
def brain_half(x: pd.Series) -> pd.Series:
    """A number after a round trip through the upper 16 bits of single precision, nearest with ties to even. (VEC15)"""
    bits = x.to_numpy(np.float32).view(np.uint32).astype(np.uint64)
    special = (bits >> 23 & 0xFF) == 0xFF
    near = np.where(special, bits >> 16, (bits + 0x7FFF + (bits >> 16 & 1)) >> 16)
    return pd.Series((near << 16).astype(np.uint32).view(np.float32).astype(np.float64), index=x.index)


def linear(x: Column, weights: list[list[float]], bias: list[float] | None = None) -> Column:
    """A matrix, row by row, times a vector, in whole Arrow batches; products are summed in their order, whatever the batch. (VEC2)"""
    matrix = np.array(weights, np.float64)

    def run(batch: pd.Series) -> pd.Series:
        if not len(batch):
            return batch
        rows = np.stack(batch.to_list()).astype(np.float64)
        out = np.zeros((len(rows), len(matrix)))
        for column, weight in zip(rows.T, matrix.T, strict=True):
            out += column[:, None] * weight
        return pd.Series(list(out + (0 if bias is None else np.array(bias))), index=batch.index)

    return F.pandas_udf(run, "array<double>")(x)


def split_heads(x: Column, sizes: dict[str, int]) -> dict[str, Column]:
    """A fused projection cut into named parts. (VEC2)"""
    out, at = {}, 1
    for name, size in sizes.items():
        out[name] = F.slice(x, at, size)
        at += size
    return out


def rope(x: Column, position: Column, theta: float = 10_000.0, scale: float = 1.0, low: float = 1.0, high: float = 32.0) -> Column:
    """Rotary position embedding of one head; pairs are neighbours. (VEC6)

    With ``scale`` above 1, wave lengths above ``high`` are stretched by it, those below ``low`` stay, and the ones between are blended.
    """
    pi2 = 2 * math.pi
    n = F.size(x)

    def angle(i: Column) -> Column:
        base = F.pow(F.lit(theta), -(2.0 * i) / n)
        if scale <= 1:
            return position * base
        share = F.least(F.greatest((pi2 / base - low) / ((high - low) or 1.0), F.lit(0.0)), F.lit(1.0))
        return position * base * (1 - share + share / scale)

    pair = F.sequence(F.lit(0), (n / 2).cast("int") - 1)
    turned = F.transform(
        pair,
        lambda i: F.array(
            F.get(x, 2 * i) * F.cos(angle(i)) - F.get(x, 2 * i + 1) * F.sin(angle(i)),
            F.get(x, 2 * i) * F.sin(angle(i)) + F.get(x, 2 * i + 1) * F.cos(angle(i)),
        ),
    )
    return F.flatten(turned)


def sampled(logits: Column, draw: Column, temperature: float = 1.0, most: int = 0, top_p: float = 0.0, min_p: float = 0.0) -> Column:
    """The id that a uniform ``draw`` in [0, 1) picks: the largest logit at temperature 0, else by probability among the ``most``
    largest (at most 2,048), those that reach ``min_p`` of the best, and the fewest whose sum reaches ``top_p``. (VEC13)"""
    if temperature <= 0 or most == 1:
        return argmax(logits)
    best = top_k(logits, min(most, 2048) if most > 0 else (2048 if top_p or min_p else 1 << 30))
    e = F.transform(best, lambda b: F.exp((b["value"] - F.get(best, F.lit(0))["value"]) / temperature))
    p = F.transform(e, lambda v: v / total(e))
    least = min_p * F.get(p, F.lit(0))
    start = F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("kept"))

    def step(s: Column, v: Column) -> Column:
        take = (F.size(s["kept"]) == 0) | ((v >= least) & ((s["sum"] < top_p) if 0 < top_p < 1 else F.lit(True)))
        return F.struct((s["sum"] + v).alias("sum"), F.when(take, F.concat(s["kept"], F.array(v))).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate(p, start, step, lambda s: s["kept"])
    goal = draw * total(kept)
    begun = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    place = F.aggregate(kept, begun, lambda s, v: F.struct((s["sum"] + v).alias("sum"), (s["n"] + F.when(s["sum"] + v < goal, 1).otherwise(0)).alias("n")), lambda s: s["n"])
    return F.get(best, F.least(place, F.size(kept) - 1))["i"]


def expert_load(picked: DataFrame, experts: int, column: str = "picked") -> DataFrame:
    """(expert, slots, share, balance) of rows with an array of (expert, weight): balance is 1 where all experts get alike, ``experts`` at worst. (AGG21)"""
    counts = picked.select(F.explode(column).alias("p")).groupBy(F.col("p.expert").alias("expert")).agg(F.count(F.lit(1)).alias("slots"))
    every = picked.sparkSession.range(experts).select(F.col("id").cast("int").alias("expert")).join(counts, "expert", "left")
    whole = every.agg(F.sum("slots")).first()[0] or 1
    share = F.coalesce("slots", F.lit(0)) / whole
    balance = experts * (every.agg(F.sum(F.pow(share, F.lit(2)))).first()[0] or 0.0)
    return every.select("expert", F.coalesce("slots", F.lit(0)).alias("slots"), share.alias("share"), F.lit(balance).alias("balance"))


def gathered(rows: DataFrame, table: DataFrame, ids: str = "ids") -> DataFrame:
    """(row, place, vector): the vector of each id of rows (row, ids); ``table`` has id and vector, and an id that it lacks gets null. (JN9)"""
    placed = rows.select("row", F.posexplode(ids).alias("place", "id"))
    return placed.join(table.select("id", "vector"), "id", "left").select("row", F.col("place").cast("long").alias("place"), "vector")
