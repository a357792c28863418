"""64-bit hashes that wrap, in Arrow batches. (HSH1, AGG8-9, DED4)

Hashes leave as 16 hexadecimal digits or as signed longs with the same bits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

U = np.uint64
# Fixed values.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MINHASH_SEED = 0xD1CE5EED
_ALL = (1 << 64) - 1


def splitmix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + U(GOLDEN)
        x = (x ^ (x >> U(30))) * U(MIX1)
        x = (x ^ (x >> U(27))) * U(MIX2)
        return x ^ (x >> U(31))


def fnv1a(values: list[bytes]) -> np.ndarray:
    """FNV-1a of each value; all values step through their bytes together."""
    size = np.array([len(v) for v in values], np.int64)
    order = np.argsort(-size, kind="stable")
    buf = np.frombuffer(b"".join(values), np.uint8).astype(np.uint64)
    start = (np.cumsum(size) - size)[order]
    size = size[order]
    h = np.full(len(values), FNV_START, np.uint64)
    alive = len(values)
    with np.errstate(over="ignore"):
        for i in range(int(size[0]) if len(size) else 0):
            while alive and size[alive - 1] <= i:
                alive -= 1
            if alive <= 8:  # the last long ones, byte by byte
                break
            h[:alive] = (h[:alive] ^ buf[start[:alive] + i]) * U(FNV_PRIME)
        else:
            i = int(size[0]) if len(size) else 0
    for k in range(alive):
        x = int(h[k])
        for b in values[order[k]][i:]:
            x = ((x ^ b) * FNV_PRIME) & _ALL
        h[k] = x
    out = np.empty(len(values), np.uint64)
    out[order] = h
    return out


def seeds(n: int, seed: int = MINHASH_SEED) -> np.ndarray:
    """The chain of odd seeds that a signature's hashes use."""
    out, s = [], np.array([seed], np.uint64)
    for _ in range(n):
        s = splitmix64(s)
        out.append(int(s[0]) | 1)
    return np.array(out, np.uint64)


def minhash(words: list[str], n: int = 128, shingle: int = 5) -> np.ndarray:
    """The least of each hash over the shingles of a text; all ones where there is no word."""
    if not words:
        return np.full(n, _ALL, np.uint64)
    count = max(1, len(words) - shingle + 1)
    base = np.unique(fnv1a([" ".join(words[i : i + shingle]).encode() for i in range(count)]))
    out = np.full(n, _ALL, np.uint64)
    own = seeds(n)
    for at in range(0, len(base), 2048):
        out = np.minimum(out, splitmix64(base[at : at + 2048, None] ^ own[None, :]).min(axis=0))
    return out


def bands(signature: np.ndarray, n: int = 16) -> np.ndarray:
    """A hash of each band of a signature."""
    rows = signature.reshape(n, -1)
    h = np.full(n, FNV_START, np.uint64)
    with np.errstate(over="ignore"):
        for r in range(rows.shape[1]):
            h = (h ^ rows[:, r]) * U(FNV_PRIME)
    return splitmix64(h ^ np.arange(n, dtype=np.uint64))


@F.pandas_udf(ST.LongType())
def fnv_long(texts: pd.Series) -> pd.Series:
    return pd.Series(fnv1a([(t or "").encode() for t in texts]).view(np.int64), index=texts.index)


def fnv_hex(t: Column) -> Column:
    """FNV-1a as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fnv_long(t)), 16, "0"))


def fnv_mod(t: Column, n: int) -> Column:
    """FNV-1a, unsigned, modulo n."""
    h = fnv_long(t)
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(n)) * 2 + F.pmod(h.bitwiseAND(F.lit(1)), F.lit(n)), F.lit(n))


@F.pandas_udf(ST.StructType([ST.StructField("signature", ST.ArrayType(ST.LongType())), ST.StructField("bands", ST.ArrayType(ST.LongType()))]))
def signatures(words: pd.Series) -> pd.DataFrame:
    """MinHash signature and band keys of arrays of words."""
    sigs = [minhash(list(w)) for w in words]
    return pd.DataFrame({"signature": [s.view(np.int64) for s in sigs], "bands": [bands(s).view(np.int64) for s in sigs]})
