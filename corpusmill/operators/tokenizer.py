"""A byte-pair tokenizer over typed chunks: encoding, special tokens, chats with loss masks, decoding. (TOK1, TOK3-6, CHT2, SRC22, SNK7, STR6)

The vocabulary is two small tables, tokens and merges; encoding runs in Arrow batches with a cache of chunks on each worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from corpusmill.functions import chars as C
from corpusmill.functions import text as T
from corpusmill.operators import bpe

# Special tokens in the order of their ids; bytes follow.
SPECIALS = (
    "<pad>", "<s>", "</s>", "<unk>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<|nl|>", "<|fr|>", "<|ar|>", "<|darija|>", "<|latin|>", "<|tool|>", "<|mask|>", "<|reserved|>",
)
BOS, EOS, END = 1, 2, 7
ROLES = {"system": 4, "user": 5, "assistant": 6}


def _python(chars: str) -> str:
    """A class of code points in the syntax of Python's expressions."""
    return re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: rf"\U{int(m[1], 16):08x}", chars)


@lru_cache(maxsize=1)
def _chunks() -> re.Pattern:
    space, arabic, latin, digit, emoji, punct = (_python(c) for c in (C.SPACE, C.ARABIC_LETTER + C.ARABIC_MARK, C.LATIN, C.DIGIT, C.EMOJI, C.PUNCT))
    sound = C.ARABIZI_DIGIT
    return re.compile(
        rf"(?P<space>[{space}]{{2,}}|\n|[{space}]\Z)|(?P<lead>[{space}])?(?:(?P<arabic>[{arabic}][{arabic}\u200c]*)|(?P<latin>(?:[{latin}]|[{sound}](?=[{latin}]))(?:[{latin}{sound}]|['\u2019](?=[{latin}]))*)"
        rf"|(?P<number>[{digit}](?:[{digit}]|[.,](?=[0-9]))*)|(?P<emoji>[{emoji}][{emoji}\u200d]*)|(?P<punct>(?P<same>[{punct}])(?P=same)*)|(?P<other>[^{space}]))",
        re.DOTALL,
    )


def pre_tokenized(text: str) -> list[tuple[str, str]]:
    """(text, kind) of the chunks of a text; a single space before a chunk belongs to it. (TOK1)"""
    out = []
    for m in _chunks().finditer(text):
        kind = next(k for k in ("space", "arabic", "latin", "number", "emoji", "punct", "other") if m[k] is not None)
        out.append(((" " if m["lead"] else "") + m[kind], kind))
    return out


@F.pandas_udf(ST.ArrayType(ST.StructType([ST.StructField("text", ST.StringType()), ST.StructField("kind", ST.StringType())])))
def chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"text": c, "kind": k} for c, k in pre_tokenized(t or "")])


class Tokenizer:
    """Special tokens, bytes, and merges of two ids in the order of their rank."""

    def __init__(self, merges: list[tuple[int, int]]):
        self.merges = merges
        self.coder = bpe.Encoder(merges)
        self.vocab = [s.encode() for s in SPECIALS] + [self.coder.bytes[i] for i in range(bpe.FIRST_BYTE, bpe.FIRST_BYTE + 256 + len(merges))]
        self.ids = {v: i for i, v in reversed(list(enumerate(self.vocab)))}

    def chunk(self, text: str) -> list[int]:
        whole = self.ids.get(text.encode())
        return [whole] if whole is not None and whole >= bpe.FIRST_BYTE else self.coder.word(text)

    def encode(self, text: str) -> list[int]:
        """The ids of a normalised text. A special token's spelling in it is ordinary text. (TOK3)"""
        return [i for c, _ in pre_tokenized(text) for i in self.chunk(c)]

    def decode(self, ids: list[int], skip_special: bool = True) -> bytes:
        """(TOK5)"""
        return b"".join(self.vocab[i] for i in ids if 0 <= i < len(self.vocab) and not (skip_special and i < bpe.FIRST_BYTE))


class StreamDecoder:
    """Decodes ids one by one and gives out whole characters only. (TOK6)"""

    def __init__(self, tokenizer: Tokenizer, held: bytes = b""):
        self.tokenizer, self.held = tokenizer, held

    def push(self, token: int) -> bytes:
        """What is certain after one more token; a byte that belongs to no character goes out as it is."""
        vocab = self.tokenizer.vocab
        self.held += vocab[token] if 0 <= token < len(vocab) else b""
        at = 0
        while at < len(self.held):
            size = self._size(self.held[at])
            if size == 0 or at + size > len(self.held):
                break
            at += size if all(b & 0xC0 == 0x80 for b in self.held[at + 1 : at + size]) else 1
        out, self.held = self.held[:at], self.held[at:]
        return out

    def flush(self) -> bytes:
        """What is left: a replacement character if it is no whole one."""
        left, self.held = self.held, b""
        try:
            left.decode()
        except UnicodeDecodeError:
            return "\ufffd".encode()
        return left

    @staticmethod
    def _size(first: int) -> int:
        return 1 if first < 0x80 else 2 if first >> 5 == 0b110 else 3 if first >> 4 == 0b1110 else 4 if first >> 3 == 0b11110 else 0


def _udf(merges: list[tuple[int, int]], kind: ST.DataType, one):
    keep: list[Tokenizer] = []

    def run(batch: pd.Series) -> pd.Series:
        if not keep:
            keep.append(Tokenizer(merges))
        return batch.map(lambda v: one(keep[0], v))

    return F.pandas_udf(run, kind)


_IDS = ST.ArrayType(ST.IntegerType())


def encoded(t: Column, merges: list[tuple[int, int]], bos: bool = False, eos: bool = False) -> Column:
    """The ids of a text, which is normalised first. (TOK3)"""
    ids = _udf(merges, _IDS, lambda k, v: [BOS] * bos + k.encode(v or "") + [EOS] * eos)
    return ids(T.normalized(t))


def encoded_with_specials(t: Column, merges: list[tuple[int, int]]) -> Column:
    """The ids of trusted text whose special tokens count as such, the longest spelling first; what lies between is normalised. (TOK4)"""
    spelled = "|".join(rf"\Q{s}\E" for s in sorted(SPECIALS, key=len, reverse=True))
    pieces = F.split(t, f"(?={spelled})|(?<={spelled})")
    clean = F.transform(pieces, lambda p: F.when(p.isin(*SPECIALS), p).otherwise(T.normalized(p)))
    return _udf(merges, _IDS, lambda k, v: [i for p in v for i in ([SPECIALS.index(p)] if p in SPECIALS else k.encode(p))])(clean)


def decoded(ids: Column, merges: list[tuple[int, int]], skip_special: bool = True) -> Column:
    """(TOK5)"""
    return _udf(merges, ST.StringType(), lambda k, v: k.decode(list(v), skip_special).decode("utf-8", "replace"))(ids)


def decoded_steps(ids: Column, merges: list[tuple[int, int]]) -> Column:
    """What a reader sees after each token, and at the end. (TOK6)"""

    def one(k: Tokenizer, v) -> list[str]:
        stream = StreamDecoder(k)
        return [stream.push(int(i)).decode("utf-8", "replace") for i in v] + [stream.flush().decode("utf-8", "replace")]

    return _udf(merges, ST.ArrayType(ST.StringType()), one)(ids)


_CHAT = ST.StructType([ST.StructField("ids", _IDS), ST.StructField("mask", ST.ArrayType(ST.IntegerType()))])


def encoded_chat(messages: Column, merges: list[tuple[int, int]], prompt: bool = False) -> Column:
    """(ids, mask) of an array of (role, content): assistant texts and their ends are learnt, all else is not. (CHT2)"""
    clean = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), T.normalized(F.coalesce(m["content"], F.lit(""))).alias("content")))
    keep: list[Tokenizer] = []

    def run(batch: pd.Series) -> pd.DataFrame:
        if not keep:
            keep.append(Tokenizer(merges))
        rows = []
        for turns in batch:
            ids, mask = [BOS], [0]
            for m in turns:
                body = [*keep[0].encode(m["content"]), END]
                learnt = int(m["role"] == "assistant")
                ids += [ROLES.get(m["role"], ROLES["user"]), *body]
                mask += [0] + [learnt] * len(body)
            if prompt:
                ids.append(ROLES["assistant"])
                mask.append(0)
            rows.append((ids, mask))
        return pd.DataFrame(rows, columns=["ids", "mask"])

    return F.pandas_udf(run, _CHAT)(clean)


def write_vocabulary(spark: SparkSession, merges: list[tuple[int, int]], path: str) -> None:
    """Two tables: (id, token) and (rank, left, right, merged). (SNK7)"""
    known = Tokenizer(merges)
    spark.createDataFrame(list(enumerate(known.vocab)), "id int, token binary").coalesce(1).write.parquet(f"{path}/vocab")
    rows = [(i, a, b, bpe.FIRST_BYTE + 256 + i) for i, (a, b) in enumerate(merges)]
    spark.createDataFrame(rows, "rank int, left int, right int, merged int").coalesce(1).write.parquet(f"{path}/merges")


def read_vocabulary(spark: SparkSession, path: str, expect: int | None = None) -> list[tuple[int, int]]:
    """The merges of a vocabulary, after checking its special tokens, its bytes, its merges, and its size if one is expected. (SRC22, TOK7, FLT25)"""
    merges = [(r.left, r.right) for r in spark.read.parquet(f"{path}/merges").orderBy("rank").collect()]
    found = [bytes(r.token) for r in spark.read.parquet(f"{path}/vocab").orderBy("id").collect()]
    if expect is not None and len(found) != expect:
        raise ValueError(f"a vocabulary of {len(found)} tokens, not of {expect}")
    if found[: len(SPECIALS)] != [s.encode() for s in SPECIALS] or found[len(SPECIALS) : len(SPECIALS) + 256] != [bytes([b]) for b in range(256)]:
        raise ValueError("special tokens or bytes are not where they must be")
    if any(max(p) >= bpe.FIRST_BYTE + 256 + i for i, p in enumerate(merges)) or Tokenizer(merges).vocab != found:
        raise ValueError("the tokens are not those that the merges make")
    return merges


def decode_stream(tokens: DataFrame, merges: list[tuple[int, int]]) -> DataFrame:
    """(key, text) for a stream of (key, seq, token, last): whole characters as they become certain, held bytes kept per key. (STR6)"""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        stream = StreamDecoder(Tokenizer(merges), bytes(state.get[0]) if state.exists else b"")
        rows = pd.concat(list(frames)).sort_values("seq")
        out = b"".join(stream.push(int(t)) for t in rows["token"])
        if rows["last"].any():
            out += stream.flush()
            state.remove()
        else:
            state.update((stream.held,))
        yield pd.DataFrame({"key": [key[0]], "text": [out.decode("utf-8", "replace")]})

    return tokens.groupBy("key").applyInPandasWithState(run, "key long, text string", "held binary", "append", "NoTimeout")
