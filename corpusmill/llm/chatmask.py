"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as a whole: each turn is a start mark, its role, a middle mark, its text,
and an end mark. The escape character is doubled, and put after the first character of any control
string that stands inside a role or a text, so marks in the output are only the template's own and
reading it back is exact. The rendered text is encoded once by a byte-level vocabulary in which the three marks are
tokens of their own, so no token lies partly in a mark and partly in a text. As each token stands for
certain bytes, the sums of their lengths are the tokens' offsets; the sorted spans of assistant texts are intersected with the
sorted token spans by binary search, and the masked tokens are exactly the assistant texts.

Defined cases: null text or role counts as empty; turns are ordered by (turn, role, text), nulls first,
so ties and repeated rows have one order and all stay; a null conv_id is a conversation of its own;
an empty table gives no rows. A conversation is handled alone, so memory follows the longest one, never
a partition. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm.store import arrow_ready

#: How byte-level vocabularies of 50,257 tokens split text before merging. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Template:
    """Marks of a turn, and the strings that must not stand unescaped in a text."""

    start: str = "<|turn|>"
    middle: str = "<|says|>"
    end: str = "<|end|>"
    escape: str = "\\"
    #: Control strings of other formats are escaped as well, so no reader takes them for its own.
    foreign: tuple[str, ...] = ("</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")

    def escaped(self, text: str) -> str:
        out = text.replace(self.escape, self.escape * 2)
        if "<" in out or "[" in out:
            for mark in (self.start, self.middle, self.end, *self.foreign):
                out = out.replace(mark, mark[0] + self.escape + mark[1:])
        return out

    def unescaped(self, text: str) -> str:
        if self.escape not in text:
            return text
        out, at = [], 0
        while (found := text.find(self.escape, at)) >= 0:
            out += (text[at:found], text[found + 1 : found + 2])
            at = found + 2
        return "".join([*out, text[at:]])

    def render(self, turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
        """The conversation, and where each turn's text stands in its bytes."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = f"{self.start}{self.escaped(role)}{self.middle}", self.escaped(text)
            a = at + len(head.encode())
            b = a + len(body.encode())
            spans.append((a, b))
            parts += (head, body, self.end)
            at = b + len(self.end.encode())
        return "".join(parts), spans

    def read(self, formatted: str) -> list[tuple[str, str]]:
        """The turns of a rendered conversation."""
        return [tuple(self.unescaped(part) for part in turn.removeprefix(self.start).split(self.middle)) for turn in formatted.split(self.end)[:-1]]


class Vocabulary:
    """A byte-level vocabulary with a template's marks as its last tokens; ``ranks`` is the text of a rank file."""

    def __init__(self, ranks: str, template: Template):
        import tiktoken

        merges = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
        first = max(merges.values()) + 2  # one id stays free for the end of a text
        marks = {mark: first + i for i, mark in enumerate((template.start, template.middle, template.end))}
        self.marks = frozenset(marks)
        self.coder = tiktoken.Encoding("chat", pat_str=SPLIT, mergeable_ranks=merges, special_tokens=marks)
        self.size = np.zeros(first + len(marks), np.int64)
        for token, rank in merges.items():
            self.size[rank] = len(token)
        for mark, rank in marks.items():
            self.size[rank] = len(mark.encode())

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and the offset in bytes where each begins, with the text's length at the end."""
        tokens = np.array(self.coder.encode(text, allowed_special=self.marks, disallowed_special=()), np.int32)
        return tokens, np.concatenate([[0], np.cumsum(self.size[tokens])])

    def decode(self, tokens: list[int]) -> str:
        return self.coder.decode_bytes(tokens).decode()


@lru_cache(maxsize=4)
def vocabulary(ranks: str, template: Template) -> Vocabulary:
    return Vocabulary(ranks, template)


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """1 for the tokens that begin in a span; ``offsets`` and ``spans`` are sorted, and no token crosses a span's end."""
    edges = np.searchsorted(offsets[:-1], np.array(spans, np.int64).reshape(-1, 2))
    change = np.zeros(len(offsets), np.int8)
    np.add.at(change, edges[:, 0], 1)
    np.add.at(change, edges[:, 1], -1)
    return np.cumsum(change[:-1], dtype=np.int8)


@dataclass(frozen=True)
class Formatted:
    text: str
    tokens: np.ndarray
    mask: np.ndarray
    spans: list[tuple[int, int]]


def formatted(turns: list[tuple[str, str]], template: Template, coder: Vocabulary, learnt_role: str = "assistant") -> Formatted:
    """Render, encode once, and mask the texts of ``learnt_role``."""
    text, spans = template.render(turns)
    tokens, offsets = coder.encode(text)
    learnt = [s for s, (role, _) in zip(spans, turns, strict=True) if role == learnt_role]
    return Formatted(text, tokens, masked(offsets, learnt), learnt)


_SCHEMA = "conv_id long, n_turns long, formatted string, tokens array<int>, loss_mask array<byte>, loss_spans array<struct<start:int,end:int>>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])
_OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("tokens", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())), ("loss_spans", pa.list_(_SPAN))])


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(off, pa.array(np.concatenate(values), kind))


def format_conversations(turns: DataFrame, ranks: str, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, formatted, tokens, loss_mask, loss_spans) of each conversation; spans count bytes of ``formatted``.

    ``ranks`` is the text of a byte-level vocabulary's rank file; it is broadcast, so executors need no file.
    """
    arrow_ready(turns.sparkSession)
    shared = turns.sparkSession.sparkContext.broadcast(ranks)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(shared.value, template)
        own: list[tuple[str, str]] = []
        now: object = run  # no conversation yet
        done: list[tuple[object, int, Formatted]] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            spans = [[{"start": a, "end": b} for a, b in f.spans] for _, _, f in done]
            return K.batch_of(_OUT, [c for c, _, _ in done], [n for _, n, _ in done], [f.text for _, _, f in done], _lists([f.tokens for _, _, f in done], pa.int32()), _lists([f.mask for _, _, f in done], pa.int8()), spans)

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv != now:
                    if own:
                        done.append((now, len(own), formatted(own, template, coder)))
                        size += len(done[-1][2].text)
                    now, own = conv, []
                    if size > K.BLOCK:
                        yield batch_of()
                        done, size = [], 0
                own.append((role, text))
        if own:
            done.append((now, len(own), formatted(own, template, coder)))
        if done:
            yield batch_of()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, _SCHEMA)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(conversations: DataFrame, ranks: str, template: Template = Template()) -> DataFrame:
    """What can be read back from formatted conversations: their turns from the text, and what the masked tokens say."""
    arrow_ready(conversations.sparkSession)
    shared = conversations.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(shared.value, template)
        for batch in batches:
            out = []
            texts, tokens, masks = (batch.column(c) for c in ("formatted", "tokens", "loss_mask"))
            for i, conv in enumerate(batch.column("conv_id").to_pylist()):
                text = texts[i].as_py()
                turns = template.read(text)
                told = sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                learnt = template.unescaped(coder.decode(tokens[i].values.to_numpy()[masks[i].values.to_numpy() == 1].tolist()))
                out.append((conv, len(turns), told.hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), len(text)))
            if out:
                yield K.batch_of(_DIGEST, *(list(c) for c in zip(*out, strict=True)))

    return conversations.select("conv_id", "formatted", "tokens", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
