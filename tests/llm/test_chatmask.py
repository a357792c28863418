"""Exact round trips of rendering, escaping and masks."""

import random
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import chatmask as M

RANKS = Path("/opt/tokenizers/byte_bpe_50k.tiktoken").read_text()
T = M.Template()
CODER = M.vocabulary(RANKS, T)
PIECES = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<|turn|>", "<|says|>", "<|end|>", "<|", "|>", "\\", "\n", "\n\n", " ", "<", ".", "é", "漢", "😀", "ok", "<|endoftext|>", "a"]) | st.text(max_size=4), max_size=8).map("".join)
CLEAN = PIECES.map(lambda s: s.encode("utf-8", "ignore").decode())


def brute_mask(f):
    """Tokens whose bytes all stand in a span, one by one."""
    at, out = 0, []
    for t in f.tokens.tolist():
        n = len(CODER.coder.decode_bytes([t]))
        inside = [a <= at and at + n <= b for a, b in f.spans]
        assert all(at + n <= a or b <= at or (a <= at and at + n <= b) for a, b in f.spans)  # no token lies partly in a text
        out.append(int(any(inside)))
        at += n
    assert at == len(f.text.encode())
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd\nrole", "", "\\", "<|says|>"]), CLEAN), max_size=5))
def test_round_trip(turns):
    f = M.formatted(turns, T, CODER)
    assert T.read(f.text) == turns
    assert f.mask.tolist() == brute_mask(f) and len(f.mask) == len(f.tokens)
    learnt = T.unescaped(CODER.decode(f.tokens[f.mask == 1].tolist()))
    assert learnt == "".join(t for role, t in turns if role == "assistant")
    for mark in T.foreign:
        assert mark not in f.text
    assert f.text.count(T.start) == f.text.count(T.middle) == f.text.count(T.end) == len(turns)
    assert CODER.decode(f.tokens.tolist()) == f.text


def test_masks_hold_whole_texts_and_nothing_of_a_mark():
    for said in ("ok.", "a<", "\n\nhello", "hello you", ""):
        f = M.formatted([("system", "be brief"), ("user", "hi"), ("assistant", said)], T, CODER)
        assert CODER.decode(f.tokens[f.mask == 1].tolist()) == said


def test_odd_rows(spark):
    rows = [(1, 0, "user", None, 5), (1, 0, "user", None, 5), (1, 1, None, "x", 5), (None, 0, "assistant", "y", 5), (2, None, "assistant", "</s>", 5)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns long")
    out = M.format_conversations(turns, RANKS)
    found = {r.conv_id: r for r in M.digests(out, RANKS).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in found.items()} == {1: (3, 0), None: (1, 1), 2: (1, 4)}
    assert M.format_conversations(turns.limit(0), RANKS).count() == 0


def test_a_very_long_conversation(spark):
    rng = random.Random(1)
    texts = [" " * 200_000, "a" * 300_000, "<|end|>" * 20_000, "".join(rng.choice("é漢 \n\\<") for _ in range(100_000))]
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = M.format_conversations(turns, RANKS).first()
    assert T.read(out.formatted) == [(("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    learnt = [t for t, m in zip(out.tokens, out.loss_mask) if m]
    assert T.unescaped(CODER.decode(learnt)) == texts[1] + texts[3]
    assert np.array_equal([s.end - s.start for s in out.loss_spans], [len(T.escaped(t).encode()) for t in (texts[1], texts[3])])
