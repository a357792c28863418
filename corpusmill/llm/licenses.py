"""License scans by template automata.

A template is wording in the public SPDX markup. ``<<beginOptional>>...<<endOptional>>`` may be absent.
``<<var;name="..";original="..";match="..">>`` stands for one of the phrases of ``match`` where that is phrases with ``|`` between them,
and for any words where it is another pattern: one at least unless the pattern accepts an empty text, and at most ``most``, a bound that
the markup has not, so that a template can't stretch over a whole document. All other wording is mandatory. The template is compiled to
an automaton over words. A text is accepted at a place where the automaton reaches an end state by exactly the
mandatory words, with or without the optional ones; of the ends, the farthest counts. Case of A-Z, white
space and punctuation don't count; words are runs of digits, letters and non-ASCII characters.

All words of a block are hashed at once, and automata start only at words that can begin a template; the
automaton itself compares words, not hashes. It keeps a set of states, so a text costs its length times
the states alive.

Defined cases: null text is empty; a text without words has no labels and score 0; overlapping matches each count; a word
under several matches counts once in the score, the share of the text's words that accepted wording covers;
repeated rows are scanned each. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm.store import arrow_ready


@dataclass(frozen=True)
class Template:
    label: str
    markup: str
    base: bool = False
    most: int = 8


# Wording of public licenses.
_GPL = (
    "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
    "<<beginOptional>>either<<endOptional>> version {} <<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>"
)
_MIT_GRANT = (
    'permission is hereby granted free of charge to any person obtaining a copy of <<var;name="what";original="this software and associated documentation files";'
    'match="this software and associated documentation files|this software|this source file">> <<beginOptional>>the software<<endOptional>> to deal in the software without restriction'
)
_MIT_REST = (
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
    "fitness for a particular purpose and noninfringement in no event shall "
    '<<var;name="holder";original="the authors or copyright holders";match=".+">> be liable for any claim damages or other liability '
    "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution"
)
#: Base phrases, then wording that names a license more closely. Fixed values.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-3.0", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 3"),
    Template("gpl-2.0", "licensed under the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> version 2"),
    Template("gpl-3.0", _GPL.format(3)),
    Template("gpl-2.0", _GPL.format(2)),
    Template("apache-2.0", "licensed under the apache license version 2.0"),
    Template("cc-by-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by 4.0"),
    Template("cc-by-nc-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc 4.0"),
    Template("cc-by-sa-4.0", "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa 4.0"),
    Template("mit-notice", "released under the mit license"),
    Template("copyright-mit", 'copyright <<beginOptional>>c<<endOptional>> <<var;name="holder";original="year and name";match=".+">> released under the mit license', most=6),
    Template("spdx", 'spdx license identifier <<var;name="id";original="";match=".+">>', most=4),
    Template("mit-grant", _MIT_GRANT),
    Template("mit-text", f"{_MIT_GRANT} {_MIT_REST}"),
    Template("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("bsd-2-clause", _BSD),
)

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_PART = re.compile(r"<<(beginOptional|endOptional|var)((?:;[^;=<>]*=\"[^\"]*\")*)>>")
_PHRASES = re.compile(r"[\w\s,.'|()-]*")


def words_of(text: str) -> list[str]:
    return _WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


class Automaton:
    """Word transitions, transitions on any word, and free moves between numbered states."""

    def __init__(self, markup: str, most: int = 8):
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[int | None] = [None]
        self.free: list[list[int]] = [[]]
        open_at: list[int] = []
        state, at = 0, 0
        for part in [*_PART.finditer(markup), None]:
            for word in words_of(markup[at : part.start() if part else len(markup)]):
                to = self._state()
                self.on[state][word.encode()] = to
                state = to
            if part is None:
                break
            at = part.end()
            if part[1] == "beginOptional":
                # states around the region, so that skipping it can't leave an outer one
                to = self._state()
                self.free[state].append(to)
                state = to
                open_at.append(state)
            elif part[1] == "endOptional":
                if not open_at:
                    raise ValueError("an optional region ends that did not begin")
                to = self._state()
                self.free[state].append(to)
                self.free[open_at.pop()].append(to)
                state = to
            else:
                match = dict(re.findall(r';([^;=]*)="([^"]*)"', part[2])).get("match", ".+")
                end = self._state()
                begin, state = state, end
                if _PHRASES.fullmatch(match) and words_of(match) and "." not in match:
                    for phrase in match.strip("()").split("|"):
                        now = self._state()
                        self.free[begin].append(now)
                        for word in words_of(phrase):
                            to = self._state()
                            self.on[now][word.encode()] = to
                            now = to
                        self.free[now].append(end)
                    continue
                if re.fullmatch(match, ""):
                    self.free[begin].append(end)
                for _ in range(most):
                    to = self._state()
                    self.any[begin] = to
                    self.free[to].append(end)
                    begin = to
        if rest := re.search("<<(?:beginOptional|endOptional|var)", _PART.sub("", markup)):
            raise ValueError(f"not understood: {rest[0]}")
        if open_at:
            raise ValueError("an optional region is not closed")
        self.final = state

    def _state(self) -> int:
        self.on.append({})
        self.any.append(None)
        self.free.append([])
        return len(self.on) - 1

    def closed(self, states: set[int]) -> set[int]:
        """The states and all that free moves lead to."""
        todo, found = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return found

    def first_words(self) -> set[bytes] | None:
        """The words that a match can begin with; None if any word can."""
        begin = self.closed({0})
        if any(self.any[s] is not None for s in begin):
            return None
        return {w for s in begin for w in self.on[s]}

    def accepts(self, words: Iterator[bytes]) -> int:
        """The number of words of the longest match from the first word on; 0 for none."""
        alive, best = self.closed({0}), 0
        for n, word in enumerate(words, 1):
            alive = self.closed({to for s in alive for to in (self.on[s].get(word), self.any[s]) if to is not None})
            if not alive:
                break
            if self.final in alive:
                best = n
        return best


_OUT = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "n_base", "first_word", "last_word")] + [("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("matches", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])
_OUT_DDL = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>"


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches) of every row."""
    arrow_ready(docs.sparkSession)
    compiled = [(t, Automaton(t.markup, t.most)) for t in templates]
    starts: dict[bytes, list[int]] = {}
    for i, (t, machine) in enumerate(compiled):
        first = machine.first_words()
        if first is None:
            raise ValueError(f"{t.label}: a template can't begin with a replaceable region")
        for word in first:
            starts.setdefault(word, []).append(i)
    known = np.array(sorted(K.word_hash(w.decode()) for w in starts), np.uint64)
    by_hash = {K.word_hash(w.decode()): (w, own) for w, own in starts.items()}
    # lower-case A-Z only, byte for byte
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, off in K.blocks(batches):
            buf = lower[raw]
            w = K.Words(buf, off, K.LETTERED)
            h = w.hashes()
            at = np.flatnonzero(np.isin(h, known))
            doc = np.searchsorted(w.off, at, "right") - 1
            found: dict[int, list[tuple[str, int, int, bool]]] = {}
            for i, d in zip(at.tolist(), doc.tolist(), strict=True):
                word, own = by_hash[int(h[i])]
                if buf[w.start[i] : w.end[i]].tobytes() != word:
                    continue
                for k in own:
                    n = compiled[k][1].accepts(buf[w.start[j] : w.end[j]].tobytes() for j in range(i, int(w.off[d + 1])))
                    if n:
                        found.setdefault(d, []).append((compiled[k][0].label, i - int(w.off[d]), i - int(w.off[d]) + n, compiled[k][0].base))
            rows = []
            for d in range(batch.num_rows):
                own = found.get(d, [])
                base = [m for m in own if m[3]]
                total = int(w.count[d])
                under = np.zeros(total, bool) if own else None
                for _, a, b, _ in own:
                    under[a:b] = True
                rows.append(
                    (
                        total,
                        len(base),
                        min((m[1] for m in base), default=None),
                        max((m[1] for m in base), default=None),
                        ",".join(sorted({m[0] for m in base})),
                        ",".join(sorted({m[0] for m in own})),
                        round(float(under.sum()) / total, 6) if own else 0.0,
                        [{"label": m[0], "start": m[1], "end": m[2]} for m in own],
                    )
                )
            yield K.batch_of(_OUT, batch.column("doc_id"), *(list(c) for c in zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT_DDL)
