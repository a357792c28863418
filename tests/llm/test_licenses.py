"""Automata against expanded wording."""

import random
import re

import pytest

from corpusmill.llm import licenses as L


def test_optional_and_replaceable_regions():
    m = L.Automaton('licensed <<beginOptional>>under <<beginOptional>>the<<endOptional>> terms<<endOptional>> by <<var;name="who";original="A; B";match=".+">> inc', 2)
    yes = ["licensed by a inc", "licensed under terms by a b inc", "licensed under the terms by a inc", "licensed by inc inc"]
    no = ["licensed the terms by a inc", "licensed by inc", "licensed under by a inc", "licensed by a b c inc"]
    for text, want in [(t, True) for t in yes] + [(t, False) for t in no]:
        words = [w.encode() for w in text.split()]
        assert (m.accepts(iter(words)) == len(words)) is want, text
    for wrong in ("a <<beginOptional>> b", "a <<endOptional>> b", "a <<var;max=2>> b"):
        with pytest.raises(ValueError):
            L.Automaton(wrong)


def test_phrases_and_patterns_that_a_region_may_be():
    def accepts(markup, text, most=8):
        words = [w.encode() for w in text.split()]
        return L.Automaton(markup, most).accepts(iter(words)) == len(words)

    phrases = 'copy <<var;name="x";original="the work";match="(the work|this file)">> freely'
    assert accepts(phrases, "copy the work freely") and accepts(phrases, "copy this file freely") and not accepts(phrases, "copy my file freely") and not accepts(phrases, "copy freely")
    some = 'copy <<var;name="x";original="";match=".*">> freely'
    assert accepts(some, "copy freely") and accepts(some, "copy a b freely", 2) and not accepts(some, "copy a b c freely", 2)
    assert not accepts(some.replace(".*", ".{1,40}"), "copy freely") and accepts(some.replace(".*", ".{1,40}"), "copy x freely")


#: Genuine wording. Fixed values.
MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""


def test_genuine_texts_and_odd_rows(spark):
    long = "word " * 300_000 + MIT
    texts = [MIT, GPL, GPL.replace("version 3", "version 2"), APACHE, BSD, MIT.replace("free of charge", "for money"), long, MIT]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, MIT), (None, GPL)], "doc_id long, text string")
    rows = L.scan(docs).collect()
    got = {r.doc_id: set(r.labels.split(",")) - {""} for r in rows}
    assert {"mit-text", "mit-grant"} <= got[0] and got[6] >= {"mit-text"} and not {"mit-text", "mit-grant"} & got[5]
    assert "gpl-3.0" in got[1] and "gpl-2.0" in got[2] and "gpl-3.0" not in got[2] and "apache-2.0" in got[3] and {"bsd-text", "bsd-2-clause"} <= got[4]
    assert len(rows) == 10 and "gpl-3.0" in got[None] and next(r for r in rows if r.doc_id == 0).score > 0.9


def test_places_and_labels_against_regular_expressions(spark):
    rng = random.Random(0)
    pieces = ["GNU", "General", "Public", "License", "apache", "LICENSE", "cc", "by", "cc-by", "mit", "é", "x1", "mit  license,", "CC\nBY", "the", "gnu general public license"]
    texts = [" ".join(rng.choice(pieces) + rng.choice(["", ".", "-"]) for _ in range(rng.randrange(40))) for _ in range(150)]
    texts += [None, "", "...", "CC by CC by", "under cc by 4.0", "Released under the MIT License."]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in L.scan(docs).collect():
        words = L.words_of(texts[r.doc_id] or "")
        places = {}
        for phrase, label in (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")):
            p = phrase.split()
            places[label] = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = sum(places.values(), [])
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(k for k, v in places.items() if v))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert L.scan(docs.limit(0)).count() == 0
    named = {r.doc_id: r.labels for r in L.scan(docs).collect()}
    assert named[len(texts) - 1] == "mit,mit-notice"


def test_words():
    assert L.words_of("Version 2.0, É-x_y") == re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "version 2.0, É-x_y")
