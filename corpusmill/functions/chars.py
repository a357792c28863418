"""Code point classes and folding tables: the one place that says what a letter or a space is.

Classes are written for a regular expression's brackets, in the syntax that Java and RE2 share.
"""

from __future__ import annotations

# Code point classes.
SPACE = r" \t\n\r\x0B\x0C\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F"
ARABIC_LETTER = r"\x{620}-\x{63F}\x{641}-\x{64A}\x{66E}-\x{6D3}\x{6FA}-\x{6FF}\x{750}-\x{77F}\x{8A0}-\x{8BF}"
ARABIC_MARK = r"\x{64B}-\x{65F}\x{670}\x{6D6}-\x{6ED}\x{8D3}-\x{8FF}"
LATIN = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}"
DIGIT = r"0-9\x{660}-\x{669}\x{6F0}-\x{6F9}"
EMOJI = r"\x{1F000}-\x{1F2FF}\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2600}-\x{27BF}\x{FE00}-\x{FE0F}\x{203C}\x{2049}"
#: Punctuation that is neither a space nor an emoji.
PUNCT = (
    r"!-/:-@\[-`{-~\x{A1}-\x{BF}\x{2010}-\x{2027}\x{202A}-\x{202E}\x{2030}-\x{203B}\x{203D}-\x{2048}\x{204A}-\x{205E}"
    r"\x{600}\x{60C}\x{61B}\x{61E}\x{61F}\x{66A}-\x{66D}\x{6D4}"
)
ZERO_WIDTH = "​‍‎‏‪‫‬‭‮⁦⁧⁨⁩﻿"
ARABIZI_DIGIT = "2356789"

# Each Arabic letter with presentation forms, in code point order from U+FE80, and its number of forms.
_FORMS = (
    ("ء", 1), ("آ", 2), ("أ", 2), ("ؤ", 2), ("إ", 2), ("ئ", 4), ("ا", 2), ("ب", 4), ("ة", 2),
    ("ت", 4), ("ث", 4), ("ج", 4), ("ح", 4), ("خ", 4), ("د", 2), ("ذ", 2), ("ر", 2), ("ز", 2),
    ("س", 4), ("ش", 4), ("ص", 4), ("ض", 4), ("ط", 4), ("ظ", 4), ("ع", 4), ("غ", 4), ("ف", 4),
    ("ق", 4), ("ك", 4), ("ل", 4), ("م", 4), ("ن", 4), ("ه", 4), ("و", 2), ("ى", 2), ("ي", 4),
)
# Arabic letters that the canonical form writes as another.
_FOLDED = {"آ": "ا", "أ": "ا", "إ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ؤ": "ء", "ئ": "ء"}


def _span(first: int, last: int) -> list[str]:
    return [chr(c) for c in range(first, last + 1)]


#: Upper-case letters that have a lower-case one 32 places on: ASCII and Latin-1.
UPPER = "".join(_span(0x41, 0x5A) + [c for c in _span(0xC0, 0xDE) if c != "×"])
LOWER = "".join(chr(ord(c) + 32) for c in UPPER)

#: Characters that normalising removes: controls, zero-width ones, tatweel, Arabic marks. ZWNJ has a rule of its own.
REMOVED = "".join(
    [c for c in _span(0, 0x1F) if c not in "\t\n\r"] + _span(0x7F, 0x9F) + list(ZERO_WIDTH) + ["ـ"] + _span(0x64B, 0x65F) + ["ٰ"] + _span(0x6D6, 0x6ED) + _span(0x8D3, 0x8FF)
)


def folding(letters: bool = False, lower: bool = True) -> tuple[str, str]:
    """The characters that normalising replaces, and what by; the ones it removes stand last and have no partner."""
    table: dict[str, str] = {}
    at = 0xFE80
    for letter, forms in _FORMS:
        table |= dict.fromkeys(_span(at, at + forms - 1), letter)
        at += forms
    for first in (0x660, 0x6F0):
        table |= {chr(first + d): str(d) for d in range(10)}
    table |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
    if letters:
        table = {k: _FOLDED.get(v, v) for k, v in table.items()} | _FOLDED
    if lower:
        small = dict(zip(UPPER, LOWER, strict=True))
        table = {k: small.get(v, v) for k, v in table.items()} | small
    return "".join(table) + REMOVED.replace("\x00", ""), "".join(table.values())
