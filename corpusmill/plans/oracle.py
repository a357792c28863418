"""Builders of the DuckDB expressions that mirror the library's text functions."""

from __future__ import annotations

from corpusmill.functions import chars as C
from corpusmill.functions import quality as Q


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _gap() -> str:
    return C.SPACE.replace(r"\n", "").replace(r"\x0B\x0C", "")


def lowered(t: str) -> str:
    return f"translate({t}, '{C.UPPER}', '{C.LOWER}')"


def normalized(t: str, letters: bool = False) -> str:
    """Without the rule on zero-width non-joiners, which the tables don't hold, and without collapsing repeats."""
    source, target = (s.replace("'", "''") for s in C.folding(letters))
    t = rf"regexp_replace({t}, '[\x{{FEF5}}-\x{{FEFC}}]', '{chr(0x644)}{chr(0x627)}', 'g')"
    t = f"translate({t}, '{source}', '{target}')"
    t = rf"regexp_replace({t}, '[{_gap()}]*\n[{_gap()}\n]*', chr(10), 'g')"
    t = f"regexp_replace({t}, '[{_gap()}]+', ' ', 'g')"
    return rf"regexp_replace({t}, '\A[ \n]+|[ \n]+\z', '', 'g')"


def canonical(t: str) -> str:
    """A character that equals the three before it goes, white space excepted."""
    split = f"string_split({normalized(t, True)}, '')"
    kept = "list_filter({s}, lambda c, i: NOT coalesce(c NOT IN (' ', chr(10)) AND c = s.s[i - 1] AND c = s.s[i - 2] AND c = s.s[i - 3], false))".replace("{s}", "s.s")
    return f"(SELECT CASE WHEN len(s.s) = 0 THEN '' ELSE array_to_string({kept}, '') END FROM (SELECT {split} AS s) s)"


def counted(t: str, chars: str) -> str:
    return f"length(regexp_replace({t}, '[^{chars.replace(chr(39), chr(39) * 2)}]', '', 'g'))"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '[{C.SPACE}]+'), lambda w: w <> '')"


def holds_any(t: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({t}, {quoted(p)})" for p in phrases) + ")"


def measured(table: str = "documents", extra: str = "") -> str:
    """A subquery with what the quality rules look at; needs doc_id and text."""
    t = "coalesce(text, '')"
    return f"""(SELECT *, list_filter(string_split(t, chr(10)), lambda l: l <> '') AS lines, {words('t')} AS w,
      {counted('t', C.SPACE)} AS whitespace, {counted('t', C.ARABIC_LETTER + C.ARABIC_MARK)} AS arabic, {counted('t', C.LATIN)} AS latin, {counted('t', C.DIGIT)} AS digits,
      {counted('t', C.EMOJI)} AS emoji, {counted('t', C.PUNCT)} AS punct, {counted('t', 'A-Z')} AS upper, length(t) AS total, {lowered('t')} AS low
      FROM (SELECT *, {t} AS t {extra} FROM {table}))"""


def top_count(w: str) -> str:
    return f"coalesce(list_max(list_transform(map_entries(list_aggregate({w}, 'histogram')), lambda e: e.value)), 0)"


def verdict(rules: Q.QualityRules) -> str:
    share = "greatest(total, 1)"
    when = [
        ("total = 0", "empty"),
        (holds_any("low", Q.DISCLAIMERS) if rules.disclaimers else "false", "ai_disclaimer"),
        (holds_any("t", Q.PLACEHOLDERS) if rules.placeholders else "false", "unresolved_placeholder"),
        ("arabic + latin = 0", "no letters"),
        (f"(arabic + latin) / {share} < {rules.min_letter_ratio}", "low letter ratio"),
        (f"(total - whitespace - arabic - latin - digits - emoji) / {share} > {rules.max_symbol_ratio}", "symbol spam"),
        (f"digits / {share} > {rules.max_digit_ratio}", "digit spam"),
        (f"latin > 20 AND upper > {rules.max_upper_ratio}::double * latin", "shouting"),
        (f"len(w) < {rules.min_words}", "too few words"),
        (f"coalesce(list_max(list_transform(w, lambda x: length(x))), 0) > {rules.max_word_length}", "absurd word length"),
        (f"len(w) >= 8 AND {top_count('w')} / len(w) > {rules.max_word_repeat}", "word repetition"),
        (f"len(lines) >= 5 AND (len(lines) - len(list_distinct(lines))) / len(lines) > {rules.max_repeat_line}", "duplicated lines"),
        (holds_any("low", Q.HARD_DISCLOSURES) if rules.hard_disclosure else "false", "ai_disclosure_hard"),
    ]
    return "CASE " + " ".join(f"WHEN {c} THEN '{name}'" for c, name in when) + " ELSE 'accept' END"
