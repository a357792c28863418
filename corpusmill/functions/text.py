"""Text normalisation and measurement as Column expressions. (NRM1-12, NRM15-16)"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions import chars as C

_GAP = C.SPACE.replace(r"\n", "").replace(r"\x0B\x0C", "")


def text(column: Column | str) -> Column:
    """Null counts as empty everywhere."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def lowered(t: Column) -> Column:
    """Lower case of ASCII and Latin-1 letters only. (NRM4)"""
    return F.translate(t, C.UPPER, C.LOWER)


def normalized(t: Column, letters: bool = False, repeats: int = 0) -> Column:
    """Fold, strip and collapse a text. (NRM1, NRM5)

    A zero-width non-joiner stays only between Arabic letters; a run of white space becomes a line break if it holds
    one and a space otherwise; with ``repeats`` a character stands no more than that often in a row.
    """
    joined = F.regexp_replace(t, rf"(?<![{C.ARABIC_LETTER}])\x{{200C}}|\x{{200C}}(?![{C.ARABIC_LETTER}])", "")
    pairs = F.regexp_replace(joined, r"[\x{FEF5}-\x{FEFC}]", "لا")
    folded = F.translate(F.regexp_replace(pairs, r"\x00", ""), *C.folding(letters))
    lines = F.regexp_replace(folded, rf"[{_GAP}]*\n[{_GAP}\n]*", "\n")
    spaced = F.regexp_replace(lines, rf"[{_GAP}]+", " ")
    if repeats:
        spaced = F.regexp_replace(spaced, rf"([^ \n])\1{{{repeats},}}", "$1" * repeats)
    return F.regexp_replace(spaced, r"\A[ \n]+|[ \n]+\z", "")


def canonical(t: Column) -> Column:
    """The key that duplicates share. (NRM2)"""
    return normalized(t, letters=True, repeats=3)


def counted(t: Column, chars: str) -> Column:
    """How many characters of a class a text has: what it is longer than without their runs."""
    return (F.length(t) - F.length(F.regexp_replace(t, f"[{chars}]+", ""))).cast("long")


def script_stats(t: Column) -> dict[str, Column]:
    """Characters by class. (NRM7)"""
    found = {
        "total": F.length(t).cast("long"),
        "whitespace": counted(t, C.SPACE),
        "arabic": counted(t, C.ARABIC_LETTER + C.ARABIC_MARK),
        "latin": counted(t, C.LATIN),
        "digits": counted(t, C.DIGIT),
        "emoji": counted(t, C.EMOJI),
        "punct": counted(t, C.PUNCT),
    }
    found["other"] = found["total"] - sum((found[k] for k in ("arabic", "latin", "digits", "emoji", "punct")), found["whitespace"])
    return found


def words(t: Column) -> Column:
    """Runs of anything but white space. (NRM6)"""
    return F.array_remove(F.split(t, f"[{C.SPACE}]+"), "")


def html_stripped(t: Column) -> Column:
    """Tags out, entities in. (NRM9)"""
    out = F.regexp_replace(t, r"<[A-Za-z/!][^>]*(>|\z)", "")
    # Fixed values, applied in this order.
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "-")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def flattened(t: Column) -> Column:
    """One line. (NRM11)"""
    return F.btrim(F.translate(t, "\n\r\t", "   "), F.lit(" "))


def retrieval_key(t: Column) -> Column:
    """The form in which questions are compared. (NRM12)

    Digits that stand for Arabic sounds are folded where the text has a non-ASCII character, or such a digit beside a letter.
    """
    loose = t.rlike(r"[^\x00-\x7F]") | t.rlike("[A-Za-z][23579]|[23579][A-Za-z]")
    plain = F.translate(F.regexp_replace(t, r"[\x{64B}-\x{652}]", ""), C.UPPER[:26], C.LOWER[:26])
    folded = F.when(loose, F.translate(plain, "37952", "ahqka")).otherwise(plain)
    return F.btrim(F.regexp_replace(folded, r"[\x00-/:-`{-\x7F]+", " "), F.lit(" "))


def word_repeat_ratio(w: Column) -> Column:
    """The share of the commonest word. (FLT13)"""
    start = F.struct(F.lit("").alias("word"), F.lit(0).alias("run"), F.lit(0).alias("top"))

    def step(state: Column, word: Column) -> Column:
        run = F.when(state["word"] == word, state["run"] + 1).otherwise(1)
        return F.struct(word.alias("word"), run.alias("run"), F.greatest(state["top"], run).alias("top"))

    top = F.aggregate(F.array_sort(w), start, step, lambda s: s["top"])
    return F.when(F.size(w) > 0, top / F.size(w)).otherwise(0.0)


def dup_line_ratio(t: Column) -> tuple[Column, Column]:
    """The share of lines that repeat another, and the number of lines; empty lines don't count. (FLT14)"""
    lines = F.array_remove(F.split(t, "\n"), "")
    n = F.size(lines)
    return F.when(n > 0, (n - F.size(F.array_distinct(lines))) / n).otherwise(0.0), n


def mojibake_repaired(t: Column) -> Column:
    """Text whose UTF-8 bytes were read as Latin-1, read again. (NRM10)

    Only where at least half of the bytes beyond ASCII are such as begin a Latin-1 character's UTF-8 form, and only if every character is
    one byte of Latin-1 and the bytes are valid UTF-8.
    """
    narrow = t.rlike(r"[\x{80}-\x{FF}]") & ~t.rlike(r"[^\x00-\x{FF}]")
    # a Latin-1 character beyond ASCII is one of these lead bytes and one byte more, so half of the bytes are leads wherever all characters are narrow
    again = F.try_validate_utf8(F.encode(F.when(narrow, t), "ISO-8859-1").cast("string"))
    return F.coalesce(again, t)


def human_count(n: Column) -> Column:
    """1234 as 1.23K. (NRM16)"""
    return _human(n.cast("double"), 1000.0, ("", "K", "M", "B", "T"), "%.0f", "%.2f")


def human_bytes(n: Column) -> Column:
    """2048 as 2.00 KiB. (NRM16)"""
    return _human(n.cast("double"), 1024.0, (" B", " KiB", " MiB", " GiB", " TiB"), "%.0f", "%.2f")


def _human(v: Column, step: float, units: tuple[str, ...], whole: str, part: str) -> Column:
    out = F.when(v < step, F.format_string(f"{whole}{units[0]}", v))
    for i, unit in enumerate(units[1:], 1):
        size = v / step**i
        out = out.when((size < step) | F.lit(i == len(units) - 1), F.format_string(f"{part}{unit}", size))
    return out


def human_duration(s: Column) -> Column:
    """Seconds as 250ms, 12.5s, 3m07s, 2h05m or 1d03h. (NRM16)"""
    n = F.floor(s).cast("long")
    pair = lambda a, b, form: F.format_string(form, F.floor(n / a), F.floor(n % a / b))
    return (
        F.when(s < 1, F.format_string("%.0fms", s.cast("double") * 1000)).when(s < 60, F.format_string("%.1fs", s.cast("double")))
        .when(s < 3600, pair(60, 1, "%dm%02ds")).when(s < 86400, pair(3600, 60, "%dh%02dm")).otherwise(pair(86400, 3600, "%dd%02dh"))
    )


def json_escaped(t: Column) -> Column:
    """What stands between the quotes of a JSON string. (NRM15)"""
    one = F.to_json(F.struct(t.alias("s")))
    return F.substring(one, F.lit(7), F.length(one) - 8)


def json_unescaped(t: Column) -> Column:
    """The reverse; null for what is no JSON string. (NRM15)"""
    return F.try_variant_get(F.try_parse_json(F.concat(F.lit('"'), t, F.lit('"'))), "$", "string")
