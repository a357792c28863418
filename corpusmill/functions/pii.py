"""Personal data: detectors, counts and redaction. (FLT2-11)

Five detectors are regular expressions and have Column forms. Phones, accounts and cards
count digits within a run, so all eight are also one span finder in Python, run in Arrow batches.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as ST

# Fixed values.
KEY_PREFIXES = ("sk-", "pk-", "ghp_", "gho_", "AKIA", "AIza", "xox", "Bearer ", "api_key=", "apikey=", "token=", "password=", "passwd=", "secret=")
TAGS = ("EMAIL", "PHONE", "URL", "IBAN", "CARD", "KEY", "ID", "IP")

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01][0-9]{2}|[0-9]{1,2})"
EMAIL = r"[A-Za-z0-9._+\-]+@(?=([A-Za-z0-9.\-]*))"
URL = r"://(?=/?[^\s/@]*@)(?=(\S*))"
ID = r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{5,8}(?![A-Za-z0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])"
KEY_TAIL = r"[A-Za-z0-9_.\-]"


def emails(t: Column) -> Column:
    """A local part, and a domain of three characters or more with a dot, not counting dots and dashes at its end."""
    domains = F.regexp_extract_all(t, F.lit(EMAIL), F.lit(1))
    return F.size(F.filter(domains, lambda d: F.contains(d, F.lit(".")) & (F.length(F.regexp_replace(d, r"[.\-]+\z", "")) >= 3))).cast("long")


def urls(t: Column) -> Column:
    """Addresses with a user and a password."""
    rest = F.regexp_extract_all(t, F.lit(URL), F.lit(1))
    return F.size(F.filter(rest, lambda r: r.rlike(":.*@"))).cast("long")


def keys(t: Column) -> Column:
    """Well-known prefixes before eight key characters or more."""
    return sum((F.regexp_count(t, F.lit(rf"\Q{p}\E(?={KEY_TAIL}{{8}})")) for p in KEY_PREFIXES), F.lit(0)).cast("long")


def ids(t: Column) -> Column:
    return F.regexp_count(t, F.lit(ID)).cast("long")


def ips(t: Column) -> Column:
    return F.regexp_count(t, F.lit(IP)).cast("long")


def _digit_runs(text: str, start: str, run: str, most: int):
    """Runs that begin with ``start``, cut before digit most + 1, trimmed to a digit: (begin, end, digits seen)."""
    at, head, body = 0, re.compile(start), re.compile(run)
    while found := head.search(text, at):
        b = found.start()
        e = body.match(text, b + 1).end()
        places = [i for i in range(b, e) if text[i] in "0123456789"]
        if len(places) > most:
            e = places[most]
        seen = min(len(places), most + 1)
        while e > b and text[e - 1] not in "0123456789":
            e -= 1
        yield b, e, seen
        at = max(e, b + 1)


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def spans(text: str) -> list[tuple[int, int, str]]:
    """(begin, end, tag) of everything found, by detector."""
    out = []
    for m in re.finditer(EMAIL, text):
        domain = m[1].rstrip(".-")
        if "." in m[1] and len(domain) >= 3:
            out.append((m.start(), m.end() + len(domain), "EMAIL"))
    for b, e, n in _digit_runs(text, "[0-9+]", r"[0-9 \-.()]*", 15):
        local, abroad = n == 10 and text[b : b + 2] in ("06", "07"), text[b] == "+" and n >= 9
        if local or abroad or (10 <= n <= 15 and e - b > n):
            out.append((b, e, "PHONE"))
    for m in re.finditer(URL, text):
        if re.search(r":.*@", m[1]):
            scheme = re.search("[A-Za-z]*$", text[: m.start()])
            out.append((scheme.start(), m.end() + len(m[1]), "URL"))
    for m in re.finditer(r"(?<![A-Za-z0-9])(?=[A-Za-z]{2}[0-9]{2})", text):
        if m.start() + 15 >= len(text):
            continue
        run = re.compile("[A-Za-z0-9 ]*").match(text, m.start())[0]
        places = [i for i, c in enumerate(run) if c != " "]
        end = places[34] if len(places) > 34 else len(run)
        if len(places) >= 15:
            out.append((m.start(), m.start() + len(run[:end].rstrip(" ")), "IBAN"))
    for b, e, n in _digit_runs(text, "[0-9]", r"[0-9 \-]*", 19):
        if 13 <= n <= 19 and _luhn(re.sub("[^0-9]", "", text[b:e])):
            out.append((b, e, "CARD"))
    for prefix in KEY_PREFIXES:
        for m in re.finditer(re.escape(prefix) + f"(?=({KEY_TAIL}{{8,}}))", text):
            out.append((m.start(), m.end() + len(m[1]), "KEY"))
    out += [(m.start(), m.end(), "ID") for m in re.finditer(ID, text)]
    out += [(m.start(), m.end(), "IP") for m in re.finditer(IP, text)]
    return out


def redacted(text: str) -> str:
    """Each span by its tag; of spans that overlap the first stays, of equal beginnings the first detector's."""
    out, at = [], 0
    for b, e, tag in sorted(spans(text), key=lambda s: (s[0], TAGS.index(s[2]))):
        if b >= at:
            out += (text[at:b], f"[{tag}]")
            at = e
    return "".join([*out, text[at:]])


@F.pandas_udf(ST.StructType([ST.StructField(t.lower(), ST.LongType()) for t in TAGS]))
def count_spans(texts: pd.Series) -> pd.DataFrame:
    """Spans by tag."""
    found = [[s[2] for s in spans(t or "")] for t in texts]
    return pd.DataFrame({t.lower(): [f.count(t) for f in found] for t in TAGS})


@F.pandas_udf(ST.StringType())
def redact(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: redacted(t or ""))


def any_found(t: Column) -> Column:
    """Whether any detector finds something: no digit, at sign, colon or key prefix means none can, and Python sees the rest only."""
    prefixes = "|".join(rf"\Q{p}\E" for p in KEY_PREFIXES)
    found = count_spans(F.when(t.rlike(rf"@|://|[0-9]{{2}}|{prefixes}"), t))
    return sum((found[tag.lower()] for tag in TAGS), F.lit(0)) > 0
