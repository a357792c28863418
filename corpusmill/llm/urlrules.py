"""URL rules by a sort-merge range join.

A host is written with its labels reversed and a closing dot, ``blog.example.org`` as
``org.example.blog.``, so that a host and its subdomains are the keys that begin with the host's key:
an interval. Pages and rules are sorted together by key; a sweep over them keeps the stack of the
rule hosts whose intervals are open, each nested in the one below, and asks each for the longest of
its paths that begins the page's path.

The key space is cut into ranges by (key, path, hash of the page) of a small hash sample of the pages, so one very
common host, or one very common url, is spread over many ranges. A rule goes to every range
that its interval meets. Intervals nest, so a range's lower end lies in as many rule hosts as that key
has labels, and rules are copied no more than that per range. Nothing is broadcast but the cuts, of
which there are as many as shuffle partitions.

The longest rule (host and path together) wins, then the longest host, then ``block``. Defined cases: a null url
or one without ``://`` has empty host and path, and no rule fits an empty host; a path is empty where
the url ends after the host, and then only rules with an empty path fit; repeated pages are judged each;
rules with a null field are ignored; without rules every page gets the default. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm import textkit as K
from corpusmill.llm.store import arrow_ready

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Sampled pages for each cut.
SAMPLE = 40


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The two parts that rules look at."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Reversed labels with a closing dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


class Sweep:
    """The open rule hosts at a place of the sorted order."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, str], set[int]]] = []

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, set()))
        _, paths, sizes = self.stack[-1]
        if paths.get(path) != "block":
            paths[path] = verdict
        sizes.add(len(path))

    def page(self, key: str, path: str) -> tuple[str, str, str] | None:
        """The winning rule's key, path and verdict."""
        self.close(key)
        best = None
        for rule_key, paths, sizes in self.stack:
            for n in sorted((n for n in sizes if n <= len(path)), reverse=True):
                if path[:n] in paths:
                    rank = (len(rule_key) + n, len(rule_key))
                    if best is None or rank > best[0]:
                        best = (rank, rule_key, path[:n], paths[path[:n]])
                    break
        return best and best[1:]


_EVENT = "part int, key string, kind int, path string, salt long, page_id long, host string, verdict string"
_OUT = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])
_EVENTS = pa.schema([("part", pa.int32()), ("key", pa.string()), ("kind", pa.int32()), ("path", pa.string()), ("salt", pa.int64()), ("page_id", pa.int64()), ("host", pa.string()), ("verdict", pa.string())])


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    arrow_ready(spark)
    host, path = host_and_path(F.col("url"))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), F.xxhash64("page_id", "url").alias("salt"))
    page = page.select("page_id", "host", "path", "salt", host_key(F.col("host")).alias("key"))
    rule = rules.dropna(subset=["host", "path", "verdict"]).select(host_key(F.translate("host", _UPPER, _LOWER)).alias("key"), "path", "verdict").filter("key <> ''").distinct()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, pages.count())
    share = int(min(1.0, SAMPLE * parts / n) * (1 << 30))
    some = sorted((r.key, r.path, r.salt) for r in page.filter(F.pmod(F.xxhash64("salt", F.lit("cut")), F.lit(1 << 30)) < share).select("key", "path", "salt").limit(4 * SAMPLE * parts).collect())
    cuts = [some[len(some) * i // parts] for i in range(1, parts)] if some else []
    shared = spark.sparkContext.broadcast(cuts)

    def place_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("key", "path", "salt")), strict=True)
            part = [bisect_right(shared.value, row) for row in rows]
            none = pa.nulls(b.num_rows, pa.string())
            yield K.batch_of(_EVENTS, part, b.column("key"), [1] * b.num_rows, b.column("path"), b.column("salt"), b.column("page_id"), b.column("host"), none)

    def place_rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [c[0] for c in shared.value]
        for b in batches:
            out = []
            for key, path, verdict in zip(*(b.column(c).to_pylist() for c in ("key", "path", "verdict")), strict=True):
                # from the range that holds the key's first page to the one that holds the last of its subdomains
                out += [(p, key, 0, path, 0, None, None, verdict) for p in range(bisect_left(keys, key), bisect_right(keys, key + "\U0010ffff") + 1)]
            yield K.batch_of(_EVENTS, *(list(c) for c in zip(*out, strict=True)))

    events = page.mapInArrow(place_pages, _EVENT).unionByName(rule.mapInArrow(place_rules, _EVENT))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_rules = None, Sweep()
        for b in batches:
            out = []
            for p, key, kind, path, page_id, host, verdict in zip(*(b.column(c).to_pylist() for c in ("part", "key", "kind", "path", "page_id", "host", "verdict")), strict=True):
                if p != part:
                    part, open_rules = p, Sweep()
                if kind == 0:
                    open_rules.rule(key, path, verdict)
                    continue
                won = open_rules.page(key, path)
                name = won and ".".join(reversed(won[0][:-1].split("."))) + won[1]
                out.append((page_id, host, path, name, won[2] if won else default))
            if out:
                yield K.batch_of(_OUT, *(list(c) for c in zip(*out, strict=True)))

    ordered = events.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "key", "kind", "path")  # a range is a task
    return ordered.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string")
