"""The range join against a plain scan of all rules."""

import random

from corpusmill.llm import urlrules as U

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def plain(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, key string")
    found = U.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in found.collect()}


def test_against_a_plain_scan(spark):
    rng = random.Random(1)
    labels = ["org", "com", "example", "a", "a-b", "exampleorg", "www", "net", "é", "z"]
    rules = RULES + [(".".join(rng.choices(labels, k=rng.randrange(1, 4))), rng.choice(["", "/", "/es/", "/en/1", "/en/12"]), rng.choice(["allow", "block"])) for _ in range(60)]
    urls = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.org/es/x", "https://org", "https://org?q=/es/", "http://x.com/fr/#a", "a://b://c.org/", "http://com/de/?x", "http://org./es/"]
    urls += ["http://" + ".".join(rng.choices(labels, k=rng.randrange(1, 5))) + rng.choice(["", "/", "/es/1", "/en/1", "/en/12?x#y", "/fr/", "#/es/"]) for _ in range(600)]
    urls += ["http://www.example.org/es/7"] * 300
    assert judged(spark, urls, rules) == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_no_rules_and_no_pages(spark):
    assert judged(spark, ["http://a.org/"], []) == {0: ("a.org", "/", None, "allow")}
    assert judged(spark, [], RULES) == {}


def test_null_ids_repeated_pages_and_long_urls(spark):
    long = "http://www.example.org/es/" + "x" * 300_000
    pages = spark.createDataFrame([(None, "http://org/a"), (1, long), (1, long), (2, "http://" + "a." * 5000 + "com/de/")], "page_id long, url string")
    found = U.judge(pages, spark.createDataFrame(RULES, "host string, path string, verdict string")).collect()
    assert sorted((r.page_id or 0, r.rule) for r in found) == [(0, "org/"), (1, "example.org/es/"), (1, "example.org/es/"), (2, "com/de/")]
