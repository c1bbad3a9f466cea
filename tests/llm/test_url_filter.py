import random

from tidelog.llm import url_filter


def judge(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fit = [(len(h + p), len(h), v == "block", h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], "allow" if best is None or not best[2] else "block"


def run(spark, urls, rules=url_filter.RULES):
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in urls], "page_id long, url string, host string, rule string, digest string")
    found = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).collect()
    return sorted(tuple(r) for r in found), sorted((i, *judge(u, rules)) for i, u in urls)


def test_odd_urls(spark):
    urls = [
        None, "", "no scheme", "://", "http://", "http://NET/", "http://a.net", "http://a.net?x=/", "http://a.net#/", "http://xnet/",
        "http://www.Example.NET/en/1?q", "http://example.net/en", "http://example.com/de/", "http://example.com.de/de/", "http://b.org/fr/x#y",
        "http://org/fr/", "http://.net/", "http://a..net/", "http://user@a.net:80/", "http://" + "a." * 3000 + "net/" + "p/" * 5000, "http://é.NET/É",
    ]
    got, want = run(spark, list(enumerate(urls)))
    assert got == want


def test_repeated_rows_ties_and_both_verdicts(spark):
    rules = [("block", "a.b", "/"), ("allow", "b", "/xx"), ("allow", "c", "/"), ("block", "c", "/"), ("block", "d", "")]
    urls = [(1, "http://a.b/xx"), (1, "http://a.b/xx"), (2, "http://c/"), (None, "http://x.d"), (None, "http://x.d"), (3, None)]
    got = run(spark, [u for u in urls if u[0] is not None], rules)[0]
    assert got == [(1, "a.b", "/xx", "a.b/", "block"), (1, "a.b", "/xx", "a.b/", "block"), (2, "c", "/", "c/", "block"), (3, "", "", None, "allow")]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    nulls = url_filter.filter_urls(pages, url_filter.rule_table(spark, rules)).filter("page_id IS NULL").collect()
    assert [tuple(r) for r in nulls] == [(None, "x.d", "", "d", "block")] * 2


def test_random_urls(spark):
    rng = random.Random(1)
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for _ in range(60) for h, p in [(".".join(rng.choices("ab", k=rng.randint(1, 3))), "/" + "".join(rng.choices("xy/", k=rng.randint(0, 3))))]}.values())
    urls = [(i, "http://" + ".".join(rng.choices("abc", k=rng.randint(1, 5))) + rng.choice(["", "/"]) + "".join(rng.choices("xy/?#", k=rng.randint(0, 6)))) for i in range(400)]
    got, want = run(spark, urls, rules)
    assert got == want


def test_empty_tables(spark):
    assert run(spark, []) == ([], [])
    assert run(spark, [(1, "http://a.net/")], [])[0] == [(1, "a.net", "/", None, "allow")]
