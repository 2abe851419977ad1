import random

import pytest

from extentlake.llm.url_filters import PRODUCTION_RULES, filter_urls

SCHEMA = "page_id long, url string, host string, rule string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = lambda s, chars: min([s.index(c) for c in chars if c in s], default=len(s))
        host = rest[: cut(rest, "/?#")]
        path = rest[len(host) :]
        path = path[: cut(path, "?#")]
        host = host.translate(LOWER)
    hits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return (host, path, best and best[1], best[2] if best else default)


def run(spark, urls, rules):
    df = spark.createDataFrame([(k, u, "clash", "clash") for k, u in enumerate(urls)], SCHEMA)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(df, rules).collect()}


ODD = [None, "", "no scheme/en/", "://", "http://", "http://com", "http://COM/", "http://a.com?x/", "http://www.Example.com/en/", "http://xexample.com/en/", "http://example.com/EN/", "http://example.com./en/", "a://b://example.com/en/", "http://.com/", "http://a..com/", "http://com.:80/", "http://exämple.com/en/\n?", "http://example.com\n/en/", "http://example.com/en/x#://net/es/", "http://net/es/", "http://b.net/fr/?q"]


@pytest.mark.parametrize("rules", [PRODUCTION_RULES, [], [("block", "b.c", "/"), ("allow", "a.b.c", "/x"), ("block", "c", "/x/y"), ("allow", "a.b.c", "/x/y/z"), ("block", "ab.c", "/")]])
def test_equals_brute_force(spark, rules):
    rnd = random.Random(6)
    urls = ODD + ["http://" + ".".join(rnd.choice(["a", "b", "c", "ab", "com", "net", "example", "www"]) for _ in range(rnd.randint(1, 5))) + rnd.choice(["", "/", "/x", "/x/y/z", "/en/1", "/es/", "/fr"]) for _ in range(400)]
    urls += ["http://hot.example.com/en/"] * 300
    assert run(spark, urls, rules) == {k: brute(u, rules) for k, u in enumerate(urls)}


def test_empty(spark):
    assert run(spark, [], PRODUCTION_RULES) == {}
