"""Address rules against plain Python."""

import random
from collections import Counter

import pytest

from filmgrain.llm import urls
from filmgrain.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "https://example.net/en/a", "https://www.Example.NET/en/?q", "https://example.net/EN/a",
    "https://xexample.com/de/", "https://example.com/de/x#y", "https://a.b.example.com/de", "http://org/fr/", "http://a.org/fr/b", "http://a.org?x/fr/", "http://net.com/", "http://a.net#frag",
    "ftp://x://net/", "http://.net/", "http://a..net/p", "http://net:80/", "http://é.net/é/", "http://a.net/" + "x/" * 3000, "http://" + "a." * 300 + "net/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i, c in enumerate(rest) if c in "/?#"], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    path = rest[cut:].split("?")[0].split("#")[0]
    fit = [(-len(h + p), v != "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, min(fit)[2], min(fit)[3]) if fit else (host, path, None, default)


@pytest.mark.parametrize("rules", [URL_RULES, (("com", "", "block"), ("com", "/d", "allow"), ("a.net", "/x/x", "block"), ("net", "/p", "allow"), ("net", "/p", "block"))])
def test_equals_brute_force(spark, rules):
    rng = random.Random(1)
    every = [(i, u) for i, u in enumerate(URLS)] + [(None, URLS[7])] * 2
    every += [(100 + i, f"http://{'.'.join(rng.choices(['a', 'net', 'example', 'com', 'org'], k=3))}/{rng.choice(['en', 'de', 'fr', 'p'])}/{i}") for i in range(150)]
    df = spark.createDataFrame([(i, u, "z") for i, u in every], "page_id bigint, url string, host string")
    got = urls.judge_urls(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter((i, *brute(u, rules)) for i, u in every)


def test_no_rules_no_pages_and_too_long_rules(spark):
    schema = "host string, path string, verdict string"
    pages, none = spark.createDataFrame([(1, "http://a.net/")], "page_id bigint, url string"), spark.createDataFrame([], schema)
    assert [tuple(r) for r in urls.judge_urls(pages, none, "block").collect()] == [(1, "a.net", "/", None, "block")]
    assert urls.judge_urls(pages.limit(0), spark.createDataFrame(URL_RULES, schema)).collect() == []
    assert urls.judge_urls(pages, spark.createDataFrame([(None, "/", "block")], schema)).first().verdict == "allow"
    with pytest.raises(ValueError):
        urls.judge_urls(pages, spark.createDataFrame([("a", "/" * 3000, "block")], schema))
