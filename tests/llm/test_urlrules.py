"""URL rules against the SQL and a brute-force version."""

import random

import pytest
from compare import connect, differences

from fleetledger.llm import queries, urlrules


def test_query_matches_sql(spark, sf_small):
    found = queries.QUERIES["op9_url_rules"](spark, sf_small)
    assert differences(found, connect(sf_small), queries.ORACLE["op9_url_rules"]) == []
    assert {r.rule for r in found.collect()} >= {"net/", "example.com/de/", None}


def plain(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("seed", range(3))
def test_random_pages(spark, seed):
    rng = random.Random(seed)
    labels, paths = ["a", "b", "ab", "c-d", "com", "", "é"], ["", "/", "/x", "/x/", "/x/y", "/xy?z", "#f"]
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((".".join(rng.choices(labels[:5], k=rng.randint(1, 3))), rng.choice(paths[:5])) for _ in range(25))}.values())
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(rng.choices(labels, k=rng.randint(1, 4)))}{rng.choice(paths)}" for _ in range(300)]
    urls += ["http://hot.a.com/x/y"] * 300 + [None, "", "no scheme", "http://", "x://A.COM", "a://b://c/d", "h://a\n.b/x\ny"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(5)
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(pages, frame).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_odd_tables(spark, rows):
    pages = rows([(None, "http://a.net/", 1), (1, None, 2), (1, None, 2)], "page_id bigint, url string, rule int")
    rules = rows([("net", "/", "block"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    got = sorted((r.page_id or 0, r.verdict) for r in urlrules.judge(pages, rules).collect())
    assert got == [(0, "block"), (1, "allow"), (1, "allow")]
    assert {r.verdict for r in urlrules.judge(pages, rules.limit(0)).collect()} == {"allow"}
    assert urlrules.judge(pages.limit(0), rules).collect() == []
