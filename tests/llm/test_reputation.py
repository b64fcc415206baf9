import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import reputation
from parlance.llm.hot import join_keyed
from parlance.llm.url_queries import RULES

def bad():
    return F.col("bad") == 1



def parts(url):
    rest = url[url.index("://") + 3:] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, re.match("[^?#]*", rest[len(host):])[0]


def domain(host, suffixes=()):
    name = re.sub(":[0-9]*$", "", re.sub("^.*@", "", host)).strip(".")
    labels = name.split(".")
    if len(labels) < 2 or re.fullmatch("[0-9.]+", name):
        return name, ""
    n = max([1, *(s.count(".") + 1 for s in suffixes if name == s or name.endswith("." + s))])
    return ".".join(labels[-n - 1:]), ".".join(labels[-n:])


def bound(a, b, tail):
    """The posterior's quantile by a fine sum in the logit."""
    mid, wide = math.log(a / b), 12 * math.sqrt(1 / a + 1 / (a * a) + 1 / b + 1 / (b * b))
    t = np.linspace(mid - wide, mid + wide, 400_001)
    h = -a * np.log1p(np.exp(-t)) - b * np.log1p(np.exp(t))
    mass = np.cumsum(np.exp(h - h.max()))
    return 1 / (1 + math.exp(-np.interp(tail * mass[-1], mass, t)))


def plain(pages, labels, plan, suffixes=()):
    """pages: (id, url); labels: (id, 0 / 1 / None) -> per page host, outcomes, bad, rate, bound, blocked."""
    hosts = {}
    for i, url in pages:
        seen = [b for k, b in labels if k is not None and k == i and b is not None]
        n, k = hosts.get(parts(url)[0], (0, 0))
        hosts[parts(url)[0]] = n + len(seen), k + sum(seen)

    def total(of):
        out = {}
        for name, (n, k) in of[0].items():
            up = of[1](name)
            out[up] = out.get(up, (0, 0))[0] + n, out.get(up, (0, 0))[1] + k
        return out

    domains = total((hosts, lambda h: domain(h, suffixes)))
    tops = total((domains, lambda d: d[1]))
    n, k = total((tops, lambda s: ""))[""] if tops else (0, 0)

    def shrink(level, mean):
        over = sum((k - n * mean(x)) ** 2 - n * mean(x) * (1 - mean(x)) for x, (n, k) in level.items() if n)
        pairs = sum(n * (n - 1) * mean(x) * (1 - mean(x)) for x, (n, k) in level.items() if n)
        r = over / pairs if pairs else None
        m = reputation.LEAST if r is None else min(reputation.MOST, max(reputation.LEAST, 1 / r - 1)) if r > 0 else reputation.MOST
        return {x: (m * mean(x) + k, m * (1 - mean(x)) + n - k) for x, (n, k) in level.items()}

    rate = lambda t: (lambda x: t[x][0] / sum(t[x]))
    top = shrink(tops, lambda s: (k + 0.5) / (n + 1))
    middle = shrink(domains, lambda d: rate(top)(d[1]))
    last = shrink(hosts, lambda h: rate(middle)(domain(h, suffixes)))
    low = {h: bound(*last[h], plan.tail) for h in hosts}
    return {h: (*hosts[h], rate(last)(h), low[h], low[h] > plan.limit) for h in hosts}


def judge(spark, pages, labels, plan=reputation.Reputation(), rules=()):
    p = spark.createDataFrame(pages, "page_id long, url string")
    b = spark.createDataFrame(labels, "doc_id long, bad int")
    return reputation.judge_urls(p, b, bad(), rules, plan=plan)


def farm():
    pages = [(i, f"http://{'www.' if i % 3 else ''}good{i % 7}.example.com/{i}") for i in range(700)]
    pages += [(1000 + i, f"https://m.spam.example.net/x{i}") for i in range(60)]
    pages += [(2000 + i, f"https://s{i % 40}.farm.test/{i}") for i in range(200)]
    pages += [(3000, "http://new.farm.test/"), (3001, "http://new.example.com/")]
    labels = [(i, int(i % 20 == 0)) for i in range(700)] + [(1000 + i, int(i % 10 != 0)) for i in range(60)] + [(2000 + i, int(i % 12 != 0)) for i in range(200)]
    return pages, labels


def test_against_plain_version(spark):
    pages, labels = farm()
    plan = reputation.Reputation()
    want = plain(pages, labels, plan)
    out = judge(spark, pages, labels, plan).collect()
    assert len(out) == len(pages)
    for r in out:
        n, k, rate, low, blocked = want[r.host]
        assert (r.outcomes, r.bad_outcomes) == (n, k)
        assert r.rate == pytest.approx(rate, abs=1e-9) and r.bound == pytest.approx(low, abs=2e-4)
        assert r.verdict == ("block" if blocked else "allow") and r.rule is None
    verdict = {r.host: r.verdict for r in out}
    assert verdict["m.spam.example.net"] == verdict["s1.farm.test"] == "block"
    # A host without outcomes has its domain's reputation.
    assert verdict["new.farm.test"] == "block" and verdict["new.example.com"] == verdict["good1.example.com"] == "allow"


def test_few_outcomes_do_not_block(spark):
    pages, labels = farm()
    pages, labels = pages + [(5000, "http://one.example.com/")], labels + [(5000, 1)]
    got = {r.host: r for r in judge(spark, pages, labels).collect()}
    assert got["one.example.com"].verdict == "allow" and got["one.example.com"].bad_outcomes == 1


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://ÄB.Example.ORG", "http://user:pw@Host.Example.com:8080/a?b#c", "x://a?b/c", "x://a#b/c",
            "http://a://b/c", "http://1.2.3.4/x", "http://...", "http://a.b.co.uk/p", "http://co.uk/", "http://" + "a." * 5000 + "com/" + "p" * 100_000, "http://a b/c d"]
    pages = [(i, u) for i, u in enumerate(urls)] + [(None, "http://x.org/"), (None, None), (3, "http://x.org/"), (3, "http://x.org/")]
    labels = [(i, i % 2) for i in range(8)] + [(None, 1), (3, None), (3, 1), (3, 1)]
    plan = reputation.Reputation(limit=0.4, suffixes=("co.uk",))
    got = sorted((r.page_id is None, r.page_id or 0, r.host, r.path, r.outcomes, r.bad_outcomes) for r in judge(spark, pages, labels, plan).collect())
    want = plain(pages, labels, plan, ("co.uk",))
    assert got == sorted((i is None, i or 0, *parts(u), *want[parts(u)[0]][:2]) for i, u in pages)


def test_rules(spark):
    urls = {"http://a.org/x": ("org/", "allow"), "http://org/x": ("org/", "allow"), "http://a.borg/x": (None, "allow"), "http://EXAMPLE.org/es/1": ("example.org/es/", "block"),
            "http://b.example.org/en/12": ("example.org/en/1", "block"), "http://b.example.org/en/2": ("org/", "allow"), "http://notexample.org/es/1": ("org/", "allow"),
            "http://x.com/fr/": ("com/fr/", "allow"), "http://x.com/de/#": ("com/de/", "block"), "http://x.com/de?/": (None, "allow"), "http://a.org": (None, "allow"), "http://x.com:80/de/": (None, "allow")}
    out = judge(spark, list(enumerate(urls)), [], reputation.Reputation(limit=0.99), RULES).collect()
    assert {r.url: (r.rule, r.verdict) for r in out} == urls


def test_empty_tables_and_clashing_names(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", "mine", 7, 2)], "page_id long, url string, HOST string, rows int, n int")
    labels = spark.createDataFrame([], "doc_id long, bad int, host string")
    out = reputation.judge_urls(pages, labels, bad())
    assert out.columns == ["page_id", "url", "rows", "n", "host", "path", "rule", "verdict", "outcomes", "bad_outcomes", "rate", "bound"]
    row = out.first()
    assert (row.host, row["rows"], row.n, row.outcomes, row.rate, row.verdict) == ("a.b", 7, 2, 0, 0.5, "allow")
    assert reputation.judge_urls(pages.limit(0), labels, bad()).count() == 0


@pytest.mark.parametrize("a,b", [(0.01, 0.01), (0.3, 5.0), (5.0, 0.02), (1.0, 1.0), (30.0, 70.0), (2e5, 3e6)])
def test_bound(spark, a, b):
    got = spark.range(1).select(reputation.posterior_bound(F.lit(a), F.lit(b), 0.05).alias("x")).first().x
    sd = math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
    assert abs(got - bound(a, b, 0.05)) <= 0.02 * sd + 1e-9


def test_join_keyed_deals_out_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("w"), F.max("id").alias("top"))
    out = join_keyed(rows, keyed, "k", "w", ["id"])
    assert sorted(out.columns) == ["id", "k", "top"]
    assert {(r.k, r.id, r.top) for r in out.collect()} == {(0, i, 3999) for i in range(4000)} | {(i, i, i) for i in range(4000, 5000)}
    missing = join_keyed(rows, keyed.filter("k = 0"), "k", "w", ["id"], "left")
    assert missing.filter("top IS NULL").count() == 1000 and missing.count() == 5000
