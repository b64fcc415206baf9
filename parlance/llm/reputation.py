"""Host reputation by empirical Bayes, and explicit url rules.

Labelled pages are outcomes of their host: bad or not. A host with few outcomes tells little by itself, so its rate of bad
pages is shrunk to that of its registered domain, the domain's to that of its suffix, and the suffix's to that of all pages.
Each level is a beta-binomial: the children of a parent have rates drawn from a beta distribution around the parent's rate,
and one number per level, its concentration, is estimated from how far the children's outcomes spread (method of moments).
A host is blocked when the lower bound of its posterior lies above ``limit``: rates that could still be fine by chance are
not blocked. Everything is native: counts, one aggregate per level, and a quadrature of the posterior per host.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.base import let, written
from parlance.llm.hot import join_keyed

STEPS = 256     # intervals of the quadrature
WIDTH = 9.0     # its half width in standard deviations
LEAST, MOST = 1.0, 200.0  # bounds of a level's concentration: what the parent counts for, in outcomes


@dataclass(frozen=True)
class Rule:
    """``verdict`` for urls whose host is ``host`` or a subdomain of it and whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    """``limit``: rate of bad pages that a host may have; ``tail``: how sure a block is (the posterior's mass below its bound).

    ``suffixes``: public suffixes of more than one label (``co.uk``); all other suffixes are the last label.
    """

    limit: float = 0.3
    tail: float = 0.05
    suffixes: tuple[str, ...] = field(default=())


def url_parts(url: str) -> dict[str, Column]:
    """``host`` (after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case) and ``path`` (then up to ``?``,
    ``#`` or the end). NULL or no ``://``: both empty."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return {"host": host, "path": path}


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The fitting rule with the longest text as ``struct<rule, verdict>``, or NULL. Ties go to the smaller host."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.host, r.path, r.verdict)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found.append(F.when(fits, F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))))
    return F.coalesce(*found)


def domain_parts(host: str, suffixes: tuple[str, ...] = ()) -> dict[str, Column]:
    """``domain`` (suffix and one label more) and ``suffix`` of a host, user and port left out. An address of digits and dots, or
    a host of one label, is its own domain and has the empty suffix."""
    name = F.regexp_replace(F.regexp_replace(F.col(host), "^.*@", ""), ":[0-9]*$", "")
    name = F.regexp_replace(name, r"^\.+|\.+$", "")
    labels = F.split(name, r"\.")
    size = F.size(labels)
    single = (size < 2) | name.rlike(r"^[0-9.]+$")
    long = F.lit(1)
    for suffix in sorted(suffixes, key=lambda s: s.count(".")):
        long = F.when((name == suffix) | name.endswith("." + suffix), suffix.count(".") + 1).otherwise(long)
    tail = F.array_join(F.slice(labels, -F.least(long, size), F.least(long, size)), ".")
    domain = F.array_join(F.slice(labels, -F.least(long + 1, size), F.least(long + 1, size)), ".")
    return {"domain": F.when(single, name).otherwise(domain), "suffix": F.when(single, "").otherwise(tail)}


def posterior_bound(a: Column, b: Column, tail: float) -> Column:
    """The value with a mass of ``tail`` below it under Beta(a, b).

    In the logit the density is ``x^a (1-x)^b``, smooth and with one peak at log(a/b), so the trapezoid rule on a grid around it
    (``WIDTH`` standard deviations to either side) is exact to many digits; between grid points the mass is interpolated.
    """
    spread = F.sqrt(1 / a + 1 / (2 * a * a) + 1 / b + 1 / (2 * b * b))  # about trigamma(a) + trigamma(b)
    low, step = F.log(a / b) - WIDTH * spread, 2 * WIDTH / STEPS * spread

    def height(t: Column) -> Column:
        peak = -a * F.log1p(b / a) - b * F.log1p(a / b)
        return F.exp(-a * F.log1p(F.exp(-t)) - b * F.log1p(F.exp(t)) - peak)

    heights = F.transform(F.sequence(F.lit(0), F.lit(STEPS)), lambda i: height(low + i * step))

    def bound(h: Column) -> Column:
        goal = tail * F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"), F.lit(0.0).alias("n"))

        def walk(s: Column, x: Column) -> Column:
            now = s["sum"] + x
            hit = (s["at"] < 0) & (now >= goal)
            # A point's mass lies half an interval to either side of it.
            return F.struct(now.alias("sum"), F.when(hit, s["n"] + (goal - s["sum"]) / x - 0.5).otherwise(s["at"]).alias("at"), (s["n"] + 1).alias("n"))

        at = F.aggregate(h, start, walk, lambda s: s["at"])
        return 1 / (1 + F.exp(-(low + at * step)))

    return let(heights, bound)


def _concentration(children: DataFrame) -> float:
    """Of ``n, bad, mean`` (outcomes and the parent's rate): how many outcomes the parent's rate counts for.

    (bad - n mean)^2 has the expectation n mean (1 - mean) (1 + (n - 1) r); r is the correlation of a child's outcomes.
    """
    v = F.col("mean") * (1 - F.col("mean"))
    d = F.col("bad") - F.col("n") * F.col("mean")
    row = children.filter("n > 0").agg(F.sum(d * d - F.col("n") * v).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * v).alias("pairs")).first()
    if not row["pairs"]:
        return LEAST  # no child has two outcomes: nothing says that children are alike
    r = row["over"] / row["pairs"]
    return MOST if r <= 1 / (MOST + 1) else max(LEAST, 1 / r - 1)


def host_reputation(pages: DataFrame, labels: DataFrame, bad: Column, key: str = "page_id", label_key: str = "doc_id",
                    plan: Reputation = Reputation()) -> DataFrame:
    """``host, rows, n, bad, mean, low, blocked`` per host of ``pages`` (``key`` and ``host``).

    ``bad`` (boolean, over the columns of ``labels``) is the outcome of a labelled row; where it is NULL the row isn't counted.
    A page with several labels has several outcomes; repeated page rows count again. Hosts without outcomes have their parents'
    rate. Without any outcome the rate of all is 1/2 with a concentration of ``LEAST``, and nothing is blocked for it while
    ``limit`` lies above the posterior's lower tail. The empty host is a host.
    """
    told = labels.select(F.col(label_key).alias("__k"), bad.cast("int").alias("__bad")).filter("__k IS NOT NULL AND __bad IS NOT NULL")
    told = told.groupBy("__k").agg(F.count("*").alias("n"), F.sum("__bad").alias("bad"))
    seen = pages.select(F.col(key).alias("__k"), "host").groupBy("__k", "host").agg(F.count("*").alias("rows"))
    seen = seen.join(told, "__k", "left")
    hosts = seen.groupBy("host").agg(F.sum("rows").alias("rows"), F.coalesce(F.sum(F.col("rows") * F.col("n")), F.lit(0)).alias("n"),
                                     F.coalesce(F.sum(F.col("rows") * F.col("bad")), F.lit(0)).alias("bad"))
    hosts = written(hosts.withColumns(domain_parts("host", plan.suffixes)), "hosts")
    sums = [F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = written(hosts.groupBy("suffix", "domain").agg(*sums), "domains")
    suffixes = written(domains.groupBy("suffix").agg(*sums), "suffixes")
    every = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    rate = (every["bad"] + 0.5) / (every["n"] + 1)

    def shrunk(children: DataFrame) -> tuple[DataFrame, float]:
        m = _concentration(children)
        return children.withColumns({"a": F.lit(m) * F.col("mean") + F.col("bad"), "b": F.lit(m) * (1 - F.col("mean")) + (F.col("n") - F.col("bad"))}), m

    def rates(level: DataFrame, name: str) -> DataFrame:
        return level.select(F.col(name), F.col("children"), (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))

    top, _ = shrunk(suffixes.withColumn("mean", F.lit(rate)))
    below = join_keyed(domains.withColumnRenamed("children", "own"), written(rates(top, "suffix"), "suffix-rates"), "suffix", "children", ["domain"])
    middle, _ = shrunk(written(below.withColumnRenamed("own", "children"), "domain-priors"))
    # A domain is one row: its suffix follows from it, but for an address and a host of one label, whose suffix is empty.
    last = join_keyed(hosts.drop("suffix"), written(rates(middle, "domain"), "domain-rates"), "domain", "children", ["host"])
    final, _ = shrunk(written(last, "host-priors"))
    low = posterior_bound(F.col("a"), F.col("b"), plan.tail)
    return final.select("host", "rows", "n", "bad", (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"), low.alias("low")).withColumn(
        "blocked", F.col("low") > plan.limit)


def judge_urls(pages: DataFrame, labels: DataFrame, bad: Column, rules: list[Rule] = (), url: str = "url", key: str = "page_id",
               label_key: str = "doc_id", plan: Reputation = Reputation()) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict, outcomes, bad_outcomes, rate, bound``; columns of these names are replaced.

    ``verdict`` is the longest fitting rule's, else ``block`` for hosts whose posterior bound is above the limit, else ``allow``.
    All rows come back: NULL and repeated keys, NULL urls (host and path empty), urls without ``://``. The rules are a parameter
    and go into the plan. An empty table gives an empty result.
    """
    new = ["host", "path", "rule", "verdict", "outcomes", "bad_outcomes", "rate", "bound"]
    rows = pages.withColumns(url_parts(url))
    table = written(host_reputation(rows, labels, bad, key, label_key, plan), "reputation")
    known = table.select("host", "rows", F.col("n").alias("outcomes"), F.col("bad").alias("bad_outcomes"), F.col("mean").alias("rate"), F.col("low").alias("bound"), F.col("blocked").alias("__blocked"))
    plain = rows.drop(*[c for c in rows.columns if c.lower() in new[2:]])
    out = join_keyed(plain, known, "host", "rows", [key, url], "left")
    rule = ruled(F.col("host"), F.col("path"), list(rules))
    out = out.withColumn("__rule", rule).withColumns({
        "rule": F.col("__rule.rule"), "verdict": F.coalesce("__rule.verdict", F.when(F.col("__blocked"), "block").otherwise("allow"))})
    kept = [c for c in pages.columns if c.lower() not in new]
    return out.select(*kept, *new)
