"""Soft-membership mixing of sources to target weights, on built-in functions only.

1. A classifier is fitted on labelled rows: logistic regression on the features (distinct words and a few proportions of
   the text) that tell the domains apart. It starts from shrunken naive Bayes weights; each step is one aggregation.
2. Every document gets posteriors p over the domains (the label combinations), so it belongs to several domains softly.
3. Rates r >= 0 are fitted so that the expected tokens of each domain, sum of r * n * p, match the targets in the least
   squares sense (errors relative to the domain's size). Projected gradient with momentum: each round needs one number per
   domain from all documents. From r = 1, the rate after t rounds depends on p and the t gradients only, so no state per
   document is kept, rates are computed where they are needed, and a lost executor costs nothing but its tasks. The first
   rounds run on documents added up by nearly equal p; then the totals are taken from all documents, and rounds go on
   there if a target is missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.base import let, written

MAX_LABELLED = 20_000     # labelled rows the classifier is fitted on (those of smallest id hash)
MAX_FEATURES = 1_024      # features of the classifier (those that tell the domains apart best)
MIN_DOCS = 5              # fitted documents a feature is found in, at least, whatever their share
MIN_GAIN = 8.0            # least information of a feature about the domains: sum of n * log(n / expected n)
SHRINK = 25.0             # documents of the whole corpus that each domain's counts are mixed with
MAX_DOMAINS = 200         # label combinations that are domains beside the named ones; all others are one, REST
REST = "rest"
LEAST_LABELLED = 1_000    # a named domain with fewer rows in the sample is fitted on so many of its own, or all it has
STEPS = 20                # of the logistic regression
PENALTY = 5.0             # on squared weights, in documents
PRECISION = 0.01          # of posteriors in profiles: documents of nearly equal posteriors are one row in the first rounds
BYTES_PER_TOKEN = 4
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # ASCII but for a-z and 0-9
SIGNS = r"[#$%&*+/<=>@\[\]^_`{|}~\\]+"
ROUNDS = 60
TOLERANCE = 0.002         # of all tokens, for each domain, and
NEAR_TARGET = 0.02        # of a domain's own target, if it has one


@dataclass(frozen=True)
class Classifier:
    domains: list[str]
    prior: list[float]                 # log shares
    weights: dict[str, list[float]]    # by feature, what it adds to each domain's score

    def posteriors(self, text: Column) -> Column:
        """Probabilities in the order of ``domains``. A text without known features gets the priors."""
        return softmax(_scores(self.prior, list(self.weights.values()), _places(features(text), list(self.weights))))


def _shares(parts: Column) -> Column:
    return let(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(parts, lambda x: x / total))


def softmax(scores: Column) -> Column:
    return let(scores, lambda s: let(F.array_max(s), lambda top: let(F.transform(s, lambda x: F.exp(x - top)), _shares)))


def _numbers(rows: list[list[float]]) -> Column:
    """A constant array of arrays of doubles, passed as one expression."""
    return F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(v)!r}D" for v in row) + ")" for row in rows) + ")")


def _places(own: Column, names: list[str]) -> Column:
    """Positions in ``names`` of the features a document has, in the order of ``own``.

    A feature's hash leads to one slot of a constant table, and the slot to the only name that may be there: two array reads and
    a comparison a word. The table's size is chosen so that no two names share a slot.
    """
    if not names:
        return F.array().cast("array<int>")
    hashes = np.array([xxhash.xxh64(n.encode(), seed=42).intdigest() for n in names], np.uint64).view(np.int64)  # as Spark's xxhash64
    slots = max(1 << 16, len(names) ** 2 // 16)
    while len(np.unique(hashes % slots)) < len(names):
        slots += 1
    table = np.zeros(slots, np.int64)
    table[hashes % slots] = np.arange(1, len(names) + 1)
    # Both are folded into one constant each.
    place_of = F.split(F.lit(" ".join(map(str, table))), " ").cast("array<int>")
    name_of = F.split(F.lit(" ".join(["", *names])), " ")

    def place(feature: Column) -> Column:
        return F.get(place_of, F.pmod(F.xxhash64(feature), F.lit(slots)).cast("int"))

    return F.transform(F.filter(own, lambda f: F.get(name_of, place(f)) == f), lambda f: place(f) - 1)


def _scores(prior: list[float], weights: list[list[float]], places: Column) -> Column:
    start = F.get(_numbers([prior]), F.lit(0))
    if not weights:
        return start
    # Bound once a row: inside the lambda the table would be built anew for every feature.
    return let(_numbers(weights), lambda table: F.aggregate(
        places, start, lambda a, i: F.zip_with(a, F.get(table, i), lambda x, y: x + y)))


def features(text: Column) -> Column:
    """Distinct words in lower case (runs of ASCII letters and digits and of all characters beyond ASCII), and three
    proportions of the text as words of their own. No feature has a space."""
    def build(t: Column, words: Column) -> Column:
        n, size = F.size(words), F.length(t)
        signs = size - F.length(F.regexp_replace(t, SIGNS, ""))

        def shape(distinct: Column) -> Column:
            return F.concat(distinct, F.array(
                F.concat(F.lit("~distinct"), F.when(n > 0, F.floor(F.size(distinct) * 10 / n)).otherwise(-1).cast("string")),
                F.concat(F.lit("~signs"), F.when(size > 0, F.floor(signs * 25 / size)).otherwise(-1).cast("string")),
                F.concat(F.lit("~length"), F.floor(F.log2(n + F.lit(1.0))).cast("string"))))

        return let(F.array_distinct(words), shape)

    return let(F.coalesce(text, F.lit("")), lambda t: let(F.array_remove(F.split(F.lower(t), BETWEEN_WORDS), ""), lambda words: build(t, words)))


def token_count(text: Column) -> Column:
    """Tokens of a text, counted as one per four UTF-8 bytes, rounded up; NULL has none."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + (BYTES_PER_TOKEN - 1)) / BYTES_PER_TOKEN).cast("double")


def domain_of(labels: list[str]) -> Column:
    """The label combination as a name such as ``quality=1,toxic=0``; NULL if a label is NULL."""
    return F.concat(*[x for i, c in enumerate(labels) for x in (F.lit("," * (i > 0) + c + "="), F.col(c).cast("string"))])


def fit_classifier(docs: DataFrame, labelled: DataFrame, labels: list[str], key: str = "doc_id", text: str = "text",
                   named: Iterable[str] = ()) -> Classifier:
    """Fit on at most ``MAX_LABELLED`` labelled rows and ``LEAST_LABELLED`` more for each ``named`` domain that is rare;
    rows whose text is not in ``docs`` don't count.

    Domains are the named label combinations that have labelled rows, however few, and the most frequent
    ``MAX_DOMAINS`` others. Rows of any other combination make up the domain ``REST``. Domains that are rare among the
    labelled rows have more than their share of the fitted ones; the priors make up for that.
    """
    sample = labelled.select(F.col(key).alias("id"), domain_of(labels).alias("domain")).dropna()
    all_counts = sample.groupBy("domain").agg(F.count("*").alias("n"))
    named = list(named)
    chosen = all_counts.filter(F.col("domain").isin(named)).collect() if named else []
    chosen += all_counts.filter(~F.col("domain").isin(named)).orderBy(F.desc("n"), "domain").limit(MAX_DOMAINS).collect()
    if not chosen:
        return Classifier(["all"], [0.0], {})
    total = sample.count()
    own_counts = {r["domain"]: r["n"] for r in chosen}
    rest = total - sum(own_counts.values())
    rate = min(1.0, MAX_LABELLED / total)
    rare = [d for d in named if d in own_counts and rate < 1 and own_counts[d] * rate < LEAST_LABELLED]
    parts = [sample.filter(~F.col("domain").isin(rare)).orderBy(F.xxhash64("id"), "domain").limit(MAX_LABELLED)]
    parts += [sample.filter(F.col("domain") == d).orderBy(F.xxhash64("id")).limit(LEAST_LABELLED) for d in rare]
    sample = reduce(DataFrame.unionAll, parts)
    sample = sample.withColumn("domain", F.when(F.col("domain").isin(list(own_counts)), F.col("domain")).otherwise(REST))
    counts = sorted([*own_counts.items(), *([(REST, rest)] if rest else [])])
    domains = [d for d, _ in counts]
    prior = [math.log(n / total) for _, n in counts]
    # How much more often than the others the rows of a rare domain are in the sample.
    usual = min(1.0, MAX_LABELLED / max(1, total - sum(own_counts[d] for d in rare)))
    extra = [math.log(min(1.0, LEAST_LABELLED / n) / usual) if d in rare else 0.0 for d, n in counts]
    # The sample has a fixed greatest size, so it may be broadcast whatever the table.
    known = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(sample), "id")
    known = known.select("domain", features(F.col("text")).alias("features"), F.xxhash64("text").alias("hash"))
    # Copies would teach the same words again: one row per text and domain.
    fitted = written(known.dropDuplicates(["hash", "domain"]), "labelled")
    n_of = {r["domain"]: r["n"] for r in fitted.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    sizes = [n_of.get(d, 0) for d in domains]
    all_docs = sum(sizes)
    if not all_docs:
        return Classifier(domains, prior, {})
    own = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)]
    found = fitted.select("domain", F.explode("features").alias("feature")).groupBy("feature").agg(*own)
    n = sum((F.col(f"n{i}") for i in range(len(domains))), F.lit(0))
    def gain(i: int, share: float) -> Column:
        own = F.col(f"n{i}")
        return F.when(own > 0, own * F.log(own / (F.col("n") * share))).otherwise(0.0)

    gains = sum((gain(i, s / all_docs) for i, s in enumerate(sizes) if s), F.lit(0.0))
    found = found.withColumn("n", n).filter(F.col("n") >= MIN_DOCS).withColumn("gain", gains)
    best = found.filter(F.col("gain") >= MIN_GAIN).orderBy(F.desc("gain"), "feature").limit(MAX_FEATURES).collect()
    weights = {}
    for r in best:
        share = r["n"] / all_docs
        weights[r["feature"]] = [math.log((r[f"n{i}"] + SHRINK * share) / ((s + SHRINK) * share)) for i, s in enumerate(sizes)]
    if not weights:
        return Classifier(domains, prior, {})
    right = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    rows = written(fitted.select(right.alias("k"), _places(F.col("features"), list(weights)).alias("at")), "features")
    prior, refined = _regress(rows, [a + b for a, b in zip(prior, extra)], list(weights.values()), {i: r["n"] for i, r in enumerate(best)})
    return Classifier(domains, [a - b for a, b in zip(prior, extra)], dict(zip(weights, refined)))


def _regress(rows: DataFrame, prior: list[float], start: list[list[float]], counts: dict[int, int]) -> tuple[list[float], list[list[float]]]:
    """Multinomial logistic regression on ``k`` (the right domain) and ``at`` (positions of features) by gradient steps
    with momentum. A feature's step is the inverse of its curvature, which its documents and the features beside it bound.
    """
    m, n = rows.agg(F.avg(F.size("at")), F.count("*")).first()
    k, everywhere = len(prior), len(start)  # the last place stands for the prior, which every document has
    rows = rows.select("k", F.concat("at", F.array(F.lit(everywhere))).alias("at"))
    # Half the naive Bayes weights: words come together, so their sum would be too sure.
    x = [[v / 2 for v in w] for w in start] + [list(prior)]
    y, before = [list(w) for w in x], [list(w) for w in x]
    count = [*[counts[i] for i in range(everywhere)], n]
    for step in range(STEPS):
        scores = _scores([0.0] * k, y, F.col("at"))
        errors = let(softmax(scores), lambda p: F.transform(p, lambda v, i: v - (F.col("k") == i).cast("double")))
        found = rows.select("at", errors.alias("e")).select(F.explode("at").alias("f"), "e")
        sums = found.groupBy("f").agg(*[F.sum(F.get("e", F.lit(i))).alias(f"e{i}") for i in range(k)]).collect()
        for r in sums:
            f = r["f"]
            size = 2.0 / ((m + 1) * (count[f] + PENALTY))
            for i in range(k):
                x[f][i] = y[f][i] - size * (r[f"e{i}"] + PENALTY * y[f][i] * (f != everywhere))
        y = [[a + momentum(step + 1) * (a - b) for a, b in zip(w, v)] for w, v in zip(x, before)]
        before = [list(w) for w in x]
    return x[-1], x[:-1]


@dataclass(frozen=True)
class Mix:
    classifier: Classifier
    targets: list[float]            # tokens per domain
    totals: list[float]             # tokens per domain at rate 1
    gradients: list[list[float]]    # one per round
    reached: list[float]            # expected tokens per domain at the fitted rates

    def rate(self, posteriors: Column) -> Column:
        return rates_after(posteriors, self.gradients)["x"]


def momentum(done: int) -> float:
    """Weight of the last move when a round begins after ``done`` rounds (Nesterov's sequence, in its simple form)."""
    return done / (done + 3.0)


def rates_after(p: Column, gradients: list[list[float]]) -> Column:
    """Struct of the rate ``x`` of a document with posteriors p after all rounds and the rate ``y`` the next round starts
    from. A round goes from y against its gradient and projects to >= 0; y then is x carried on by the last move."""
    start = F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y"))
    if not gradients:
        return start
    # Each row: the gradient and, last, the momentum that follows it.
    steps = _numbers([[*g, momentum(i + 1)] for i, g in enumerate(gradients)])
    k = len(gradients[0])

    def step(at: Column, by: Column) -> Column:
        change = sum((F.get(p, F.lit(i)) * F.get(by, F.lit(i)) for i in range(k)), F.lit(0.0))
        return let(F.greatest(F.lit(0.0), at["y"] - change), lambda x: F.struct(
            x.alias("x"), (x + F.get(by, F.lit(k)) * (x - at["x"])).alias("y")))

    return F.aggregate(steps, start, step)


def fit_rates(scored: DataFrame, classifier: Classifier, weights: dict[str, float], keep_whole: str | None = None,
              budget: float | None = None) -> Mix:
    """Fit rates on ``scored`` (``n``, ``p``). Targets: the weights' shares of ``budget`` tokens.

    Without a budget it is the tokens there are or, with ``keep_whole``, what leaves that domain as it is. Domains
    without a weight have target 0. With steps of 1 / (tokens of the domain) the curvature is at most 1, so the unit
    step always converges. Rounds end when all targets are met on the documents themselves within ``TOLERANCE`` of all
    tokens and ``NEAR_TARGET`` of the target, when the gradient no longer moves them (a target that can't be met), or
    after ``ROUNDS``. ``reached`` always comes from the documents.
    """
    k = len(classifier.domains)
    exact = scored.filter("n > 0").select("p", F.transform("p", lambda x: x * F.col("n")).alias("np"))
    binned = exact.groupBy(F.transform("p", lambda x: F.floor(x / PRECISION + 0.5)).alias("bin"))
    sums = binned.agg(F.array(*[F.sum(F.get("np", F.lit(i))) for i in range(k)]).alias("np"))
    profiles = written(sums.select(_shares(F.col("np")).alias("p"), "np"), "profiles")

    def expected(rows: DataFrame, gradients: list[list[float]]) -> tuple[list[float], list[float]]:
        rows = rows.select("np", rates_after(F.col("p"), gradients).alias("r"))
        row = rows.agg(*[F.sum(F.col(f"r.{at}") * F.get("np", F.lit(i))) for at in ("x", "y") for i in range(k)]).first()
        both = [float(v or 0.0) for v in row]
        return both[:k], both[k:]

    totals, _ = expected(profiles, [])
    shares = [max(0.0, float(weights.get(d, 0.0))) for d in classifier.domains]
    shares = [s / (sum(shares) or 1.0) for s in shares]
    at = classifier.domains.index(keep_whole) if keep_whole in classifier.domains else None
    if budget is None:
        budget = totals[at] / shares[at] if at is not None and shares[at] else sum(totals)
    targets = [s * budget for s in shares]
    scale = sum(totals)
    allowed = [min(TOLERANCE * scale, NEAR_TARGET * t) if t > 0 else TOLERANCE * scale for t in targets]
    gradients, now = [], totals
    for rows in (profiles, exact):
        now, ahead = expected(rows, gradients)
        while scale and len(gradients) < ROUNDS:
            if all(abs(a - b) <= c for a, b, c in zip(now, targets, allowed)):
                break
            gradients.append([(a - b) / t if t > 0 else 0.0 for a, b, t in zip(ahead, targets, totals)])
            before = now
            now, ahead = expected(rows, gradients)
            if all(abs(a - b) <= 0.005 * c for a, b, c in zip(before, now, allowed)):
                break
    return Mix(classifier, targets, totals, gradients, now)


def _draw(key: str, text: str) -> Column:
    """A fixed number in [0, 1) for each key and text."""
    return F.pmod(F.xxhash64(F.col(key), F.col(text), F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))


def _scored(docs: DataFrame, classifier: Classifier, key: str, text: str) -> DataFrame:
    return written(docs.select(
        F.col(key).alias("key"), token_count(F.col(text)).alias("n"), classifier.posteriors(F.col(text)).alias("p"), _draw(key, text).alias("draw")), "scored")


def mix_to_targets(docs: DataFrame, labelled: DataFrame, labels: list[str], weights: dict[str, float], key: str = "doc_id",
                   text: str = "text", keep_whole: str | None = None, budget: float | None = None) -> tuple[DataFrame, Mix]:
    """``key, n_tokens, posteriors, rate, copies`` for each row of ``docs``, and the fit.

    ``copies`` is the rate rounded up or down by a fixed draw from key and text, so that its mean is the rate. A NULL or
    empty text has no tokens and gets the rate of its posteriors; NULL keys and repeated rows are rows like others; rows
    of one key and text draw alike; other columns are ignored. An empty table gives an empty result; without labels
    there is one domain, ``all``.
    """
    classifier = fit_classifier(docs, labelled, labels, key, text, weights)
    scored = _scored(docs, classifier, key, text)
    mix = fit_rates(scored, classifier, weights, keep_whole, budget)
    rated = scored.withColumn("rate", mix.rate(F.col("p")))
    return rated.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_tokens"), F.col("p").alias("posteriors"), "rate",
                        F.floor(F.col("rate") + F.col("draw")).cast("int").alias("copies")), mix


def mixed(docs: DataFrame, labelled: DataFrame, labels: list[str], weights: dict[str, float], key: str = "doc_id",
          text: str = "text", keep_whole: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_to_targets`` has copies of it, with the columns of ``docs``.

    Rates are computed again beside the text, so that texts need not be joined with them.
    """
    classifier = fit_classifier(docs, labelled, labels, key, text, weights)
    mix = fit_rates(_scored(docs, classifier, key, text), classifier, weights, keep_whole)
    rate = let(classifier.posteriors(F.col(text)), mix.rate)
    copies = F.floor(rate + _draw(key, text)).cast("int")
    rows = docs.select(F.struct("*").alias("row"), F.array_repeat(F.lit(0), copies).alias("copies"))
    # Not explode: Spark would add a filter on the array and with it compute the rates twice.
    return rows.select("row", F.explode_outer("copies").alias("copy")).filter("copy IS NOT NULL").select("row.*")
