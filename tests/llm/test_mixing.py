import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import mixing, queries

LABELS = ["quality", "toxic"]


def corpus(spark, n, seed=1):
    """Texts whose words tell the labels, with noise; (doc_id, text, quality, toxic)."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        quality, toxic = int(rng.random() < 0.7), int(rng.random() < 0.2)
        words = [f"w{rng.randrange(2_000)}" for _ in range(rng.randrange(20, 120))]
        words += [rng.choice(["nasty", "vile", "rotten"]) for _ in range(3 if toxic else int(rng.random() < 0.02))]
        if not quality:
            words += [rng.choice(["###", "$$$"]) for _ in range(20)]
        rng.shuffle(words)
        rows.append((i, " ".join(words), quality, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows = corpus(spark, 1_500).cache()
    seen = rows.filter("doc_id < 1000")
    model = mixing.fit_classifier(rows.select("doc_id", "text"), seen.select("doc_id", *LABELS), LABELS)
    assert model.domains == sorted(f"quality={q},toxic={t}" for q in (0, 1) for t in (0, 1))
    scored = rows.filter("doc_id >= 1000").select(mixing.domain_of(LABELS).alias("d"), model.posteriors(F.col("text")).alias("p")).collect()
    right = sum(model.domains[max(range(4), key=lambda i: r.p[i])] == r.d for r in scored)
    assert right / len(scored) > 0.9
    assert all(abs(sum(r.p) - 1) < 1e-9 for r in scored)


def test_toxic_rows_of_every_language_on_held_out_labels(spark):
    rng, rows = random.Random(4), []
    for i in range(3_000):
        lang = rng.choices(["en", "de", "es"], [0.9, 0.06, 0.04])[0]
        toxic = int(rng.random() < 0.25)
        words = [f"{lang}{rng.randrange(500)}" for _ in range(60)]
        words += [f"{lang}bad{rng.randrange(4)}" for _ in range(5 * toxic)]
        rng.shuffle(words)
        rows.append((i, lang, " ".join(words), 1, toxic))
    rows = spark.createDataFrame(rows, "doc_id long, lang string, text string, quality int, toxic int").cache()
    model = mixing.fit_classifier(rows.select("doc_id", "text"), rows.filter("doc_id < 2000").select("doc_id", *LABELS), LABELS)
    at = model.domains.index("quality=1,toxic=1")
    held = rows.filter("doc_id >= 2000").select("lang", "toxic", F.get(model.posteriors(F.col("text")), F.lit(at)).alias("p"))
    shares = {(r.lang, r.toxic): r.share for r in held.groupBy("lang", "toxic").agg(F.avg((F.col("p") > 0.5).cast("int")).alias("share")).collect()}
    for lang in ("en", "de", "es"):
        assert shares[lang, 1] > 0.9, shares
        assert shares[lang, 0] < 0.05, shares


def test_rare_domains_are_kept_or_rest(spark, monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(30)) + " vile nasty rotten awful" * (i < 16) for i in range(4_000)]
    rows = spark.createDataFrame([(i, t, 1, int(i < 16)) for i, t in enumerate(texts)], "doc_id long, text string, quality int, toxic int").cache()
    docs, named = rows.select("doc_id", "text"), "quality=1,toxic=1"
    monkeypatch.setattr(mixing, "MAX_LABELLED", 1_500)  # the sample of this size has only a few of the 16
    out, mix = mixing.mix_to_targets(docs, rows.select("doc_id", *LABELS), LABELS, {"quality=1,toxic=0": 0.9999, named: 0.0001})
    at = mix.classifier.domains.index(named)
    found = out.join(rows.select("doc_id", "toxic"), "doc_id").groupBy("toxic").agg(F.avg(F.get("posteriors", F.lit(at))).alias("p"))
    p = {r.toxic: r.p for r in found.collect()}
    assert p[1] > 0.5 and p[0] < 0.01
    monkeypatch.setattr(mixing, "MAX_DOMAINS", 1)
    labels = rows.select("doc_id", "quality", F.pmod("doc_id", F.lit(3)).alias("toxic"))
    model = mixing.fit_classifier(docs, labels, LABELS)
    assert model.domains == ["quality=1,toxic=0", mixing.REST]
    assert mixing.fit_classifier(docs, labels, LABELS, named=["quality=1,toxic=2"]).domains == ["quality=1,toxic=0", "quality=1,toxic=2", mixing.REST]


def plain_rates(p, gradients):
    x = y = 1.0
    for t, g in enumerate(gradients):
        new = max(0.0, y - sum(a * b for a, b in zip(p, g)))
        y = new + mixing.momentum(t + 1) * (new - x)
        x = new
    return x


def test_targets_are_met_and_rates_follow_the_gradients(spark):
    rows = corpus(spark, 1_200)
    weights = {"quality=1,toxic=0": 0.8, "quality=0,toxic=0": 0.15, "quality=1,toxic=1": 0.05}
    out, mix = mixing.mix_to_targets(rows.select("doc_id", "text"), rows.select("doc_id", *LABELS), LABELS, weights)
    got = out.collect()
    total = sum(r.n_tokens for r in got)
    for k, target in enumerate(mix.targets):
        expected = sum(r.rate * r.n_tokens * r.posteriors[k] for r in got)
        assert abs(expected - mix.reached[k]) < 1e-6 * total
        assert abs(expected - target) < 0.01 * total
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
    assert all(abs(r.rate - plain_rates(r.posteriors, mix.gradients)) < 1e-9 for r in got)
    copied = sum(r.copies * r.n_tokens for r in got)
    assert abs(copied - sum(mix.reached)) < 0.1 * total


def test_small_targets_are_met_on_unrounded_posteriors(spark):
    classifier = mixing.Classifier(["a", "b", "c"], [0.0] * 3, {})
    rng, rows = random.Random(6), []
    for _ in range(3_000):
        c = rng.choice([0.004, 0.0049, 0.3 * rng.random()])
        rows.append((float(rng.randrange(1, 500)), [0.9 - 0.9 * c, 0.1 - 0.1 * c, c]))
        rows.append((float(rng.randrange(1, 500)), [0.2 - 0.2 * c, 0.8 - 0.8 * c, c]))
    mix = mixing.fit_rates(spark.createDataFrame(rows, "n double, p array<double>"), classifier, {"a": 0.8, "b": 0.18, "c": 0.02})
    totals, reached = [0.0] * 3, [0.0] * 3
    for n, p in rows:
        rate = plain_rates(p, mix.gradients)
        for i in range(3):
            totals[i] += n * p[i]
            reached[i] += rate * n * p[i]
    for i in range(3):
        assert abs(mix.totals[i] / totals[i] - 1) < 1e-9
        assert abs(mix.reached[i] / reached[i] - 1) < 1e-9
        assert abs(reached[i] / mix.targets[i] - 1) < 0.03
    model = mixing.Classifier(["a", "b"], [math.log(0.9973), math.log(0.0027)], {})
    assert abs(spark.range(1).select(model.posteriors(F.lit("x"))).first()[0][1] - 0.0027) < 1e-9


def test_whole_domain_stays_and_pipeline_form_copies_rows(spark):
    rows = corpus(spark, 800).withColumn("rate", F.lit("mine"))
    weights = {"quality=1,toxic=0": 0.9, "quality=0,toxic=0": 0.1}
    docs, labels = rows.drop(*LABELS), rows.select("doc_id", *LABELS)
    out, mix = mixing.mix_to_targets(docs, labels, LABELS, weights, keep_whole="quality=1,toxic=0")
    k = mix.classifier.domains.index("quality=1,toxic=0")
    assert abs(mix.targets[k] - mix.totals[k]) < 1e-6 * mix.totals[k]
    copies = {r.doc_id: r.copies for r in out.collect()}
    taken = mixing.mixed(docs, labels, LABELS, weights, keep_whole="quality=1,toxic=0")
    assert taken.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in copies.items() if n}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (None, "a b c", 1), (3, "a b c", 1), (3, "a b c", 1), (4, "x " * 50_000, 1)], "doc_id long, text string, copies int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    nulls = spark.createDataFrame([(1, None, 0), (None, 1, 1), (77, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, nulls):
        out, mix = mixing.mix_to_targets(docs, labels, LABELS, {})
        assert out.count() == 6
        assert [r.n_tokens for r in out.orderBy("n_tokens").collect()][:2] == [0, 0]
    empty = docs.filter("false")
    out, _ = mixing.mix_to_targets(empty, nulls, LABELS, {"quality=1,toxic=0": 1.0})
    assert out.count() == 0
    assert mixing.mixed(empty, none, LABELS, {}).columns == docs.columns


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for df in (mixing.mix_to_targets(docs, labels, LABELS, {})[0], mixing.mixed(docs, labels, LABELS, {})):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())


def plain_features(text):
    text = text or ""
    words = [w for w in re.split(mixing.BETWEEN_WORDS, text.lower()) if w]
    distinct = list(dict.fromkeys(words))
    signs = len(text) - len(re.sub(mixing.SIGNS, "", text))
    shares = (len(distinct) * 10 // len(words) if words else -1, signs * 25 // len(text) if text else -1, int(math.log2(len(words) + 1)))
    return [*distinct, *(f"~{k}{v}" for k, v in zip(("distinct", "signs", "length"), shares))]


def test_features_and_posteriors_against_plain_versions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "É é E-e %%%"), (-4, "same " * 3_000), (-5, "~signs1 ~length0")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(odd)
    counts = Counter(f for r in rows.collect() for f in plain_features(r.text))
    names = [f for f, _ in counts.most_common(700)] + ["never", "~never"]
    rng = random.Random(8)
    model = mixing.Classifier(["a", "b", "c"], [-0.1, -2.0, -3.0], {f: [rng.uniform(-1, 1) for _ in range(3)] for f in names})
    at = {f: i for i, f in enumerate(names)}
    got = rows.select("text", mixing._places(mixing.features(F.col("text")), names).alias("at"), model.posteriors(F.col("text")).alias("p")).collect()
    for r in got:
        own = [f for f in plain_features(r.text) if f in at]
        assert sorted(r["at"]) == sorted(at[f] for f in own)
        scores = [p + sum(model.weights[f][k] for f in own) for k, p in enumerate(model.prior)]
        top = max(scores)
        shares = [math.exp(s - top) for s in scores]
        assert all(abs(x - y / sum(shares)) < 1e-9 for x, y in zip(r.p, shares))
    assert spark.range(1).select(mixing._places(F.array(F.lit("x")), []).alias("n")).first().n == []


def plain_classifier(texts, labels):
    """Domains, features, weights and prior, from all labelled rows, with a matrix of documents by features."""
    names = {i: f"quality={q},toxic={t}" for i, q, t in labels if q is not None and t is not None}
    tally = Counter(names.values())
    domains = sorted(tally)
    prior = np.log([tally[d] / len(names) for d in domains])
    once = sorted({(texts[i] or "", d) for i, d in names.items() if i in texts})
    own = [set(plain_features(t)) for t, _ in once]
    right = np.array([domains.index(d) for _, d in once])
    sizes = np.bincount(right, minlength=len(domains))
    found = {}
    for fs, k in zip(own, right):
        for f in fs:
            found.setdefault(f, np.zeros(len(domains)))[k] += 1
    gains = {f: sum(c * math.log(c / (n.sum() * s / len(once))) for c, s in zip(n, sizes) if c) for f, n in found.items() if n.sum() >= mixing.MIN_DOCS}
    kept = sorted((f for f, g in gains.items() if g >= mixing.MIN_GAIN), key=lambda f: (-gains[f], f))[:mixing.MAX_FEATURES]
    count = np.array([found[f].sum() for f in kept] + [len(once)])
    share = count[:-1, None] / len(once)
    start = np.log((np.array([found[f] for f in kept]) + mixing.SHRINK * share) / ((sizes + mixing.SHRINK) * share))
    has = np.array([[f in fs for f in kept] + [True] for fs in own], float)
    step = 2 / ((has[:, :-1].sum() / len(once) + 1) * (count + mixing.PENALTY))
    pull = mixing.PENALTY * (np.arange(len(count)) < len(kept))
    x = ahead = np.vstack([start / 2, prior])
    for t in range(mixing.STEPS):
        e = np.exp(has @ ahead)
        e /= e.sum(axis=1, keepdims=True)
        e[np.arange(len(once)), right] -= 1
        moved = ahead - step[:, None] * (has.T @ e + pull[:, None] * ahead)
        x, ahead = moved, moved + (t + 1) / (t + 4) * (moved - x)
    return domains, kept, x


def plain_fit(n, p, weights):
    """Rates of all documents: rounds on documents added up by nearly equal posteriors, then on all."""
    def rates(p, gradients):
        x = ahead = np.ones(len(p))
        for t, g in enumerate(gradients):
            moved = np.maximum(0, ahead - p @ g)
            x, ahead = moved, moved + (t + 1) / (t + 4) * (moved - x)
        return x, ahead

    mass = n[:, None] * p
    groups = {}
    for key, row in zip(map(tuple, np.floor(p / mixing.PRECISION + 0.5).astype(int)), mass):
        groups[key] = groups.get(key, 0) + row
    binned = np.array([g for g in groups.values() if g.sum() > 0])
    totals = binned.sum(axis=0)
    targets = np.array(weights) / sum(weights) * totals.sum()
    allowed = np.where(targets > 0, np.minimum(mixing.TOLERANCE * totals.sum(), mixing.NEAR_TARGET * targets), mixing.TOLERANCE * totals.sum())
    gradients = []
    for q, m in ((binned / binned.sum(axis=1, keepdims=True), binned), (p, mass)):
        now, ahead = (r @ m for r in rates(q, gradients))
        while len(gradients) < mixing.ROUNDS and (abs(now - targets) > allowed).any():
            gradients.append((ahead - targets) / totals)
            before = now
            now, ahead = (r @ m for r in rates(q, gradients))
            if (abs(now - before) <= 0.005 * allowed).all():
                break
    return rates(p, gradients)[0]


@pytest.mark.parametrize("made", [False, True])
def test_the_whole_query_against_a_plain_version(spark, tmp_path, made):
    sf = "/root/testdata/sf0.001"
    if made:
        rows, sf = corpus(spark, 900, seed=3).cache(), str(tmp_path)
        rows.select("doc_id", F.when(F.col("doc_id") % 90 != 0, F.col("text")).alias("text")).write.parquet(f"{sf}/documents.parquet")
        rows.select("doc_id", *LABELS).filter("doc_id % 3 > 0").write.parquet(f"{sf}/labels.parquet")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", *queries.LABELS).collect()]
    domains, kept, x = plain_classifier(texts, labels)
    ids, at = sorted(texts), {f: i for i, f in enumerate(kept)}
    has = np.zeros((len(ids), len(kept) + 1))
    has[:, -1] = 1
    for row, i in zip(has, ids):
        row[[at[f] for f in set(plain_features(texts[i])) if f in at]] = 1
    p = np.exp(has @ x)
    p /= p.sum(axis=1, keepdims=True)
    n = np.array([-(-len((texts[i] or "").encode()) // mixing.BYTES_PER_TOKEN) for i in ids], float)
    rate = plain_fit(n, p, [queries.WEIGHTS.get(d, 0.0) for d in domains])
    got = {r.doc_id: r for r in queries.op10_soft_mixing(spark, sf).collect()}
    assert sorted(got) == ids and len(kept) > 3 and len(domains) > 2
    for i, own, tokens, r in zip(ids, p, n, rate):
        row = got[i]
        assert row.n_tokens == tokens
        assert all(abs(row["p_" + d.replace("=", "").replace(",", "_")] - v) < 1e-6 for d, v in zip(domains, own))
        assert abs(row.rate - r) < 1e-5
        seed = xxhash.xxh64_intdigest(i.to_bytes(8, "little", signed=True), seed=42)
        seed = seed if texts[i] is None else xxhash.xxh64_intdigest(texts[i].encode(), seed=seed)
        draw = (xxhash.xxh64_intdigest(b"copies", seed=seed) & 0xFFFFF) / (1 << 20)
        assert row.copies in {math.floor(r + draw + d) for d in (-1e-5, 1e-5)}
