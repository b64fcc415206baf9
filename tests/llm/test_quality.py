import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from parlance.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def plain_js(p, q):
    if not sum(p) or not sum(q):
        return None
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    total = 0.0
    for a, b in zip(p, q):
        m = (a + b) / 2
        total += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(0.0, total))


def plain_classes(text):
    left, out = text or "", []
    for one in quality.CLASSES:
        kept = re.sub(one, "", left)
        out.append(len(left) - len(kept))
        left = kept
    return [*out, len(left)]


def plain_limits(rows, refs):
    """(text, lang) rows -> the limits of each language, from the quartiles of its own documents."""
    found = {}
    for text, lang in rows:
        base, *distances, _ = plain_verdict(text, lang, refs)
        if lang is not None and not base[-1]:
            for kind, d, (_, second) in zip(("char", "word"), distances, (quality.CHAR_LIMIT, quality.WORD_LIMIT)):
                if d is not None:
                    found.setdefault((lang, kind), []).append(math.floor((d - second / math.sqrt(base[0])) * quality.LIMIT_STEPS))
    limits = {}
    for at, steps in found.items():
        steps.sort()
        if len(steps) >= quality.LIMIT_DOCS:
            q = [(steps[math.ceil(len(steps) * k / 4) - 1] + 0.5) / quality.LIMIT_STEPS for k in (1, 2, 3)]
            limits[at] = q[1] + max(quality.LEAST_MARGIN, quality.SPREADS * (q[2] - q[0]))
    return limits


def plain_verdict(text, lang, refs, limits=None):
    base = plain_base(text)
    words = WORD.findall(text or "")
    char = word = None
    if len(words) >= quality.MIN_WORDS and lang in refs:
        ref = refs[lang]
        char = plain_js(plain_classes(text), ref.classes)
        if ref.words:
            n = Counter(words)
            own = [n[w] for w in ref.words]
            word = plain_js([*own, len(words) - sum(own)], ref.counts)
    own = {kind: (limits or {}).get((lang, kind), fixed[0]) for kind, fixed in (("char", quality.CHAR_LIMIT), ("word", quality.WORD_LIMIT))}
    far = any(d is not None and d > own[kind] + b / math.sqrt(len(words))
              for kind, d, b in (("char", char, quality.CHAR_LIMIT[1]), ("word", word, quality.WORD_LIMIT[1])))
    return base, char, word, not base[-1] and not far


def check(spark, docs):
    refs = quality.language_references(docs)
    got = quality.score_quality(docs, references=refs).select("doc_id", "text", "lang", "quality.*").collect()
    for r in got:
        base, char, word, kept = plain_verdict(r.text, r.lang, refs)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base, r.doc_id
        for mine, theirs in ((r.char_distance, char), (r.word_distance, word)):
            assert (mine is None) == (theirs is None) and (mine is None or abs(mine - theirs) < 1e-9), r.doc_id
        assert r.kept == kept
    return refs, got


def test_against_plain_version(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    refs, got = check(spark, docs)
    assert 1 <= len(refs) <= 64
    assert 0.5 < sum(r.kept for r in got) / len(got) < 1


def test_whole_result_under_each_languages_own_limits(spark):
    """The query's own path: references and limits from all documents, against the plain version."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    refs = quality.language_references(docs)
    limits = plain_limits([(r.text, r.lang) for r in rows], refs)
    assert len(limits) >= 2
    want = {r.doc_id: plain_verdict(r.text, r.lang, refs, limits)[-1] for r in rows}
    got = {r.doc_id: r.quality.kept for r in quality.score_quality(docs).collect()}
    assert got == want and got != {r.doc_id: plain_verdict(r.text, r.lang, refs)[-1] for r in rows}


def test_languages_at_the_least_number_of_documents(spark):
    """With ``LIMIT_DOCS`` tested documents a language has its own limits, with one less the fixed ones."""
    rng, rows = random.Random(4), []
    for lang, n in (("at", quality.LIMIT_DOCS), ("below", quality.LIMIT_DOCS - 1)):
        for _ in range(n):
            rows.append((len(rows), " ".join(rng.choice([f"{lang}the", "of", "".join(rng.choices("abcdefgh", k=6))]) for _ in range(400)), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    measured = quality.score_quality(docs).select("lang", "quality")
    assert [r.lang for r in quality.distance_limits(measured).collect()] == ["at"]
    refs = quality.language_references(docs)
    limits = plain_limits([r[1:] for r in rows], refs)
    got = {r.doc_id: r.quality.kept for r in quality.score_quality(docs).collect()}
    assert got == {i: plain_verdict(t, lang, refs, limits)[-1] for i, t, lang in rows}


def test_references_are_exact_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    refs = quality.language_references(docs)
    for lang, ref in refs.items():
        words = Counter(w for r in docs.filter(F.col("lang") == lang).collect() for w in WORD.findall(r.text))
        total = sum(words.values())
        best = [w for w, n in sorted(words.items(), key=lambda x: (-x[1], x[0])) if n >= total * quality.COMMON_SHARE and re.search(r"[^\W\d_]", w)]
        assert ref.words == best[:quality.COMMON_WORDS]
        assert ref.counts == [*(words[w] for w in ref.words), total - sum(words[w] for w in ref.words)]


def test_edge_cases(spark):
    run = "a b c d e f g h "
    rows = [(1, None, "en", "x"), (2, "", None, "x"), (3, run * 40, "en", None), (4, "😀 " * 70, "xx", "x"), (5, "\x0b\x0c \n\n", "en", "x"),
            (5, "\x0b\x0c \n\n", "en", "x"), (None, "one\none\n two\ttwo", "de", "x"), (7, run + "x y " + run + "z q r s t u v w", "en", "x"),
            (8, " ".join(f"w{i}" for i in range(30_000)) + " " + " ".join(f"w{i}" for i in range(100)), "en", "x"),
            (9, "word### " * 3 + "$%&|<>*", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality string")
    _, got = check(spark, docs)
    assert len(got) == len(rows)
    assert not any(r.kept for r in got if not r.text)
    kept = quality.keep_good(docs.select("doc_id", "text", "lang", F.lit(1).alias("n_words"), F.lit("c").alias("kept")))
    assert kept.columns == ["doc_id", "text", "lang", "n_words", "kept"]
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.kept}


def test_recall_and_false_rejections_against_labels(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    docs = spark.read.parquet(f"{path}/documents.parquet").join(labels, "doc_id", "left")
    got = quality.score_quality(docs, columns=["doc_id", "label"]).filter("label IS NOT NULL AND NOT quality.base_failed AND quality.n_words >= 60")
    shares = {r.label: r.kept for r in got.groupBy("label").agg(F.avg(F.col("quality.kept").cast("int")).alias("kept")).collect()}
    assert shares[0] < 0.1
    assert shares[1] > 0.995


def test_rare_languages_are_tested_too(spark):
    rng, rows = random.Random(3), []
    for lang, n in (("en", 1_500), ("t1", 8), ("t2", 8)):
        for _ in range(n):
            text = " ".join(rng.choice([f"{lang}the", f"{lang}of", "".join(rng.choices("abcdefgh", k=6))]) for _ in range(400))
            rows.append((len(rows), text, lang))
    broken = [len(rows), len(rows) + 1]
    rows += [(i, " ".join("|%d|X" % rng.randrange(10**6) for _ in range(100)), lang) for i, lang in zip(broken, ("t1", "t2"))]
    got = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "quality.*").collect()
    assert all(r.char_distance is not None for r in got)
    assert [r.doc_id for r in got if not r.kept] == broken


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert quality.language_references(docs) == {}
    assert quality.score_quality(docs).count() == quality.keep_good(docs).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality.score_quality(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
