"""Quality rules by distribution divergence, on built-in functions only.

A document fails when it breaks a base rule, or when its text is distributed unlike its language: the Jensen-Shannon
distance between its histogram and that of the language is above a limit, for character classes or for common words.
Short documents scatter widely, so both tests need ``MIN_WORDS`` words, and the limits widen with 1 / sqrt(words). A
limit is taken from the spread of the distances of all tested documents of the language (see ``distance_limits``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.base import NO_SPACE, SPACE, let, written

# Character classes, in this order; what none of them matches (letters and signs outside ASCII) is the last class.
CLASSES = ["[a-z]+", f"{SPACE}+", "[A-Z]+", "[0-9]+", r"""[.,;:!?'"()-]+""", r"[\x21-\x7E]+"]
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8                  # words of a window that may repeat
MIN_BASE_WORDS = 20         # fewer words fail
MAX_REPEATED_PERCENT = 30   # more words than this in repeated windows fail
MIN_WORDS = 60              # guard of both divergence tests
CHAR_LIMIT = (0.25, 0.7)    # limit = first + second / sqrt(words); the first where a language has none of its own
WORD_LIMIT = (0.23, 0.8)
LIMIT_DOCS = 20             # tested documents a language needs for limits of its own
SPREADS = 3                 # a limit lies so many interquartile ranges above the median
LEAST_MARGIN = 0.05         # and at least this much, for languages of uniform documents
LIMIT_STEPS = 4_096         # distances are counted in steps of 1 / this
COMMON_WORDS = 32           # words of a language's histogram, at most
COMMON_SHARE = 0.005        # a common word makes up this share of its language's words, at least
LANGUAGE_WORDS = 2_000      # a language with fewer words of its own gets no reference, whatever the other languages have
BUCKETS = 65_536


@dataclass(frozen=True)
class Reference:
    """What a language looks like: characters per class, its common words, and their counts (other words last)."""

    classes: list[int]
    words: list[str]
    counts: list[int]


def words_of(text: Column) -> Column:
    """Words of a text; NULL counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def class_counts(text: Column) -> Column:
    """Code points per character class. Each class is cut out of what the classes before it have left."""
    def strip(rest: Column, classes: list[str], lengths: list[Column]) -> Column:
        if not classes:
            return F.array(*[a - b for a, b in zip(lengths, lengths[1:])], lengths[-1])
        return let(F.regexp_replace(rest, classes[0], ""), lambda left: strip(left, classes[1:], [*lengths, F.length(left)]))

    return let(F.coalesce(text, F.lit("")), lambda t: strip(t, CLASSES, [F.length(t)]))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of two histograms; NULL if one is empty."""
    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x)

    def term(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(F.lit(2.0) * x / (x + y))).otherwise(0.0)

    def distance(p: Column, q: Column, sp: Column, sq: Column) -> Column:
        terms = F.zip_with(p, q, lambda x, y: (term(x / sp, y / sq) + term(y / sq, x / sp)) / 2)
        return F.when((sp > 0) & (sq > 0), F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total(terms)))))

    return let(p, lambda a: let(q, lambda b: let(total(a), lambda sa: let(total(b), lambda sb: distance(a, b, sa, sb)))))


def repeated_words(words: Column, n: Column, width: int = WINDOW) -> Column:
    """Words inside windows of ``width`` (an even number of) words that occur twice or more in the text, the first occurrence included.

    Window hashes come from hashes of words and of neighbours. Only texts whose window hashes are not all different go on
    to sort them; covered words are then counted from the starts in ascending order.
    """
    def windows(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.xxhash64(x, F.get(h, i + 1)))
        return let(pairs, lambda p: F.slice(F.transform(p, lambda x, i: F.xxhash64(
            x, *[F.get(p, i + k) for k in range(2, width, 2)])), F.lit(1), F.greatest(F.lit(0), n - (width - 1))))

    hashes = let(F.transform(words, lambda w: F.xxhash64(w)), windows)

    def starts(ordered: Column) -> Column:
        same = F.transform(ordered, lambda x, i: F.when(
            (F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["at"]))
        return F.array_sort(F.filter(same, lambda x: x.isNotNull()))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("total"))
        return F.aggregate(at, zero, lambda a, x: F.struct(
            x.alias("last"), (a["total"] + F.least(F.lit(width), x - a["last"])).alias("total")), lambda a: a["total"])

    def count(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(ordered, lambda o: covered(starts(o))))

    return F.when(n < width, 0).otherwise(let(hashes, count)).cast("long")


def word_histogram(words: Column, common: Column) -> Column:
    """Counts of the common words and, last, of all others; words are compared as they are written."""
    known = F.filter(words, lambda w: F.array_contains(common, w))
    return let(known, lambda k: F.concat(
        F.transform(common, lambda c: F.size(F.filter(k, lambda w: w == c))), F.array(F.size(words) - F.size(k))))


def reference_table(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """References from all documents: ``lang, classes, words, counts``, sums per language, no sampling.

    Common words are found exactly without counting every word: words are first counted by hash bucket (65,536 a
    language, added up before the shuffle); only words of buckets that reach ``COMMON_SHARE`` are then counted one by
    one. At most 1 / share words of a language can reach it, so a row is bounded; the number of languages is not, and
    nothing comes to the driver. Documents without a language take no part.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL")
    words = rows.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    words = words.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    buckets = written(words.groupBy("lang", "bucket").agg(F.count("*").alias("n")), "buckets")
    totals = buckets.groupBy("lang").agg(F.sum("n").alias("total")).filter(F.col("total") >= LANGUAGE_WORDS)
    # Tables that Spark wrote, so Spark itself checks whether they are small enough to broadcast.
    heavy = written(buckets.join(totals, "lang").filter(F.col("n") >= F.col("total") * COMMON_SHARE).select("lang", "bucket", "total"), "heavy")
    counts = words.join(heavy, ["lang", "bucket"]).groupBy("lang", "word").agg(F.count("*").alias("n"), F.first("total").alias("total"))
    common = counts.filter((F.col("n") >= F.col("total") * COMMON_SHARE) & F.col("word").rlike(r"\p{L}"))
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("less"), "word"))), 1, COMMON_WORDS)
    common = common.groupBy("lang").agg(best.alias("best"))
    sums = rows.select("lang", class_counts(F.col("text")).alias("c"))
    classes = sums.groupBy("lang").agg(F.array(*[F.sum(F.col("c")[i]) for i in range(len(CLASSES) + 1)]).alias("classes"))
    found = totals.join(classes, "lang").join(common, "lang", "left")
    words_found = F.coalesce(F.transform("best", lambda w: w["word"]), F.array().cast("array<string>"))
    counts_found = F.coalesce(F.transform("best", lambda w: -w["less"]), F.array().cast("array<long>"))
    others = F.col("total") - F.aggregate(counts_found, F.lit(0).cast("long"), lambda a, x: a + x)
    return written(found.select("lang", "classes", words_found.alias("words"), F.concat(counts_found, F.array(others)).alias("counts")), "references")


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, Reference]:
    """``reference_table`` by language, for a corpus of few languages."""
    return {r["lang"]: Reference(list(r["classes"]), list(r["words"]), list(r["counts"])) for r in reference_table(docs, text, lang).collect()}


def distance_limits(measured: DataFrame) -> DataFrame:
    """``lang, char_limit, word_limit`` of each language with ``LIMIT_DOCS`` tested documents or more, from ``lang`` and
    ``quality`` (see ``quality_metrics``): median plus ``SPREADS`` interquartile ranges (``LEAST_MARGIN`` at least) of the distances, less their part
    that depends on the words, over all documents that the base rules pass. Junk moves quartiles little until it is a
    quarter of the language.

    Distances are counted by steps, added up before the shuffle, so the quartiles take every row and a language has at
    most 2 x ``LIMIT_STEPS`` counts for each distance.
    """
    tested = measured.filter("lang IS NOT NULL AND NOT quality.base_failed")
    kinds = [F.struct(F.lit(kind).alias("kind"), F.floor((F.col(f"quality.{kind}_distance") - second / F.sqrt("quality.n_words")) * LIMIT_STEPS).alias("step"))
             for kind, (_, second) in (("char", CHAR_LIMIT), ("word", WORD_LIMIT))]
    steps = tested.select("lang", F.explode(F.array(*kinds)).alias("at")).select("lang", "at.*").filter("step IS NOT NULL")
    counts = steps.groupBy("lang", "kind", "step").agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang", "kind")
    counts = counts.withColumns({"upto": F.sum("n").over(own.orderBy("step")), "total": F.sum("n").over(own)}).filter(F.col("total") >= LIMIT_DOCS)
    quartiles = [F.min(F.when(F.col("upto") >= F.col("total") * q / 4, (F.col("step") + 0.5) / LIMIT_STEPS)).alias(f"q{q}") for q in (1, 2, 3)]
    limits = counts.groupBy("lang", "kind").agg(*quartiles).withColumn("limit", F.col("q2") + F.greatest(F.lit(LEAST_MARGIN), SPREADS * (F.col("q3") - F.col("q1"))))
    return limits.groupBy("lang").agg(*[F.max(F.when(F.col("kind") == kind, F.col("limit"))).alias(f"{kind}_limit") for kind in ("char", "word")])


def quality_metrics(text: Column, reference: Column) -> Column:
    """One struct per document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance,
    word_distance, kept. ``reference`` is a row of ``reference_table`` as a struct. Distances are NULL below the guard or
    without a reference, and then don't decide."""
    ref_classes, ref_counts = reference["classes"].cast("array<double>"), reference["counts"].cast("array<double>")
    ref_words = reference["words"]

    def measured(t: Column, words: Column, n: Column) -> Column:
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(NO_SPACE))
        base = F.struct(
            n.cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(words, n).alias("n_repeat_words"),
            F.when(n >= MIN_WORDS, js_distance(class_counts(t).cast("array<double>"), ref_classes)).alias("char_distance"),
            # The reference is bound once a row; inside the lambdas it would be picked anew for every word.
            let(ref_words, lambda common: F.when((n >= MIN_WORDS) & (F.size(common) > 0), js_distance(
                word_histogram(words, common).cast("array<double>"), ref_counts))).alias("word_distance"))
        return let(base, verdict)

    def verdict(m: Column) -> Column:
        failed = (m["n_words"] < MIN_BASE_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEATED_PERCENT * m["n_words"])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance"]
        with_base = F.struct(*[m[x].alias(x) for x in names], failed.alias("base_failed"))
        return let(with_base, lambda x: x.withField("kept", kept(x, F.lit(CHAR_LIMIT[0]), F.lit(WORD_LIMIT[0]))))

    return let(F.coalesce(text, F.lit("")), lambda t: let(
        words_of(t), lambda words: let(F.size(words), lambda n: measured(t, words, n))))


def kept(m: Column, char_limit: Column, word_limit: Column) -> Column:
    """The verdict on measures, under the parts of the limits that don't depend on the words."""
    def beyond(distance: Column, first: Column, second: float) -> Column:
        return F.coalesce(distance > first + second / F.sqrt(m["n_words"]), F.lit(False))

    return ~m["base_failed"] & ~beyond(m["char_distance"], char_limit, CHAR_LIMIT[1]) & ~beyond(m["word_distance"], word_limit, WORD_LIMIT[1])


def _measured(docs: DataFrame, text: str, lang: str, references: DataFrame, columns: list[str]) -> DataFrame:
    """``row`` (the ``columns`` of ``docs``), ``lang`` and the struct ``quality`` under the fixed limits."""
    rows = docs.select(F.struct(F.lit(0).alias("0"), *[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(text).alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    refs = references.select(F.col("lang").alias("of"), F.struct("classes", "words", "counts").alias("reference"))
    joined = rows.join(refs, F.col("lang") == F.col("of"), "left")
    return joined.select("row", "lang", quality_metrics(F.col("text"), F.col("reference")).alias("quality"))


def _judged(docs: DataFrame, text: str, lang: str, columns: list[str]) -> DataFrame:
    """``_measured`` with the verdict under each language's own limits. Measures are written, so they are taken once."""
    measured = written(_measured(docs, text, lang, reference_table(docs, text, lang), columns), "measured")
    limits = written(distance_limits(measured), "limits").withColumnRenamed("lang", "of")
    verdict = kept(F.col("quality"), F.coalesce("char_limit", F.lit(CHAR_LIMIT[0])), F.coalesce("word_limit", F.lit(WORD_LIMIT[0])))
    joined = measured.join(limits, F.col("lang") == F.col("of"), "left")
    return joined.select("row", F.col("quality").withField("kept", verdict).alias("quality"))


def score_quality(docs: DataFrame, text: str = "text", lang: str = "lang", references: dict[str, Reference] | None = None,
                  name: str = "quality", columns: list[str] | None = None) -> DataFrame:
    """Add a struct ``name`` with the measures and the verdict; see ``quality_metrics``.

    Without ``references`` they and each language's limits come from ``docs``; with given ones the fixed limits hold.
    Map-side apart from tables with a row per language, which Spark broadcasts if it finds them small. A NULL or
    empty text has no words and fails; a NULL language or one of less than ``LANGUAGE_WORDS`` words has no reference, so
    only the base rules decide; repeated rows are each judged alike; an empty table gives an empty result; a column
    called ``name`` is replaced; of the others ``columns`` pass through, or all.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c != name]
    if references is None:
        judged = _judged(docs, text, lang, columns)
    else:
        judged = _measured(docs, text, lang, _as_table(docs, references), columns)
    return judged.select(*[F.col(f"row.`{c}`") for c in columns], F.col("quality").alias(name))


def _as_table(docs: DataFrame, references: dict[str, Reference]) -> DataFrame:
    rows = [(k, r.classes, r.words, r.counts) for k, r in references.items()]
    return docs.sparkSession.createDataFrame(rows, "lang string, classes array<long>, words array<string>, counts array<long>")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose verdict is kept, with their columns as they are."""
    return _judged(docs, text, lang, docs.columns).filter("quality.kept").select(*[F.col(f"row.`{c}`") for c in docs.columns])
