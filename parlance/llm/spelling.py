"""Words that differ by one letter, found in a trie by joins, and the commonest form of each.

The trie is a table of edges, one for each branch: ``node, first, label, child`` (or ``ends``, the word that ends there); chains
without a branch are one edge with a longer label, so a node is a prefix that at least two words go on from differently. A
state is ``word, pos, node, edits``: the trie's path to ``node`` agrees with the first ``pos`` letters of the word but for
``edits`` edits. States without an edit are the word's own path. An edit is made where the paths of two words part: there the
next letter of the word is replaced by another branch's, or dropped (an insertion is the other word's drop). From then on
states have spent their edit: level by level the frontier is joined with the level's edges on the node and the word's next
letter, and states whose label doesn't agree are gone. Those that reach the end of a word as theirs ends are neighbours.

Near the root every word would branch to every letter. So there are two tries, of the words and of the words reversed, and
edits are made only in the second half of a word: if two words of at most ``m`` letters differ by one edit, their common
prefix or their common suffix has (m - 1) / 2 letters or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.llm.base import column, new_shared_path, written
from parlance.llm.hot import join_keyed

LETTERS = r"[A-Za-zÀ-ÿ]+"
OWN = ["word", "n", "way"]  # of a state: its word as read in one of the tries (way 1: backwards), and the count of the word


def _steps(vocabulary: DataFrame) -> DataFrame:
    """``word, n, way, pos, node, next``: each prefix of a word as a node, and the letter after it (empty at the end).

    Nodes are 63-bit hashes and the trie they are in; should two prefixes meet, paths are added but none is lost, and ``near_pairs``
    checks its pairs.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = column(batch, "word").to_pylist(), column(batch, "n").to_pylist()
            for start in range(0, len(words), 256):
                rows: list[tuple] = []
                for word, n in zip(words[start:start + 256], counts[start:start + 256]):
                    for way, text in enumerate((word, word[::-1])):
                        state = xxhash.xxh3_64(b"a prefix of a word of the vocabulary")
                        for pos, letter in enumerate(text):
                            rows.append((text, n, way, pos, (state.intdigest() >> 1) - (1 << 62) << 1 | way, letter))
                            state.update(letter.encode())
                        rows.append((text, n, way, len(text), (state.intdigest() >> 1) - (1 << 62) << 1 | way, ""))
                if rows:
                    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[*OWN, "pos", "node", "next"])

    return vocabulary.select("word", F.col("n").cast("long")).mapInArrow(emit, "word string, n long, way int, pos int, node long, next string")


def _trie(vocabulary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``paths`` (``word, n, way, stops``: the branching nodes on a word's own path) and ``nodes`` (``node, weight``: words through it)."""
    steps = written(_steps(vocabulary), "trie-steps")
    nodes = steps.groupBy("node").agg(F.count("*").alias("weight"), F.min("next").alias("low"), F.max("next").alias("high"))
    nodes = written(nodes.filter("low <> high").select("node", "weight"), "trie-nodes")
    on = join_keyed(steps.select(*OWN, "pos", "node"), nodes, "node", "weight", ["word"])
    paths = on.groupBy(*OWN).agg(F.sort_array(F.collect_list(F.struct("pos", "node"))).alias("stops"))
    return written(paths, "trie-paths"), nodes


def _edges(paths: DataFrame) -> DataFrame:
    """``level, node, first, label, child, ends, n``: from each branching node along each of its letters."""
    size = F.length("word")

    def edge(s: Column, i: Column) -> Column:
        after = F.get("stops", i + 1)
        to = F.coalesce(after["pos"], size)
        label = F.substring(F.col("word"), s["pos"] + 1, to - s["pos"])
        last = after.isNull()
        return F.struct((i + 0).alias("level"), s["node"].alias("node"), F.substring(label, 1, 1).alias("first"), label.alias("label"),
                        after["node"].alias("child"), F.when(last, F.col("word")).alias("ends"), F.when(last, F.col("n")).alias("n"))

    return paths.select(F.explode(F.transform("stops", edge)).alias("e")).select("e.*").distinct()


def _seeds(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """States that make their edit at a branching node: ``word, n, way, pos, level, child, ends, near_n``."""
    branches = edges.groupBy("node").agg(F.collect_list(F.struct("first", "label", "child", "ends", "n")).alias("out"))
    keyed = written(nodes.join(branches, "node"), "trie-branches")
    own = paths.select(*OWN, F.posexplode("stops").alias("level", "stop")).select(*OWN, "level", "stop.*")
    # Only where the rest of the word isn't longer than what stands before: see the module text.
    own = own.filter((2 * F.col("pos") >= F.length("word") - 1) & (F.col("pos") < F.length("word")))
    size, at = F.length("word"), F.col("pos")
    letter = F.substring(F.col("word"), at + 1, F.lit(1))

    def moved(skip: Column, used: Column):
        return lambda e: F.struct((at + skip + F.length(e["label"]) - used).alias("to"), e["child"].alias("child"), e["ends"].alias("ends"), e["n"].alias("near_n"))

    def done(e: Column, to: Column) -> Column:
        return e["ends"].isNull() | (to == size)

    def replaced(e: Column) -> Column:
        n = F.length(e["label"])
        return (e["first"] > letter) & (F.substring(e["label"], F.lit(2), n) == F.substring(F.col("word"), at + 2, n - 1)) & done(e, at + n)

    def dropped(e: Column) -> Column:
        n = F.length(e["label"])
        return (e["first"] != letter) & (e["label"] == F.substring(F.col("word"), at + 2, n)) & done(e, at + n + 1)

    both = F.concat(F.transform(F.filter("out", replaced), moved(F.lit(0), F.lit(0))), F.transform(F.filter("out", dropped), moved(F.lit(1), F.lit(0))))
    met = join_keyed(own, keyed, "node", "weight", ["word", "pos"])
    met = met.select(*OWN, (F.col("level") + 1).alias("level"), F.explode(both).alias("x"))
    return met.select(*OWN, F.col("x.to").alias("pos"), "level", "x.child", "x.ends", "x.near_n")


def _partitioned(df: DataFrame, label: str) -> DataFrame:
    """``written``, by level: each level of the frontier reads its own rows only."""
    path = new_shared_path(df.sparkSession, label)
    df.write.partitionBy("level").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """``vocabulary`` (``word`` distinct, ``n``; NULL words are passed over) -> ``word, n, near, near_n``, both ways, for all words that
    differ by exactly one inserted, deleted or replaced code point.

    Words may have any length: the number of levels is that of the branches on a path, whatever the letters between them.
    """
    paths, nodes = _trie(vocabulary.filter("word IS NOT NULL"))
    edges = _partitioned(_edges(paths), "trie-edges")
    seeds = _partitioned(_seeds(paths, nodes, edges), "trie-seeds")
    first, last = seeds.agg(F.min("level")).first()[0], edges.agg(F.max("level")).first()[0]
    found = seeds.filter("ends IS NOT NULL").select(*OWN, "ends", "near_n")
    begun = seeds.filter("ends IS NULL").select(*OWN, "pos", F.col("child").alias("node"), "level")
    carried = None
    for level in range(first, last + 1) if first is not None else ():
        frontier = begun.filter(F.col("level") == level).drop("level")
        frontier = frontier if carried is None else frontier.union(carried)
        out = edges.filter(F.col("level") == level).select("node", "first", "label", "child", "ends", F.col("n").alias("near_n"))
        met = frontier.withColumn("first", F.substring(F.col("word"), F.col("pos") + 1, F.lit(1))).join(out, ["node", "first"])
        to = F.col("pos") + F.length("label")
        agrees = F.substring(F.col("word"), F.col("pos") + 1, F.length("label")) == F.col("label")
        met = met.filter(agrees & (F.col("ends").isNull() | (to == F.length("word"))))
        met = written(met.select(*OWN, to.alias("pos"), "child", "ends", "near_n"), "frontier")
        found = found.union(met.filter("ends IS NOT NULL").select(*OWN, "ends", "near_n"))
        carried = met.filter("ends IS NULL").select(*OWN, "pos", F.col("child").alias("node"))
    turned = {c: F.when(F.col("way") == 1, F.reverse(c)).otherwise(F.col(c)) for c in ("word", "ends")}
    pairs = found.withColumns(turned).filter(F.levenshtein("word", "ends", 1) == 1)
    sides = F.array(F.struct("word", "n", F.col("ends").alias("near"), "near_n"), F.struct(F.col("ends").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.explode(sides).alias("x")).select("x.*").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, form`` -> ``word, root``: forms followed to the last. Counts at least double with each step, so a chain has less than
    64 and pointers that double their reach are done after 6 rounds."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        now = written(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not now.filter("moved").limit(1).count():
            return now.select("word", "root")
        at = now.select("word", "root")


def variant_groups(vocabulary: DataFrame, factor: int = 2) -> DataFrame:
    """``word, n, form, root, n_near, form_n`` for each word of ``vocabulary`` (``word`` distinct, ``n``).

    ``form``: of the words one edit away that with the largest n (ties: the smallest in code-point order), if it has ``factor`` times the
    word's n or more; else NULL, as ``form_n``. ``root``: the last word that forms lead to, from the word itself on. ``n_near``: how
    many words are one edit away. NULL words are left out; other columns are ignored; an empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("forms must be at least twice as frequent, or they may lead in a circle")
    words = vocabulary.filter("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("k"), "near")).alias("b"))
    best = best.select("word", "n_near", F.col("b.near").alias("form"), (-F.col("b.k")).alias("form_n"))
    known = words.join(best, "word", "left").withColumn("n_near", F.coalesce("n_near", F.lit(0)))
    large = F.col("form_n") >= factor * F.col("n")
    known = written(known.withColumns({c: F.when(large, F.col(c)) for c in ("form", "form_n")}), "forms")
    roots = _roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def vocabulary(words: DataFrame, min_chars: int = 5, min_count: int = 3) -> DataFrame:
    """``word`` per row -> ``word, n`` of the words with ``min_chars`` code points and ``min_count`` rows or more, written."""
    long = words.filter(F.length("word") >= min_chars)
    return written(long.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count), "vocabulary")


def runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, word``: each maximal run of letters of each text, A-Z in lower case. A NULL or empty text has none."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select(key, F.explode(F.regexp_extract_all(low, F.lit(LETTERS), F.lit(0))).alias("word"))
