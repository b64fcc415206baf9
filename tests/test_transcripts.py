import random
import re

import pytest
from pyspark.sql import functions as F

from parlance.operators import transcripts as t


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def words(text):
    return [w for w in text.split(" ") if w] if text.strip() else []


def plain_merge(texts, fraction):
    """The rule told step by step, for comparison."""
    def norm(w):
        return re.sub(r'[.,!?;:"()—-]+', "", w.lower())

    def kept(prev, cur):
        if not prev or not cur:
            return cur or prev
        p, c = words(prev), words(cur)
        for k in range(min(max(5, int(len([w for w in prev.split(" ") if w]) * fraction * 2)), len(p), len(c)), 0, -1):
            if all(distance(norm(a), norm(b)) <= 1 for a, b in zip(p[-k:], c[:k])):
                at = cur.lower().find(" ".join(c[:k]).lower())
                return cur if at < 0 else cur[at + len(" ".join(c[:k])):].strip()
        return cur

    if len(texts) == 1:
        return texts[0] or ""
    prev, out = "", []
    for i, text in enumerate(texts):
        prev = (text or "") if i == 0 else kept(prev, text or "")
        out.append(prev)
    return " ".join(out).rstrip()


def merged(spark, cases):
    data = [(str(i), j, text, float(f)) for i, (f, texts) in enumerate(cases) for j, text in enumerate(texts)]
    df = spark.createDataFrame(data, "clip_id string, chunk_idx int, text string, f double")
    out = {}
    for f in {c[0] for c in cases}:
        part = df.filter(F.col("f") == f).drop("f")
        out.update({r.clip_id: r.text for r in t.merge_transcripts(part, f).collect()})
    return [out[str(i)] for i in range(len(cases))]


GOLDEN = [
    (.04, ["Hello world"], "Hello world"),
    (.04, ["Hello world", "this is a test"], "Hello world this is a test"),
    (.1, ["Hello world this is", "this is a test"], "Hello world this is a test"),
    (.04, ["Hello", None, "world"], "Hello Hello world"),
    (.1, ["Hello world, how are", "how are you today"], "Hello world, how are you today"),
    (.1, ["Hello WORLD test", "test FOO bar"], "Hello WORLD test FOO bar"),
    (.0, ["Hello world", "world test"], "Hello world test"),
    (.1, ["apple banana", "elephant giraffe"], "apple banana elephant giraffe"),
    (.1, ["same words"] * 3, "same words  same words"),
    (.04, [f"chunk {i} transcript" for i in range(13)], "  ".join(f"chunk {i} transcript" for i in range(0, 13, 2))),
    (2.0, ["a  b c d", "c d e"], "a  b c d"),
    (2.0, ["x y", "  y  z w"], "x y   y  z w"),
    (.1, ["one two", "one\ttwo"], "one two one\ttwo"),
]


@pytest.mark.parametrize("per_block", [1_024, 2])
def test_golden_merges(spark, monkeypatch, per_block):
    monkeypatch.setattr(t, "CHUNKS_PER_BLOCK", per_block)
    got = merged(spark, [(f, texts) for f, texts, _ in GOLDEN])
    assert got == [want for _, _, want in GOLDEN]


@pytest.mark.parametrize("per_block", [1_024, 3])
def test_random_merges_match_the_step_by_step_rule(spark, monkeypatch, per_block):
    monkeypatch.setattr(t, "CHUNKS_PER_BLOCK", per_block)
    rng = random.Random(11)
    vocabulary = ["a", "on", "one", "two", "Two,", "three", "four", "i", "-", "x."]

    def text():
        if rng.random() < .12:
            return rng.choice([None, "", " ", "\t"])
        body = ""
        for _ in range(rng.randrange(1, 7)):
            body += rng.choice(vocabulary) + rng.choice([" "] * 8 + ["  ", " \t", "\n"])
        return (rng.choice(["", "", "", " ", "  "]) + body).rstrip(" ") if rng.random() < .8 else body

    cases = [(rng.choice([0.0, .1, 2.0]), [text() for _ in range(rng.randrange(1, 14))]) for _ in range(150)]
    got = merged(spark, cases)
    for (f, texts), result in zip(cases, got):
        assert result == plain_merge(texts, f), (f, texts)


@pytest.mark.parametrize("per_block", [1, 3])
def test_random_merges_in_small_blocks(spark, per_block):
    """Chunks that overlap, with runs of spaces, tabs, white space at either end and empty ones between them."""
    rng = random.Random(5)
    spaces = [" "] * 9 + ["  ", " \t", "\t "]

    def clip():
        words = [rng.choice(["a", "on", "one", "two", "Two,", "three", "four", "i"]) for _ in range(40)]
        out = []
        for at in range(0, 36, 4):
            body = "".join(w + rng.choice(spaces) for w in words[at:at + 6])
            out.append(rng.choice([None, "", " ", "\t"]) if rng.random() < .15 else rng.choice(["", "", "  ", "\t"]) + (body if rng.random() < .3 else body.strip()))
        return out

    clips = [clip() for _ in range(120)]
    df = spark.createDataFrame([(i, j, x) for i, c in enumerate(clips) for j, x in enumerate(c)], "clip_id int, chunk_idx int, text string")
    for fraction in (.1, 2.0):
        got = {r.clip_id: r.text for r in t.merge_transcripts(df, fraction, per_block).collect()}
        for i, c in enumerate(clips):
            assert got[i] == plain_merge(c, fraction), (fraction, c)


@pytest.mark.parametrize("per_block", [1, 1_024])
def test_repeated_chunks_follow_each_other(spark, per_block):
    """A chunk given twice is compared with itself, after the chunk before it."""
    texts = ["one two three four", "three four  five six", "five six seven"]
    twice = [(0, i, x) for i, x in enumerate(texts) for _ in range(2)]
    df = spark.createDataFrame(twice, "clip_id int, chunk_idx int, text string")
    got = t.merge_transcripts(df, 2.0, per_block).collect()
    assert [(r.chunks, r.text) for r in got] == [(6, plain_merge([x[2] for x in twice], 2.0))]


def test_merge_without_overlap_is_concatenation(spark):
    texts = ["alpha bravo", "charlie delta", "echoes foxtrot"]
    assert merged(spark, [(.1, texts)]) == [" ".join(texts)]


def test_long_true_overlap_beyond_the_search_is_missed(spark):
    shared = "seven eight nine eleven twelve thirteen fourteen"
    texts = ["alpha bravo " + shared, shared + " golf hotel"]
    assert merged(spark, [(.1, texts)]) == [" ".join(texts)]


def test_fuzzy_tokens(spark, rows):
    df = spark.createDataFrame([("Hello, world", "hello WORLDS!"), ("a b", "x y"), ("cat", "dogs"), ("a", "a b"), ("", " ")], "x string, y string")
    assert [r.matches for r in t.fuzzy_token_match(df, "x", "y").collect()] == [True, True, False, False, True]


def test_detect_overlap_across_blocks(spark, monkeypatch, rows):
    monkeypatch.setattr(t, "CHUNKS_PER_BLOCK", 1)
    df = spark.createDataFrame([("c", 0, "one two three"), ("c", 1, "two three four"), ("c", 2, None)], "clip_id string, chunk_idx int, text string")
    assert rows(t.detect_overlap(df, .1), "chunk_idx", "overlap_words", "overlap_text") == [(0, 0, None), (1, 2, "two three"), (2, 0, None)]


def test_concat_skips_empty(spark, rows):
    df = spark.createDataFrame([("c", 1, "b"), ("c", 0, "a"), ("c", 2, ""), ("c", 3, None), ("d", 0, None)], "clip_id string, chunk_idx int, text string")
    assert rows(t.concat_transcripts(df)) == [("c", "a b"), ("d", "")]


def test_agreement(spark):
    df = spark.createDataFrame(
        [(" Hello There ", "hello there"), ("a b c d e", "e d c b"), ("a b c d e", "a b c"), ("a a a a b", "a b"), ("", "")],
        "expected string, actual string")
    got = [(round(r.match_rate, 2), r.agrees) for r in t.transcript_agreement(df).collect()]
    assert got == [(1.0, True), (.8, True), (.6, False), (.4, False), (.0, True)]


@pytest.mark.parametrize("per_block", [1_024, 2])
def test_texts_are_read_and_compared_once(spark, per_block):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    chunks = spark.createDataFrame([("c", i, f"w{i} w{i + 1}  x w{i + 2}") for i in range(9)], "clip_id string, chunk_idx int, text string")
    got = t.merge_transcripts(chunks.withColumn("text", seen("text")), 2.0, per_block).collect()
    assert got[0].text == plain_merge([r.text for r in chunks.orderBy("chunk_idx").collect()], 2.0)
    assert read.value == 9


@pytest.mark.parametrize("per_block", [1_024, 2])
def test_ways_through_a_block_are_few(spark, per_block):
    """A block is followed for the numbers of words that the text before it can have lost, not for all of them."""
    words = [f"{i:03}" * 3 for i in range(400)]
    chunks = [(0, i, " ".join(words[i * 32:i * 32 + 40])) for i in range(12)]
    df = spark.createDataFrame(chunks, "clip_id int, chunk_idx int, text string")
    blocks = t._blocks(df, 2.0, per_block).select(t._ways(2.0).alias("way")).collect()
    assert max(len(r.way.entries) for r in blocks) <= 3 and max(len(r.way.tracks) for r in blocks) <= 2
    pieces = [p.piece for r in t.merge_pieces(df, 2.0, per_block).orderBy("__block").collect() for p in r.pieces]
    assert " ".join(pieces) == plain_merge([c[2] for c in chunks], 2.0)


def test_detokenize(spark, rows):
    vocab = spark.createDataFrame([(0, "<unk>"), (1, "▁he"), (2, "llo"), (3, "##s"), (4, ""), (5, "▁you")], "token_id int, piece string")
    ids = spark.createDataFrame([("c", i, v) for i, v in enumerate([0, 1, 2, 3, 4, 5, 99])] + [("d", 0, 77)], "clip_id string, seq long, token_id int")
    assert rows(t.detokenize(ids, vocab)) == [("c", "hellos you"), ("d", "")]
    chars = spark.createDataFrame([("c", 0, 72), ("c", 1, 105), ("c", 2, 0), ("c", 3, 256), ("c", 4, 33)], "clip_id string, seq long, token_id int")
    assert rows(t.detokenize(chars)) == [("c", "Hi!")]


@pytest.mark.parametrize("per_block", [2, t.TOKENS_PER_BLOCK])
def test_detokenize_keeps_the_vocabulary_out_of_every_task(spark, per_block):
    """A task's memory must not hold the whole vocabulary, however small Spark takes it to be."""
    vocab = spark.createDataFrame([(1, "▁he"), (2, "llo"), (3, "<unk>")], "token_id int, piece string")
    ids = spark.createDataFrame([("c", i, v) for i, v in enumerate([1, 2, 3, 9, 1])] + [("d", 0, 3)], "clip_id string, seq long, token_id int")
    out = t.detokenize(ids, vocab, per_block)
    assert sorted(map(tuple, out.collect())) == [("c", "hello he"), ("d", "")]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_progressive_text(spark, rows):
    df = spark.createDataFrame([(1, "I  heard you")], "id int, text string")
    assert rows(t.progressive_text(df)) == [(1, 1, "I "), (1, 2, "I  "), (1, 3, "I  heard "), (1, 4, "I  heard you ")]
