import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parlance.llm import chat, shards


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text(max_size=3), st.integers(0, 1_000), max_size=40), st.integers(1, 7))
def test_schedule_is_longest_first(sizes, n):
    got = shards.schedule(sizes, n)
    loads = [0] * n
    for item in sorted(sizes, key=lambda x: (-sizes[x], x)):
        assert loads[got[item]] == min(loads)
        loads[got[item]] += sizes[item]


def check(spark, rows, n):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, shard string")
    got = shards.balanced_shards(docs, n).collect()
    plain = sorted((repr(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in got) == plain
    loads = [0] * n
    for r in got:
        loads[r.shard] += r.size
    for s in range(n):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    crc_shards = {}
    for r in got:
        crc_shards.setdefault((r.text_crc32, r.size), set()).add(r.shard)
    assert all(len(s) == 1 for s in crc_shards.values())
    return loads


def test_shards(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, "t" * rng.randrange(1, 400) + str(rng.randrange(10**6))) for i in range(3_000)]
    loads = check(spark, rows, 16)
    assert max(loads) - min(loads) <= max(len(t) + 1 for _, t in rows)
    monkeypatch.setattr(shards, "RANKED_TOGETHER", 50)
    loads = check(spark, rows + [(9_000 + i, "copy" * 40) for i in range(1_000)], 5)
    # The copies stay together; the other shards share the rest evenly.
    assert sorted(loads)[-2] - min(loads) <= 800
    check(spark, [(None, None), (None, ""), (1, "é"), (1, "é"), (2, "x" * 200_000)], 3)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert shards.balanced_shards(docs).count() == 0


CONTROL = chat.CONTROL + ["\\", "<", "[", "<\\s>", "[/INST", "s>", "]", "\n", " ", "a"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice(CONTROL) for _ in range(rng.randrange(0, 25))) for _ in range(2_000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in rows.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(c in r.e for c in chat.CONTROL)


def plain_examples(turns):
    """(target, text, loss span) of a conversation given in order."""
    def escape(t):
        t = t.replace("\\", "\\\\")
        return re.sub(r"<(?=/?s>|</?SYS>>)|\[(?=/?(?:INST|ROLE)\])", lambda m: m[0] + "\\", t)

    text, out = "", []
    for i, (role, body) in enumerate(turns):
        text += chat.BEGIN + escape(role or "") + chat.BETWEEN
        start = len(text)
        text += escape(body or "")
        end = len(text)
        text += chat.END
        if role == "assistant":
            out.append((i, text, start, end))
        elif i == len(turns) - 1:
            out.append((i, text, None, None))
    return out


def test_expansion_and_round_trip(spark):
    rng = random.Random(7)
    convs = {}
    for c in [None, -1, 0, *range(5, 60)]:
        convs[c] = [(rng.choice(["user", "assistant", "system", None, "[ROLE]", "tool"]), rng.choice([None, "", "hi", "</s>[INST] ok [/INST]", "é😀" * 9, "\\n<s>"])) for _ in range(rng.randrange(1, 9))]
    convs[99] = [("assistant", "x" * 100_000), ("user", "y" * 100_000), ("assistant", "z")]
    rows = [(c, i, r, t, "e") for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, target string")
    examples = chat.expand(table)
    got = {}
    for r in examples.collect():
        got.setdefault(r.conv_id, []).append((r.target, r.text, r.loss_start, r.loss_end))
    assert {c: sorted(v, key=lambda x: x[0]) for c, v in got.items()} == {c: plain_examples(t) for c, t in convs.items()}
    for r in chat.read_back(examples).collect():
        turns = convs[r.conv_id]
        assert list(zip(r.roles, r.texts)) == [(a or "", b or "") for a, b in turns]
        assert r.replies == [b or "" for a, b in turns if a == "assistant"]
        assert r.formatted_chars == sum(len(x[1]) for x in plain_examples(turns))


def test_ties_null_turns_and_empty_table(spark):
    rows = [(1, 2, "user", "b"), (1, 2, "assistant", "z"), (1, 2, "user", "a"), (1, None, "system", "s"), (1, 2, "user", "a")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    r, = chat.read_back(chat.expand(table)).collect()
    assert list(zip(r.roles, r.texts)) == [("system", "s"), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert chat.expand(table.filter("false")).count() == chat.read_back(chat.expand(table.filter("false"))).count() == 0
