import hashlib
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from parlance.llm import lines, queries


def key(line):
    line = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return re.sub("[A-Z]", lambda m: m[0].lower(), line)


def plain(texts, min_docs, min_chars):
    docs = [(t or "").split("\n") for t in texts]
    n = Counter(k for d in docs for k in {key(x) for x in d})
    out = []
    for d in docs:
        kept = [x for x in d if len(key(x)) < min_chars or n[key(x)] < min_docs]
        out.append(("\n".join(kept), len(d), len(d) - len(kept)))
    return out


def run(spark, rows, min_docs, min_chars):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, n_lines string")
    got = sorted(lines.drop_common_lines(docs, min_docs=min_docs, min_chars=min_chars).collect(), key=lambda r: r.doc_id)
    return [(r.text, r.n_lines, r.n_dropped) for r in got]


@pytest.mark.parametrize("min_docs,min_chars", [(3, 1), (2, 0), (2, 3), (1, 1), (99, 1)])
def test_against_plain_version(spark, min_docs, min_chars):
    rows = [None, "", "\n", " A b\nc", "a B \x0b\nc\nC\nc", "a b\r\nünï", "ÜNÏ\nÜnï", " a b", "a b", "\n\n a b \n\n", "x" * 100_000 + "\na b", "éé", "éé\nc", "éé"]
    rows += rows[:5]
    assert run(spark, rows, min_docs, min_chars) == plain(rows, min_docs, min_chars)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id")
    texts = [r.text for r in docs.collect()]
    got = sorted(lines.drop_common_lines(docs, min_docs=3).collect(), key=lambda r: r.doc_id)
    want = plain(texts, 3, 1)
    assert [(r.text, r.n_lines, r.n_dropped) for r in got] == want
    assert sum(w[2] for w in want) > 0
    assert hashlib.sha256(got[0].text.encode()).digest() == hashlib.sha256(want[0][0].encode()).digest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lines.drop_common_lines(docs).columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert lines.drop_common_lines(docs).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        hi, lo = (rng.integers(0, 1 << 64, n, dtype=np.uint64) for _ in range(2))
        made = lines.PerfectHash.build(hi, lo)
        assert sorted(made.number(hi, lo).tolist()) == list(range(n))
    # Keys that differ in one half only.
    hi, lo = np.zeros(500, np.uint64), np.arange(500, dtype=np.uint64)
    assert sorted(lines.PerfectHash.build(hi, lo).number(hi, lo).tolist()) == list(range(500))
    with pytest.raises(ValueError):
        lines.PerfectHash.build(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_many_shards(spark):
    rows = [f"line {i}\nline {i + 1}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    folder, shards = lines.build_line_index(docs, min_docs=2, keys_per_shard=20)
    assert shards == 15
    hi, lo = lines._hashes([f"line {i}".encode() for i in range(302)])
    assert lines.counts_of(folder, shards, hi, lo).tolist() == [0, *[2] * 299, 0, 0]


def test_repeated_ids_as_the_sql_has_them(spark, tmp_path):
    """Rows of one id are documents of their own, in the operator and in its SQL."""
    rows = [(1, "a\nb")] * 12 + [(2, "a\nc"), (2, None), (None, "b\nd"), (None, "b\nd")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.op4_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = contract.oracle_sql()["op4_line_dedup"]
    assert got == sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({sql})").fetchall(), key=repr)
    assert len(got) == 16 and sum(r[2] for r in got) == 12 * 2 + 1 + 2
