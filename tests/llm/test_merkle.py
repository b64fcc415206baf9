import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlance.llm import merkle

COLUMNS = ["doc_id", "source", "text"]
SCHEMA = "doc_id long, source string, text string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves, arity):
    """(root, steps by leaf)"""
    steps, spot, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(spot):
            first = k // arity * arity
            steps[i].append(("".join(level[first:k]), "".join(level[k + 1:first + arity])))
        level, spot = [h("".join(level[i:i + arity])) for i in range(0, len(level), arity)], [k // arity for k in spot]
    return level[0], steps


def plain(rows, seen, arity):
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
        built[name] = tree([x[2] for x in groups[name]], arity)
    root, upper = tree([built[name][0] for name in names], arity) if names else (None, [])
    out = []
    for s, name in enumerate(names):
        for (_, _, digest, row), steps in zip(groups[name], built[name][1]):
            now = leaf((row[0], row[1], seen(row)))
            for before, after in [*steps, *upper[s]]:
                now = h(before + now + after)
            out.append((row[0], digest, built[name][0], root, h("".join(b + a for b, a in [*steps, *upper[s]])), now, now == root))
    return sorted(out, key=repr)


def run(spark, rows, shape, seen=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in merkle.manifest(df, COLUMNS, seen=seen, shape=shape).collect()), key=repr)


@pytest.mark.parametrize("arity,height", [(2, 3), (3, 2), (16, 4)])
def test_against_plain_version(spark, arity, height):
    rows = [(i, f"s{i % 3}" if i % 2 else "hot", f"Text {i}") for i in range(150)]
    rows += [(None, "s1", "no id"), (7, None, None), (8, None, ""), (9, "", "x"), (10, "é", "ü" * 3), (11, "alone", "A" * 200_000), (-5, "s1", "a")]
    rows += [(3, "s0", "same")] * 5 + [(None, None, None)] * 3
    changed = F.when(F.col("doc_id") % 5 == 0, F.upper("text")).otherwise(F.col("text"))
    got = run(spark, rows, merkle.Shape(arity, height), {"text": changed})
    want = plain(rows, lambda r: r[2].upper() if r[0] is not None and r[2] is not None and r[0] % 5 == 0 else r[2], arity)
    assert got == want
    assert {r[-1] for r in got} == {True, False} and len({r[3] for r in got}) == 1


@pytest.mark.parametrize("n", [1, 2, 16, 17, 64, 65])
def test_sizes_at_the_edges(spark, n):
    """One leaf, full runs, full blocks, and one more."""
    rows = [(i, "s", str(i)) for i in range(n)]
    got = run(spark, rows, merkle.Shape(4, 3))
    assert got == plain(rows, lambda r: r[2], 4)
    assert all(r[-1] for r in got)


def test_many_groups_and_the_hot_one_in_many_partitions(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 89}", f"t{i}") for i in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    placed = merkle.ranked(df.withColumnRenamed("source", "g"), "g", ["doc_id"])
    at = defaultdict(list)
    for r in placed.collect():
        at[r.g].append((r.doc_id, r["at"]))
    assert all([a for _, a in sorted(x)] == list(range(len(x))) for x in at.values())
    assert run(spark, rows, merkle.Shape(4, 3)) == plain(rows, lambda r: r[2], 4)


def test_empty_table_and_clashing_names(spark):
    empty = merkle.manifest(spark.createDataFrame([], SCHEMA), COLUMNS)
    assert empty.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and empty.count() == 0
    df = spark.createDataFrame([(1, "s", "t", 5, "x", "y", 2)], SCHEMA + ", g int, at string, leaf string, b int")
    row = merkle.manifest(df, COLUMNS).first()
    assert row.leaf == row.root == row.folded_root == leaf((1, "s", "t")) and row.verified and row.proof_sha256 == h("")


@pytest.mark.parametrize("levels,arity", [(1, 16), (2, 16), (3, 16), (4, 16), (5, 3), (6, 2)])
def test_van_emde_boas_order(levels, arity):
    places = [merkle.address(levels, d, np.arange(arity**d), arity) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range((arity**levels - 1) // (arity - 1)))
    # The top half is first, each bottom tree is in one piece, and so are the children of a node of the lowest inner level.
    top = levels // 2
    if top:
        assert sorted(np.concatenate(places[:top]).tolist()) == list(range((arity**top - 1) // (arity - 1)))
        for t in range(arity**top):
            own = [p for d in range(top, levels) for p in places[d][t * arity ** (d - top):(t + 1) * arity ** (d - top)].tolist()]
            assert sorted(own) == list(range(min(own), min(own) + len(own)))
    if levels > 1:
        runs = places[-1].reshape(-1, arity)
        assert (np.diff(runs, axis=1) == 1).all()


def test_encoding_is_unambiguous(spark):
    df = spark.createDataFrame([("-", None), (None, "-"), ("1:a", ""), ("", "1:a"), ("é", "a")], "a string, b string")
    got = [r.x for r in df.select(merkle.encoded([F.col("a"), F.col("b")]).alias("x")).collect()]
    assert got == ["1:--", "-1:-", "3:1:a0:", "0:3:1:a", "2:é1:a"]
