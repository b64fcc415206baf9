import random
import re

import numpy as np
import pytest

from parlance.llm import jaccard
from parlance.llm.components import connected_components


def shingles(text, width=5):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def plain(rows, percent=75, width=5):
    sets = [(i, shingles(t, width)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        if rows[k][0] is not None:
            least[find(k)] = min(rows[k][0], least.get(find(k), rows[k][0]))
    return sorted(((rows[k][0], len(sets[k][1]), least.get(find(k))) for k in range(len(rows))), key=repr)


def run(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, b"x") for i, t in rows], "doc_id long, text string, cls binary")
    got = jaccard.jaccard_classes(docs, plan=jaccard.Plan(**options)).collect()
    return sorted(((r.id, r.n_shingles, r.component) for r in got), key=repr)


def test_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (7, base), (8, base + " tail"), (8, base + " tail"),
            (None, base), (9, "x y z"), (10, " ".join(["same"] * 500)), (11, "same same same same same"), (12, " ".join(f"v{i}" for i in range(30_000))),
            (13, " ".join(f"v{i}" for i in range(29_000))), (None, "alone at last here we are"), (14, "É é"), (15, "é é")]
    assert run(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_hot_groups_of_near_copies(spark, seed, monkeypatch):
    """Many edits of few originals, with shared passages; small limits so that groups go through several levels."""
    monkeypatch.setattr(jaccard, "REPEATS", 0 if seed == 1 else 4)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 16)
    monkeypatch.setattr(jaccard, "SAMPLE_DOCS", 40)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3_000)}"
    passage = [word() for _ in range(30)]
    originals = [[word() for _ in range(rng.choice([12, 40, 90]))] for _ in range(5)]
    texts = []
    for i in range(240):
        words = list(originals[min(4, int(rng.expovariate(1.2)))]) if i % 4 else [word() for _ in range(rng.randrange(1, 60))]
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
            at = rng.randrange(len(words))
            if rng.random() < 0.6:
                words[at] = word()
            elif rng.random() < 0.5:
                words.insert(at, rng.choice(["edit", word()]))
            elif len(words) > 1:
                del words[at]
        if rng.random() < 0.3:
            words += passage
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    assert run(spark, rows) == plain(rows)


def test_other_thresholds(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 8)):
            words[rng.randrange(60)] = f"e{rng.randrange(20)}"
        rows.append((i, " ".join(words)))
    assert run(spark, rows, percent=50, width=3) == plain(rows, 50, 3)
    assert run(spark, rows, percent=90, width=2, fragments=4, probe=1) == plain(rows, 90, 2)


def test_empty_table_and_kept_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, label string")
    assert jaccard.jaccard_classes(docs).count() == 0
    assert jaccard.keep_one_of_each(docs).columns == ["doc_id", "text", "label"]
    base = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(3, base, "c"), (1, base, "a"), (2, base + " x", "b"), (4, None, "d"), (5, "", "e")], "doc_id long, text string, label string")
    assert sorted(r.label for r in jaccard.keep_one_of_each(docs).collect()) == ["a", "d", "e"]


def test_repeated_and_null_ids(spark):
    """Rows are told apart by id and text: an unrelated text under a copy's id stays, of equal rows one."""
    base, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    schema = "doc_id long, text string, label string"
    rows = [(3, base, "a"), (3, base, "b"), (8, base + " x", "c"), (8, other, "d"), (None, base, "e"), (None, base + " x", "f")]
    kept = sorted((tuple(r) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, schema)).collect()), key=repr)
    assert [r[:2] for r in kept] == [(3, base), (8, other)] and kept[0][2] in ("a", "b")
    rows = [(None, base, "e"), (None, base + " x", "f"), (None, None, "g"), (None, None, "h"), (None, base, "e"), (5, other, "i"), (5, other + " y", "j")]
    kept = [tuple(r) for r in jaccard.keep_one_of_each(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(r[2] for r in kept if r[1] is None) == ["g", "h"] and len(kept) == 4
    assert sum(r[0] is None and r[1] is not None for r in kept) == 1 and sum(r[0] == 5 for r in kept) == 1


def test_large_group_without_a_centre(spark, monkeypatch):
    """Near copies of a text that isn't there itself, many just above or below the threshold: rows stay in proportion."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1_200):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 4, 5])):
            words[at] = f"e{rng.randrange(400)}"
        rows.append((i, " ".join(words)))
    made = []
    blocks = jaccard._compare_blocks

    def counted(units, *rest):
        made.append((units.count(), units.selectExpr("sum(blocks)").first()[0], units.selectExpr("max(blocks)").first()[0]))
        return blocks(units, *rest)

    monkeypatch.setattr(jaccard, "_compare_blocks", counted)
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 256)
    assert run(spark, rows) == plain(rows)
    (members, repeated, most), = made
    assert members <= 1_200 and most >= 2 and repeated <= 6 * len(rows)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps(seed):
    rng = np.random.default_rng(seed)
    owners = rng.integers(0, 60, 4_000)
    grams = (rng.exponential(40, 4_000)).astype(np.int64)
    both = np.unique(np.stack([owners, grams], 1), axis=0)
    shared = np.zeros((60, 60), np.float32)
    jaccard._add_overlaps(shared, both[:, 0], both[:, 1], rare=8)
    sets = [set(both[both[:, 0] == i, 1].tolist()) for i in range(60)]
    assert all(shared[i, j] == len(sets[i] & sets[j]) for i in range(60) for j in range(60) if i != j)
    empty = np.zeros((3, 3), np.float32)
    jaccard._add_overlaps(empty, np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert not empty.any()


def test_components(spark):
    links = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (7, 7), (10, 11), (11, 12), (12, 10)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((r.node, r.label) for r in got) == [*[(i, 1) for i in range(1, 6)], (8, 8), (9, 8), (10, 10), (11, 10), (12, 10)]
    path = [(i, i + 1) for i in range(200)]
    assert {r.label for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()} == {0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
