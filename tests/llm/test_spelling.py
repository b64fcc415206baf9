import random
import zlib

import pytest

from parlance.llm import spelling


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(counts, factor=2):
    links = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, others in links.items():
        best = min(others, key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(links[w]), counts.get(form[w])))
    return sorted(out, key=repr)


def run(spark, counts, factor=2):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    return sorted((tuple(r) for r in spelling.variant_groups(df, factor).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)


@pytest.mark.parametrize("letters,most,seed", [("ab", 7, 1), ("abé", 6, 2), ("abcdefgh", 5, 3)])
def test_dense_words_against_plain_version(spark, letters, most, seed):
    """Few letters: most words have neighbours, palindromes and words that are another's reverse included."""
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, most))) for _ in range(250)}
    counts = {w: rng.choice([1, 2, 4, 8, 9, 100]) for w in words}
    assert run(spark, counts) == plain(counts)


def test_edits_anywhere_and_long_words(spark):
    base = "abcdefghij"
    words = {base, "xyz"} | {base[:i] + base[i + 1:] for i in range(10)} | {base[:i] + "ß" + base[i:] for i in range(11)} | {base[:i] + "ü" + base[i + 1:] for i in range(10)}
    long = "ab" * 3_000
    words |= {long, long + "x", long[1:], long[:2_000] + "q" + long[2_001:], long[:4_000] + "q" + long[4_000:], "x" + long[:-1], "b" * 5_000, "b" * 5_001, "b" * 5_003}
    words |= {"", "a", "b", "ab", "ba", "𝒳a", "𝒳b", "éa", "éa"}
    counts = {w: 1 + 3 * (len(w) % 4) for w in words}
    assert run(spark, counts) == plain(counts)


def test_ties_and_chains(spark):
    counts = {"aaaaa": 1, "aaaab": 4, "aaaac": 4, "aaacc": 8, "aaccc": 16, "acccc": 31, "zzzzz": 5}
    got = {r[0]: r for r in run(spark, counts)}
    assert got["aaaaa"][1] == "aaaab" and got["aaaaa"][2] == "aaaab"     # the smaller of two with 4; it has no form of twice its count
    assert got["aaaac"][2] == "aaccc" and got["aaccc"][1] is None         # 31 is less than twice 16
    assert got["zzzzz"] == ("zzzzz", None, "zzzzz", 5, 0, None)
    assert run(spark, counts) == plain(counts)
    with pytest.raises(ValueError):
        spelling.variant_groups(spark.createDataFrame([("a", 1)], "word string, n long"), factor=1)


def test_empty_single_and_other_columns(spark):
    assert run(spark, {"alone": 3}) == [("alone", None, "alone", 3, 0, None)]
    df = spark.createDataFrame([("word", 1, "x", 1), (None, 5, "y", 2), ("wold", 2, "z", 3)], "word string, n int, node string, level int")
    assert sorted((r.word, r.form, r.n_near) for r in spelling.variant_groups(df).collect()) == [("wold", None, 1), ("word", "wold", 1)]
    assert spelling.variant_groups(df.limit(0)).count() == 0


def test_runs_and_vocabulary(spark):
    texts = [None, "", "123 _", "ÀÉ aB-Cd", "ét", "ß÷ÿĀx", "x" * 300_000, "same same same"]
    docs = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)] + [(None, "null id", "w")], "doc_id long, text string, word string")
    got = sorted((r.word, r.doc_id) for r in spelling.runs(docs).collect())
    assert [w for w, _ in got] == sorted(["ÀÉ", "ab", "cd", "e", "t", "ß÷ÿ", "x", "x" * 300_000, "same", "same", "same", "null", "id"])
    words = spelling.vocabulary(spelling.runs(docs), min_chars=4, min_count=3)
    assert [(r.word, r.n) for r in words.collect()] == [("same", 3)]


def test_query_on_the_table(spark):
    """The words of the contract, and all neighbours of a part of them."""
    import re
    from collections import Counter

    from parlance.llm import spelling_queries

    sf = "/root/testdata/sf0.001"
    counts = Counter()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", r.text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {r.word: r for r in spelling_queries.op12_spelling_variants(spark, sf).collect()}
    assert {w: r.n for w, r in out.items()} == counts
    for w in sorted(counts)[::40]:
        assert out[w].n_near == sum(near(w, v) for v in counts)
    assert any(r.form for r in out.values())
