import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from parlance.llm import phrases


def plain_phrases(text):
    data, seen, start, out = text.encode(), set(), 0, []
    for end in range(1, len(data) + 1):
        if data[start:end] not in seen:
            seen.add(data[start:end])
            out.append(data[start:end])
            start = end
    return out + ([data[start:]] if start < len(data) else [])


def plain_fingerprint(text):
    least = np.full(phrases.SLOTS, 2**64 - 1, np.uint64)
    for phrase in plain_phrases(text):
        h = phrases.phrase_hashes(phrase, np.array([0]), np.array([len(phrase)]))
        least = np.minimum(least, h * phrases.ODD + phrases.SHIFT)
    return phrases.signature(least)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \né", max_size=120), st.text(alphabet="abcé", max_size=80))
def test_parse_and_edit(text, following):
    assert (phrases.fingerprint(text) == plain_fingerprint(text)).all()
    own, changed, new = phrases.fingerprints_with_edit(text, following)
    quarter = len(text) // 4
    want = text[:len(text) - quarter] + following[:quarter]
    assert new == want.encode()
    assert (own == plain_fingerprint(text)).all() and (changed == plain_fingerprint(want)).all()


def test_likeness_estimates_shared_phrases():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(400)]
    a, b = " ".join(words[:300]), " ".join(words[:250] + words[350:])
    x, y = set(plain_phrases(a)), set(plain_phrases(b))
    assert abs(phrases.likeness(phrases.fingerprint(a), phrases.fingerprint(b)) - len(x & y) / len(x | y)) < 0.15
    assert phrases.likeness(phrases.fingerprint(a), phrases.fingerprint(a)) == 1.0


def check(spark, rows):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_chars string").repartition(3)
    got = sorted(phrases.edit_fingerprints(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    texts = [t or "" for _, t in rows]
    for i, r in enumerate(got):
        own, following = texts[i], texts[(i + 1) % len(texts)]
        new, _ = phrases.edited(own, following)
        prints = [plain_fingerprint(x) for x in (own, new, following)]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (rows[i][0], len(own), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (prints[0].tobytes().hex(), prints[1].tobytes().hex())
        assert (r.near_edited, r.near_next) == (phrases.likeness(prints[0], prints[1]), phrases.likeness(prints[0], prints[2]))
    assert len(got) == len(rows)


def test_rows_against_plain_version(spark):
    check(spark, [(None, "first of all"), (-5, None), (-4, ""), (0, "short"), (1, "ünïcode " * 30), (2, "ünïcode " * 30), (7, "x"), (9, "long " * 4_000), (100, "\n \t"), (101, "end")])
    check(spark, [(1, "alone in the table")])
    check(spark, [(i, f"text number {i} " * (i % 7 + 1)) for i in range(300)])


def test_empty_table(spark):
    assert phrases.edit_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
