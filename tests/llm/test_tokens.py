import hashlib
import io
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from parlance.llm import encoding, packing, tokenfiles

BYTE, WORD = (str(public_tokenizers.path(x)) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "  a", "a  b", "a \n b\n", "\n foo  ", " x y   z", "don't  we'll 12 3a", "<|endoftext|> <|startoftext|> hi", "é ́x", "a\tb \t c",
       "\U0001f600 ok \U0001f600\U0001f600", "   q", "ß İ I ŉ", "x" * 3_000 + " y", "a\x1c b \x1f c \x85 d", "日本 語 "]


def plain(path, texts, end=()):
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    return [np.array([*x.ids, *end], "<u4") for x in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_whole_texts(path, monkeypatch):
    rng = random.Random(3)
    parts = ["a", "B", " ", "  ", "\n", "\t", "é", "'s", "1", ".", "<|endoftext|>", " ", "日本", "́", "word", " "]
    texts = ODD + ["".join(rng.choice(parts) for _ in range(40)) for _ in range(1_500)]
    own = encoding.TextEncoder(path)
    assert own.cut
    want = [x.tobytes() for x in plain(path, texts)]
    assert own.encode(texts) == want
    own.room = -1
    assert own.encode(texts[:200]) == want[:200]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for path in (BYTE, WORD):
        assert encoding.encoder(path).encode([text])[0] == plain(path, [text])[0].tobytes()


def pieces_of(texts, capacity):
    for i, ids in enumerate(plain(BYTE, texts, [2])):
        first = len(ids) % capacity or capacity
        ends = [min(first, len(ids)), *range(first + capacity, len(ids) + 1, capacity)]
        for j, (a, b) in enumerate(zip([0, *ends], ends)):
            yield i, j, a, b - a, zlib.crc32(ids[a:b].tobytes())


@pytest.mark.parametrize("capacity", [16, 100])
def test_packing(spark, capacity):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60)
    texts = [r.text for r in docs.collect()] + [None, "", "a", *ODD] + ["same"] * 50
    table = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    got = packing.pack(table, BYTE, capacity, 2, keep_ids=True)
    rows = got.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(pieces_of(texts, capacity))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= capacity
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // capacity) * 1.02 + 1
    whole = packing.assemble(got).collect()
    assert all(len(r.ids) == 4 * r.length for r in whole) and sum(r.length for r in whole) == total


def test_packing_of_nothing_and_of_null_keys(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "x")], "doc_id long, text string")
    assert packing.pack(docs, BYTE, 8).count() == 3


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=12), st.integers(0, 30))
def test_fullest_bin(counts, room):
    chosen = packing.fullest(Counter(counts), room)
    reach = {0}
    for length, n in counts.items():
        for _ in range(n):
            reach |= {x + length for x in reach if x + length <= room}
    assert sum(chosen) == max(reach)
    assert not Counter(chosen) - Counter(counts)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), max_size=40))
def test_bins_use_up_the_counts(counts):
    bins = packing.plan_bins(counts, 64)
    used = Counter()
    for lengths, times in bins:
        assert sum(lengths) <= 64
        for x in lengths:
            used[x] += times
    assert used == Counter(counts)
    places = packing.Places(counts, bins)
    taken = set()
    for length, n in counts.items():
        sequence, offset = places.find(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist()):
            taken.update((s, o + i) for i in range(length))
    assert len(taken) == sum(x * n for x, n in counts.items())


def test_token_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id")
    texts = [r.text for r in docs.collect()] + [None, "", *ODD]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    files = tokenfiles.write_token_files(table, WORD)
    got = sorted(tokenfiles.read_token_files(files, keep_ids=True).collect(), key=lambda r: r.doc_id)
    at = 0
    want = plain(WORD, texts, [2])
    for r, ids in zip(got, want, strict=True):
        assert (r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)
    row = files.orderBy("file_no").first()
    with pa.OSFile(row.path.removeprefix("file:")) as source:
        file = tokenfiles.TokenFile(source)
        assert len(file) == len(file.keys) == row["docs"]
        for i in (len(file) - 1, 0, len(file) // 2):
            assert file.document(i).tolist() == want[file.keys[i].as_py()].tolist()


def test_token_file_without_and_with_other_dictionary():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 1, 5)]
    samples = [np.random.default_rng(i).integers(0, 50, 300).astype("<u4").tobytes() for i in range(200)]
    import zstandard

    dictionary = zstandard.train_dictionary(4_096, samples).as_bytes()
    for own in (b"", dictionary):
        out = io.BytesIO()
        writer = tokenfiles.Writer(out, own)
        for x in ids:
            writer.add(x)
        writer.close(pa.array(["a", None, "c"]))
        source = pa.BufferReader(out.getvalue())
        file = tokenfiles.TokenFile(source, hashlib.sha256(own).hexdigest())
        assert [x.tolist() for x in file] == [list(range(n)) for n in (0, 1, 5)]
        assert file.keys.to_pylist() == ["a", None, "c"]
        with pytest.raises(ValueError):
            tokenfiles.TokenFile(pa.BufferReader(out.getvalue()), hashlib.sha256(b"other").hexdigest())
    broken = bytearray(out.getvalue())
    broken[200] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.TokenFile(pa.BufferReader(bytes(broken)))


def test_token_files_of_few_and_no_documents(spark):
    assert tokenfiles.token_files_round_trip(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
    docs = spark.createDataFrame([(None, "b"), (None, "b"), (1, None)], "doc_id long, text string")
    got = sorted(((r.start, r.n_tokens) for r in tokenfiles.token_files_round_trip(docs, WORD).collect()))
    assert got == [(0, 2), (2, 2), (4, 1)]
