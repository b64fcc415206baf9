import base64
import hashlib
import io
import struct

import pytest
import zstandard

from pyspark.sql import functions as F

from parlance.llm import hot, queries, warc


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def run(spark, rows, **options):
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, error int").repartition(2)
    archives = warc.write_archives(pages, **options)
    got = warc.read_archives(archives, keep_payload=True)
    return got.withColumns({"page_id": warc.key_of("record_id"), "of": warc.key_of("refers_to")}).collect()


def want(rows, least):
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [k for k, _, other in rows if (other or "") == (html or "") and k is not None]
        head = max(same, default=None) if len(data) >= least else i
        other = head is not None and i != head
        out.append((i, len(data), digest(data), "revisit" if other else "response", head if other else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/", "x" * 50), (2, None, "x" * 50), (3, "http://b/é\r\nWARC-Type: warcinfo", "x" * 50), (4, "", ""), (5, "u", None), (6, "u", "ünï\r\n\r\nWARC/1.1"),
        (7, "u", "y" * 3_000_000), (8, "u", "short"), (9, "u", "short"), (None, "u", "x" * 50), (None, "u", "no key"), (None, "u", "no key"), (10, "u", "once")]


@pytest.mark.parametrize("least", [0, 10, 10_000_000])
def test_round_trip(spark, least):
    rows = ROWS + [(100 + i, f"http://h/{i}", f"page {i % 40} " * 20) for i in range(200)]
    got = run(spark, rows, min_revisit_bytes=least)
    assert all(r.error is None for r in got)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.of) for r in got), key=repr) == want(rows, least)
    texts = {i: (html or "").encode() for i, _, html in rows}
    assert all(bytes(r.payload) == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id)
    assert all(r.payload is None for r in got if r.record_type == "revisit")


def test_rows_that_repeat_and_empty_table(spark):
    got = run(spark, [(1, "u", "a"), (1, "u", "a"), (0, "u", "a")])
    assert sorted((r.page_id, r.record_type, r.of) for r in got) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]
    assert run(spark, []) == []


def archive(records, dictionary=b""):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


def make(i, payload=None):
    payload = f"payload {i} ".encode() * 20 if payload is None else payload
    return warc.record(i, "http://u/", payload, len(payload), digest(payload), None, "2020-01-01T00:00:00Z")


def test_dictionary_forms():
    records = [make(i) for i in range(300)]
    dictionary = warc.train_dictionary(records)
    packed = archive(records, dictionary)
    assert struct.unpack("<I", packed[:4])[0] == warc.DICTIONARY_FRAME and len(packed) < len(archive(records)) / 2
    assert [d for _, d, e in warc.frames(io.BytesIO(packed))] == records
    assert [d for _, d, e in warc.frames(io.BytesIO(archive(records)))] == records
    # A dictionary that isn't compressed, and other skippable frames between the records.
    size = struct.unpack("<I", packed[4:8])[0]
    raw = struct.pack("<II", warc.DICTIONARY_FRAME, len(dictionary)) + dictionary + struct.pack("<II", 0x184D2A50, 3) + b"abc" + packed[8 + size:]
    assert [d for _, d, e in warc.frames(io.BytesIO(raw))] == records
    assert warc.train_dictionary([]) == warc.train_dictionary([b"x"]) == b""
    assert list(warc.frames(io.BytesIO(b""))) == []


def test_damage_is_reported_and_passed_over():
    records = [make(i, bytes([65 + i]) * 5_000) for i in range(5)]
    frames = [archive([r]) for r in records]
    broken = bytearray(frames[2])
    broken[-2] ^= 0xFF  # the checksum
    got = list(warc.frames(io.BytesIO(frames[0] + b"junk" * 30_000 + frames[1] + bytes(broken) + frames[3] + frames[4][:-3])))
    assert [d for _, d, e in got if e is None] == [records[0], records[1], records[3]]
    assert [e for _, d, e in got if e and "truncated" in e] == ["truncated frame"]
    assert sum(e is not None for _, _, e in got) == 3


@pytest.mark.parametrize("change", [
    lambda r: r.replace(b"WARC/1.1", b"HTTP/1.1", 1), lambda r: r + b"more", lambda r: r[:-1], lambda r: r.replace(b"Content-Length: 2", b"Content-Length: 3"),
    lambda r: r.replace(b"payload 7 ", b"payload 8 ", 1), lambda r: r.replace(b"WARC-Record-ID", b"WARC-Nothing"), lambda r: r + r,
    lambda r: r.replace(b"WARC-Date: ", b"WARC-Date "), lambda r: b"", lambda r: b"\xff\xfe" + r,
])
def test_records_are_validated(change):
    record = make(7)
    assert warc.parse_record(record)["payload_bytes"] == 200
    with pytest.raises(ValueError):
        warc.parse_record(change(record))


def test_frame_with_two_records_and_huge_dictionary_header():
    two = zstandard.ZstdCompressor().compress(make(1) + make(2))
    (_, data, error), = warc.frames(io.BytesIO(two))
    with pytest.raises(ValueError):
        warc.parse_record(data)
    cut = struct.pack("<II", warc.DICTIONARY_FRAME, 1_000) + b"x"
    assert list(warc.frames(io.BytesIO(cut))) == [(0, None, "truncated dictionary")]


def test_frequent_payload_is_dealt_to_many_tasks(spark):
    """A payload of two thirds of all rows, next to rarer ones: the same records."""
    rows = [(i, f"u{i}", "<p>same</p>" if i % 3 else f"<p>{i % 50}</p>") for i in range(600)]
    got = run(spark, rows)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.of) for r in got), key=repr) == want(rows, 0)
    parts = spark.createDataFrame([(f"k{i}", "x") for i in range(600)], "id string, sha string")
    keyed = spark.createDataFrame([("x", 1, 600)], "sha string, head int, n long")
    joined = hot.join_keyed(parts, keyed, "sha", "n", [F.col("id")], "left")
    assert joined.count() == 600 and "__part" in joined._jdf.queryExecution().optimizedPlan().toString()


def test_query_fails_on_a_record_that_cannot_be_read(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "u", "<p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    monkeypatch.setattr(warc, "read_archives", lambda archives: real(archives).withColumn("error", F.lit("frame: damaged")))
    with pytest.raises(Exception, match="frame: damaged"):
        queries.op1_warc_round_trip(spark, str(tmp_path)).collect()


real = warc.read_archives
