"""WARC archives in Zstandard: one frame per record, with a dictionary in the leading skippable frame.

Writing. Records with equal payloads are stored once: the one with the largest key is a ``response``, the others are
``revisit`` records that refer to it and carry the HTTP header only (whose Content-Length still tells the payload's size).
Every task writes archives of its own and turns to the next when one is full.

Reading. An archive is read in runs of 64 KB, a frame at a time, so memory follows the largest record. Frames, headers and
lengths are checked; what fails is reported in the row's ``error``, and reading goes on at the next frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.base import column, new_shared_file, new_shared_path, open_shared, parts_of, written
from parlance.llm.hot import join_keyed

FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ARCHIVE_BYTES = 256 << 20       # uncompressed bytes of an archive, about
SAMPLE_BYTES = 1 << 20          # of a task's first records, for its dictionary
MOST_READERS = 20_000      # tasks that read archives; beyond it a task reads several
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
RUN = 64 << 10
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "application/http;msgtype=response"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key) -> str:
    return "<urn:page:" + ("" if key is None else quote(str(key), safe="")) + ">"


def _header_value(value: str) -> str:
    """Header lines can't hold control characters."""
    return "".join(quote(c) if ord(c) < 32 or ord(c) == 127 else c for c in value)


def record(key, url: str | None, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """A record; ``payload`` None makes a revisit of a payload of ``size`` bytes."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    lines = ["WARC/1.1", "WARC-Type: " + ("response" if payload is not None else "revisit"), f"WARC-Record-ID: {record_id(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"Content-Type: {HTTP}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(samples: list[bytes]) -> bytes:
    """Empty where there is too little to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes() if len(samples) > 7 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    def __init__(self, out, dictionary: bytes):
        self.out = out
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        if shared:
            shared.precompute_compress(level=LEVEL)  # once, not with every record
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)

    def add(self, data: bytes) -> None:
        self.out.write(self.compressor.compress(data))


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0,
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row; returns the archives: ``path, records``.

    Payload: the html in UTF-8, NULL as empty. Of payloads of at least ``min_revisit_bytes`` bytes that are equal, the rows
    with the largest key are responses (rows that repeat that key each), the others revisits of it; without any key
    there is nothing to refer to, and all are responses. NULL keys and urls are allowed; other columns are ignored; an
    empty table writes nothing.
    """
    spark = pages.sparkSession
    folder = new_shared_path(spark, "warc")
    text = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), text.alias("html")).withColumns(
        {"sha": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    groups = rows.filter(F.col("size") >= min_revisit_bytes).groupBy("sha").agg(F.max("key").alias("head"), F.count("*").alias("n"))
    # Equal payloads may be a third of all rows: those of a frequent one are dealt to many tasks by key and url.
    joined = join_keyed(rows, written(groups.filter("n > 1"), "payloads"), "sha", "n", [F.col("key"), F.col("url")], "left")
    other = F.col("head").isNotNull() & ~F.col("key").eqNullSafe(F.col("head"))
    joined = joined.select("key", "url", "sha", "size", F.when(other, F.col("head")).alias("refers_to"),
                           F.when(other, F.lit(None)).otherwise(F.col("html")).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        dictionary, source = None, parts_of(batches, "html")
        waiting: list[bytes] = []
        paths, counts = [], []

        def records(batch: pa.RecordBatch) -> list[bytes]:
            out = []
            for k, u, s, n, r, h in zip(*(column(batch, c).to_pylist() for c in ("key", "url", "sha", "size", "refers_to", "html"))):
                digest = base64.b32encode(bytes.fromhex(s)).decode()
                out.append(record(k, u, None if h is None else h.encode(), n, digest, r, date))
            return out

        batch = next(source, None)
        while batch is not None:
            waiting = records(batch)
            if dictionary is None:
                samples, room = [], SAMPLE_BYTES
                for x in waiting:
                    samples.append(x[:room])
                    room -= len(samples[-1])
                    if room <= 0:
                        break
                dictionary = train_dictionary(samples)
            written_bytes = n = 0
            with new_shared_file(folder, f"part-{TaskContext.get().partitionId():06d}-{len(paths):04d}", ".warc.zst") as (path, out):
                archive = ArchiveWriter(out, dictionary)
                while True:
                    for x in waiting:
                        archive.add(x)
                        written_bytes += len(x)
                    n += len(waiting)
                    batch = next(source, None)
                    if batch is None or written_bytes >= ARCHIVE_BYTES:
                        break
                    waiting = records(batch)
            paths.append(path)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(joined.mapInArrow(write, "path string, records long"), "archives")


def frames(source, most_bytes: int = 1 << 30) -> Iterator[tuple[int, bytes | None, str | None]]:
    """``(offset, record, error)`` for each frame of an archive opened for reading."""
    buffer, offset, dictionary = bytearray(), 0, None

    def fill(n: int) -> bool:
        while len(buffer) < n:
            more = source.read(max(RUN, n - len(buffer)))
            if not more:
                return False
            buffer.extend(more)
        return True

    def skip(n: int) -> None:
        nonlocal offset
        del buffer[:n]
        offset += n

    def resync() -> bool:
        """Go to the next frame's first bytes after the current position."""
        at = buffer.find(FRAME, 1)
        while at < 0:
            skip(max(0, len(buffer) - 3))
            if not fill(len(buffer) + 1):
                return False
            at = buffer.find(FRAME, 1 if offset == 0 else 0)
        skip(at)
        return True

    if fill(8):
        magic, size = struct.unpack("<II", buffer[:8])
        if magic == DICTIONARY_FRAME:
            if not fill(8 + size):
                yield 0, None, "truncated dictionary"
                return
            packed = bytes(buffer[8:8 + size])
            skip(8 + size)
            try:
                data = zstandard.ZstdDecompressor().decompress(packed, max_output_size=64 << 20) if packed[:4] == FRAME else packed
                dictionary = zstandard.ZstdCompressionDict(data)
            except zstandard.ZstdError as error:
                yield 0, None, f"dictionary: {error}"
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while fill(1):
        if not fill(4):
            yield offset, None, "truncated frame"
            return
        magic = struct.unpack("<I", buffer[:4])[0]
        if magic in SKIPPABLE:
            if not fill(8) or not fill(8 + struct.unpack("<I", buffer[4:8])[0]):
                yield offset, None, "truncated skippable frame"
                return
            skip(8 + struct.unpack("<I", buffer[4:8])[0])
            continue
        start, error, parts, size = offset, None, [], 0
        if bytes(buffer[:4]) != FRAME:
            error = "no frame begins here"
        else:
            frame, fed = decompressor.decompressobj(), 0
            try:
                while True:
                    parts.append(frame.decompress(bytes(buffer[fed:])))
                    size += len(parts[-1])
                    fed = len(buffer)
                    if frame.eof:
                        skip(len(buffer) - len(frame.unused_data))
                        break
                    if size > most_bytes:
                        error = "record too large"
                        break
                    if not fill(fed + 1):
                        yield start, None, "truncated frame"
                        return
            except zstandard.ZstdError as problem:
                error = f"frame: {problem}"
        if error is None:
            yield start, b"".join(parts), None
            continue
        yield start, None, error
        if not resync():
            return


def parse_record(data: bytes) -> dict:
    """Fields of a record; raises ValueError where headers, lengths or digests don't fit."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not mark or not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or " " in name:
            raise ValueError("a header line has no name")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not fields["content-length"].isdigit():
        raise ValueError("content-length is not a number")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("the block is not as long as content-length says")
    block = rest[:length]
    if fields.get("warc-block-digest", "sha1:" + base32_sha1(block)) != "sha1:" + base32_sha1(block):
        raise ValueError("block digest")
    out = {"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "url": fields.get("warc-target-uri"),
           "refers_to": fields.get("warc-refers-to"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
           "payload_bytes": len(block), "payload": block}
    if fields.get("content-type", "").replace(" ", "").startswith(HTTP.split(";")[0]):
        http, mark, payload = block.partition(b"\r\n\r\n")
        size = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), None)
        if not mark or (size is not None and not size.isdigit()):
            raise ValueError("HTTP header")
        full = len(payload) if size is None else int(size)
        if out["record_type"] == "revisit":
            out |= {"payload": None, "payload_bytes": full}
        else:
            if full != len(payload):
                raise ValueError("the payload is not as long as its HTTP header says")
            out |= {"payload": payload, "payload_bytes": full}
            if out["payload_digest"] not in (None, base32_sha1(payload)):
                raise ValueError("payload digest")
    return out


FIELDS = ["record_id", "record_type", "url", "refers_to", "payload_digest", "payload_bytes"]


def read_archives(archives: DataFrame, path: str = "path", keep_payload: bool = False) -> DataFrame:
    """One row per frame of the archives named in ``path``: archive, offset, the record's fields and ``error`` (NULL if
    all is well; then ``payload`` is there for responses, with ``keep_payload``)."""
    schema = "archive string, offset long, record_id string, record_type string, url string, refers_to string, payload_digest string, payload_bytes long, error string"
    schema += ", payload binary" * keep_payload
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.string(), *[pa.binary()] * keep_payload]
    names = ["archive", "offset", *FIELDS, "error", *["payload"] * keep_payload]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for name in column(batch, "path").to_pylist():
                rows, size = [], 0
                with open_shared(name) as source:
                    for at, data, error in frames(source):
                        fields: dict = {}
                        if error is None:
                            try:
                                fields = parse_record(data)
                            except ValueError as problem:
                                error = str(problem)
                        rows.append((name, at, *[fields.get(f) for f in FIELDS], error, *[fields.get("payload")] * keep_payload))
                        size += len(data or b"") * keep_payload + 500
                        if size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    # One archive is one unit of work: frames tell their length only to who reads them. The number of partitions is stated, since
    # Spark would put the names, which are short, into one task.
    paths = archives.select(F.col(path).alias("path"))
    return paths.repartition(max(1, min(paths.count(), MOST_READERS)), "path").mapInArrow(read, schema)


def key_of(name: str, kind: str = "long"):
    """The key in a record id column; NULL for the empty one."""
    decode = F.url_decode(F.regexp_replace(F.regexp_extract(F.col(name), "^<urn:page:(.*)>$", 1), r"\+", "%2B"))
    return F.when(decode != "", decode).cast(kind)


