"""Files with names of their own, published only after the whole job has succeeded.

1. Tasks write under ``root/_staged/<write id>/<attempt>``, each with a listing of what it wrote. An attempt that fails or
   is repeated leaves files there only.
2. The commit names the attempts that count (one row per task); an abort removes everything that was staged.
3. A second job moves the files of these attempts into place and writes ``root/_manifests/<write id>``: path and bytes of
   every final file. Moves are repeatable, so a lost executor, or a driver that ended in between (``publish_files``), does no
   harm.

The driver handles attempts, never files. Folders that start with an underscore are skipped by Spark's readers.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_LISTING = pa.schema([("attempt", pa.string()), ("staged", pa.string()), ("path", pa.string()), ("bytes", pa.int64())])
_COMMITTED = pa.schema([("attempt", pa.string())])


def _staging(root: str, write_id: str) -> str:
    return f"{root.rstrip('/')}/_staged/{write_id}"


def _remove(folder: str) -> None:
    system, path = fs.FileSystem.from_uri(folder)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


@dataclass
class Attempt(WriterCommitMessage):
    name: str


class StagedFiles(DataSource):
    """Sink for rows ``path`` (below the root, unique) and ``content`` (binary; NULL as empty)."""

    @classmethod
    def name(cls) -> str:
        return "parlance_staged_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return StagedWriter(_staging(self.options["path"], self.options["write_id"]))


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        system, base = fs.FileSystem.from_uri(self.folder)
        attempt, n = uuid.uuid4().hex, 0
        system.create_dir(f"{base}/{attempt}", recursive=True)
        system.create_dir(f"{base}/listing", recursive=True)
        with system.open_output_stream(f"{base}/listing/{attempt}.parquet") as out, pq.ParquetWriter(out, _LISTING) as listing:
            for batch in iterator:
                rows = []
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                    staged = f"{attempt}/{n}"
                    data = (content.as_buffer() if content.is_valid else None) or b""
                    with system.open_output_stream(f"{base}/{staged}") as file:
                        file.write(data)
                    rows.append({"attempt": attempt, "staged": staged, "path": path, "bytes": len(data)})
                    n += 1
                listing.write_batch(pa.RecordBatch.from_pylist(rows, _LISTING))
        return Attempt(attempt)

    def commit(self, messages: list) -> None:
        system, base = fs.FileSystem.from_uri(self.folder)
        names = pa.table({"attempt": [m.name for m in messages if m is not None]}, _COMMITTED)
        system.create_dir(base, recursive=True)
        with system.open_output_stream(f"{base}/committed.parquet.part") as out:
            pq.write_table(names, out)
        system.move(f"{base}/committed.parquet.part", f"{base}/committed.parquet")

    def abort(self, messages: list) -> None:
        _remove(self.folder)


def _check_paths(listing: DataFrame) -> None:
    """No two rows may name one file, and none may leave the root or its own part of it."""
    first = F.split("path", "/")[0]
    bad = F.col("path").isNull() | F.startswith("path", F.lit("/")) | F.endswith("path", F.lit("/")) | (F.col("path") == "") | F.array_contains(
        F.split("path", "/"), "..") | first.isin("_staged", "_manifests")
    worst = listing.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 1) | bad).limit(1).collect()
    if worst:
        raise ValueError(f"{worst[0].n} row(s) for the file {worst[0].path!r}: paths must be unique and below the root")


def publish_files(spark: SparkSession, root: str, write_id: str) -> DataFrame:
    """Move the files of a committed write into place; returns its manifest (``path``, ``bytes``).

    May be repeated after a failure. A write that was never committed is refused; files of the same names from earlier writes are
    replaced.
    """
    root = root.rstrip("/")
    folder, manifest = _staging(root, write_id), f"{root}/_manifests/{write_id}"
    system, base = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{base}/committed.parquet").type == fs.FileType.File:
        committed = spark.read.parquet(f"{folder}/committed.parquet")
        # As many rows as the write had tasks.
        listing = spark.read.parquet(f"{folder}/listing").join(F.broadcast(committed), "attempt", "left_semi")
        _check_paths(listing)

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, below = fs.FileSystem.from_uri(root)
            _, staging = fs.FileSystem.from_uri(folder)
            made = set()
            for batch in batches:
                for staged, path in zip(batch.column("staged").to_pylist(), batch.column("path").to_pylist()):
                    target = f"{below}/{path}"
                    parent = posixpath.dirname(target)
                    if parent not in made:
                        files.create_dir(parent, recursive=True)
                        made.add(parent)
                    try:
                        files.move(f"{staging}/{staged}", target)
                    except FileNotFoundError:
                        # Moved by an earlier attempt of this task, which was lost afterwards.
                        if files.get_file_info(target).type != fs.FileType.File:
                            raise
                yield batch.select(["path", "bytes"])

        moved = listing.select("staged", "path", "bytes").mapInArrow(move, "path string, bytes long")
        moved.write.mode("overwrite").parquet(manifest)
        _remove(folder)
    elif system.get_file_info(fs.FileSystem.from_uri(manifest)[1] + "/_SUCCESS").type != fs.FileType.File:
        raise ValueError(f"write {write_id} was not committed")
    return spark.read.parquet(manifest)


def write_files(df: DataFrame, root: str, write_id: str | None = None) -> DataFrame:
    """Write ``content`` of each row to the file ``path`` below ``root``; returns the manifest of the write.

    All files appear or none: an error in any row or task leaves nothing behind. Paths that are NULL, repeated or outside the
    root are an error. Other columns are ignored; an empty table writes an empty manifest.
    """
    spark = df.sparkSession
    write_id = write_id or uuid.uuid4().hex
    spark.dataSource.register(StagedFiles)
    rows = df.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content"))
    try:
        rows.write.format(StagedFiles.name()).mode("append").option("write_id", write_id).save(root)
        return publish_files(spark, root, write_id)
    except ValueError:
        _remove(_staging(root, write_id))
        raise
