"""Helpers shared by the operators: reading tables, shared files, Arrow batches of bounded size."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.session import new_shared_path, written  # noqa: F401

# White space of the contracts: the six ASCII characters, nothing else. bytes.split and bytes.strip use the same set.
SPACE = r"[\x20\x09-\x0D]"
NO_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it as often as ``body`` likes, also under filters that are pushed down."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parts_of(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose text adds up to about ``most_bytes`` (one long text stays whole)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        start = size = 0
        for i, n in enumerate(pc.binary_length(texts).to_pylist()):
            size += n or 0
            if size >= most_bytes:
                yield batch.slice(start, i + 1 - start)
                start, size = i + 1, 0
        if start < batch.num_rows:
            yield batch.slice(start)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def with_columns(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with columns replaced where the name exists and added at the end where it doesn't."""
    arrays = {name: batch.column(i) for i, name in enumerate(batch.schema.names)} | new
    return pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))


def _filesystem(path: str):
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def open_shared(path: str):
    """Open a file of the shared folder for reading; local paths and every scheme that Arrow knows."""
    system, name = _filesystem(path)
    return system.open_input_file(name)


@contextlib.contextmanager
def new_shared_file(folder: str, stem: str, suffix: str):
    """``with new_shared_file(...) as (path, out)``: a file under a name no other attempt uses.

    A task that is repeated writes another file; only the one whose path the surviving attempt returned is ever read.
    """
    path = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
    system, name = _filesystem(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name, compression=None) as out:
        yield path, out


def read_shared_table(folder: str) -> pa.Table:
    """A small table that Spark wrote as Parquet, read inside a task."""
    import pyarrow.dataset as ds

    system, name = _filesystem(folder)
    return ds.dataset(name, filesystem=system, format="parquet").to_table()
