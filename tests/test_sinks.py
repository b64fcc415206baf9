import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from parlance.sources import sinks


def on_disk(folder):
    return {str(p.relative_to(folder)): p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.startswith(".") and not str(p.relative_to(folder)).startswith("_manifests")}


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary, attempt string").repartition(3)


def test_files_and_manifest(spark, tmp_path, rows):
    root = f"file://{tmp_path}/out"
    made = sinks.write_files(files(spark, [(f"s{i % 3}/f{i}.bin", b"x" * i, "clash") for i in range(20)] + [("empty", None, "")]), root)
    want = {f"s{i % 3}/f{i}.bin": b"x" * i for i in range(20)} | {"empty": b""}
    assert on_disk(tmp_path / "out") == want
    assert rows(made) == sorted((p, len(c)) for p, c in want.items())
    sinks.write_files(files(spark, [("empty", b"now full", "")]), root)
    assert on_disk(tmp_path / "out") == want | {"empty": b"now full"}


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    good = files(spark, [(f"f{i}", b"abc", "") for i in range(30)])
    sinks.write_files(good.limit(1).withColumn("path", F.lit("before")), root)
    late = F.when(F.col("path") == "f29", F.raise_error(F.lit("damaged"))).otherwise(F.col("content"))
    with pytest.raises(Exception, match="damaged"):
        sinks.write_files(good.coalesce(1).sortWithinPartitions(F.length("path"), "path").withColumn("content", late), root)
    assert on_disk(tmp_path / "out") == {"before": b"abc"}


def test_only_committed_attempts_count(spark, tmp_path, rows):
    """A task that fails after writing, one that is repeated, and a driver that ends before publishing."""
    root, folder = f"file://{tmp_path}/out", sinks._staging(f"file://{tmp_path}/out", "w")
    batch = pa.RecordBatch.from_pydict({"path": ["a", "b/c"], "content": [b"1", b"22"]})

    def lost():
        yield batch
        raise RuntimeError("lost")

    writer = sinks.StagedWriter(folder)
    with pytest.raises(RuntimeError):
        writer.write(lost())
    writer.write(iter([batch]))
    kept = writer.write(iter([batch]))
    with pytest.raises(ValueError, match="not committed"):
        sinks.publish_files(spark, root, "w")
    writer.commit([kept, None])
    listing = pq.read_table(f"{tmp_path}/out/_staged/w/listing/{kept.name}.parquet").to_pylist()
    # One of two files had been moved when the publishing job was lost.
    (tmp_path / "out" / "_staged" / "w" / listing[0]["staged"]).rename(tmp_path / "out" / "a")
    assert rows(sinks.publish_files(spark, root, "w")) == [("a", 1), ("b/c", 2)]
    assert on_disk(tmp_path / "out") == {"a": b"1", "b/c": b"22"}
    assert rows(sinks.publish_files(spark, root, "w")) == [("a", 1), ("b/c", 2)]


@pytest.mark.parametrize("paths", [["a", "a"], ["a", None], ["../a"], ["/a"], ["x/../../a"], ["_staged/a"], ["a/"], [""]])
def test_refused_paths(spark, tmp_path, paths):
    with pytest.raises(ValueError, match="unique and below"):
        sinks.write_files(files(spark, [(p, b"", "") for p in paths]), f"file://{tmp_path}/out")
    assert on_disk(tmp_path / "out") == {}


def test_empty_table(spark, tmp_path, rows):
    assert rows(sinks.write_files(files(spark, []), f"file://{tmp_path}/out")) == []
