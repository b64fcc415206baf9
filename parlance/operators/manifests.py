"""Audit of required files (a manifest of artifacts) against a file listing.

``manifest``: artifact_id, dir, primary_file, alternates, additional_files, include_patterns (arrays) and what the
caller wants to keep. ``files``: dir, rel_path; rows without either are ignored. The listing is the large side; a
directory may hold most of it and be shared by many artifacts, so an artifact never meets all files of its directory:
named files are found by equality, patterns by equality with the suffixes of each path (one per pattern length in use in
its directory, so at most as many as the path has characters).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.ordered import salted_join

# Extensions searched when neither named files nor patterns are present, in this order.
FALLBACK_SUFFIXES = (".onnx", ".safetensors")
_PATTERN_RANK = 1_000_000
_FALLBACK_RANK = 2_000_000


def explode_manifest(manifest: DataFrame) -> DataFrame:
    """``(artifact_id, dir, kind, priority, file)``: the primary file, then alternates, then additional files. NULL arrays
    are empty."""
    def part(name: str, kind: str, first: int) -> Column:
        listed = F.coalesce(F.col(name), F.array().cast("array<string>"))
        return F.transform(listed, lambda f, i: F.struct(
            F.lit(kind).alias("kind"), (i + first).cast("int").alias("priority"), f.alias("file")))

    primary = F.array(F.struct(F.lit("primary").alias("kind"), F.lit(0).alias("priority"), F.col("primary_file").alias("file")))
    named = F.filter(
        F.concat(primary, part("alternates", "alternate", 1), part("additional_files", "additional", 0)),
        lambda e: (e["kind"] != "primary") | (F.coalesce(F.trim(e["file"]), F.lit("")) != ""),
    )
    return manifest.select("artifact_id", "dir", F.explode(named).alias("e")).select("artifact_id", "dir", "e.*")


def _requests(manifest: DataFrame, named: bool, fallbacks: Sequence[str] = ()) -> DataFrame:
    """``(artifact_id, dir, way, text, rank)``: what each artifact looks for. ``way``: ``file`` (the path is the text), ``fold``
    (it ends with it, ignoring case) or ``end`` (it ends with it). Blank patterns look for nothing; additional files have
    no rank, since they never stand for the artifact."""
    def request(way: str, text: Column, rank: Column) -> Column:
        return F.struct(F.lit(way).alias("way"), text.alias("text"), rank.cast("int").alias("rank"))

    def each(name: str, make) -> Column:
        return F.coalesce(F.transform(name, make), F.array().cast("array<struct<way: string, text: string, rank: int>>"))

    asked = [F.filter(each("include_patterns", lambda p, i: request("fold", F.lower(p), i + _PATTERN_RANK)), lambda r: F.trim(r["text"]) != "")]
    if named:
        primary = F.array(request("file", F.col("primary_file"), F.lit(0)))
        asked += [F.filter(primary, lambda r: F.trim(r["text"]) != ""), each("alternates", lambda f, i: request("file", f, i + 1)),
                  each("additional_files", lambda f, i: request("file", f, F.lit(None)))]
    if fallbacks:
        asked.append(F.array(*[request("end", F.lit(x), F.lit(_FALLBACK_RANK + i)) for i, x in enumerate(fallbacks)]))
    return manifest.select("artifact_id", "dir", F.explode(F.concat(*asked)).alias("r")).select("artifact_id", "dir", "r.*")


def _path_keys(files: DataFrame, requests: DataFrame, named: bool) -> DataFrame:
    """``(dir, way, text, rel_path)``: every text by which a path can be asked for in its directory - itself, and its
    suffixes of the lengths in use there."""
    ways = requests.groupBy("dir").agg(F.array_compact(F.collect_set(
        F.when(F.col("way") != "file", F.struct("way", F.length("text").alias("length"))))).alias("ways"))
    path = F.col("rel_path")
    folded = F.lower(path)
    keys = F.transform(
        F.filter("ways", lambda w: F.length(F.when(w["way"] == "fold", folded).otherwise(path)) >= w["length"]),
        lambda w: F.struct(w["way"].alias("way"), F.right(F.when(w["way"] == "fold", folded).otherwise(path), w["length"]).alias("text")))
    if named:
        keys = F.concat(F.array(F.struct(F.lit("file").alias("way"), path.alias("text"))), keys)
    listing = files.select("dir", "rel_path").filter("dir IS NOT NULL AND rel_path IS NOT NULL")
    return salted_join(listing, ways, ["dir"], path).select("dir", F.explode(keys).alias("k"), "rel_path").select("dir", "k.*", "rel_path")


def _resolved(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """``artifact_id, resolved_file, rule, missing`` of every artifact. The listing is read once and becomes an index of the least
    path per key, added up before its shuffle; requests are joined with that."""
    requests = _requests(manifest, True, FALLBACK_SUFFIXES)
    index = _path_keys(files, requests, True).groupBy("dir", "way", "text").agg(F.min("rel_path").alias("path"))
    found = requests.join(index, ["dir", "way", "text"], "left").groupBy("artifact_id").agg(
        F.min(F.when(F.col("rank").isNotNull() & F.col("path").isNotNull(), F.struct("rank", "path"))).alias("c"),
        F.sort_array(F.collect_set(F.when(F.col("rank").isNull() & F.col("path").isNull(), F.col("text")))).alias("missing"))
    return found.select("artifact_id", F.col("c.path").alias("resolved_file"), _rule(F.col("c.rank")).alias("rule"), "missing")


def _rule(rank: Column) -> Column:
    return (
        F.when(rank.isNull(), F.lit(None).cast("string")).when(rank == 0, "primary").when(rank < _PATTERN_RANK, "alternate")
        .when(rank < _FALLBACK_RANK, "pattern").otherwise("fallback")
    )


def resolve_primary(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The file that stands for each artifact: primary, alternates, include patterns, then known extensions; the
    first path in order where several match one pattern. NULL when nothing is there."""
    return _resolved(manifest, files).drop("missing")


def match_includes(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files of each artifact's directory that end with one of its patterns, ignoring case; paths that differ only in
    case count once."""
    requests = _requests(manifest, False).select("artifact_id", "dir", "way", "text").distinct()
    hit = salted_join(_path_keys(files, requests, False), requests, ["dir", "way", "text"], F.col("rel_path"))
    return hit.groupBy("artifact_id", F.lower("rel_path").alias("__folded")).agg(F.min("rel_path").alias("file")).drop("__folded")


def audit_completeness(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Per artifact: what resolves it, which additional files are missing, and whether it is complete (resolved and
    nothing missing)."""
    return _resolved(manifest, files).withColumn(
        "complete", F.col("resolved_file").isNotNull() & (F.size("missing") == 0))


def catalogue_status(manifest: DataFrame, audit: DataFrame, gated_types: Sequence[str] = (),
                     gated_prefixes: Sequence[str] = ()) -> DataFrame:
    """Listing of all artifacts. The listing flags gated *types* only; a download is also gated by the repository
    prefix, ignoring case."""
    by_type = F.col("artifact_type").isin(*gated_types) if gated_types else F.lit(False)
    by_repo = F.lit(False)
    for prefix in gated_prefixes:
        by_repo = by_repo | F.startswith(F.lower("repo"), F.lit(prefix.lower()))
    return manifest.join(audit.select("artifact_id", "complete", "resolved_file").hint("merge"), "artifact_id", "left").select(
        "artifact_id", "name", F.col("artifact_type").alias("type"), "repo",
        F.when(F.col("complete"), "downloaded").otherwise("not_downloaded").alias("status"),
        F.when(F.col("resolved_file").isNotNull(), F.col("dir")).alias("local_dir"),
        (F.col("expected_bytes") / F.lit(1024.0 * 1024.0)).alias("expected_size_mb"), "is_required", "is_available",
        by_type.alias("listed_as_gated"), (by_type | by_repo).alias("download_is_gated"),
    )


def ensure_summary(manifest: DataFrame, audit: DataFrame, results: DataFrame, auto_download: bool = True) -> DataFrame:
    """What ensuring the required artifacts comes to: ``cached``, ``disabled`` (missing, downloads off), ``fetched`` or
    ``failed``. ``results(artifact_id, success)`` are the transfers made."""
    required = manifest.filter("is_required").select("artifact_id", "name")
    # Both have a row per artifact; compressed files look small enough to broadcast long after their rows are too many.
    joined = required.join(audit.select("artifact_id", "complete").hint("merge"), "artifact_id", "left").join(
        results.select("artifact_id", "success").hint("merge"), "artifact_id", "left")
    outcome = F.when(F.col("complete"), "cached")
    if not auto_download:
        outcome = outcome.otherwise("disabled")
    else:
        outcome = outcome.when(F.col("success"), "fetched").otherwise("failed")
    return joined.select("artifact_id", "name", outcome.alias("outcome")).withColumn(
        "ready", F.col("outcome").isin("cached", "fetched"))


def ready_count(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if("ready").alias("ready"), F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("cached", "disabled", "fetched", "failed")])


def delete_plan(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Files to delete for the given artifacts (primary and additional ones that exist), then directories left empty.

    ``step`` orders the work inside a directory tree: files first, then directories, the longest path first; the
    artifact's own directory is the empty path.
    """
    named = F.filter(F.concat(F.array("primary_file"), F.col("additional_files")), lambda f: F.coalesce(f, F.lit("")) != "")
    targets = manifest.select("dir", F.explode(named).alias("rel_path"))
    # The listing and the doomed names become one row per path in one shuffle.
    rows = files.select("dir", "rel_path").withColumns({"listed": F.lit(True), "doomed": F.lit(False)}).unionByName(
        targets.withColumns({"listed": F.lit(False), "doomed": F.lit(True)}))
    paths = rows.filter("dir IS NOT NULL AND rel_path IS NOT NULL").groupBy("dir", "rel_path").agg(
        F.max("listed").alias("listed"), F.max("doomed").alias("doomed")).filter("listed")
    marked = salted_join(paths, manifest.select("dir").distinct(), ["dir"], F.col("rel_path"))
    parts = F.split("rel_path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.array_join(F.slice(parts, F.lit(1), d), "/"))
    # A file carries itself and its ancestors, so that one pass over the listing yields both kinds of rows.
    entries = marked.select(
        "dir", "doomed",
        F.explode(F.concat(
            F.array(F.struct(F.lit("file").alias("kind"), F.col("rel_path").alias("path"))),
            F.transform(ancestors, lambda a: F.struct(F.lit("directory").alias("kind"), a.alias("path"))),
        )).alias("e"),
    )
    grouped = entries.groupBy("dir", "e.kind", "e.path").agg(F.count_if(~F.col("doomed")).alias("left"))
    step = F.when(F.col("kind") == "file", F.lit(0)).otherwise(F.lit(1))
    return grouped.filter(F.col("left") == 0).select(
        "dir", "kind", "path", step.alias("step"), F.length("path").alias("path_length"))
