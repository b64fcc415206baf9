"""Manifest queries: artifacts from ``part``, listings from ``lineitem``."""

from pyspark.sql import functions as F

from parlance import proxies
from parlance.catalog.registry import register
from parlance.operators import manifests

_F = "'f' || (1 + ({}) % 100) || '.bin'"
MANIFEST = f"""px_manifest AS (SELECT p_partkey AS artifact_id, p_type AS artifact_type, p_name AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'vendor/' ELSE 'hub/' END || p_brand AS repo, {_F.format('p_partkey')} AS primary_file,
  CAST(trunc(p_retailprice * 1000000) AS BIGINT) AS expected_bytes, p_partkey AS dir, p_size >= 25 AS is_required,
  [{_F.format('p_partkey * 13')}] AS additional_files, [{_F.format('p_partkey * 7')}] AS alternates,
  [(p_partkey % 10) || '.BIN'] AS include_patterns, p_size % 2 = 0 AS is_available FROM part),
px_files AS (SELECT DISTINCT l_partkey AS dir, 'f' || l_suppkey || '.bin' AS rel_path FROM lineitem)"""
RESOLVED = f"""{MANIFEST}, ranked AS (SELECT m.artifact_id, f.rel_path AS path,
    CASE WHEN f.rel_path = m.primary_file THEN 0 WHEN f.rel_path = m.alternates[1] THEN 1
         WHEN ends_with(lower(f.rel_path), lower(m.include_patterns[1])) THEN 1000000 END AS rank
  FROM px_manifest m JOIN px_files f ON f.dir = m.dir),
best AS (SELECT artifact_id, arg_min(path, (rank, path)) AS path, min(rank) AS rank FROM ranked WHERE rank IS NOT NULL GROUP BY artifact_id),
resolved AS (SELECT m.artifact_id, b.path AS resolved_file, CASE b.rank WHEN 0 THEN 'primary' WHEN 1 THEN 'alternate' WHEN 1000000 THEN 'pattern' END AS rule
  FROM px_manifest m LEFT JOIN best b ON b.artifact_id = m.artifact_id),
audit AS (SELECT r.*, f.dir IS NULL AS lacks, m.additional_files[1] AS extra, r.resolved_file IS NOT NULL AND f.dir IS NOT NULL AS complete
  FROM resolved r JOIN px_manifest m ON m.artifact_id = r.artifact_id LEFT JOIN px_files f ON f.dir = m.dir AND f.rel_path = m.additional_files[1])"""


@register("explode_manifest", f"""WITH {MANIFEST}
SELECT artifact_id, dir, 'primary' AS kind, 0 AS priority, primary_file AS file FROM px_manifest
UNION ALL SELECT artifact_id, dir, 'alternate', 1, alternates[1] FROM px_manifest
UNION ALL SELECT artifact_id, dir, 'additional', 0, additional_files[1] FROM px_manifest""")
def explode_manifest(spark, sf):
    return manifests.explode_manifest(proxies.manifest(spark, sf))


@register("resolve_primary", f"WITH {RESOLVED} SELECT * FROM resolved")
def resolve_primary(spark, sf):
    return manifests.resolve_primary(proxies.manifest(spark, sf), proxies.files(spark, sf))


@register("match_includes", f"""WITH {MANIFEST} SELECT m.artifact_id, f.rel_path AS file FROM px_manifest m JOIN px_files f
  ON f.dir = m.dir AND ends_with(lower(f.rel_path), lower(m.include_patterns[1]))""")
def match_includes(spark, sf):
    return manifests.match_includes(proxies.manifest(spark, sf), proxies.files(spark, sf))


def _audit(spark, sf):
    return manifests.audit_completeness(proxies.manifest(spark, sf), proxies.files(spark, sf))


@register("audit_completeness", f"""WITH {RESOLVED} SELECT artifact_id, resolved_file, rule, CASE WHEN lacks THEN extra ELSE '' END AS missing, complete FROM audit""")
def audit_completeness(spark, sf):
    return _audit(spark, sf).withColumn("missing", F.array_join("missing", ","))


@register("catalogue_status", f"""WITH {RESOLVED} SELECT m.artifact_id, name, artifact_type AS type, repo,
  CASE WHEN complete THEN 'downloaded' ELSE 'not_downloaded' END AS status, CASE WHEN resolved_file IS NOT NULL THEN dir END AS local_dir,
  round(expected_bytes / 1048576.0, 6) AS expected_size_mb, is_required, is_available,
  artifact_type IN ('STANDARD', 'PROMO') AS listed_as_gated, artifact_type IN ('STANDARD', 'PROMO') OR starts_with(repo, 'vendor/') AS download_is_gated
FROM px_manifest m JOIN audit a ON a.artifact_id = m.artifact_id""")
def catalogue_status(spark, sf):
    listed = manifests.catalogue_status(
        proxies.manifest(spark, sf), _audit(spark, sf), gated_types=["STANDARD", "PROMO"], gated_prefixes=["Vendor/"])
    return listed.withColumn("expected_size_mb", F.round("expected_size_mb", 6))


_RESULTS = "results AS (SELECT p_partkey AS artifact_id, p_partkey % 3 <> 0 AS success FROM part WHERE p_partkey % 4 <> 0)"
_OUTCOMES = f"""{RESOLVED}, {_RESULTS}, outcomes AS (SELECT m.artifact_id, m.name,
  CASE WHEN a.complete THEN 'cached' WHEN r.success THEN 'fetched' ELSE 'failed' END AS outcome
  FROM px_manifest m JOIN audit a ON a.artifact_id = m.artifact_id LEFT JOIN results r ON r.artifact_id = m.artifact_id WHERE m.is_required)"""


def _summary(spark, sf):
    key = F.col("p_partkey")
    results = proxies.table(spark, sf, "part").filter(key % 4 != 0).select(key.alias("artifact_id"), (key % 3 != 0).alias("success"))
    return manifests.ensure_summary(proxies.manifest(spark, sf), _audit(spark, sf), results)


@register("ensure_summary", f"WITH {_OUTCOMES} SELECT *, outcome IN ('cached', 'fetched') AS ready FROM outcomes")
def ensure_summary(spark, sf):
    return _summary(spark, sf)


@register("ready_count", f"""WITH {_OUTCOMES} SELECT count(*) FILTER (WHERE outcome IN ('cached', 'fetched')) AS ready, count(*) AS total,
  count(*) FILTER (WHERE outcome = 'cached') AS cached, count(*) FILTER (WHERE outcome = 'disabled') AS disabled,
  count(*) FILTER (WHERE outcome = 'fetched') AS fetched, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM outcomes""")
def ready_count(spark, sf):
    return manifests.ready_count(_summary(spark, sf))


# Nested listing: d<n>/e<m>/f<supplier>.bin; the artifacts of every third part are deleted.
_NEST = "'d' || (({0}) % 3) || '/e' || (({0}) % 5) || '/f' || ({0}) || '.bin'"


@register("delete_plan", f"""WITH tree AS (SELECT DISTINCT l_partkey AS dir, {_NEST.format('l_suppkey')} AS rel_path FROM lineitem),
doomed AS (SELECT DISTINCT l_partkey AS dir, {_NEST.format('l_suppkey')} AS rel_path FROM lineitem WHERE l_linenumber = 1 AND l_partkey % 3 = 0),
marked AS (SELECT t.dir, t.rel_path, d.dir IS NOT NULL AS gone FROM tree t LEFT JOIN doomed d ON d.dir = t.dir AND d.rel_path = t.rel_path WHERE t.dir % 3 = 0),
entries AS (SELECT dir, gone, 'file' AS kind, rel_path AS path FROM marked
  UNION ALL SELECT dir, gone, 'directory', '' FROM marked
  UNION ALL SELECT dir, gone, 'directory', split_part(rel_path, '/', 1) FROM marked
  UNION ALL SELECT dir, gone, 'directory', split_part(rel_path, '/', 1) || '/' || split_part(rel_path, '/', 2) FROM marked)
SELECT dir, kind, path, CASE WHEN kind = 'file' THEN 0 ELSE 1 END AS step, CAST(length(path) AS INTEGER) AS path_length
FROM entries GROUP BY dir, kind, path HAVING bool_and(gone)""")
def delete_plan(spark, sf):
    supp = F.col("l_suppkey")
    nested = F.concat(F.lit("d"), (supp % 3).cast("string"), F.lit("/e"), (supp % 5).cast("string"), F.lit("/f"),
                      supp.cast("string"), F.lit(".bin"))
    items = proxies.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("dir"), nested.alias("rel_path"), "l_linenumber")
    listing = items.select("dir", "rel_path")
    artifacts = items.filter("l_linenumber = 1 AND dir % 3 = 0").select(
        "dir", F.col("rel_path").alias("primary_file"), F.array("rel_path").alias("additional_files"))
    # Parts without a doomed file still belong to the plan: an artifact whose files are absent.
    absent = items.filter("dir % 3 = 0").select(
        "dir", F.lit("absent.bin").alias("primary_file"), F.array().cast("array<string>").alias("additional_files")).distinct()
    return manifests.delete_plan(artifacts.unionByName(absent), listing)
