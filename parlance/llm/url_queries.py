"""The query of the host reputation operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import reputation
from parlance.llm.base import table

RULES = [
    reputation.Rule("allow", "org", "/"), reputation.Rule("block", "example.org", "/es/"), reputation.Rule("block", "example.org", "/en/1"),
    reputation.Rule("allow", "com", "/fr/"), reputation.Rule("block", "com", "/de/"),
]
PLAN = reputation.Reputation(limit=0.3, tail=0.05)

_FITS = " ".join(
    f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text} {r.verdict}'"
    for r in sorted(RULES, key=lambda r: -len(r.text)))


def _level(name: str, rows: str, mean: str) -> str:
    """CTEs that shrink the rows of a level to ``mean``: their concentration, and the beta parameters."""
    return f"""{name}_p AS (SELECT x.*, {mean} AS mean FROM {rows}),
{name}_c AS (SELECT sum((bad - n * mean) * (bad - n * mean) - n * (mean * (1 - mean))) AS over, sum(n * (n - 1) * (mean * (1 - mean))) AS pairs FROM {name}_p WHERE n > 0),
{name}_m AS (SELECT CASE WHEN coalesce(pairs, 0) = 0 THEN {reputation.LEAST} WHEN over / pairs <= 1 / ({reputation.MOST} + 1) THEN {reputation.MOST}
  ELSE greatest({reputation.LEAST}, 1 / (over / pairs) - 1) END AS m FROM {name}_c),
{name} AS (SELECT p.*, m * mean + bad AS a, m * (1 - mean) + (n - bad) AS b FROM {name}_p p, {name}_m)"""


SQL = f"""WITH rest AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
told AS (SELECT doc_id, CAST(quality = 0 OR toxic = 1 AS INTEGER) AS bad FROM labels),
hosts AS (SELECT host, CAST(count(t.bad) AS DOUBLE) AS n, CAST(coalesce(sum(t.bad), 0) AS DOUBLE) AS bad FROM parts LEFT JOIN told t ON t.doc_id = page_id GROUP BY host),
named AS (SELECT *, trim(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS name FROM hosts),
split AS (SELECT *, string_split(name, '.') AS l, NOT contains(name, '.') OR regexp_full_match(name, '[0-9.]+') AS single FROM named),
placed AS (SELECT host, n, bad, CASE WHEN single THEN name ELSE l[-2] || '.' || l[-1] END AS domain, CASE WHEN single THEN '' ELSE l[-1] END AS suffix FROM split),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM placed GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
total AS (SELECT (coalesce(sum(bad), 0) + 0.5) / (coalesce(sum(n), 0) + 1) AS rate FROM suffixes),
{_level("top", "suffixes x, total", "rate")},
{_level("middle", "domains x JOIN top USING (suffix)", "a / (a + b)")},
{_level("last", "placed x JOIN middle USING (domain)", "a / (a + b)")},
spread AS (SELECT host, n, bad, a, b, sqrt(1 / a + 1 / (2 * a * a) + 1 / b + 1 / (2 * b * b)) AS s FROM last),
grid AS (SELECT *, ln(a / b) - {reputation.WIDTH} * s AS low, {2 * reputation.WIDTH / reputation.STEPS} * s AS step, unnest(range({reputation.STEPS + 1})) AS i FROM spread),
high AS (SELECT *, exp(-a * ln(1 + exp(-(low + i * step))) - b * ln(1 + exp(low + i * step)) + a * ln(1 + b / a) + b * ln(1 + a / b)) AS h FROM grid),
walk AS (SELECT *, sum(h) OVER (PARTITION BY host ORDER BY i) AS upto, {PLAN.tail} * sum(h) OVER (PARTITION BY host) AS goal FROM high),
bound AS (SELECT host, n, bad, a / (a + b) AS rate, 1 / (1 + exp(-(low + step * (i + (goal - (upto - h)) / h - 0.5)))) AS bound FROM walk
  WHERE upto >= goal AND upto - h < goal QUALIFY row_number() OVER (PARTITION BY host ORDER BY i) = 1),
judged AS (SELECT page_id, host, path, n, bad, rate, bound, CASE {_FITS} END AS fits FROM parts JOIN bound USING (host))
SELECT page_id, host, path, split_part(fits, ' ', 1) AS rule, CASE WHEN fits IS NOT NULL THEN split_part(fits, ' ', 2) WHEN bound > {PLAN.limit} THEN 'block' ELSE 'allow' END AS verdict,
  CAST(n AS BIGINT) AS outcomes, CAST(bad AS BIGINT) AS bad_outcomes, round(rate, 6) AS rate, round(bound, 6) AS bound FROM judged"""


def op11_host_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Bad pages are those labelled as of low quality or toxic (the label of the document of the page's id)."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    out = reputation.judge_urls(table(spark, sf, "pages").select("page_id", "url"), table(spark, sf, "labels"), bad, RULES, plan=PLAN)
    return out.select("page_id", "host", "path", "rule", "verdict", "outcomes", "bad_outcomes", F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"))
