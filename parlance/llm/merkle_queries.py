"""The query of the Merkle manifest and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import merkle
from parlance.llm.base import table

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

# The CRC-32 of a text in DuckDB: the table of a byte's remainders by rule, then a fold over the bytes of the text.
CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, i:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc32(text: str) -> str:
    octets = f"list_transform(range(strlen({text})), lambda i: CAST('0x' || substr(hex({text}), CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, o: xor(c >> 8, t[CAST(xor(c, o) & 255 AS INTEGER) + 1])), 4294967295)"


def _digest(text: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({v})::VARCHAR || ':' || {v}, '-')" for v in values) + ")"


def _levels(name: str, leaves: str, group: str) -> str:
    """All nodes of the trees over ``leaves`` (group, pos, digest), by level."""
    return f"""{name} AS (SELECT {group} AS g, 0 AS level, pos, digest, count(*) OVER (PARTITION BY {group}) AS n FROM {leaves}
  UNION ALL (SELECT g, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM {name} WHERE n > 1 GROUP BY g, level, n, pos // 16))"""


def _steps(nodes: str, leaves: str) -> str:
    """For each leaf and level: what stands before and after its ancestor in the run."""
    return f"""SELECT l.id, x.level, coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos < x.pos), '') AS before,
  coalesce(string_agg(s.digest, '' ORDER BY s.pos) FILTER (WHERE s.pos > x.pos), '') AS after
  FROM {leaves} l JOIN {nodes} x ON x.g = l.g AND x.pos = l.pos // CAST(16 ** x.level AS BIGINT) AND x.n > 1
  JOIN {nodes} s ON s.g = x.g AND s.level = x.level AND s.pos // 16 = x.pos // 16 GROUP BY l.id, x.level"""


SQL = f"""WITH RECURSIVE {CRC_TABLE},
docs AS (SELECT row_number() OVER () AS id, coalesce('=' || source, '') AS g, doc_id, {_digest("text")} AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0
  THEN {_digest("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_digest("text")} END AS seen FROM documents, crc),
leaves AS (SELECT *, leaf AS digest, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
{_levels("trees", "leaves", "g")},
subs AS (SELECT g AS source, row_number() OVER (ORDER BY g) AS id, '' AS g, digest, row_number() OVER (ORDER BY g) - 1 AS pos FROM trees WHERE n = 1),
{_levels("tops", "subs", "g")},
low AS ({_steps("trees", "leaves")}),
high AS ({_steps("tops", "subs")}),
steps AS (SELECT id, level, before, after FROM low UNION ALL
  SELECT l.id, 100 + h.level, h.before, h.after FROM leaves l JOIN subs s ON s.source = l.g JOIN high h ON h.id = s.id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY level) AS i FROM steps),
fold AS (SELECT id, 0 AS i, seen AS digest FROM leaves UNION ALL
  SELECT f.id, f.i + 1, sha256(n.before || f.digest || n.after) FROM fold f JOIN numbered n ON n.id = f.id AND n.i = f.i + 1),
folded AS (SELECT id, max_by(digest, i) AS folded_root FROM fold GROUP BY id),
proofs AS (SELECT id, sha256(string_agg(before || after, '' ORDER BY level)) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = t.digest AS verified
FROM leaves l JOIN subs s ON s.source = l.g JOIN folded f ON f.id = l.id LEFT JOIN proofs p ON p.id = l.id, (SELECT digest FROM tops WHERE n = 1) t"""


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(*COLUMNS)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return merkle.manifest(docs, COLUMNS, seen={"text": F.when(tampered, lower).otherwise(F.col("text"))})
