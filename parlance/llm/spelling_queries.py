"""The query of the spelling variants and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import spelling
from parlance.llm.base import table
from parlance.llm.merkle_queries import CRC_TABLE, crc32

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '{spelling.LETTERS}')) AS run FROM documents WHERE text IS NOT NULL),
each AS (SELECT run, doc_id::VARCHAR || ':' || run AS k, count(*) AS n FROM runs GROUP BY ALL),
marked AS (SELECT run, n, {crc32("k")} AS h FROM each, crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM marked),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM words WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS part FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INTEGER) AS i FROM v)),
pairs AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM less a JOIN less b ON a.part = b.part AND a.i = b.i AND a.word < b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN v b ON a.part = b.word),
near AS (SELECT * FROM pairs UNION SELECT b, bn, a, an FROM pairs),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-bn, b)) AS form, max(bn) AS form_n FROM near GROUP BY a),
known AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * v.n THEN form END AS form, CASE WHEN form_n >= 2 * v.n THEN form_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word),
chain AS (SELECT word, word AS at, 0 AS i FROM known UNION ALL SELECT c.word, k.form, c.i + 1 FROM chain c JOIN known k ON k.word = c.at WHERE k.form IS NOT NULL)
SELECT k.word, k.form, r.root, k.n, k.n_near, k.form_n FROM known k JOIN (SELECT word, max_by("at", i) AS root FROM chain GROUP BY word) r ON r.word = k.word"""


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf, "documents").select("doc_id", "text"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "word").cast("binary"))
    at = (F.col("h") % F.length("word")).cast("int")
    shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % 97 == 0, shorter).otherwise(F.col("word")).alias("word"))
    return spelling.variant_groups(spelling.vocabulary(words)).select("word", "form", "root", "n", "n_near", "form_n")
