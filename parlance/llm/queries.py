"""One query per operator, over its whole table with production parameters, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import chat, jaccard, lines, merkle_queries, mixing, packing, phrases, quality, shards, spelling_queries, tokenfiles, url_queries, warc
from parlance.llm.base import table, written

LABELS = ["quality", "toxic"]
# Shares of the mixed tokens: mostly good text, some rough text, hardly any toxic text.
WEIGHTS = {"quality=1,toxic=0": 0.92, "quality=0,toxic=0": 0.06, "quality=1,toxic=1": 0.02}
WHOLE = "quality=1,toxic=0"


def tokenizer_path(name: str) -> str:
    """Where the vocabulary files of public tokenizers are installed, on the driver as on the executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# In DuckDB: the six white space characters, and A-Z to a-z only.
_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return query

    return add


@register("op3_ngram_jaccard_join", f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM w),
u AS (SELECT doc_id, len(g) AS n, unnest(g) AS s FROM g),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM g UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id FROM g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = g.doc_id""")
def op3_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    found = jaccard.jaccard_classes(table(spark, sf, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


@register("op4_line_dedup", f"""WITH l AS (SELECT doc_id, r, unnest(t) AS line, unnest(range(len(t))) AS i
  FROM (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
k AS (SELECT *, {_lower(f"trim(line, {_SPACES})")} AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON k.key = c.key GROUP BY doc_id, r""")
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return lines.drop_common_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@register("op8_quality_divergence")
def op8_quality_divergence(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return quality.score_quality(docs, columns=["doc_id"]).select("doc_id", "quality.*")


@register("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@register("op10_soft_mixing")
def op10_soft_mixing(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out, mix = mixing.mix_to_targets(docs, table(spark, sf, "labels"), LABELS, WEIGHTS)
    shares = [F.get("posteriors", F.lit(i)).alias("p_" + d.replace("=", "").replace(",", "_")) for i, d in enumerate(mix.classifier.domains)]
    return out.select("doc_id", "n_tokens", *shares, "rate", "copies")


@register("op5_phrase_fingerprints")
def op5_phrase_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.edit_fingerprints(table(spark, sf, "documents").select("doc_id", "text"))


@register("op7_token_files")
def op7_token_files(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return tokenfiles.token_files_round_trip(docs, tokenizer_path("word_bpe_49k.json"), end_id=2)


_ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"


@register("op1_warc_round_trip", f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS sha FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr({_ALPHABET},
  CAST((CAST('0x' || substr(sha, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  max(page_id) OVER (PARTITION BY sha) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = head THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> head THEN head END AS refers_to FROM b""")
def op1_warc_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf, "pages"), min_revisit_bytes=0)
    records = warc.read_archives(archives)
    # A record that can't be read back is no row without a page, but a failure.
    whole = F.when(F.col("error").isNull(), warc.key_of("record_id")).otherwise(F.raise_error(F.concat_ws(": ", "archive", F.col("offset").cast("string"), "error")))
    return records.select(whole.alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          warc.key_of("refers_to").alias("refers_to"))


@register("op2_lpt_shards")
def op2_lpt_shards(spark: SparkSession, sf: str) -> DataFrame:
    dealt = shards.balanced_shards(table(spark, sf, "documents").select("doc_id", "text"), shards=16)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _escaped(text: str) -> str:
    """Code points of an escaped text."""
    added = [f"(length({text}) - length(replace({text}, '{c}', ''))) // {len(c)}" for c in ["\\", *chat.CONTROL]]
    return f"(length({text}) + {' + '.join(added)})"


@register("op6_prefix_targets", f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, sum({len(chat.BEGIN + chat.BETWEEN + chat.END)} + {_escaped("role")} + {_escaped("text")}) OVER w AS upto,
  lead(turn) OVER w IS NULL AS is_last FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (WHERE role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""")
def op6_prefix_targets(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", control), (-1, 1, "assistant", control)], "conv_id long, turn long, role string, text string")
    examples = written(chat.expand(turns.union(added)), "examples")
    back = chat.read_back(examples)
    spoken = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    trained = F.array_join("replies", "")
    return back.select(
        "conv_id", F.size("texts").cast("long").alias("n_turns"), F.sha2(F.array_join(spoken, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(trained).cast("long").alias("loss_chars"), F.sha2(trained.cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


register("op11_host_reputation", url_queries.SQL)(url_queries.op11_host_reputation)
register("op12_spelling_variants", spelling_queries.SQL)(spelling_queries.op12_spelling_variants)
register("op13_merkle_manifest", merkle_queries.SQL)(merkle_queries.op13_merkle_manifest)
