"""Transcript queries over ``documents`` (cut into overlapping chunks), ``conversations``, ``lineitem`` and ``part``."""

from pyspark.sql import functions as F

from parlance import proxies
from parlance.catalog.registry import register
from parlance.functions import audio
from parlance.operators import transcripts

_SIZE, _STRIDE = proxies.WORDS_PER_CHUNK, proxies.WORDS_PER_CHUNK - proxies.WORDS_OVERLAP
CHUNK_TEXTS = rf"""doc_words AS (SELECT doc_id AS clip_id,
    list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS words FROM documents),
chunk_texts AS (SELECT clip_id, CAST(i AS INTEGER) AS chunk_idx,
    array_to_string(words[i * {_STRIDE} + 1 : i * {_STRIDE} + {_SIZE}], ' ') AS text
  FROM doc_words, LATERAL (SELECT unnest(range(CAST(greatest(0, ceil((len(words) - {_SIZE}) / {_STRIDE}.0)) AS BIGINT) + 1)) AS i))"""
# The same with what real chunks have: missing text, leading spaces, runs of spaces, tabs.
NOISY_TEXTS = f"""{CHUNK_TEXTS}, noisy AS (SELECT clip_id, chunk_idx, CASE
    WHEN (clip_id + chunk_idx) % 11 = 5 THEN NULL WHEN (clip_id + chunk_idx) % 7 = 3 THEN '  ' || text
    WHEN (clip_id + chunk_idx) % 13 = 6 THEN replace(text, 'e ', 'e  ')
    WHEN (clip_id + chunk_idx) % 17 = 9 THEN replace(text, ' d', ' ' || chr(9) || 'd') ELSE text END AS text FROM chunk_texts)"""

# DuckDB measures edit distance in bytes, so each letter of more than one byte is mapped to a control character.
_WIDE = "ßäçèéêíñóöü"
_NARROW = " || ".join(f"chr({i + 14})" for i in range(len(_WIDE)))


def _normal(x):
    return f"""translate(regexp_replace(lower({x}), '[.,!?;:"()—-]+', '', 'g'), '{_WIDE}', {_NARROW})"""


def _words(x):
    return rf"CASE WHEN regexp_matches({x}, '\S') THEN list_filter(string_split({x}, ' '), lambda w: w <> '') ELSE [] END"


def _normals(words):
    return f"list_transform({words}, lambda t: {_normal('t')})"


def _width(n, fraction):
    product = f"CAST({n} AS FLOAT) * CAST({fraction} AS FLOAT) * CAST(2 AS FLOAT)"
    return f"greatest(5, CAST(trunc({product}) AS INTEGER))"


def _longest(a, b, width):
    """Longest k with the last k of list a matching the first k of list b."""
    at, bt = f"{a}[len({a}) - k + j + 1]", f"{b}[j + 1]"
    return f"""coalesce(list_max(list_filter(range(1, least({width}, len({a}), len({b})) + 1), lambda k:
      len(list_filter(range(k), lambda j: {at} <> {bt} AND levenshtein({at}, {bt}) > 1)) = 0)), 0)"""


def noisy_chunks(spark, sf):
    key, text = F.col("clip_id") + F.col("chunk_idx"), F.col("text")
    return proxies.chunk_texts(spark, sf).withColumn(
        "text",
        F.when(key % 11 == 5, F.lit(None).cast("string")).when(key % 7 == 3, F.concat(F.lit("  "), text))
        .when(key % 13 == 6, F.replace(text, F.lit("e "), F.lit("e  ")))
        .when(key % 17 == 9, F.replace(text, F.lit(" d"), F.lit(" \td"))).otherwise(text))


@register("tokenize", f"""WITH t AS (SELECT doc_id, {_words('text')} AS tokens FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS pos, tokens[i + 1] AS token, regexp_replace(lower(tokens[i + 1]), '[.,!?;:"()—-]+', '', 'g') AS normalized
FROM t, LATERAL (SELECT unnest(range(len(tokens))) AS i)""")
def tokenize(spark, sf):
    tokens = transcripts.tokenize(proxies.table(spark, sf, "documents").select("doc_id", "text"))
    pairs = F.arrays_zip("tokens", "normalized")
    return tokens.select("doc_id", F.posexplode(pairs).alias("pos", "p")).select(
        "doc_id", "pos", F.col("p.tokens").alias("token"), "p.normalized")


@register("fuzzy_token_match", f"""WITH p AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || '!'
    WHEN 1 THEN 'x' || p_name WHEN 2 THEN p_name || ' q' ELSE reverse(p_name) END AS b FROM part),
t AS (SELECT p_partkey, {_normals(_words('a'))} AS a, {_normals(_words('b'))} AS b FROM p)
SELECT p_partkey, len(a) = len(b) AND len(list_filter(range(len(a)), lambda j: a[j + 1] <> b[j + 1] AND levenshtein(a[j + 1], b[j + 1]) > 1)) = 0
  AS matches FROM t""")
def fuzzy_token_match(spark, sf):
    name, k = F.col("p_name"), F.col("p_partkey") % 4
    pairs = proxies.table(spark, sf, "part").select(
        "p_partkey", name.alias("a"),
        F.when(k == 0, F.concat(F.upper(name), F.lit("!"))).when(k == 1, F.concat(F.lit("x"), name))
        .when(k == 2, F.concat(name, F.lit(" q"))).otherwise(F.reverse(name)).alias("b"))
    return transcripts.fuzzy_token_match(pairs, "a", "b").select("p_partkey", "matches")


@register("detect_overlap", f"""WITH {NOISY_TEXTS}, linked AS (SELECT clip_id, chunk_idx, text,
    coalesce(lag(text) OVER (PARTITION BY clip_id ORDER BY chunk_idx), '') AS prev, coalesce(text, '') AS cur FROM noisy),
w AS (SELECT *, {_words('prev')} AS pw, {_words('cur')} AS cw FROM linked),
n AS (SELECT *, {_normals('pw')} AS pn, {_normals('cw')} AS cn FROM w),
k AS (SELECT *, {_longest('pn', 'cn', _width('len(pn)', 0.1))} AS k FROM n)
SELECT clip_id, chunk_idx, CAST(k AS INTEGER) AS overlap_words, CASE WHEN k > 0 THEN array_to_string(cw[1 : k], ' ') END AS overlap_text FROM k""")
def detect_overlap(spark, sf, **blocks):
    return transcripts.detect_overlap(noisy_chunks(spark, sf), 0.1, **blocks).drop("text")


def merge_sql(texts, fraction):
    """CTEs that fold ``texts`` (clip_id, chunk_idx, cur) into ``merged`` (clip_id, chunks, text); needs WITH RECURSIVE."""
    return rf"""texts AS ({texts}),
prepared AS (SELECT *, {_words('cur')} AS cw, {_normals(_words('cur'))} AS cn FROM texts),
fold AS (
  SELECT clip_id, chunk_idx, cur AS prev, cur AS merged FROM prepared WHERE chunk_idx = 0
  UNION ALL
  SELECT clip_id, chunk_idx, piece, merged || ' ' || piece FROM (
    SELECT *, CASE WHEN prev = '' THEN cur WHEN cur = '' THEN prev WHEN k = 0 OR spot = 0 THEN cur
      ELSE regexp_replace(substr(cur, spot + length(phrase)), '^\s+|\s+$', '', 'g') END AS piece
    FROM (SELECT *, instr(lower(cur), lower(phrase)) AS spot FROM (SELECT *, array_to_string(cw[1 : k], ' ') AS phrase
    FROM (SELECT *, {_longest('pn', 'cn', _width('len(pn)', fraction))} AS k
    FROM (SELECT p.clip_id, p.chunk_idx, p.cur, p.cw, p.cn, f.prev, f.merged, {_normals(_words('f.prev'))} AS pn
      FROM fold f JOIN prepared p ON p.clip_id = f.clip_id AND p.chunk_idx = f.chunk_idx + 1)))))),
merged AS (SELECT clip_id, count(*) AS chunks, CASE WHEN count(*) > 1 THEN regexp_replace(arg_max(merged, chunk_idx), '\s+$', '')
  ELSE arg_max(merged, chunk_idx) END AS text FROM fold GROUP BY clip_id)"""


def _merge_sql(fraction):
    return f"""WITH RECURSIVE {NOISY_TEXTS}, {merge_sql("SELECT clip_id, chunk_idx, coalesce(text, '') AS cur FROM noisy", fraction)}
SELECT * FROM merged"""


@register("merge_transcripts", _merge_sql(0.1))
def merge_transcripts(spark, sf, **blocks):
    return transcripts.merge_transcripts(noisy_chunks(spark, sf), 0.1, **blocks)


@register("merge_transcripts_flow", _merge_sql(2.0))
def merge_transcripts_flow(spark, sf, **blocks):
    return transcripts.merge_transcripts(noisy_chunks(spark, sf), transcripts.FLOW_FRACTION, **blocks)


@register("concat_transcripts", f"""WITH {NOISY_TEXTS} SELECT clip_id, coalesce(string_agg(text, ' ' ORDER BY chunk_idx)
  FILTER (WHERE text <> ''), '') AS text FROM noisy GROUP BY clip_id""")
def concat_transcripts(spark, sf, **blocks):
    return transcripts.concat_transcripts(noisy_chunks(spark, sf), **blocks)


@register("transcript_agreement", rf"""WITH pairs AS (SELECT conv_id, turn, text AS expected,
    CASE turn % 4 WHEN 0 THEN '  ' || lower(text) || ' ' WHEN 1 THEN substr(text, 1, length(text) * 9 // 10)
      WHEN 2 THEN substr(text, length(text) // 2) ELSE 'nothing alike' END AS actual FROM conversations),
n AS (SELECT *, regexp_replace(lower(expected), '^\s+|\s+$', '', 'g') AS e, regexp_replace(lower(actual), '^\s+|\s+$', '', 'g') AS a FROM pairs),
w AS (SELECT *, list_filter(string_split(e, ' '), lambda x: x <> '') AS ew, list_filter(string_split(a, ' '), lambda x: x <> '') AS aw FROM n),
r AS (SELECT *, CASE WHEN len(ew) > 0 THEN len(list_distinct(list_intersect(ew, aw))) / len(ew) ELSE 0.0 END AS rate FROM w)
SELECT conv_id, turn, round(rate, 6) AS match_rate, e = a OR rate >= 0.8 AS agrees FROM r""")
def transcript_agreement(spark, sf):
    text, t = F.col("text"), F.col("turn") % 4
    n = F.length(text)
    pairs = proxies.table(spark, sf, "conversations").select(
        "conv_id", "turn", text.alias("expected"),
        F.when(t == 0, F.concat(F.lit("  "), F.lower(text), F.lit(" ")))
        .when(t == 1, F.substring(text, F.lit(1), audio.div(n * 9, 10).cast("int")))
        .when(t == 2, F.substring(text, audio.div(n, 2).cast("int"), n)).otherwise("nothing alike").alias("actual"))
    return transcripts.transcript_agreement(pairs).select("conv_id", "turn", F.round("match_rate", 6).alias("match_rate"), "agrees")


_VOCAB = """CASE WHEN p_partkey % 9 = 0 THEN '<unk>' WHEN p_partkey % 9 = 1 THEN '' WHEN p_partkey % 9 = 2 THEN '##' || p_brand
  WHEN p_partkey % 2 = 0 THEN '▁' || p_type ELSE p_brand END"""


_IDS = """ids AS (SELECT l_suppkey AS clip_id, l_partkey AS token_id, row_number() OVER (PARTITION BY l_suppkey
  ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS seq FROM lineitem)"""


@register("detokenize", rf"""WITH {_IDS}, v AS (SELECT p_partkey AS token_id, {_VOCAB} AS piece FROM part),
j AS (SELECT i.clip_id, string_agg(piece, '' ORDER BY seq) FILTER (WHERE piece NOT IN ('', '<blank>', '<pad>', '<unk>')) AS t
      FROM ids i LEFT JOIN v ON v.token_id = i.token_id GROUP BY i.clip_id)
SELECT clip_id, regexp_replace(replace(replace(coalesce(t, ''), '▁', ' '), '##', ''), '^\s+|\s+$', '', 'g') AS text FROM j""")
def detokenize(spark, sf, **blocks):
    key = F.col("p_partkey")
    vocab = proxies.table(spark, sf, "part").select(
        key.alias("token_id"),
        F.when(key % 9 == 0, "<unk>").when(key % 9 == 1, "").when(key % 9 == 2, F.concat(F.lit("##"), "p_brand"))
        .when(key % 2 == 0, F.concat(F.lit("▁"), "p_type")).otherwise(F.col("p_brand")).alias("piece"))
    return transcripts.detokenize(proxies.token_ids(spark, sf), vocab, **blocks)


@register("detokenize_characters", f"""WITH {_IDS} SELECT clip_id, coalesce(string_agg(chr(CAST(32 + token_id % 90 AS INTEGER)), '' ORDER BY seq)
  FILTER (WHERE token_id % 5 <> 0), '') AS text FROM ids GROUP BY clip_id""")
def detokenize_characters(spark, sf, **blocks):
    ids = proxies.token_ids(spark, sf)
    code = F.when(F.col("token_id") % 5 == 0, F.lit(0)).otherwise(32 + F.col("token_id") % 90)
    return transcripts.detokenize(ids.withColumn("token_id", code), **blocks)


@register("progressive_text", """WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS words FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, CAST(i AS INTEGER) AS step, array_to_string(words[1 : i], ' ') || ' ' AS partial
FROM w, LATERAL (SELECT unnest(range(1, len(words) + 1)) AS i)""")
def progressive_text(spark, sf):
    replies = proxies.table(spark, sf, "conversations").filter("role = 'assistant'").select("conv_id", "turn", "text")
    return transcripts.progressive_text(replies)


