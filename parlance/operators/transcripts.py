"""Transcript operators: tokens, fuzzy overlap, merge of overlapping chunk transcripts, agreement, detokenising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.ordered import BLOCK, concat_ordered, salted_join, sequence_block, with_previous

CHUNKS_PER_BLOCK = 1_024
TOKENS_PER_BLOCK = 65_536
DEFAULT_FRACTION = 0.04
# Fixed value: the fraction the transcription flow passes. It is the overlap in seconds, not 2/50, so the search
# covers the whole text.
FLOW_FRACTION = 2.0
CLIP = ["clip_id"]


def tokenize(df: DataFrame, text: str = "text") -> DataFrame:
    words = tx.tokens(F.col(text))
    return df.withColumns({"tokens": words, "normalized": tx.normalized_tokens(F.col(text))})


def fuzzy_token_match(df: DataFrame, left: str, right: str, max_dist: int = 1) -> DataFrame:
    """Whether two texts have equally many tokens and each pair is equal or ``max_dist`` edits apart."""
    a, b = (tx.normalized_tokens(F.col(c)) for c in (left, right))
    return df.withColumn("matches", tx.bind(
        F.struct(a.alias("a"), b.alias("b")), lambda p: tx.token_arrays_match(p["a"], p["b"], max_dist)))


def _longest_overlap(prev: Column, cur: Column, fraction: float) -> Column:
    """Longest overlap in words between two texts, 0 when there is none (tokens are prepared once)."""
    both = F.struct(tx.normalized_tokens(prev).alias("a"), tx.normalized_tokens(cur).alias("b"))
    return tx.bind(both, lambda p: F.coalesce(
        F.get(tx.matching_lengths(p["a"], p["b"], tx.search_width(F.size(p["a"]), fraction)), F.lit(0)), F.lit(0)))


def detect_overlap(df: DataFrame, fraction: float = DEFAULT_FRACTION, per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """For each chunk after the first: words shared by the end of the previous text and the start of this one."""
    linked = with_previous(df, CLIP, ["chunk_idx"], sequence_block("chunk_idx", per_block), {"prev_text": "text"})
    prev, cur = F.coalesce("prev_text", F.lit("")), F.coalesce("text", F.lit(""))
    return linked.withColumn("overlap_words", _longest_overlap(prev, cur, fraction)).withColumn(
        "overlap_text",
        F.when(F.col("overlap_words") > 0, tx.leading_phrase(tx.tokens(F.col("text")), F.col("overlap_words"))),
    ).drop("prev_text")


def _prepared(text: Column) -> Column:
    return F.struct(tx.tokens(text).alias("w"), tx.normalized_tokens(text).alias("n"), tx.is_plain(text).alias("plain"))


def _lost(kept: Column, text: Column, words: Column, fraction: float) -> Column:
    """Words ``text`` loses after ``kept``, the normalised words left of the text before it. The phrase must occur in the
    raw text; otherwise the text stays whole."""
    def found(k):
        at = F.instr(F.lower(text), F.lower(tx.leading_phrase(words["w"], k)))
        return F.when(k > 0, F.when(at > 0, k).otherwise(F.lit(0))).otherwise(F.lit(0))

    longest = F.get(tx.matching_lengths(kept, words["n"], tx.search_width(F.size(kept), fraction)), F.lit(0))
    return tx.bind(F.coalesce(longest, F.lit(0)), found)


def _kept(piece: Column, words: Column, lost: Column) -> Column:
    """Normalised words of what is left of a text. Of a plain text these are its last words."""
    return F.when(words["plain"], F.slice(words["n"], lost + 1, F.size(words["n"]))).otherwise(tx.normalized_tokens(piece))


def _left(text: Column, words: Column, lost: Column) -> Column:
    """What is left of a text: ``struct(state, piece, kept)``."""
    return tx.bind(tx.remainder(text, words["w"], lost), lambda piece: F.struct(
        lost.alias("state"), piece.alias("piece"), _kept(piece, words, lost).alias("kept")))


def _possible(prev: Column, text: Column, fraction: float) -> Column:
    """Numbers of words that ``text`` can lose, whatever ``prev`` lost; a few more may be listed.

    What is left of ``prev`` is an end of it, so its words are those of ``prev``, but for the first one where ``prev`` is not
    plain. White space at the end is trimmed with the first word lost, so such a ``prev`` says nothing about its last word.
    """
    def listed(p):
        n = F.size(p["a"])
        skip = F.when(tx.is_plain(prev), F.lit(0)).otherwise(F.lit(1))
        matching = tx.bind(skip, lambda i: tx.matching_lengths(p["a"], p["b"], tx.search_width(n, fraction), skip=i))
        return F.when(prev.rlike(r"(?U)[^\S ]$"), F.sequence(F.lit(0), F.size(p["b"]))).otherwise(
            F.array_distinct(F.concat(F.array(F.lit(0)), matching)))

    return tx.bind(F.struct(tx.normalized_tokens(prev).alias("a"), tx.normalized_tokens(text).alias("b")), listed)


def _blocks(df: DataFrame, fraction: float, per_block: int) -> DataFrame:
    """``(clip_id, block, chunks, carried, states)``: chunks in order, the last text before the block, and the numbers of
    words that text may have lost."""
    chunk = F.struct(F.col("chunk_idx").cast("long").alias("chunk_idx"), F.coalesce("text", F.lit("")).alias("text"))
    # Rows without a key have no place in a chain.
    keyed = df.filter(F.col("clip_id").isNotNull() & F.col("chunk_idx").isNotNull()).withColumn(BLOCK, sequence_block("chunk_idx", per_block))
    blocks = keyed.filter(F.col(BLOCK).isNotNull()).groupBy("clip_id", BLOCK).agg(F.sort_array(F.collect_list(chunk)).alias("chunks"))
    said = F.filter("chunks", lambda c: c["text"] != "")
    before = Window.partitionBy("clip_id").orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    ends = blocks.select("clip_id", BLOCK, F.slice(F.reverse(said), 1, 2)["text"].alias("ends")).select(
        "clip_id", BLOCK, F.get("ends", F.lit(0)).alias("last"), F.get("ends", F.lit(1)).alias("second"))
    prev = F.coalesce("second", "carried", F.lit(""))
    carried = ends.withColumn("carried", F.last("last", ignorenulls=True).over(before)).withColumn(
        "states", F.when(F.col("last").isNotNull(), _possible(prev, F.col("last"), fraction))).select(
        "clip_id", BLOCK, F.coalesce("carried", F.lit("")).alias("carried"),
        F.coalesce(F.last("states", ignorenulls=True).over(before), F.array(F.lit(0))).alias("states"))
    return blocks.join(carried, ["clip_id", BLOCK])


def _ways(fraction: float) -> Column:
    """Every way through a block of ``_blocks``: ``struct(lead, entries, tracks)``.

    An entry is a number of words lost before the block: what is left then, which the ``lead`` empty chunks repeat, the words
    ``after`` lost by the first text, and those lost at the block's end. The rest of the block depends on ``after`` only, so
    there is one track for each.
    """
    chunks, carried = F.col("chunks"), F.col("carried")
    at = F.array_position(F.transform(chunks, lambda c: c["text"] != ""), True).cast("int")

    def add(acc, c):
        def say(p):
            return tx.bind(_lost(acc["now"]["kept"], c["text"], p, fraction), lambda k: _left(c["text"], p, k))

        now = F.when(c["text"] == "", acc["now"]).otherwise(tx.bind(_prepared(c["text"]), say))
        return tx.bind(now, lambda x: F.struct(x.alias("now"), F.concat(
            acc["pieces"], F.array(F.struct(c["chunk_idx"].alias("chunk_idx"), x["piece"].alias("piece")))).alias("pieces")))

    def entry(state, b, words, first):
        # The text itself is needed only where empty chunks repeat it, or its words don't follow from those of the whole.
        piece = F.when((b["lead"] > 0) | ~words["plain"], tx.remainder(carried, words["w"], state))
        return tx.bind(piece, lambda x: tx.bind(_kept(x, words, state), lambda kept: F.struct(
            state.alias("entering"), x.alias("piece"),
            F.when(b["first"].isNotNull(), _lost(kept, b["first"]["text"], first, fraction)).alias("after"))))

    def track(after, b, first):
        start = tx.bind(_left(b["first"]["text"], first, after), lambda x: F.struct(x.alias("now"), F.array(
            F.struct(b["first"]["chunk_idx"].alias("chunk_idx"), x["piece"].alias("piece"))).alias("pieces")))
        return tx.bind(F.aggregate(b["rest"], start, add), lambda x: F.struct(
            after.alias("after"), x["now"]["state"].alias("exit"), x["pieces"].alias("pieces")))

    def through(b, first, entries):
        begun = F.array_distinct(F.filter(entries["after"], lambda k: k.isNotNull()))
        return tx.bind(F.transform(begun, lambda k: track(k, b, first)), lambda tracks: F.struct(
            b["lead"].alias("lead"),
            F.transform(entries, lambda e: F.struct(
                e["entering"].alias("entering"), e["piece"].alias("piece"), e["after"].alias("after"),
                F.coalesce(_track(tracks, e)["exit"], e["entering"]).alias("exit"))).alias("entries"),
            tracks.alias("tracks")))

    block = tx.bind(F.when(at > 0, at - 1).otherwise(F.size(chunks)), lambda m: F.struct(
        m.alias("lead"), F.get(chunks, m).alias("first"), F.slice(chunks, m + 2, F.size(chunks)).alias("rest")))
    return tx.bind(block, lambda b: tx.bind(_prepared(b["first"]["text"]), lambda first: tx.bind(
        tx.bind(_prepared(carried), lambda words: F.transform("states", lambda s: entry(s, b, words, first))),
        lambda entries: through(b, first, entries))))


def _track(tracks: Column, entry: Column) -> Column:
    return F.get(F.filter(tracks, lambda t: t["after"] == entry["after"]), F.lit(0))


def _entry(entries: Column, state: Column) -> Column:
    return F.get(F.filter(entries, lambda e: e["entering"] == state), F.lit(0))


def merge_pieces(df: DataFrame, fraction: float = DEFAULT_FRACTION, per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """``(clip_id, block, pieces ARRAY<chunk_idx, piece>)``: what each chunk adds to the merged transcript.

    Each chunk is compared with what was *kept* of the chunk before it, so the rule is a chain. A block of ``per_block`` chunks
    is followed in parallel for each of the few numbers of words that the text before it may have lost; across the blocks of
    a longer clip the chain is look-ups, a short array per block. Empty chunks repeat the piece before them.
    """
    ways = _blocks(df, fraction, per_block).select("clip_id", BLOCK, "chunks", _ways(fraction).alias("way"))
    effects = ways.select("clip_id", BLOCK, F.transform("way.entries", lambda e: F.struct(e["entering"], e["exit"])).alias("entries"))
    chain = effects.groupBy("clip_id").agg(F.sort_array(F.collect_list(F.struct(BLOCK, "entries"))).alias("chain"))
    start = F.struct(F.lit(0).alias("state"), F.array().cast(f"array<struct<{BLOCK}:bigint,entering:int>>").alias("out"))

    def step(acc, b):
        return F.struct(
            _entry(b["entries"], acc["state"])["exit"].alias("state"),
            F.concat(acc["out"], F.array(F.struct(b[BLOCK].alias(BLOCK), acc["state"].alias("entering")))).alias("out"))

    entering = chain.select("clip_id", F.explode(F.aggregate("chain", start, step)["out"]).alias("o")).select(
        "clip_id", f"o.{BLOCK}", "o.entering")
    none = F.array().cast("array<struct<chunk_idx:bigint,piece:string>>")

    def pieces(e):
        lead = F.transform(F.slice("chunks", F.lit(1), F.col("way.lead")), lambda c: F.struct(
            c["chunk_idx"].alias("chunk_idx"), e["piece"].alias("piece")))
        return F.concat(lead, F.coalesce(_track(F.col("way.tracks"), e)["pieces"], none))

    return ways.join(entering, ["clip_id", BLOCK]).select(
        "clip_id", BLOCK, tx.bind(_entry(F.col("way.entries"), F.col("entering")), pieces).alias("pieces"))


def merge_transcripts(df: DataFrame, fraction: float = DEFAULT_FRACTION, per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """One merged text per clip, by the rule of ``merge_pieces``. Blocks join their pieces first, once for each way through
    them that texts can take (nearly always one), so texts are compared once; the clip picks the ways in order."""
    def parts(w):
        return F.struct(
            F.transform(w["entries"], lambda e: F.struct(
                e["entering"].alias("entering"), e["after"].alias("after"), e["exit"].alias("exit"),
                F.when(w["lead"] > 0, F.array_join(F.array_repeat(e["piece"], w["lead"]), " ")).alias("part"))).alias("entries"),
            F.transform(w["tracks"], lambda t: F.struct(
                t["after"].alias("after"), F.array_join(t["pieces"]["piece"], " ").alias("part"))).alias("tracks"))

    blocks = _blocks(df, fraction, per_block).select(
        "clip_id", BLOCK, F.size("chunks").cast("long").alias("n"), tx.bind(_ways(fraction), parts).alias("way"))

    def step(acc, b):
        return tx.bind(_entry(b["way"]["entries"], acc["state"]), lambda e: F.struct(
            e["exit"].alias("state"),
            F.concat(acc["parts"], F.array(F.concat_ws(" ", e["part"], _track(b["way"]["tracks"], e)["part"]))).alias("parts")))

    start = F.struct(F.lit(0).alias("state"), F.array().cast("array<string>").alias("parts"))
    merged = blocks.groupBy("clip_id").agg(
        F.sum("n").alias("chunks"), F.sort_array(F.collect_list(F.struct(BLOCK, "way"))).alias("chain")).select(
        "clip_id", "chunks", F.array_join(F.aggregate("chain", start, step)["parts"], " ").alias("text"))
    return merged.withColumn(
        "text", F.when(F.col("chunks") > 1, F.regexp_replace("text", r"(?U)\s+$", "")).otherwise(F.col("text")))


def concat_transcripts(df: DataFrame, per_block: int = CHUNKS_PER_BLOCK) -> DataFrame:
    """Texts of a clip in order, empty ones skipped, joined by spaces. Clips without any text keep an empty row.
    This is also the result when texts and chunks differ in number: no overlap is removed."""
    texts = df.select("clip_id", F.col("chunk_idx").cast("long").alias("chunk_idx"), F.nullif("text", F.lit("")).alias("text"))
    return concat_ordered(texts, CLIP, ["chunk_idx"], sequence_block("chunk_idx", per_block), "text", " ", "text")


def transcript_agreement(df: DataFrame, expected: str = "expected", actual: str = "actual", min_rate: float = 0.8) -> DataFrame:
    """Equal after lower-casing and trimming, or enough of the expected words present (distinct hits over all
    expected words)."""
    def prepared(name):
        return F.lower(tx.trimmed(F.col(name)))

    def words(text):
        return F.filter(F.split(text, " "), lambda w: w != "")

    hits = F.size(F.array_intersect(words(prepared(expected)), words(prepared(actual))))
    total = F.size(words(prepared(expected)))
    rate = F.when(total > 0, hits / total).otherwise(F.lit(0.0))
    return df.withColumn("match_rate", rate).withColumn(
        "agrees", (prepared(expected) == prepared(actual)) | (F.col("match_rate") >= min_rate))


def _finish(text: Column) -> Column:
    return tx.trimmed(F.replace(F.replace(text, F.lit(tx.WORD_BOUNDARY), F.lit(" ")), F.lit(tx.WORD_CONTINUATION), F.lit("")))


def detokenize(ids: DataFrame, vocab: DataFrame | None = None, per_block: int = TOKENS_PER_BLOCK) -> DataFrame:
    """``(clip_id, seq, token_id)`` -> text per clip. Ids outside the vocabulary and special pieces are skipped; without
    a vocabulary, ids 1..255 are character codes. Clips without usable pieces yield an empty text.

    The vocabulary is joined without a hint, so Spark broadcasts it only below its size threshold; beyond, frequent ids are
    spread over several tasks.
    """
    if vocab is None:
        code = F.col("token_id")
        pieces = ids.withColumn("piece", F.when((code > 0) & (code < 256), F.chr(code)))
        return concat_ordered(pieces, CLIP, ["seq"], sequence_block("seq", per_block), "piece", "", "text")
    usable = vocab.filter((F.col("piece") != "") & ~F.col("piece").isin(*tx.SPECIAL_PIECES)).select("token_id", "piece")
    pieces = salted_join(ids, usable, ["token_id"], F.col("seq"), "left", salts=8)
    texts = concat_ordered(pieces, CLIP, ["seq"], sequence_block("seq", per_block), "piece", "", "text")
    return texts.withColumn("text", _finish(F.col("text")))


def progressive_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Every word prefix of a reply, each with a trailing space, in order. Map-side: prefixes stay in their row."""
    rest = [c for c in df.columns if c != text]
    words = df.select(*rest, F.split(text, " ").alias("__words"))
    return words.select(*rest, "__words", F.explode(F.sequence(F.lit(1), F.size("__words"))).alias("step")).select(
        *rest, "step", F.concat(F.array_join(F.slice("__words", F.lit(1), F.col("step")), " "), F.lit(" ")).alias("partial"))
