"""Chat formatting by prefix-target expansion, on built-in functions.

Every assistant turn becomes an example of its own: all turns before it are context, and only its reply is trainable. An
example's text is the formatted conversation up to and including the reply; the loss mask is one span of code points.
Examples of a conversation add up to the square of its turns: that is what the expansion means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Strings that mark turns, and those of other templates that a tokenizer may know. None is left inside a text.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "<<SYS>>", "<</SYS>>"]
BEGIN, BETWEEN, END = "<s>[ROLE]", "[/ROLE]", "</s>"
_CONTROL = r"<(?=/?s>|</?SYS>>)|\[(?=/?(?:INST|ROLE)\])"
_TURN = r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>"


def escape(text: Column) -> Column:
    """Double the backslashes, then put one behind the first character of every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def expand(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, target, text, loss_start, loss_end``: one example per assistant turn.

    ``target`` is the reply's position in the conversation (from 0). A conversation that doesn't end with an assistant
    turn gets one more example, without loss (``loss_start`` NULL), that holds all its turns. Turns are ordered by number,
    equal numbers by role and text, NULL first; NULL roles and texts are empty; rows with a NULL conversation are one
    conversation. Other columns are ignored; an empty table gives an empty result.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                        F.coalesce(F.col(text), F.lit("")).alias("text"))
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(BETWEEN))
    rows = rows.withColumns({"head": head, "body": escape(F.col("text"))}).withColumn("piece", F.concat("head", "body", F.lit(END)))
    parts = F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece", F.length("body").alias("size"))))
    whole = rows.groupBy("conv").agg(parts.alias("parts"))
    last = F.size("parts") - 1
    targets = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get("parts", i)["role"] == "assistant") | (i == last))
    examples = whole.select("conv", "parts", F.explode(targets).alias("target"))
    examples = examples.select(
        "conv", "target", F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("target") + 1), lambda p: p["piece"]), "").alias("text"),
        F.get("parts", F.col("target")).alias("reply"))
    trained = F.col("reply.role") == "assistant"
    end = F.length("text") - len(END)
    return examples.select(
        F.col("conv").alias(conv), "target", "text", F.when(trained, end - F.col("reply.size")).alias("loss_start"), F.when(trained, end).alias("loss_end"))


def read_back(examples: DataFrame, conv: str = "conv_id") -> DataFrame:
    """``conv, roles, texts, replies, formatted_chars`` of each conversation, from its examples alone: the turns of the
    longest example, and what lies under each example's loss mask, in order and unescaped."""
    masked = F.when(F.col("loss_start").isNotNull(), unescape(F.col("text").substr(F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))))
    own = examples.select(F.col(conv), "target", "text", masked.alias("reply"))
    whole = own.groupBy(conv).agg(
        F.max_by("text", "target").alias("text"), F.sum(F.length("text")).cast("long").alias("formatted_chars"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("target", "reply")))), lambda r: r["reply"]).alias("replies"))
    roles, texts = (F.transform(F.regexp_extract_all("text", F.lit(_TURN), F.lit(i)), unescape) for i in (1, 2))
    return whole.select(conv, roles.alias("roles"), texts.alias("texts"), "replies", "formatted_chars")
