"""Transcript text expressions: tokens, fuzzy token equality, overlap lengths, remainders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The punctuation a token comparison ignores, and the markers of failed or special output.
TOKEN_PUNCTUATION = '.,!?;:"()—-'
FAILED_PREFIX = "[transcription error]"
FAILED_PREFIX_STRICT = "[transcription error"
FAILED_CHUNK = "[Error processing chunk]"
SPECIAL_PIECES = ("<blank>", "<pad>", "<unk>")
WORD_BOUNDARY = "▁"
WORD_CONTINUATION = "##"

_BLANK_EDGES = r"(?U)^\s+|(?U)\s+$"


def _single_spaced(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), " {2,}", " ")


def _split(text: Column, prepared: Column) -> Column:
    return F.when(text.rlike(r"(?U)\S"), F.split(prepared, " ")).otherwise(F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """Words between single spaces, empty ones dropped; none for blank text."""
    return _split(text, _single_spaced(text))


def is_plain(text: Column) -> Column:
    """Whether only single spaces separate the words of a text; there may be more before and after."""
    return ~text.rlike(r"(?U)[^\S ]") & (F.trim(text) == _single_spaced(text))


def normalize_token(token: Column) -> Column:
    return F.translate(F.lower(token), TOKEN_PUNCTUATION, "")


def normalized_tokens(text: Column) -> Column:
    """The tokens of a text without case and punctuation, position by position; one may be empty. The whole text is
    normalised at once, which is the same because neither rule crosses a space."""
    return _split(text, normalize_token(_single_spaced(text)))


def trimmed(text: Column) -> Column:
    """Without white space at both ends. The expression, which looks at every character, is left for ends that aren't spaces."""
    return bind(F.trim(text), lambda t: F.when(
        F.concat(F.substring(t, 1, 1), F.substring(t, -1, 1)).rlike(r"(?U)\s"), F.regexp_replace(t, _BLANK_EDGES, "")).otherwise(t))


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body`` (a lambda value is not re-evaluated per use)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def token_equal(a: Column, b: Column, max_dist: int = 1) -> Column:
    """Equal, or at most ``max_dist`` edits apart. Inputs are normalised tokens."""
    return (a == b) | (F.levenshtein(a, b, max_dist) >= 0)


def token_arrays_match(a: Column, b: Column, max_dist: int = 1) -> Column:
    """Position by position over two arrays of normalised tokens; different lengths never match."""
    same = F.forall(
        F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda p: token_equal(p["x"], p["y"], max_dist),
    )
    return (F.size(a) == F.size(b)) & F.when(F.size(a) == F.size(b), same).otherwise(F.lit(False))


def search_width(words: Column, fraction: float) -> Column:
    """Longest overlap to look for: twice the fraction of the previous words (single precision), at least 5."""
    width = (words.cast("float") * F.lit(fraction).cast("float") * F.lit(2.0).cast("float")).cast("int")
    return F.greatest(F.lit(5), width)


def matching_lengths(prev: Column, cur: Column, longest: Column, max_dist: int = 1, skip: Column | None = None) -> Column:
    """All k, longest first, for which the last k tokens of ``prev`` match the first k of ``cur``; the first ``skip`` of
    these are not compared.

    Inputs are normalised token arrays. Most k fail at their first token, which is compared alone; then the comparison stops at
    the first differing token.
    """
    n = F.size(prev)
    skip = F.lit(0) if skip is None else skip
    top = F.least(longest, n, F.size(cur))
    lengths = F.when(top > 0, F.sequence(top, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    begun = F.filter(lengths, lambda k: (k <= skip) | token_equal(F.get(prev, n - k + skip), F.get(cur, skip), max_dist))
    return F.filter(
        begun,
        lambda k: (k <= skip + 1) | F.forall(
            F.sequence(skip + 1, k - 1),
            lambda j: token_equal(F.get(prev, n - k + j), F.get(cur, j), max_dist),
        ),
    )


def leading_phrase(words: Column, k: Column) -> Column:
    return F.array_join(F.slice(words, F.lit(1), k), " ")


def remainder(text: Column, words: Column, k: Column) -> Column:
    """``text`` without its first ``k`` words: the phrase is searched ignoring case, and text in which it cannot
    be found (runs of spaces) stays whole."""
    cut = bind(leading_phrase(words, k), lambda phrase: bind(
        F.instr(F.lower(text), F.lower(phrase)),
        lambda at: F.when(at > 0, trimmed(F.substring(text, at + F.length(phrase), F.length(text)))).otherwise(text)))
    return F.when(k > 0, cut).otherwise(text)


def is_failed(text: Column, strict: bool = False) -> Column:
    """Failed recognition by prefix. The default prefix has a closing bracket, which real error texts
    (``[Transcription error: ...]``) do not carry; ``strict`` catches those and failed chunks too."""
    low = F.lower(text)
    if strict:
        failed = low.startswith(FAILED_PREFIX_STRICT) | (text == FAILED_CHUNK)
    else:
        failed = low.startswith(FAILED_PREFIX)
    return F.coalesce(failed, F.lit(False))
