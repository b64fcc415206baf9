"""Words and shingles of texts as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text in order; A-Z count as a-z, words end at ASCII white space (as bytes.split has it)."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Hashes of the distinct ``width``-word shingles, ascending. Fewer words: the whole sequence as one; none: empty."""
    words = word_hashes(text)
    if not len(words):
        return words
    span = min(width, len(words))
    out = np.full(len(words) - span + 1, span, _U)
    for i in range(span):
        out = _mixed(out * _U(0x9E3779B97F4A7C15) + words[i:len(words) - span + 1 + i])
    return np.unique(out)
