"""Token ids of whole texts by a tokenizer file of the ``tokenizers`` library, word by word with a cache.

Byte-pair merges never cross a pre-token, so texts may be cut at spaces where the pre-tokenizer cuts too. Each distinct
piece is then encoded once per worker (about a tenth of all pieces). Texts and tokenizers for which such cuts aren't
known to be safe are encoded whole, so ids are always those of ``encode(text, add_special_tokens=False)``, strings of
special tokens in a text being ordinary text.
"""

from __future__ import annotations

import functools
import json
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

CACHE_BYTES = 224 << 20  # about, per worker; the cache starts anew when it is full
LONGEST_PIECE = 1_024    # longer pieces are encoded with their text and not kept
SIGN = "\x01"
TAILS = (".", ",")
TOGETHER = 512           # pieces learned in one call


class TextEncoder:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.encode_special_tokens = True
        config = json.loads(text)
        self.cut, self.lead = _cuts(config)
        # A tokenizer that lower-cases texts meets fewer pieces if ASCII texts come in lower case.
        self.lower = any(s.get("type") == "Lowercase" for s in (config.get("normalizer") or {}).get("normalizers", []))
        if self.lead:
            # The byte-level sign of a space, with which the first token of a piece begins.
            size = self.tokenizer.get_vocab_size()
            self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("\u0120") for i in range(size)])
        else:
            # A sign that is one token wherever it stands alone; put between pieces, it shows where they end.
            alone, amid = (self.tokenizer.encode(x, add_special_tokens=False).ids for x in (SIGN, f"a {SIGN} b"))
            self.sign = alone[0] if len(alone) == 1 and amid.count(alone[0]) == 1 else None
        self._forget()

    def _forget(self) -> None:
        """Ids by piece (in ``lead`` tokenizers: of the piece after a space), and of pieces that a text begins with."""
        self.pieces: dict[str, bytes | None] = {}
        self.heads: dict[str, bytes | None] = {} if self.lead else self.pieces
        self.room = CACHE_BYTES

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if not self.cut:
            return [self._whole(t) for t in texts]
        if self.room < 0:
            self._forget()
        split = [(t.lower() if self.lower and t.isascii() else t).split(" ") for t in texts]
        heads = [p.pop(0) for p in split]
        self._learn_heads(set(heads).difference(self.heads))
        # One look-up a piece: what isn't found (few, once the cache is warm) is learned and put in its place.
        looked = [list(map(self.pieces.get, pieces)) for pieces in split]
        open_ = [i for i, found in enumerate(looked) if None in found]
        missing = {p for i in open_ for p, ids in zip(split[i], looked[i]) if ids is None and p not in self.pieces}
        self._learn_tails({p for p in missing if p[-1:] in TAILS and p[-2:-1].isalpha()}, missing)
        for i in open_:
            looked[i] = [self.pieces[p] if ids is None else ids for p, ids in zip(split[i], looked[i])]
        out = []
        for text, head, ids in zip(texts, heads, looked):
            try:
                out.append(self.heads[head] + b"".join(ids))
            except TypeError:  # a piece that can't be taken alone
                out.append(self._whole(text))
        return out

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _learn_heads(self, new: set[str]) -> None:
        alone = self._fit(new, self.heads)
        for start in range(0, len(alone), TOGETHER):
            some = alone[start:start + TOGETHER]
            for piece, got in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.heads[piece] = _bytes(got.ids)

    def _learn_tails(self, tails: set[str], new: set[str]) -> None:
        """Letters and a sign at the end are pre-tokens of their own: such a piece is its beginning and the sign."""
        known = self.pieces
        self._learn((new - tails).union(t[:-1] for t in tails if t[:-1] not in known))
        self._learn_heads(set(TAILS).difference(self.heads))
        signs = {t: self.heads[t] for t in TAILS}
        for tail in tails:
            start = known[tail[:-1]]
            known[tail] = None if start is None else start + signs[tail[-1]]
        self.room -= 190 * len(tails)

    def _learn(self, new: set[str]) -> None:
        """Many pieces at once: the ids of a run of pieces are cut where the next piece begins."""
        if self.lead:
            # A space before more white space is part of a run, which is one pre-token.
            apart = {p for p in new if not p or p[0].isspace()}
            self.pieces.update(dict.fromkeys(apart))
        else:
            apart = {p for p in new if self.sign is None or SIGN in p}
            self._learn_heads(apart)
        alone, between = self._fit(new - apart, self.pieces), " " if self.lead else f" {SIGN} "
        for start in range(0, len(alone), TOGETHER):
            some = alone[start:start + TOGETHER]
            run = " " + " ".join(some) if self.lead else between.join(some)
            ids = np.array(self.tokenizer.encode_batch_fast([run], add_special_tokens=False)[0].ids, dtype="<u4")
            if self.lead:
                starts = np.flatnonzero(self.begins[ids]) * 4
                ends = [*starts[1:].tolist(), len(ids) * 4]
                starts = starts.tolist()
            else:
                ends = [*(np.flatnonzero(ids == self.sign) * 4).tolist(), len(ids) * 4]
                starts = [0, *(e + 4 for e in ends[:-1])]
            if len(ends) != len(some):
                raise ValueError("the tokenizer doesn't begin pieces where it was expected to")
            whole = ids.tobytes()
            self.pieces.update(zip(some, map(whole.__getitem__, map(slice, starts, ends))))

    def _fit(self, new: set[str], into: dict[str, bytes | None]) -> list[str]:
        """Those short enough to be kept; about what they take is booked."""
        long = {p for p in new if len(p) > LONGEST_PIECE}
        into.update(dict.fromkeys(long))
        alone = list(new - long)
        self.room -= sum(map(len, new)) * 2 + 190 * len(new)
        return alone


def _bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _cuts(config: dict) -> tuple[bool, bool]:
    """Whether texts may be cut at spaces, and whether the space belongs to the piece after it."""
    before, normal = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if before.get("type") == "ByteLevel" and normal is None:
        return bool(before.get("use_regex", True)) and not before.get("add_prefix_space"), True
    steps = before.get("pretokenizers", [])
    kinds = [s.get("type") for s in (normal or {}).get("normalizers", [])]
    dropped = len(steps) == 2 and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    pattern = steps[0]["pattern"].get("Regex", " ") if dropped else " "
    no_space = "\\s" not in pattern.replace("[^\\s", "") and " " not in pattern
    plain = all(k in ("NFC", "Replace", "Lowercase") for k in kinds)
    return bool(no_space and plain and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space")), False


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TextEncoder:
    """The encoder of a worker process, kept between its tasks."""
    return TextEncoder(path)
