"""Whole texts to token ids by a byte-level BPE, with equal words encoded once per worker.

The tokenizer's own pattern splits a text into words, each encoded alone. No word reaches over a single
space that has other characters on both sides, so a text is first cut at its spaces, which is cheap, and only
pieces not met before are split by the pattern. A space with white space on both sides (or at the end) can
belong to a longer run; such texts are split by the pattern as a whole. Special tokens are cut out before.

The memo holds at most ``MEMO`` words and pieces; beyond that, new ones are encoded each time they come.
It changes no result.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import regex

MEMO = 1_000_000
ID = np.dtype("<u4")
# The pattern of the public byte-level vocabulary, and its printable stand-ins for bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]

# A superset of what any tokenizer takes for white space around a space.
_RUN = re.compile(r"[^\S ] (?:[^\S ]|\Z)")


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary file."""
    others = [b for b in range(256) if b not in _PRINTABLE]
    return {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """``encode_word`` gives the ids of one word as little-endian unsigned 32-bit bytes."""

    def __init__(self, encode_word: Callable[[str], bytes], special: dict[str, int], memo: int | None = None):
        self._encode_word = encode_word
        self._most = memo
        self._special = {s: np.array([i], ID).tobytes() for s, i in special.items()}
        self._cut = re.compile("|".join(map(re.escape, special))) if special else None
        self._words = regex.compile(PATTERN).findall
        self._memo: dict[str, bytes] = {}  # a word or piece, without the space before it
        self._bare: dict[str, bytes] = {}  # a word without a space before it

    def _keep(self, memo: dict[str, bytes], key: str, ids: bytes) -> bytes:
        if len(self._memo) + len(self._bare) < (self._most or MEMO):
            memo[key] = ids
        return ids

    def _word(self, word: str) -> bytes:
        memo, key = (self._memo, word[1:]) if word[0] == " " else (self._bare, word)
        ids = memo.get(key)
        return self._keep(memo, key, self._encode_word(word)) if ids is None else ids

    def _piece(self, piece: str) -> bytes:
        """Ids of a space and the piece after it."""
        words = self._words(f" {piece}")
        if len(words) == 1:
            return self._word(words[0])
        return self._keep(self._memo, piece, b"".join(map(self._word, words)))

    def _plain(self, text: str) -> bytes:
        if "  " in text or _RUN.search(text):
            return b"".join(map(self._word, self._words(text)))
        first, *rest = text.split(" ")
        found = list(map(self._memo.get, rest))
        if None in found:
            found = [self._piece(piece) if ids is None else ids for piece, ids in zip(rest, found)]
        return b"".join(map(self._word, self._words(first))) + b"".join(found)

    def ids(self, text: str | None) -> bytes:
        """All ids of a text; none for null."""
        if not text:
            return b""
        if self._cut is None or not any(s in text for s in self._special):
            return self._plain(text)
        out, at = [], 0
        for match in self._cut.finditer(text):
            out += [self._plain(text[at : match.start()]), self._special[match.group()]]
            at = match.end()
        return b"".join([*out, self._plain(text[at:])])


def settings(path: str) -> dict:
    """The tokenizer file, which must be of the kind this module splits: byte-level with its own pattern."""
    with open(path, encoding="utf-8") as file:
        shape = json.load(file)
    split = shape["pre_tokenizer"] or {}
    if shape["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
        raise ValueError(f"{path} is not a plain byte-level tokenizer")
    return shape


def special_tokens(shape: dict) -> dict[str, int]:
    return {t["content"]: t["id"] for t in shape["added_tokens"]}


@lru_cache(maxsize=2)
def library_encoder(path: str, plain: bool = False, memo: int | None = None) -> TextEncoder:
    """One per Python worker; the ids of each word come from the tokenizers library. ``plain``: the strings of
    special tokens are ordinary text. ``memo``: a bound of its own, instead of ``MEMO``."""
    from tokenizers import Tokenizer

    tokenize, stand_ins = Tokenizer.from_file(path).model.tokenize, byte_chars()

    def encode_word(word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(stand_ins)
        return np.array([token.id for token in tokenize(spelled)], ID).tobytes()

    return TextEncoder(encode_word, {} if plain else special_tokens(settings(path)), memo)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public tokenizer file; the same on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
