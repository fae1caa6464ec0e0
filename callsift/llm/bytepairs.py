"""Byte-pair encoding of single words with the tokenizers library.

A call of a tokenizer's ``encode`` costs several times the merging of a word.
What the vocabulary's splitting keeps whole goes to the library's model alone,
which does the merging; everything else goes through ``encode``.
"""

from __future__ import annotations

import functools
import os
import struct

import numpy as np


def _alphabet() -> dict[int, str]:
    """The letter by which byte-level vocabularies name each byte: printable
    ones their own, the others, in order, those from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


ALPHABET = _alphabet()


class Pieces:
    """Encoder of parts of texts; it holds no texts itself."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        if hasattr(self.tok.model, "_resize_cache"):
            self.tok.model._resize_cache(0)  # words are remembered by the callers
        self.merge = self.tok.model.tokenize
        self.vocabulary = max(self.tok.get_vocab().values()) + 1

    def alone(self, text: str) -> bytes:
        """Little-endian uint32 ids of any text."""
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, text: str) -> bytes:
        """The ids of a normalized text that the vocabulary does not split."""
        ids = [t.id for t in self.merge(text.encode().decode("latin-1").translate(ALPHABET))]
        return struct.pack(f"<{len(ids)}I", *ids)


pieces = functools.cache(Pieces)


class Known(dict):
    """What ``encode`` makes of each key, remembered: two generations of at most
    half of ``size`` entries; those in use move on to the new one."""

    def __init__(self, encode, size: int):
        super().__init__()
        self.encode, self.size = encode, size
        self.old: dict = {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.encode(key)
        self[key] = found
        return found

    def turn(self) -> None:
        """Between texts: the older generation goes when the new one is full."""
        if len(self) > self.size // 2:
            self.old = dict(self)
            self.clear()
