"""Whole-text ids of a tokenizer that drops white space, word by word through a cache.

The tokenizers library encodes each distinct word once per worker process; a
text's ids are its words' ids one after another. That equals the library's
encoding of the whole text for tokenizers which, like word_bpe_49k, split at
white space before anything can join across it and lower-case what they read.
Texts with "<|", where special tokens may stand, are encoded whole.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
from tokenizers import Tokenizer

from .common import LOWER_BYTES, kept
from .token_counts import byte_symbols

#: words of Latin letters alone, then perhaps of signs alone: the library cuts between the two
_LETTERS = re.compile(rb"((?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!\"#$%&()*+,./:;=>?@\\^_`{}~\[\]-]*)")
_SYMBOLS = dict(enumerate(byte_symbols()))


class _Words(dict):
    """ids of words as little-endian unsigned 32-bit bytes; two generations bound its size."""

    def __init__(self, encoder: Tokenizer, limit: int):
        super().__init__()
        self.encoder, self.limit, self.old = encoder, limit, {}
        self.tokenize = encoder.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        if (ids := self.old.get(word)) is None:
            if word.isalpha():  # ASCII letters only
                ids = array("I", [t.id for t in self.tokenize(word.decode())]).tobytes()
            elif (cut := _LETTERS.fullmatch(word)) and cut[2]:
                ids = self[cut[1]] + self[cut[2]]
            elif cut:
                letters = word.decode().lower().encode().decode("latin-1").translate(_SYMBOLS)
                ids = array("I", [t.id for t in self.tokenize(letters)]).tobytes()
            else:
                ids = np.array(self.encoder.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordTokenizer:
    def __init__(self, path: str, limit: int = 300_000):
        self.encoder = Tokenizer.from_file(path)
        self.encoder.no_truncation()
        self.encoder.no_padding()
        self.words = _Words(self.encoder, limit)

    def encode(self, text: bytes | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers; null and empty have none."""
        if not text:
            return b""
        if b"<|" in text:
            return np.array(self.encoder.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words
        return b"".join([words[w] for w in text.translate(LOWER_BYTES).replace(b"\n", b" ").split(b" ") if w])


def word_tokenizer(path: str, limit: int = 300_000) -> WordTokenizer:
    """The process's tokenizer for a file, loaded once."""
    return kept("word tokens", (path, limit), lambda: WordTokenizer(path, limit))
