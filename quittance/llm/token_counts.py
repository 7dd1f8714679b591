"""Byte-level BPE token counts by rank-synchronous merging of ragged arrays.

A batch's distinct pre-tokens stand end to end in one array of symbols. In each
round every sequence finds its lowest-rank pair and all sequences apply theirs
at once, at all its places from the left; the symbols that survive are counted. Counts of chunks
(a word with the space before it) are kept in a cache of bounded size.

Texts whose white space is more than single spaces and line feeds between words, or
that hold a special token's string, are pre-tokenised whole, without the cache.

Cases: null and empty texts have 0 bytes and 0 tokens; texts of any length are
read whole; repeated rows are counted row by row; of pairs with equal rank the leftmost merges first; other columns
are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import kept, map_texts

OUT = "n_bytes bigint, n_tokens bigint"
#: the published pre-tokenisation pattern of byte-level BPE (fixed value)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NO_RANK = np.int32(2**31 - 1)
_WHOLE = -(1 << 60)  # a chunk that cannot be counted on its own


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(others)) for b in range(256)]


class BytePairs:
    """Merge tables of a tokenizers .json file with a ByteLevel pre-tokenizer."""

    def __init__(self, path: str, limit: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.first = np.array([vocab[c] for c in byte_symbols()], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special_bytes = [s.encode() for s in self.special]
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.limit, self.chunks = limit, {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def count(self, tokens: Sequence[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token (none may be empty)."""
        lengths = np.array([len(t) for t in tokens], np.int64)
        left = np.zeros(len(tokens), np.int64)
        owner = np.arange(len(tokens))
        symbols = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        ranks = None
        while len(owner):
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            if ranks is None:
                ranks = np.full(len(symbols), NO_RANK, np.int32)
                ranks[:-1] = self._rank(symbols[:-1], symbols[1:])
                ranks[starts + lengths - 1] = NO_RANK
            lowest = np.minimum.reduceat(ranks, starts)
            going = lowest != NO_RANK
            if not going.all():
                left[owner[~going]] = lengths[~going]
                keep = np.repeat(going, lengths)
                symbols, ranks = symbols[keep], ranks[keep]
                owner, lengths, lowest = owner[going], lengths[going], lowest[going]
                if not len(owner):
                    break
            hit = ranks == np.repeat(lowest, lengths)
            at = np.flatnonzero(hit)
            # places that touch (a pair of equal symbols): every second one from the left
            touching = np.flatnonzero(np.diff(at) == 1)
            if len(touching):
                head = np.ones(len(at), bool)
                head[touching + 1] = False
                run = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
                at = at[run % 2 == 0]
            symbols[at] = self.made[ranks[at]]
            gone = np.zeros(len(symbols), bool)
            gone[at + 1] = True
            lengths = lengths - np.bincount(np.repeat(np.arange(len(owner)), lengths)[at], minlength=len(owner))
            new = at - np.arange(len(at))  # each place moves left by the merges before it
            symbols, ranks = symbols[~gone], ranks[~gone]
            ends = np.zeros(len(symbols), bool)
            ends[np.cumsum(lengths) - 1] = True
            for place in (new, new[new > 0] - 1):
                inner = place[~ends[place]]
                ranks[place] = NO_RANK
                ranks[inner] = self._rank(symbols[inner], symbols[inner + 1])
        return left

    def whole(self, text: str) -> int:
        """Tokens of a text by the pattern, special strings counted as their own token."""
        parts = self.split.split(text) if self.split else [text]
        tokens = [m.encode() for p in parts for m in self.pattern.findall(p)]
        return len(parts) - 1 + (int(self.count(tokens).sum()) if tokens else 0)

    def _learn(self, chunks: list[bytes]) -> None:
        tokens, owners = [], []
        for k, c in enumerate(chunks):
            text = c.decode()
            if not text or text[-1].isspace() or text[0] != "\n" and text[0].isspace() or text[0] == "\n" and text[1].isspace():
                self.chunks[c] = _WHOLE
                continue
            found = self.pattern.findall(text if text[0] == "\n" else " " + text)
            tokens += [t.encode() for t in found]
            owners += [k] * len(found)
        if tokens:
            totals = np.bincount(owners, self.count(tokens), len(chunks)).astype(np.int64).tolist()
            for c, n in zip(chunks, totals):
                self.chunks.setdefault(c, n)

    def texts(self, texts: Sequence[bytes | None]) -> list[int]:
        split = [[] if not t else (b"\n" + t).replace(b"\n", b" \n").split(b" ")[1:] for t in texts]
        wanted = set().union(*split)
        new = [c for c in wanted if c not in self.chunks]
        if len(self.chunks) + len(new) > self.limit:
            self.chunks = {c: self.chunks[c] for c in wanted if c in self.chunks}
        self._learn(new)
        get, out = self.chunks.__getitem__, []
        for text, chunks in zip(texts, split):
            # the line feed put before the text is one token
            n = sum(map(get, chunks)) - 1 if chunks else 0
            if n < 0 or text and any(s in text for s in self.special_bytes):
                n = self.whole(text.decode())
            out.append(n)
        return out


def byte_pairs(path: str) -> BytePairs:
    return kept("token counts", path, lambda: BytePairs(path))


def count_tokens(docs: DataFrame, tokenizer_path: str, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """row (struct of `carry`), out (n_bytes, n_tokens)."""

    def make():
        pairs = byte_pairs(tokenizer_path)
        return lambda texts: [[len(t or b"") for t in texts], pairs.texts(texts)]

    return map_texts(docs, carry, make, OUT)
