"""Benchmark decontamination by one Aho-Corasick automaton.

Benchmark items and documents are normalised alike (A-Z lower-cased; words are
runs of a-z, 0-9 and non-ASCII characters; words joined by one space). Every
window of `width` consecutive item words is a pattern between spaces; a text is
scanned once, and hits are mapped back to words and to code points of the
original text.

The automaton is broadcast as its list of patterns, whose total size is checked
first: beyond `block_bytes` the patterns are dealt into blocks by hash, each with
its own automaton and pass, and the passes' hits are united per row.

Cases: null or empty text has no words and no hit; an item without words has
no window, one with fewer than `width` words is a single window; repeated items
count once for each distinct item_id (null ids are ignored); repeated documents are
judged row by row; very long texts are scanned whole; windows shared by items count for each of them (no ties);
empty tables give no rows or no hits; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import ascii_lower, kept, map_texts, materialise

#: a-z, 0-9 and bytes from 0x80 stay, A-Z are lower-cased, the rest separates words
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OUT = "n_words bigint, n_hit bigint, item_ids array<string>, hits array<struct<first:bigint,last:bigint>>, spans array<struct<start:bigint,end:bigint>>"


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """Distinct windows with the ids of the items that hold them: window string, item_ids array<string>."""
    words = F.filter(F.split(ascii_lower(F.coalesce("text", F.lit(""))), SEPARATORS), lambda w: w != "")
    split = items.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (width - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("w", i, width), " "))
    return (
        split.select("item", F.explode(F.array_distinct(cut)).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    )


def _automaton(patterns) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for k, (window, _) in enumerate(patterns):
        chars = f" {window} ".encode().decode("latin-1")
        built.add_word(chars, (len(chars), window.count(" ") + 1, k))
    built.make_automaton()
    return built


def _hits(found: list, ends: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of hit words, last exclusive. ends: each word's end in the normalised text."""
    last = np.searchsorted(ends, [end for end, _ in found])
    runs: list[list[int]] = []
    for first, stop in sorted((int(x) - n + 1, int(x) + 1) for x, (_, (_, n, _)) in zip(last, found)):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([first, stop])
    return [(a, b) for a, b in runs]


def _scan(docs: DataFrame, carry: Sequence[str], key: str, shared) -> DataFrame:
    def make():
        patterns = shared.value
        scan = kept(f"decontamination {key}", None, lambda: _automaton(patterns))

        def apply(texts):
            out = [[], [], [], [], []]
            for raw in texts:
                words = (raw or b"").translate(NORMAL).split()
                found = list(scan.iter(f" {b' '.join(words).decode('latin-1')} ")) if words and len(scan) else []
                runs, spans, ids = [], [], set()
                if found:
                    runs = _hits(found, np.cumsum([len(w) + 1 for w in words]))
                    at = [m.span() for m in WORD.finditer(raw.decode())]
                    spans = [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]
                    ids = {i for k in {v[2] for _, v in found} for i in patterns[k][1]}
                out[0].append(len(words))
                out[1].append(sum(b - a for a, b in runs))
                out[2].append(sorted(ids))
                out[3].append([{"first": a, "last": b} for a, b in runs])
                out[4].append(spans)
            return out

        return apply

    return map_texts(docs, carry, make, OUT)


def _united(parts: list[DataFrame]) -> DataFrame:
    """One row for each `row.number`: ranges of all passes merged, ids united."""

    def merge(ranges, lo, hi):
        ordered = F.array_sort(F.transform(ranges, lambda r: F.struct(r[lo].alias(lo), r[hi].alias(hi))))
        return F.aggregate(
            ordered,
            F.slice(ordered, 1, 0),
            lambda done, r: F.when(
                (F.size(done) > 0) & (F.element_at(done, -1)[hi] >= r[lo]),
                F.concat(
                    F.slice(done, 1, F.size(done) - 1),
                    F.array(F.struct(F.element_at(done, -1)[lo].alias(lo), F.greatest(F.element_at(done, -1)[hi], r[hi]).alias(hi))),
                ),
            ).otherwise(F.concat(done, F.array(r))),
        )

    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    grouped = union.groupBy(F.col("row.number").alias("number")).agg(
        F.first("row.row").alias("row"),
        F.max("out.n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("out.item_ids")))).alias("item_ids"),
        F.flatten(F.collect_list("out.hits")).alias("hits"),
        F.flatten(F.collect_list("out.spans")).alias("spans"),
    )
    merged = grouped.withColumn("hits", merge(F.col("hits"), "first", "last")).withColumn("spans", merge(F.col("spans"), "start", "end"))
    total = F.aggregate("hits", F.lit(0).cast("bigint"), lambda s, r: s + r["last"] - r["first"])
    return merged.select("row", F.struct("n_words", total.alias("n_hit"), "item_ids", "hits", "spans").alias("out"))


def decontaminate(docs: DataFrame, items: DataFrame, carry: Sequence[str] = ("doc_id",), width: int = 10, block_bytes: int = 32 << 20) -> DataFrame:
    """A row per document: row (struct of `carry`), out (n_words, n_hit, item_ids, hits, spans).

    hits are ranges of word positions and spans ranges of code points in the
    original text, both with exclusive ends.
    """
    spark = docs.sparkSession
    cut = windows(items, width)
    total = cut.agg(F.sum(F.octet_length("window") + F.octet_length(F.array_join("item_ids", ",")))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    if blocks > 1:
        cut = materialise(cut)
        row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
        docs = materialise(docs.select(row, "text", F.monotonically_increasing_id().alias("number")))
        carry = ["row", "number"]
    parts = []
    for b in range(blocks):
        rows = cut.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == b).orderBy("window").collect()
        shared = spark.sparkContext.broadcast([(r["window"], tuple(r["item_ids"])) for r in rows])
        parts.append(_scan(docs, carry, f"{spark.sparkContext.applicationId}-{shared._jbroadcast.id()}", shared))
    if blocks == 1:
        return parts[0]
    return _united(parts)
