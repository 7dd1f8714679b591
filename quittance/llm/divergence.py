"""Audit of how far the sources of a language are from each other, by a chi-squared-like sum over term shares.

A term's share in a group is p = 1 + floor(scale * (count + 1) / (N + V)), with N the group's occurrences of kept terms
and V the language's number of kept terms; the divergence of a group from another (share q) adds up
f = floor((p - q) * (p - q) / q) over all kept terms. All arithmetic is in integers.

Baseline-correction inverted index: a pair starts at V * f(p0, q0), the value if both had no term at all. The index has
one posting list per kept term, with the sources in which it occurs. What a term adds beyond the baseline is split:
by a group's own counts against the other's zero share (from the group's histogram of counts, as f depends on nothing
else), and a correction for the sources of one posting list, where both counts are positive. Terms that
neither source has are never looked at, and no more than one sum for each pair leaves a task.

Terms are counted inside the tasks (whole texts, in pieces of bounded size), so a hot source or a frequent term comes
to the shuffle as one row from each task. Ranked terms are cut to `top` before they are shuffled.

Cases: null text, lang and source are read as ''; empty texts count as documents without terms; rows of one doc_id are
documents of their own; a group without kept terms has shares of zero counts; a language without kept terms (V = 0) has
pairs of value 0 and no terms; equal values rank by the UTF-8 order of their item; an empty table gives no rows; no other
column is read. A language with one source has no pairs.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import materialise

#: bytes.translate table: letters lower-cased and bytes over 127 kept, all else to spaces
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
COUNTS = "lang string, source string, term string, n bigint, docs bigint"
SCALE = 1_000_000_000
#: groups are broadcast up to this number (a few MB); beyond it they are joined by a shuffle
MOST_BROADCAST = 20_000


def pieces(raw: bytes, size: int):
    """A text with terms split by spaces, in pieces of about `size` bytes that end between terms."""
    at = 0
    while len(raw) - at > size:
        cut = raw.rfind(b" ", at, at + size)
        cut = cut if cut > at else raw.find(b" ", at + size)
        if cut < 0:
            break
        yield raw[at:cut]
        at = cut
    yield raw[at:] if at else raw


def term_counts(docs: DataFrame, most_entries: int = 300_000, piece_bytes: int = 4 << 20) -> DataFrame:
    """Partial counts (COUNTS) of each task; a row with a null term for each group it met."""

    def run(batches):
        # by (lang, source): occurrences of each term, and documents with it
        uses: dict[tuple, Counter] = {}
        docs_of: dict[tuple, Counter] = {}

        def flush():
            for (lang, source), found in uses.items():
                terms, having = list(found), docs_of[lang, source]
                columns = [[None, *terms], [0, *found.values()], [0, *map(having.__getitem__, terms)]]
                for a in range(0, len(columns[0]), 50_000):
                    part, n, docs = (c[a : a + 50_000] for c in columns)
                    names = [pa.array([x] * len(part), pa.string()) for x in (lang, source)]
                    arrays = [*names, pa.array(part, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])
            uses.clear()
            docs_of.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
                found, seen = uses.setdefault((lang, source), Counter()), set()
                for piece in pieces(text.as_py().translate(TERM_BYTES), piece_bytes):
                    terms = piece.split()
                    found.update(terms)
                    seen.update(terms)
                docs_of.setdefault((lang, source), Counter()).update(seen)
                if sum(map(len, uses.values())) > most_entries:
                    yield from flush()
        yield from flush()

    read = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*read).mapInArrow(run, COUNTS)


def share(count: Column, total: Column, kept: Column, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / (total + kept)), exact: the product has up to 38 digits."""
    product = (count + 1).cast("decimal(20,0)") * F.lit(scale).cast("decimal(12,0)")
    return F.call_function("div", product, (total + kept).cast("decimal(20,0)")).cast("bigint") + 1


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) for shares, at most scale + 1 each."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least_docs: int = 3, top: int = 200, scale: int = SCALE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` against each other source, part `term` the terms
    whose share is above the language's, the first `top` of them."""
    counts = materialise(
        term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    postings = counts.where("term is not null").groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "n")).alias("posting"), F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")
    )
    postings = materialise(postings.where(F.col("docs") >= least_docs).select("lang", "term", "lang_n", "posting"))
    flat = postings.select("lang", "term", "lang_n", F.explode("posting").alias("p")).select("lang", "term", "lang_n", "p.*")
    langs = postings.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    groups = counts.where("term is null").select("lang", "source").distinct()
    totals = flat.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "v", "lang_total")])
    # no kept terms: any share will do, as nothing is summed over
    zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.greatest("v", F.lit(1)), scale)).otherwise(1)
    groups = materialise(groups.withColumn("p0", zero))
    few = F.broadcast(groups) if groups.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else groups
    shares = flat.join(few, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        share(F.col("n"), F.col("total"), F.col("v"), scale).alias("p"),
        "p0",
        share(F.col("lang_n"), F.col("lang_total"), F.col("v"), scale).alias("q"),
    )
    shares = materialise(shares)
    return _pairs(shares, groups).unionByName(_terms(shares, top))


def _pairs(shares: DataFrame, groups: DataFrame) -> DataFrame:
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.select("lang", "source", "p0", "v").join(other, "lang").where("source <> item")
    start = base.select("lang", "source", "item", (F.col("v") * gap(p0, q0)).alias("value"))
    # how many terms of a group have each share
    spectrum = shares.groupBy("lang", "source", "p", "p0").agg(F.count(F.lit(1)).alias("terms"))
    against = spectrum.join(other, "lang").where("source <> item")
    here = against.select("lang", "source", "item", (F.col("terms") * (gap(p, q0) - gap(p0, q0))).alias("value"))
    there = against.select(
        "lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * (gap(q0, p) - gap(q0, p0))).alias("value")
    )
    # sources that share a term: their two shares in place of the one-sided values
    held = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("posting")).where(F.size("posting") > 1)
    both = held.select("lang", F.explode("posting").alias("g"), "posting").select("lang", "g.*", F.explode("posting").alias("h"))
    both = both.select("lang", "source", "p", "p0", F.col("h.source").alias("item"), F.col("h.p").alias("q"), F.col("h.p0").alias("q0"))
    both = both.where("source <> item").select("lang", "source", "item", (gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)).alias("value"))
    # each part is added up inside the tasks first
    parts = [x.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")) for x in (here, there, both)]
    for x in parts:
        start = start.unionByName(x)
    summed = start.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(place).alias("rank"))


def _terms(shares: DataFrame, top: int) -> DataFrame:
    above = shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    place = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = above.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
