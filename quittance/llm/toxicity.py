"""Toxicity by nearest labelled examples: exact cosine of weighted TF-IDF over all their terms.

Fitting. At most `max_examples` labelled documents of each class (a documented bound; those with
the smallest hashes of their ids) are the examples. Terms are words (A-Z lower-cased;
runs of a-z, 0-9 and non-ASCII) and the first five characters of longer words. All terms of the
examples are the vector space, and every example is in the index. Document frequencies of
those terms are counted over all documents. A term whose presence differs between the
classes (equal texts of a class count once) beyond a Bonferroni limit weighs the square root of
its chi-squared value more; no term is left out.

Index. The examples' unit vectors ((1 + ln tf) * idf * class weight of the term), in an order that sets
like ones together, are cut into blocks. Each block holds the weights of the terms in many examples (heads)
that occur in it, and the greatest weight of each: a query's bound for a block is the sum over its
terms of those maxima (rarer terms have postings, whose sums are exact). The blocks of the highest bounds
are scored first, then those whose bound reaches the k-th best score so far; all others are passed
over. Single precision serves for that; every example within its rounding error of the k-th best is
scored again in double precision, so the k nearest are exact.

Score. An example that has the scored row's doc_id takes no part in its score. Neighbours vote with
weight similarity / (1 + 0.05 - similarity), times their class's
share of all labelled rows over its share of examples, with a prior vote of one such neighbour; a logistic
curve fitted to leave-one-out votes of the examples calibrates the vote.

Cases: null, empty and all-unknown texts have no neighbours and get the calibrated
prior; very long texts are read whole; ties go to the smaller doc_id; repeated
documents are scored row by row; a doc_id labelled twice counts once (toxic wins); of the texts of a repeated
example id one counts; without labels of both classes every score is the share of toxic labels (0 without
labels); the example with the scored row's own doc_id is left out, so that no row's label is an input of its own score;
null doc_ids are scored; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import let_go, map_texts, materialise, slices
from .decontaminate import NORMAL

OUT = "score double, neighbours array<struct<doc_id:bigint,similarity:double,toxic:int>>"
PREFIX = 5
#: terms in at least one of so many examples are heads
HEAD = 32
#: examples of a block
BLOCK = 64
#: queries whose bounds are computed together, that are scored together, and postings that are added up at once
QUERIES, TOGETHER, POSTINGS = 256, 32, 1 << 17
#: bytes of text that are split into words at once
SLICE = 1 << 20
#: texts of which a task keeps the neighbours, for their copies
HELD = 5_000
#: above the error of single-precision sums of similarities
MARGIN = 2e-5


def terms_of(text: bytes | None) -> Counter:
    """Words and, marked by a final *, the first characters of longer ones."""
    words = Counter((text or b"").translate(NORMAL).decode().split(" "))
    del words[""]
    for w, n in list(words.items()):
        if len(w) > PREFIX:
            words[w[:PREFIX] + "*"] += n
    return words


class Lookup:
    """Numbers of strings by their 64-bit hashes, for many at once: sorted hashes behind a table of their upper bits."""

    def __init__(self, strings: Sequence[str], numbers: np.ndarray):
        hashes = hashes_of(strings)
        order = np.argsort(hashes)
        self.hashes, self.numbers = np.append(hashes[order], np.uint64(2**64 - 1)), np.append(numbers[order], -1)
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length() + 1))
        self.first = np.searchsorted(hashes[order] >> self.shift, np.arange(2 ** (64 - int(self.shift)) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.first).max(initial=0))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each, -1 for unknown ones."""
        out, at = np.full(len(hashes), -1, np.int64), self.first[hashes >> self.shift]
        for _ in range(self.most):
            hit = self.hashes[at] == hashes
            out[hit] = self.numbers[at[hit]]
            at = np.minimum(at + 1, len(self.hashes) - 1)
        return out


def hashes_of(strings: Sequence[str]) -> np.ndarray:
    """This process's own hashes."""
    return np.fromiter(map(hash, strings), np.int64, len(strings)).view(np.uint64)


class Terms:
    """Numbers of the terms of texts; words and first characters that no example has are passed over."""

    def __init__(self, terms: Sequence[str]):
        stem = np.array([t[-1] == "*" for t in terms], bool)  # no word holds one
        self.words = Lookup([t for t in terms if t[-1] != "*"], np.flatnonzero(~stem))
        self.stems = Lookup([t[:-1] for t in terms if t[-1] == "*"], np.flatnonzero(stem))
        self.stem_of = np.full(len(terms), -1, np.int64)
        long = np.array([i for i, t in enumerate(terms) if len(t) > PREFIX and t[-1] != "*"], np.int64)
        self.stem_of[long] = self.stems(hashes_of([terms[i][:PREFIX] for i in long.tolist()]))

    def vectors(self, texts: Sequence[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Term numbers in order, and their counts, of each text."""
        words, ends = [], []
        for t in texts:
            if t:
                words += filter(None, t.translate(NORMAL).decode().split(" "))
            ends.append(len(words))
        lengths = np.diff(np.array(ends, np.int64), prepend=0)
        whole = self.words(hashes_of(words))
        known = whole >= 0
        new = [i for i in np.flatnonzero(~known).tolist() if len(words[i]) > PREFIX]
        stems = np.full(len(words), -1, np.int64)
        stems[known] = self.stem_of[whole[known]]
        stems[new] = self.stems(hashes_of([words[i][:PREFIX] for i in new]))
        cell = np.repeat(np.arange(len(texts)) << 32, lengths)
        cells = np.concatenate([(cell + whole)[known], (cell + stems)[stems >= 0]])
        found, counts = np.unique(cells, return_counts=True)
        cuts = np.searchsorted(found >> 32, np.arange(len(texts) + 1)).tolist()
        found &= 0xFFFFFFFF
        return [(found[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]


def runs(start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start[0], start[0] + 1, ... (sizes[0] of them), start[1], ..."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + sizes, sizes)


def arranged(vectors: list, weight: np.ndarray, groups: int = 64, rounds: int = 4) -> np.ndarray:
    """An order of vectors that sets like ones together: spherical k-means over their frequent terms, alike groups in a row."""
    n = len(vectors)
    held = np.bincount(np.concatenate([np.zeros(0, np.int64), *[t for t, _ in vectors]]), minlength=len(weight))
    heads = np.flatnonzero((held > 1) & (held * HEAD >= n))
    at = np.full(len(weight), -1, np.int64)
    at[heads] = np.arange(len(heads))
    points = np.zeros((n, len(heads)), np.float32)
    for row, (t, c) in zip(points, vectors):
        seen = at[t] >= 0
        row[at[t][seen]] = (1 + np.log(c[seen])) * weight[t[seen]]
    scale = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    points = scale(points)
    centres = points[np.linspace(0, n - 1, min(groups, n)).astype(int)]
    for _ in range(rounds):
        near = (points @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        centres = scale(sums)
    likeness, chain, left = centres @ centres.T, [0], set(range(1, len(centres)))
    while left:
        chain.append(max(sorted(left), key=lambda j: likeness[chain[-1], j]))
        left.remove(chain[-1])
    place = np.empty(len(centres), np.int64)
    place[chain] = np.arange(len(centres))
    return np.argsort(place[near], kind="stable")


class Index:
    """Unit vectors of examples in blocks. vectors: (term numbers, term counts) of each example; weight: of each term."""

    def __init__(self, vectors: list, doc_ids: Sequence[int], toxic: Sequence[int], weight: np.ndarray, class_weight: Sequence[float], k: int = 15):
        self.weight, self.k, self.class_weight = weight, k, class_weight
        self.doc_ids, self.toxic = np.array(doc_ids, np.int64), np.array(toxic, np.int64)
        self.places: dict[int, list[int]] = {}
        for i, d in enumerate(doc_ids):
            self.places.setdefault(d, []).append(i)
        units = [self.unit(*v) for v in vectors]
        n = self.n = len(units)
        self.sizes = np.array([len(t) for t, _ in units], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.terms = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in units]])
        self.weights = np.concatenate([np.zeros(0), *[w for _, w in units]])
        rows = np.repeat(np.arange(n), self.sizes)
        held = np.bincount(self.terms, minlength=len(weight))
        heads = np.flatnonzero((held > 1) & (held * HEAD >= n))
        self.head = np.full(len(weight), -1, np.int64)
        self.head[heads] = np.arange(len(heads))
        at = self.head[self.terms]
        self.firsts = np.arange(0, n, BLOCK)
        #: of each block the heads in it and their weights (heads x examples); the greatest ones (heads x blocks)
        self.blocks, self.most = [], np.zeros((len(heads), len(self.firsts)), np.float32)
        for b, first in enumerate(self.firsts):
            last = min(n, first + BLOCK)
            own = slice(self.starts[first], self.starts[last - 1] + self.sizes[last - 1])
            seen = at[own] >= 0
            present, place = np.unique(at[own][seen], return_inverse=True)
            inner = np.zeros((len(present), last - first), np.float32)
            inner[place, rows[own][seen] - first] = self.weights[own][seen]
            self.blocks.append((present, inner))
            if len(present):
                self.most[present, b] = inner.max(1)
        rest = np.flatnonzero(at < 0)
        rest = rest[np.argsort(self.terms[rest], kind="stable")]
        self.rows, self.row_weights = rows[rest], self.weights[rest]
        self.first = np.searchsorted(self.terms[rest], np.arange(len(weight) + 1))
        self.query = np.zeros(len(weight))

    def unit(self, terms, counts):
        terms = np.asarray(terms, np.int64)
        w = (1 + np.log(np.asarray(counts, float))) * self.weight[terms]
        return terms, w / np.sqrt((w * w).sum()) if len(terms) else w

    def nearest(self, terms, counts, without: int | None = None) -> list[tuple[float, int]]:
        """The k nearest as (similarity, place in the index); `without` leaves one doc_id out."""
        return self.nearest_of([(terms, counts)], [without])[0]

    def nearest_of(self, vectors: list, without: Sequence[int | None] | None = None) -> list[list[tuple[float, int]]]:
        out: list = [None] * len(vectors)
        for i in range(0, len(vectors), QUERIES):
            units = [self.unit(*v) for v in vectors[i : i + QUERIES]]
            asked = np.zeros((len(units), len(self.most)), np.float32)
            rare = np.zeros((len(units), self.n), np.float32)
            sizes = np.array([len(t) for t, _ in units])
            owner, terms, w = np.repeat(np.arange(len(units)), sizes), *map(np.concatenate, zip(*units))
            at = self.head[terms]
            hit = at >= 0
            asked[owner[hit], at[hit]] = w[hit]
            self._postings(rare, owner[~hit], terms[~hit], w[~hit])
            for j, own in enumerate(without[i : i + QUERIES] if without else ()):
                rare[j, self.places.get(own, [])] = -2.0
            bounds = asked @ self.most + np.maximum.reduceat(rare, self.firsts, axis=1)
            order = np.argsort(bounds.argmax(1), kind="stable")  # queries that need the same blocks go together
            for a in range(0, len(order), TOGETHER):
                some = order[a : a + TOGETHER]
                found = self._scored(asked[some], rare[some], bounds[some])
                for j, near in zip(some.tolist(), found):
                    out[i + j] = self._exact(near, *units[j])
        return out

    def _postings(self, sums: np.ndarray, owner: np.ndarray, terms: np.ndarray, w: np.ndarray) -> None:
        """The products with the terms that are no heads, of so many queries at a time as have about POSTINGS."""
        first, lengths = self.first[terms], self.first[terms + 1] - self.first[terms]
        ends = np.searchsorted(owner, np.arange(len(sums) + 1))
        total = np.concatenate([[0], np.cumsum(lengths)])[ends]
        a = 0
        while a < len(sums):
            b = max(a + 1, int(np.searchsorted(total, total[a] + POSTINGS, "right")) - 1)
            own = slice(ends[a], ends[b])
            at = runs(first[own], lengths[own])
            cell = self.rows[at] + np.repeat((owner[own] - a) * self.n, lengths[own])
            added = np.bincount(cell, self.row_weights[at] * np.repeat(w[own], lengths[own]), (b - a) * self.n)
            sums[a:b] = added.reshape(b - a, self.n)
            a = b

    def _scored(self, asked: np.ndarray, rare: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Similarities of all examples in blocks that any of these queries needs; -1 in the others."""
        n_blocks, columns = len(self.blocks), np.ascontiguousarray(asked.T)
        near = np.full(rare.shape, -1, np.float32)
        done = np.zeros(n_blocks, bool)

        def score(wanted):
            for b in np.flatnonzero(wanted & ~done):
                present, inner = self.blocks[b]
                span = slice(self.firsts[b], self.firsts[b] + inner.shape[1])
                near[:, span] = rare[:, span] + columns[present].T @ inner
            done[wanted] = True

        first = min(n_blocks, 1 + -(-self.k // BLOCK))
        wanted = np.zeros(n_blocks, bool)
        wanted[np.argpartition(-bounds, first - 1, axis=1)[:, :first]] = True
        score(wanted)
        if not done.all():
            held = near[:, np.repeat(done, BLOCK)[: self.n]]
            least = np.partition(held, -self.k, axis=1)[:, -self.k]
            score((bounds >= (least - MARGIN)[:, None]).any(0))
        return near

    def _exact(self, near: np.ndarray, terms: np.ndarray, w: np.ndarray) -> list[tuple[float, int]]:
        least = np.partition(near, -self.k)[-self.k] - MARGIN if len(near) > self.k else 0.0
        found = np.flatnonzero((near >= least) & (near > 0))
        if not len(found):
            return []
        self.query[terms] = w
        spans = [slice(a, a + n) for a, n in zip(self.starts[found].tolist(), self.sizes[found].tolist())]
        sims = np.array([self.query[self.terms[s]] @ self.weights[s] for s in spans]).round(9)
        self.query[terms] = 0
        return [(float(sims[j]), int(found[j])) for j in np.lexsort((self.doc_ids[found], -sims))[: self.k]]

    def vote(self, near: list, prior: float) -> float:
        """Weighted share of toxic neighbours, with one prior vote at similarity 0.5."""
        total = value = 0.0
        for s, p in [*near, (0.5, None)]:
            w = s / (1.05 - s)
            y = prior if p is None else self.toxic[p]
            w *= 1.0 if p is None else self.class_weight[y]
            total, value = total + w, value + w * y
        return value / total


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope (at least 0) and intercept of a weighted, slightly ridged logistic fit by Newton's method."""
    X, beta = np.column_stack([x, np.ones(len(x))]), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        grad = X.T @ (w * (y - p)) - 1e-2 * beta
        hess = (X * (w * p * (1 - p))[:, None]).T @ X + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def _logit(p: float) -> float:
    p = min(max(p, 1e-4), 1 - 1e-4)
    return math.log(p / (1 - p))


def examples_of(docs: DataFrame, labels: DataFrame, max_examples: int):
    """Labelled documents, at most max_examples of each class, and the classes' label counts."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    marked = materialise(marked)
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    parts = [marked.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # max_examples ids a class at most
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).join(chosen, "doc_id")
    return texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic")), totals


def vectors_of(examples: DataFrame) -> tuple[list[int], list[int], list, pa.Array]:
    """doc_ids, classes, vectors (term numbers, counts) of the examples by doc_id, and all their terms in order."""

    def make():
        def one(text):
            found = terms_of(text)
            return list(found), list(found.values())

        return lambda texts: list(zip(*map(one, texts))) or [[], []]

    drawn = map_texts(examples, ["doc_id", "toxic"], make, "terms array<string>, counts array<int>")
    got = drawn.select("row.doc_id", "row.toxic", "out.terms", "out.counts").orderBy("doc_id").toArrow()
    lists = pa.concat_arrays([pa.array([], got.schema.field("terms").type), *got["terms"].chunks])
    coded = lists.flatten().dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    numbers, counts = place[coded.indices.to_numpy()], pa.compute.list_flatten(got["counts"]).to_numpy()
    cuts = np.cumsum(pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False))[:-1]
    vectors = [(t[o := np.argsort(t)], c[o]) for t, c in zip(np.split(numbers, cuts), np.split(counts, cuts))] if got.num_rows else []
    return got["doc_id"].to_pylist(), got["toxic"].to_pylist(), vectors, coded.dictionary.take(pa.array(order))


def class_weights(vectors: list, toxic: Sequence[int], n_terms: int, level: float = 0.01) -> np.ndarray:
    """The square root of chi-squared of the terms that differ between the classes, else 1. Equal vectors of a class count once."""
    n, a = np.zeros(n_terms), np.zeros(n_terms)
    distinct = {(t.tobytes(), c.tobytes(), y): t for (t, c), y in zip(vectors, toxic)}
    for (_, _, y), t in distinct.items():
        n[t] += 1
        a[t] += y
    total, t = float(len(distinct)), float(sum(y for _, _, y in distinct))
    c, b = total - t, n - a
    chi = total * (a * (c - b) - b * (t - a)) ** 2 / (t * c * n * (total - n + 1e-9) + 1e-300)
    tested = n >= 3  # the normal approximation holds for no rarer term
    # z of a two-sided normal test at level / tests: sqrt(2 ln(2 tests / level)) bounds it
    limit = 2 * math.log(2 * max(1, tested.sum()) / level)
    return np.where(tested & (chi >= limit), np.sqrt(chi), 1.0)


def document_frequencies(docs: DataFrame, terms) -> tuple[int, np.ndarray]:
    """The number of documents, and of documents with each term (terms: broadcast array)."""

    def run(batches):
        known, seen, rows = Terms(terms.value.to_pylist()), np.zeros(len(terms.value) + 1, np.int64), 0
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for a, b in slices(batch, pa.compute.binary_length(texts).fill_null(0).to_pylist(), SLICE):
                for found, _ in known.vectors(texts.slice(a, b - a).to_pylist()):
                    seen[found + 1] += 1
            rows += len(batch)
        seen[0] = rows
        found = np.flatnonzero(seen)
        for i in range(0, len(found), 1 << 16):
            part = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part - 1, pa.int32()), pa.array(seen[part])], names=["term", "n"])

    counted = docs.select(F.col("text").cast("string")).mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(terms.value) + 1, np.int64)
    out[counted["term"].to_numpy() + 1] = counted["n"].to_numpy()
    return int(out[0]), out[1:]


def score_toxicity(docs: DataFrame, labels: DataFrame, carry: Sequence[str] = ("doc_id",), max_examples: int = 4096, k: int = 15) -> DataFrame:
    """row (struct of `carry`), out (score, neighbours: evidence, nearest first).

    labels: doc_id and toxic of the rows to learn from, and of no others.
    """
    sc = docs.sparkSession.sparkContext
    examples, totals = examples_of(docs, labels, max_examples)
    ids, ys, vectors, terms = vectors_of(examples)
    prior = totals.get(1, 0) / max(1, sum(totals.values()))
    fitted = 0 < sum(ys) < len(ys)
    model = None
    if fitted:
        words = sc.broadcast(terms)
        n_docs, frequency = document_frequencies(docs, words)
        scale = (np.log((1 + n_docs) / (1 + frequency)) + 1) * class_weights(vectors, ys, len(terms))
        weight = [totals.get(y, 0) / max(1, ys.count(y)) / max(1.0, sum(totals.values()) / max(1, len(ys))) for y in (0, 1)]
        order = arranged(vectors, scale).tolist()
        vectors, ids, ys = ([x[i] for i in order] for x in (vectors, ids, ys))
        index = Index(vectors, ids, ys, scale, weight, k)
        x = np.array([_logit(index.vote(m, prior)) for m in index.nearest_of(vectors, ids)])
        slope, intercept = logistic(x, np.array(ys, float), np.array([weight[y] for y in ys]))
        model = sc.broadcast(([(t.astype(np.int32), c) for t, c in vectors], ids, ys, scale, weight, k))  # max_examples vectors a class

    def make():
        if not fitted:
            return lambda texts, _: [[prior] * len(texts), [[]] * len(texts)]
        let_go()
        index, known, held = Index(*model.value), Terms(words.value.to_pylist()), {}

        def vectors(texts):
            sizes = [len(t or b"") for t in texts]
            return [v for a, b in slices(texts, sizes, SLICE) for v in known.vectors(texts[a:b])]

        def scored(texts, doc_ids):
            own = [d if d in index.places else None for d in doc_ids]
            keys = [(hashlib.blake2b(t or b"", digest_size=16).digest(), d) for t, d in zip(texts, own)]
            new = {key: t for key, t in zip(keys, texts) if key not in held}
            made = dict(zip(new, index.nearest_of(vectors(list(new.values())), [d for _, d in new])))
            made = {key: (1 / (1 + math.exp(-(slope * _logit(index.vote(near, prior)) + intercept))), near) for key, near in made.items()}
            found = [made.get(key) or held[key] for key in keys]
            held.update(list(made.items())[: max(0, HELD - len(held))])
            near = [x for _, m in found for x in m]
            at = np.array([p for _, p in near], np.int64)
            columns = [pa.array(index.doc_ids[at]), pa.array([s for s, _ in near], pa.float64()), pa.array(index.toxic[at].astype(np.int32))]
            cuts = pa.array(np.cumsum([0, *[len(m) for _, m in found]]), pa.int32())
            inner = [pa.field("doc_id", pa.int64()), pa.field("similarity", pa.float64()), pa.field("toxic", pa.int32())]
            return [[s for s, _ in found], pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(columns, fields=inner))]

        return scored

    return map_texts(docs, carry, make, OUT, beside=F.col("doc_id").cast("bigint"))
