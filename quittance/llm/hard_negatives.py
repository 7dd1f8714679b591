"""Hard negatives by exact inner products over k-means inverted lists.

Index: components become integers (floor(scale * x)), so scores are exact. Centroids are fitted on a bounded sample; every row
goes to the list of its nearest centroid, and a list has the largest distance of its members from the centroid, its
radius. For an anchor q, Cauchy-Schwarz bounds each member x of a list: q.c - |q| r <= q.x <= q.c + |q| r.

Search: a task takes a block of anchors and visits lists by falling upper bound, one read of a list serving all anchors
of the block that still want it. An anchor stops at the first list whose bound is strictly below its k-th best score (a tie could
still win by its smaller id), and skips lists whose bounds lie outside its score window. First each anchor's positives are
found, the best rows of its own label; their scores set windows, and then the best rows of other labels in each window. Both searches
are exact whatever the centroids are; these decide only how many lists are read.

Lists lie as Parquet in the shared folder, a directory for each, in rows of at most `part_rows` vectors: a hot cluster is many
rows, which are built by many tasks and read one at a time. The driver holds the centroids, radii and sizes (at most `most_lists`) and
the sample (`sample_rows`, fewer for long vectors); nothing else leaves the tasks.

Cases: rows with a null id, a null label, a null vector or any null or non-finite component take no part; shorter vectors
count as filled up with zeros; of equal scores the smaller id comes first; rows of one id are rows of their own, and other rows than
the anchor's own; anchors with no positive, or positives with nothing in their window, give no rows; an empty table gives
none; only id, vector and label are read. Scores that might not fit 64 bits are an error.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh_dir, kept, materialise

ROWS = "list int, number bigint, distance double, id bigint, label bigint, anchor boolean, vector binary"
LIST = "list int, n int, ids binary, labels binary, numbers binary, vectors binary"
FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double; null unless all are finite numbers."""
    x = F.transform(vector.cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    fine = F.forall(vector.cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.coalesce(fine, F.lit(False)), x)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Lloyd's k-means; a centroid without members stays where it is. Without a sample: one at the origin."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked = np.random.default_rng(seed).choice(len(sample), min(lists, len(sample)), replace=False)
    centroids = sample[np.sort(picked)].astype(np.float64)
    for _ in range(rounds):
        nearest = nearest_of(sample, centroids)[0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        n = np.bincount(nearest, minlength=len(centroids))
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def nearest_of(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and the distance to it, by steps of bounded size."""
    norms = (centroids * centroids).sum(1)
    step = max(1, (8 << 20) // (8 * len(centroids)))
    places = [(norms - 2 * (rows[a : a + step] @ centroids.T)).argmin(1) for a in range(0, len(rows), step)]
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    return at, np.sqrt(((rows - centroids[at]) ** 2).sum(1))


def padded(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a batch as rows of 64-bit integers, filled up with zeros."""
    flat, lengths = vectors.flatten().to_numpy(zero_copy_only=False), pa.compute.list_value_length(vectors).to_numpy()
    if (lengths == width).all():
        return flat.reshape(len(vectors), width).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    row = np.repeat(np.arange(len(vectors)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


class Index:
    """What tasks need besides the lists: where they lie, centroids, radii and the type that keeps scores exact."""

    def __init__(self, folder: str, numbers: np.ndarray, centroids: np.ndarray, radii: np.ndarray, exact: np.dtype):
        self.folder, self.numbers, self.centroids, self.radii, self.exact = folder, numbers, centroids, radii, exact

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of scores, anchors x lists, a little wider than computed: rounding may not cut."""
        middle = queries @ self.centroids.T
        reach = np.sqrt((queries * queries).sum(1))[:, None] * self.radii
        reach += 1e-9 * (np.abs(middle) + reach) + 1e-6
        return middle - reach, middle + reach


class Lists:
    """Lists by number, each part read when asked for; some `most_bytes` of them stay."""

    def __init__(self, index: Index, most_bytes: int = 128 << 20):
        self.store, self.root = pa.fs.FileSystem.from_uri(index.folder)
        self.exact, self.most_bytes, self.held = index.exact, most_bytes, 0
        self.parts: OrderedDict[int, list] = OrderedDict()

    def read(self, number: int):
        """(ids, labels, numbers, vectors) of each part of a list."""
        if number in self.parts:
            self.parts.move_to_end(number)
            yield from self.parts[number]
            return
        read = []
        for path in self.store.get_file_info(pa.fs.FileSelector(f"{self.root}/list={number}")):
            if not path.base_name.endswith(".parquet"):
                continue
            with self.store.open_input_file(path.path) as source:
                for batch in pa.parquet.ParquetFile(source).iter_batches(1, columns=["n", "ids", "labels", "numbers", "vectors"]):
                    n, ids, labels, numbers, vectors = (c[0].as_py() for c in batch.columns)
                    part = *(np.frombuffer(x, np.int64) for x in (ids, labels, numbers)), np.frombuffer(vectors, self.exact).reshape(n, -1)
                    yield part
                    if read is not None:
                        read.append(part)
                        if sum(p[3].nbytes for p in read) > self.most_bytes // 4:
                            read = None  # a hot list is not held
        if read is not None:
            self.parts[number] = read
            self.held += sum(p[3].nbytes for p in read)
            while self.held > self.most_bytes:
                self.held -= sum(p[3].nbytes for p in self.parts.popitem(last=False)[1])


class Best:
    """The k best (score, id) of each anchor: higher scores first, then smaller ids."""

    def __init__(self, rows: int, k: int):
        self.k, self.scores, self.ids = k, np.full((rows, k), np.iinfo(np.int64).min), np.full((rows, k), np.iinfo(np.int64).max)
        self.n = np.zeros(rows, np.int64)

    def floor(self) -> np.ndarray:
        """The k-th best score, the least number while there are fewer: rows below it are of no use."""
        return np.where(self.n >= self.k, self.scores[:, -1], np.iinfo(np.int64).min)

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:  # what ties with the k-th of these stays
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            scores, ids = scores[scores >= least], ids[scores >= least]
        had = self.n[row]
        scores, ids = np.concatenate([self.scores[row, :had], scores]), np.concatenate([self.ids[row, :had], ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[row, : len(order)], self.ids[row, : len(order)] = scores[order], ids[order]
        self.n[row] = len(order)


def search(index: Index, lists: Lists, queries: np.ndarray, wanted, best: list[Best], low: np.ndarray, high: np.ndarray) -> int:
    """Fills best[j] with the best rows of each anchor whose score lies in its window j (low, high: windows x anchors, inclusive).

    wanted(anchors, labels, numbers) is a mask anchors x rows. Returns how often an anchor looked into a list.
    """
    least, most = index.bounds(queries.astype(np.float64))
    order, visits = np.argsort(-most.max(0), kind="stable"), 0
    # the best bound that is still to come, for each anchor
    coming = np.maximum.accumulate(most[:, order][:, ::-1], axis=1)[:, ::-1]
    open_ = low <= high
    for step, at in enumerate(order):
        useful = np.maximum(low, np.stack([b.floor() for b in best]))  # strictly below it, nothing helps
        if not (open_ & (coming[:, step] >= useful)).any():
            break
        asks = open_ & (most[:, at] >= useful) & (least[:, at] <= high)
        rows = np.flatnonzero(asks.any(0))
        if not len(rows):
            continue
        visits += len(rows)
        for ids, labels, numbers, vectors in lists.read(int(index.numbers[at])):
            some_rows = max(1, (4 << 20) // len(ids))
            for a in range(0, len(rows), some_rows):
                some = rows[a : a + some_rows]
                scores = (queries[some].astype(index.exact) @ vectors.T).astype(np.int64)
                mask = wanted(some, labels, numbers)
                for j, b in enumerate(best):
                    bar = np.maximum(low[j], b.floor())[some]
                    good = mask & (scores >= bar[:, None]) & (scores <= high[j, some][:, None]) & asks[j, some][:, None]
                    for i in np.flatnonzero(good.any(1)):
                        b.add(some[i], scores[i][good[i]], ids[good[i]])
    return visits


def build_index(vectors: DataFrame, lists: int | None, sample_rows: int, most_lists: int, part_rows: int) -> tuple[Index, DataFrame]:
    """vectors: id, label, anchor, vector (array<bigint>), all usable. The index, and the assigned rows (ROWS)."""
    spark = vectors.sparkSession
    size = F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x.cast("double"))))
    n, width, largest = vectors.agg(F.count(F.lit(1)), F.max(F.size("vector")), F.max(size)).first()
    width, largest = width or 0, largest or 0.0
    if width * largest * largest >= 2.0**62:
        raise OverflowError("scores might not fit 64 bits")
    exact = np.dtype(np.float64 if width * largest * largest < 2.0**52 else np.int64)
    most = max(1, min(sample_rows, (64 << 20) // (8 * max(width, 1))))
    picked = vectors.select("vector").sample(min(1.0, 1.2 * most / max(n, 1)), seed=11).limit(2 * most).toArrow().column(0).combine_chunks()
    centroids = fit_centroids(padded(picked, width).astype(np.float64), lists or min(most_lists, max(1, math.isqrt(n))))

    def assign(batches):
        first = TaskContext.get().partitionId() << 33  # rows are numbered over the table
        for batch in batches:
            rows = padded(batch.column(3), width)
            at, distance = nearest_of(rows.astype(np.float64), centroids)
            numbers = np.arange(first, first + len(rows))
            first += len(rows)
            columns = [at.astype(np.int32), numbers, distance, *batch.columns[:3], [r.tobytes() for r in rows.astype(exact)]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=[x.split()[0] for x in ROWS.split(", ")])

    rows = materialise(vectors.select("id", "label", "anchor", "vector").mapInArrow(assign, ROWS))
    sums = rows.groupBy("list").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # most_lists rows at most
    radii, parts = np.zeros(len(centroids)), np.ones(len(centroids), np.int64)
    for r in sums:
        radii[r["list"]], parts[r["list"]] = r["radius"], -(-r["n"] // part_rows)
    present = np.array(sorted(r["list"] for r in sums), np.int64)

    def pack(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy().astype(np.int64).tobytes() for c in ("id", "label", "number")]
        row = [table.column("list")[0].as_py(), len(table), *columns, b"".join(table.column("vector").to_pylist())]
        kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.table([pa.array([x], k) for x, k in zip(row, kinds)], names=[x.split()[0] for x in LIST.split(", ")])

    of_list = F.element_at(F.array(*map(F.lit, parts.tolist())), F.col("list") + 1)
    dealt = rows.select("list", "id", "label", "number", "vector", F.pmod("number", of_list).alias("part"))
    folder = fresh_dir(spark, "lists")
    dealt.groupBy("list", "part").applyInArrow(pack, LIST).write.partitionBy("list").parquet(folder)
    return Index(folder, present, centroids[present], radii[present], exact), rows


def mine(
    rows: DataFrame,
    anchor: Column,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: Column | str = "label",
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    scale: int = 256,
    lists: int | None = None,
    sample_rows: int = 16_384,
    most_lists: int = 4096,
    part_rows: int = 4096,
    block_anchors: int = 1024,
) -> DataFrame:
    """A row (FOUND) for each anchor, positive and rank; negatives score low_percent to high_percent of the positive's score.

    anchor: which rows are anchors. lists: the number of k-means lists (the root of the number of rows, at most
    `most_lists`, if None).
    """
    label = F.col(label) if isinstance(label, str) else label
    read = rows.select(
        F.col(vec_id).cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), quantised(F.col(vector), scale).alias("vector")
    )
    usable = read.where("id is not null and label is not null and vector is not null")
    index, assigned = build_index(usable, lists, sample_rows, most_lists, part_rows)
    anchors = assigned.where("anchor")
    n_anchors = anchors.count()
    blocks = max(-(-n_anchors // block_anchors), min(-(-n_anchors // 64), rows.sparkSession.sparkContext.defaultParallelism), 1)
    width = index.centroids.shape[1]

    def block(lists: Lists, ids, labels, numbers, queries):
        n = len(ids)
        found = Best(n, positives)
        same = lambda some, of, at: (labels[some][:, None] == of) & (numbers[some][:, None] != at)
        everything = np.iinfo(np.int64)
        search(index, lists, queries, same, [found], np.full((1, n), everything.min), np.full((1, n), everything.max))
        part, rest = np.divmod(found.scores.T, 100)
        low, high = low_percent * part - (-low_percent * rest) // 100, high_percent * part + (high_percent * rest) // 100
        none = np.arange(positives)[:, None] >= found.n
        low[none], high[none] = 1, 0
        mined = [Best(n, negatives) for _ in range(positives)]
        search(index, lists, queries, lambda some, of, at: labels[some][:, None] != of, mined, low, high)
        for i in range(n):
            for j in range(found.n[i]):
                for k in range(mined[j].n[i]):
                    yield ids[i], found.ids[i, j], k + 1, mined[j].ids[i, k], found.scores[i, j], mined[j].scores[i, k]

    def run(batches):
        lists = kept("hard_negatives", index.folder, lambda: Lists(index))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            for a in range(0, len(batch), block_anchors):
                ids, labels, numbers, vectors = batch.slice(a, block_anchors).columns
                queries = np.frombuffer(b"".join(vectors.to_pylist()), index.exact).reshape(len(ids), width)
                made = list(block(lists, ids.to_numpy(), labels.to_numpy(), numbers.to_numpy(), queries))
                columns = list(zip(*made)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in FOUND.split(", ")])

    # anchors of one list stand together; the number deals those of a hot one
    dealt = anchors.repartitionByRange(blocks, "list", "number").select("id", "label", "number", "vector")
    return dealt.mapInArrow(run, FOUND)
