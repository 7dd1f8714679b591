"""Language-model scores by deleted interpolation of bigram, unigram and uniform estimates.

P(w | v) = a_b * c(v, w) / c(v) + b_b * c(w) / N + c_b / (V + 1), with weights that depend
on the bucket b of the context's frequency (powers of two). The weights are learned by
expectation-maximisation on held-out counts made by deletion: each training token is scored by the counts of
all other training tokens. For that the corpus is summed up as a histogram over (bucket,
log-ratio bins of the three estimates), a table of bounded size, on which the rounds run.

All counts are exact sums in 64 bits over the whole corpus for 63-bit hashes of words and word
pairs, by the messages of exchange.py: blocks of documents send their distinct keys once and get totals back. The
counts of each token are then written to the shared folder, by blocks; learning and scoring read those.

Tokens: words (A-Z lower-cased, runs of anything but space and \\x09-\\x0D), then one
end. The first token's context is a begin mark, whose count is the number of training documents.

Cases: null and empty texts hold the end alone; texts of any length are scored whole; repeated rows
are training data and scored row by row; null doc_ids count as the empty id for the
split; tied estimates and weights need no order; other columns are not read; without training rows N and V are 0 and scores come from the uniform part; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import let_go, materialise, text_size
from .exchange import MESSAGE, WordHashes, answered, block_of, blocks_for, combined, messages, mixed, pack, summed, table_of, unpack, words_of

END, BEGIN = np.uint64(0x656E64), np.uint64(0x626567696E)
BUCKETS = 24
#: natural-log width of a histogram bin, and bins of the ratios to the uniform estimate
WIDTH, X_BINS, Y_BINS = 0.25, 128, 128
ODD = np.uint64(1)
BLOCK = "block bigint, doc_ids array<bigint>, held_out array<boolean>, n_tokens array<bigint>, uni binary, bi binary, types bigint"
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def keys_of(text: bytes | None, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Word keys (even) and word-pair keys (odd) of a text's tokens, the pairs ending at them."""
    tokens = np.append(hashes.of(words_of(text)), END)
    pairs = combined(np.concatenate([[BEGIN], tokens]), 2)
    return mixed(tokens) & ~ODD, pairs | ODD


def _block_keys(table: pa.Table):
    let_go()
    hashes = WordHashes()
    parts = [keys_of(t.as_py(), hashes) for t in table.column("text").cast(pa.binary())]
    lengths = np.array([len(u) for u, _ in parts], np.int64)
    return lengths, np.concatenate([u for u, _ in parts]), np.concatenate([b for _, b in parts])


def count_tokens(docs: DataFrame, held_out: Column, block_bytes: int) -> DataFrame:
    """A row per block (see BLOCK): its documents and, for every token, the training counts of word
    and pair. Row -1 has the number of distinct training words in `types`."""
    blocks = blocks_for(text_size(docs)[0], block_bytes)
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), held_out.alias("held_out"))
    source = source.withColumn("block", block_of([F.col("doc_id"), F.col("text")], blocks))

    def ask(table):
        lengths, uni, bi = _block_keys(table)
        train = np.repeat(~np.array(table.column("held_out").to_pylist(), bool), lengths)
        keys, inverse = np.unique(np.concatenate([uni, bi]), return_inverse=True)
        counts = np.bincount(inverse, np.concatenate([train, train]), len(keys)).astype(np.int64)
        return table_of(messages(keys, counts, table.column("block")[0].as_py(), blocks), MESSAGE)

    told_as = "block bigint, bucket bigint, counts binary, types bigint"

    def answer(table):
        sent, keys, totals = summed(table)
        bucket = table.column("bucket")[0].as_py()
        totals = totals.astype(np.uint64)
        rows = [(b, bucket, pack(totals[np.searchsorted(keys, k)]), 0) for b, k in zip(table.column("block").to_pylist(), sent)]
        rows.append((-1, bucket, b"", int(((keys & ODD == 0) & (totals > 0)).sum())))
        return table_of(rows, told_as)

    def tell(table, told):
        if not len(table):
            types = sum(told.column("types").to_pylist())
            return _block_table([-1], [[]], [[]], [[]], [b""], [b""], [types])
        lengths, uni, bi = _block_keys(table)
        keys, inverse = np.unique(np.concatenate([uni, bi]), return_inverse=True)
        counts = answered(told)[inverse]
        return _block_table(
            [table.column("block")[0].as_py()],
            [table.column("doc_id").to_pylist()],
            [table.column("held_out").to_pylist()],
            [lengths.tolist()],
            [pack(counts[: len(uni)])],
            [pack(counts[len(uni) :])],
            [0],
        )

    told = source.groupBy("block").applyInArrow(ask, MESSAGE).groupBy("bucket").applyInArrow(answer, told_as)
    return source.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(tell, BLOCK)


def _block_table(*columns) -> pa.Table:
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in BLOCK.split(", ")])


def _tokens(row: dict, contexts: int):
    """For each token: document number, counts of word, pair and context."""
    lengths = np.array(row["n_tokens"], np.int64)
    uni, bi = unpack(row["uni"]).astype(np.int64), unpack(row["bi"]).astype(np.int64)
    context = np.empty(len(uni), np.int64)
    context[1:] = uni[:-1]
    context[np.cumsum(lengths) - lengths] = contexts
    return np.repeat(np.arange(len(lengths)), lengths), uni, bi, context


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, else one more than the whole part of the logarithm to base two."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _ratio_bin(ratio: np.ndarray, bins: int) -> np.ndarray:
    """Bin 0 holds ratios of 0; others are bins of the logarithm, from exp(-8)."""
    with np.errstate(divide="ignore"):
        k = np.floor((np.log(ratio) + 8) / WIDTH)
    return np.where(ratio > 0, np.clip(k, 0, bins - 2) + 1, 0).astype(np.int64)


def _bin_ratio(bins: np.ndarray) -> np.ndarray:
    return np.where(bins > 0, np.exp((bins - 1 + 0.5) * WIDTH - 8), 0.0)


def learn_weights(cells: list[tuple[int, int]], rounds: int = 200) -> np.ndarray:
    """Mixture weights (bigram, unigram, uniform) of each bucket by EM. cells: (cell, tokens)."""
    weights = np.tile([0.0, 0.9, 0.1], (BUCKETS, 1))
    if not cells:
        return weights
    cell = np.array([c for c, _ in cells], np.int64)
    number = np.array([n for _, n in cells], float)
    bucket, x, y = cell // (X_BINS * Y_BINS), cell // Y_BINS % X_BINS, cell % Y_BINS
    parts = np.column_stack([_bin_ratio(x), _bin_ratio(y), np.ones(len(cell))])
    for b in np.unique(bucket):
        p, n, w = parts[bucket == b], number[bucket == b], np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(rounds):
            share = p * w
            share /= share.sum(1, keepdims=True)
            new = (share * n[:, None]).sum(0) / n.sum()
            done, w = np.abs(new - w).max() < 1e-7, new
            if done:
                break
        # no weight of zero: texts may hold what no training token could show
        weights[b] = (w + 1e-6) / (1 + 3e-6)
    seen = np.unique(bucket)
    for b in range(1, BUCKETS):
        if b not in seen:  # an empty bucket takes the nearest one's weights
            weights[b] = weights[seen[np.argmin(np.abs(seen - b))]]
    return weights


def score_texts(docs: DataFrame, held_out: Column, block_bytes: int = 16 << 20) -> DataFrame:
    """OUT and train_tokens, a row per document. held_out: rows the model must not learn from."""
    blocks = materialise(count_tokens(docs, held_out, block_bytes))
    train = F.aggregate(
        F.arrays_zip("n_tokens", "held_out"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("d")),
        lambda s, x: F.struct((s["n"] + F.when(~x["held_out"], x["n_tokens"]).otherwise(0)).alias("n"), (s["d"] + F.when(~x["held_out"], 1).otherwise(0)).alias("d")),
    )
    sums = blocks.select(train.alias("t"), "types").agg(F.sum("t.n").alias("n"), F.sum("t.d").alias("d"), F.sum("types").alias("v")).first()
    total, contexts, types = sums["n"] or 0, sums["d"] or 0, sums["v"] or 0

    def histogram(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                if not row["n_tokens"]:
                    continue
                doc, uni, bi, context = _tokens(row, contexts)
                learn = ~np.array(row["held_out"], bool)[doc]
                uni, bi, context = uni[learn] - 1, bi[learn] - 1, context[learn] - 1
                p0 = 1 / (types + 1)
                p2 = np.where(context > 0, bi / np.maximum(context, 1), 0.0)
                x, y = _ratio_bin(p2 / p0, X_BINS), _ratio_bin(uni / max(total - 1, 1) / p0, Y_BINS)
                cells, number = np.unique((bucket_of(context) * X_BINS + x) * Y_BINS + y, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(number.astype(np.int64))], names=["cell", "tokens"])

    cells = blocks.mapInArrow(histogram, "cell bigint, tokens bigint").groupBy("cell").agg(F.sum("tokens").alias("tokens")).collect()
    weights = learn_weights(sorted((r["cell"], r["tokens"]) for r in cells))

    def score(batches):
        for batch in batches:
            for k in range(len(batch)):
                row = batch.slice(k, 1).to_pylist()[0]
                n = len(row["n_tokens"])
                if not n:
                    continue
                doc, uni, bi, context = _tokens(row, contexts)
                w = weights[bucket_of(context)]
                p = w[:, 0] * bi / np.maximum(context, 1) + w[:, 1] * uni / max(total, 1) + w[:, 2] / (types + 1)
                columns = [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["held_out"], pa.bool_()),
                    pa.array(row["n_tokens"], pa.int64()),
                    pa.array(np.bincount(doc, uni > 0, n).astype(np.int64)),
                    pa.array(np.bincount(doc, np.log10((uni + 1) / (total + types + 1)), n)),
                    pa.array(np.bincount(doc, np.log10(p), n)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in OUT.split(", ")])

    return blocks.mapInArrow(score, OUT).withColumn("train_tokens", F.lit(total).cast("bigint"))
