"""N-gram Jaccard join: prefix filters find clusters of candidates, a prefix tree joins each.

A text's set holds the 64-bit hashes of its distinct n-grams of words. Equal sets
collapse to one node (its 128-bit signature), so copies cost one row each.

1. Every set sends the first tokens of its set, in the order of hashes, to counting buckets. Two sets
   that link share at least `ell` of those, so sets of which fewer occur elsewhere leave.
2. Among the rest, all tokens are counted, which gives the global order: rare first, then by hash.
   Sets with too few shared tokens leave; the others' prefix (n - needed overlap + 1 rarest
   tokens) joins them into candidate clusters: each token links its sets to one of them.
3. A cluster's sets, ordered from frequent to rare, form a prefix tree, walked depth first: the overlaps
   of all live queries with a path are kept at its nodes and shared by all sets below,
   and queries leave a subtree when overlap plus remaining length cannot reach what they need.
   Clusters over `chunk_sets` or `chunk_bytes` are dealt into chunks and joined chunk pair by chunk pair.
4. Links become components; every row gets its component's smallest doc_id and its links.

No pair is written, and no link is lost: all filters are exact bounds.

No step deals all rows of a key to one task where that key may be hot: a token's sets are linked in parts of
about `PART`, stars of edges, clusters, components and copies go through spread_join().

Cases: texts without words have the empty set and link with nothing; with fewer words than
`n` the whole sequence is the one n-gram; rows of equal sets link with each other; null
doc_ids take part, but are never a component's id (null where it has no other);
repeated rows are nodes of the same set; sets tied in frequency are ordered by hash, components by their least
signature; very long texts are read whole; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import let_go, materialise, spread_join, text_size
from .components import components
from .exchange import MESSAGE, WordHashes, answered, answers, block_of, blocks_for, combined, messages, pack_sorted, table_of, unpack_sorted, words_of

SHINGLES = 5
PERCENT = 80
#: sets that share a token are linked in parts of about so many
PART = 1024


def shingle_set(text: bytes | None, hashes: WordHashes, n: int = SHINGLES) -> np.ndarray:
    """Sorted distinct hashes of a text's n-grams."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=n)], np.uint64)
    return np.unique(combined(hashes.of(words), n))


def needed(n, percent: int = PERCENT):
    """Least overlap of a set of size n with any set it links to: |x & y| >= percent / 100 * |x|."""
    return -(-n * percent // 100)


def ell(n, percent: int = PERCENT):
    """Tokens that two linked sets of sizes n or more share among their first tokens; grows with n."""
    return np.maximum(1, n * 3 // 10)


def first_tokens(n, percent: int = PERCENT):
    return np.minimum(n, n - needed(n, percent) + ell(n, percent))


def signature(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def _sets(table: pa.Table) -> tuple[list, list, dict[bytes, np.ndarray]]:
    """doc_ids, signatures and the distinct non-empty sets of a block of texts."""
    let_go()
    distinct: dict[bytes, np.ndarray] = {}
    sigs, hashes = [], WordHashes()
    for text in table.column("text").cast(pa.binary()):
        tokens = shingle_set(text.as_py(), hashes)
        sig = signature(tokens) if len(tokens) else b""
        sigs.append((sig, len(tokens)))
        if sig:
            distinct.setdefault(sig, tokens)
    return table.column("doc_id").to_pylist(), sigs, distinct


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _request(parts: list[np.ndarray], block: int, buckets: int) -> pa.Table:
    keys, counts = np.unique(_joined(parts), return_counts=True)
    return table_of(messages(keys, counts, block, buckets), MESSAGE)


SETS = "sig binary, doc_id bigint, key binary, n bigint, tokens binary"


def _survivors(docs: DataFrame, blocks: int, percent: int) -> DataFrame:
    """SETS: a row per document without tokens, and one with tokens for each distinct set left in a block."""

    def ask(table):
        _, _, distinct = _sets(table)
        made = _request([t[: first_tokens(len(t), percent)] for t in distinct.values()], table.column("block")[0].as_py(), blocks)
        let_go()
        return made

    def judge(table, told):
        if not len(table):
            return table_of([], SETS)
        ids, sigs, distinct = _sets(table)
        marks = table.column("key").to_pylist()
        heads = {s: t[: first_tokens(len(t), percent)] for s, t in distinct.items()}
        keys, counts = np.unique(_joined(list(heads.values())), return_counts=False), answered(told)
        rows = [(s, i, m, n, None) for i, m, (s, n) in zip(ids, marks, sigs)]
        for s, t in distinct.items():
            shared = int((counts[np.searchsorted(keys, heads[s])] > 1).sum())
            if shared >= ell(needed(len(t), percent), percent):
                rows.append((s, None, None, len(t), pack_sorted(t)))
        del distinct, heads
        let_go()
        return table_of(rows, SETS)

    asked = docs.groupBy("block").applyInArrow(ask, MESSAGE)
    told = answers(asked)
    return docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(judge, SETS)


def _candidates(sets: DataFrame, blocks: int, percent: int) -> DataFrame:
    """sig, token, part, parts: the prefix tokens that occur in other sets too, and the set's part of the token's sets."""

    def ask(table):
        return _request([unpack_sorted(x) for x in table.column("tokens").to_pylist()], table.column("block")[0].as_py(), blocks)

    schema = "sig binary, token bigint, part bigint, parts bigint"

    def prefixes(table, told):
        rows = []
        if len(table):
            parts = [unpack_sorted(x) for x in table.column("tokens").to_pylist()]
            keys, counts = np.unique(_joined(parts)), answered(told)
            for sig, t in zip(table.column("sig").to_pylist(), parts):
                seen = counts[np.searchsorted(keys, t)]
                if int((seen > 1).sum()) < needed(len(t), percent):
                    continue
                order = np.lexsort((t, seen))[: len(t) - needed(len(t), percent) + 1]
                order = order[seen[order] > 1]
                own, parts_of = int.from_bytes(sig[:7], "little"), -(-seen[order].astype(np.int64) // PART)
                rows += [(sig, x, own % p, p) for x, p in zip(t[order].view(np.int64).tolist(), parts_of.tolist())]
        return table_of(rows, schema)

    asked = sets.groupBy("block").applyInArrow(ask, MESSAGE)
    return sets.groupBy("block").cogroup(answers(asked).groupBy("block")).applyInArrow(prefixes, schema)


def tree_join(sets: list[np.ndarray], percent: int = PERCENT, queries: np.ndarray | None = None):
    """Links among sets (arrays of distinct tokens): (set, array of linked others) for each set, in the tree's order.

    One array at a time, as all links of a group of copies would fill the memory.
    queries: the sets (a mask) whose links with the others are wanted; all if None.
    """
    count = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    frequency = np.bincount(inverse)
    rank = np.empty(len(values), np.int32)
    rank[np.lexsort((values, -frequency))] = np.arange(len(values), dtype=np.int32)  # frequent first: paths are shared near the root
    del values
    tokens = rank[inverse]
    del inverse
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    paths = [np.sort(tokens[a:b]) for a, b in zip(cuts, cuts[1:])]
    posted = np.repeat(np.arange(count, dtype=np.int32), sizes)[np.argsort(tokens, kind="stable")]
    del tokens
    at = np.concatenate([[0], np.cumsum(np.sort(frequency)[::-1])])  # ranks go by frequency
    order = sorted(range(count), key=lambda i: paths[i].astype(">i4").tobytes())

    def common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        return int(differ[0]) if len(differ) else n

    branch = [common(paths[i], paths[j]) for i, j in zip(order, order[1:])] + [0]

    def extend(overlap, place, segment):
        """Adds a path's tokens to the overlaps of the live queries."""
        starts, ends = at[segment], at[segment + 1]
        lengths = ends - starts
        if not lengths.sum():
            return overlap
        index = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        hit = place[posted[index]]
        return overlap + np.bincount(hit[hit >= 0], minlength=len(overlap))

    everyone = np.arange(count) if queries is None else np.flatnonzero(queries)
    start = np.full(count, -1, np.int32)
    start[everyone] = np.arange(len(everyone))
    # nodes on the current path: depth, live queries, their places, overlaps
    stack = [(0, everyone, start, np.zeros(len(everyone), np.int64))]
    for k, i in enumerate(order):
        path, b = paths[i], branch[k]
        before = branch[k - 1] if k else 0
        while stack[-1][0] > before:
            stack.pop()
        depth, live, place, overlap = stack[-1]
        if b > depth:
            overlap = extend(overlap, place, path[depth:b])
            last = k + 1
            # shortest and longest set below this node, for bounds
            low, high = sizes[i], sizes[i]
            while last < count and branch[last - 1] >= b:  # the sets below this node stand next to each other
                low, high = min(low, sizes[order[last]]), max(high, sizes[order[last]])
                last += 1
                if last - k > 256:  # wider subtrees use the table's bounds
                    low, high = sizes.min(), sizes.max()
                    break
            reach = overlap + np.minimum(sizes[live] - overlap, high - b)
            keep = reach * (100 + percent) >= percent * (sizes[live] + low)
            if not keep.all():
                live, overlap = live[keep], overlap[keep]
                place = np.full(count, -1, np.int32)
                place[live] = np.arange(len(live))
            stack.append((b, live, place, overlap))
            depth = b
        final = extend(overlap, place, path[depth:])
        good = 100 * final >= percent * (sizes[i] + sizes[live] - final)
        found = live[good]
        yield i, found[found != i]


JOINED = "sig binary, root binary, n_links bigint"


def _join_cluster(percent: int):
    def join(table: pa.Table) -> pa.Table:
        sigs = table.column("sig").to_pylist()
        rows_of = table.column("copies").to_numpy()
        left = table.column("side").to_numpy()
        sets = [unpack_sorted(x) for x in table.column("tokens").to_pylist()]
        one_chunk = bool((left == 0).all())
        least = np.arange(len(sets))
        counts = np.zeros(len(sets), np.int64)
        for i, found in tree_join(sets, percent, None if one_chunk else left == 1):
            if not one_chunk:  # queries stand on side 1; only their links with side 2 are new
                found = found[left[found] == 1] if left[i] == 2 else found[:0]
                np.add.at(counts, found, rows_of[i])
            counts[i] += rows_of[found].sum()
            labels = np.unique(np.append(least[found], least[i]))
            if len(labels) > 1:
                least[np.isin(least, labels[1:])] = labels[0]
        made = table_of([(s, sigs[least[i]], int(counts[i])) for i, s in enumerate(sigs)], JOINED)
        if sum(map(len, sets)) > 100_000:
            let_go()
        return made

    return join


def _token_links(prefix: DataFrame) -> DataFrame:
    """a, b: every set with the least one of its part of a token's sets, and those with the least of all."""
    hubs = prefix.groupBy("token", "part").agg(F.min("sig").alias("hub"), F.first("parts").alias("parts"))
    near = prefix.join(hubs.select("token", "part", "hub"), ["token", "part"]).select(F.col("sig").alias("a"), F.col("hub").alias("b"))
    split = hubs.where("parts > 1")
    tops = split.groupBy("token").agg(F.min("hub").alias("top"))
    return near.unionByName(split.join(tops, "token").select(F.col("hub").alias("a"), F.col("top").alias("b")))


def jaccard_join(
    docs: DataFrame, percent: int = PERCENT, block_bytes: int = 16 << 20, chunk_sets: int = 4096, chunk_bytes: int = 8 << 20, key: Column | None = None
) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, n_links (documents it links to), component (the least
    signature of its component; null for empty sets), and `key` (binary) if given."""
    size, n_docs = text_size(docs)
    blocks = blocks_for(size, block_bytes)
    source = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), (F.lit(None).cast("binary") if key is None else key).alias("key"))
    source = source.select("*", block_of([F.col("doc_id"), F.col("text")], blocks).alias("block"))
    found = materialise(_survivors(source, blocks, percent))
    members = found.where("tokens is null").select(F.when(F.col("n") > 0, F.col("sig")).alias("sig"), "doc_id", "key", "n")
    nodes = members.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    sets = found.where("tokens is not null").groupBy("sig").agg(F.first("tokens").alias("tokens"), F.first("n").alias("n"))
    total, n_sets = found.where("tokens is not null").agg(F.sum("n"), F.count(F.lit(1))).first()
    few = blocks_for(8 * (total or 0), block_bytes)
    sets = materialise(sets.withColumn("block", block_of([F.col("sig")], few)))
    prefix = materialise(_candidates(sets, few, percent))
    near = components(_token_links(prefix)).select(F.col("node").alias("sig"), F.col("component").alias("cluster"))
    weights = near.join(sets.select("sig", "n"), "sig").groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("bytes"))
    chunks = F.greatest(F.ceil(F.col("size") / chunk_sets), F.ceil(8 * F.col("bytes") / chunk_bytes)).cast("bigint")
    # at most 2048 clusters, components or sets are over the limits
    placed = spread_join(near, "cluster", weights.select("cluster", "size", chunks.alias("chunks")), ["chunks"], F.col("size") > max(64, n_sets // 2048), F.col("sig"))
    placed = placed.join(sets.select("sig", "tokens"), "sig").join(nodes.select("sig", "copies"), "sig")
    own = F.pmod(F.xxhash64("sig"), F.col("chunks"))
    # chunk pairs: side 0 within a chunk, sides 1 and 2 of a pair of chunks
    pairs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1),
        lambda other: F.struct(
            F.least(own, other).alias("x"),
            F.greatest(own, other).alias("y"),
            F.when(own == other, 0).when(own < other, 1).otherwise(2).alias("side"),
        ),
    )
    dealt = placed.select("cluster", "sig", "tokens", "copies", F.explode(pairs).alias("p")).select("cluster", "sig", "tokens", "copies", "p.*")
    joined = materialise(dealt.groupBy("cluster", "x", "y").applyInArrow(_join_cluster(percent), JOINED))
    linked = components(joined.select(F.col("sig").alias("a"), F.col("root").alias("b")))
    links = joined.groupBy("sig").agg(F.sum("n_links").alias("outside"))
    of_node = nodes.join(linked.withColumnRenamed("node", "sig"), "sig", "left").join(links, "sig", "left")
    of_node = of_node.select(
        "sig", "first_id", "copies", (F.col("copies") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("component", "sig").alias("component")
    )
    least = of_node.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("size"))
    hot = max(64, n_docs // 2048)
    of_node = materialise(spread_join(of_node, "component", least, ["component_id"], F.col("size") > hot, F.col("sig")))
    spare = F.unhex(F.md5(F.concat_ws(":", "doc_id", "key")))
    whole = spread_join(members, "sig", of_node, ["component_id", "n_links", "component"], F.col("copies") > hot, spare)
    return whole.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "component",
        *([] if key is None else ["key"]),
    )
