"""Counting keys over the whole corpus through compact array messages.

Rows are dealt into blocks of bounded size. Each block sends the sorted distinct 64-bit
keys it holds to buckets by key range, as one compressed array for each bucket; a bucket adds up
what all blocks sent and answers each with counts in the order of its keys. So a
hot key costs one entry for each block, whatever its rows, and no row is made for each occurrence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER_BYTES

MESSAGE = "bucket bigint, block bigint, keys binary, counts binary"
ANSWER = "block bigint, bucket bigint, counts binary"


class WordHashes(dict):
    """xxh3 hashes of the words of a block of texts; emptied when it holds `limit` of them."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of anything but space and \\x09-\\x0D."""
    return text.translate(LOWER_BYTES).split() if text else []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finaliser of MurmurHash3)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : len(hashes) - n + 1 + k]
    return mixed(out)


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes()


def pack(values: np.ndarray) -> bytes:
    """An unsigned array as byte planes under zstandard."""
    return zstandard.ZstdCompressor(level=1).compress(_planes(np.ascontiguousarray(values))) if len(values) else b""


def unpack(raw: bytes, kind=np.uint64) -> np.ndarray:
    if not raw:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(keys: np.ndarray) -> bytes:
    """A sorted uint64 array by its differences."""
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    return max(1, math.ceil(total_bytes / block_bytes))


def block_of(keys: list[Column], blocks: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("bigint")


def edges(buckets: int) -> np.ndarray:
    """First keys of the buckets but the first: equal ranges of the 64-bit keys."""
    return np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)


def messages(keys: np.ndarray, counts: np.ndarray, block: int, buckets: int) -> list[tuple]:
    """Rows (bucket, block, keys, counts) for sorted distinct keys and their counts in this block."""
    cuts = [0, *np.searchsorted(keys, edges(buckets)).tolist(), len(keys)]
    return [
        (b, block, pack_sorted(keys[x:y]), pack(counts[x:y].astype(np.uint32)))
        for b, (x, y) in enumerate(zip(cuts, cuts[1:]))
        if y > x
    ]


def table_of(rows: list[tuple], ddl: str) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [x.split() for x in ddl.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.table([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each message's keys, all distinct keys of a bucket, and their counts over all blocks."""
    sent = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    held = np.concatenate(sent)
    added = np.concatenate([unpack(x, np.uint32) for x in table.column("counts").to_pylist()])
    order = np.argsort(held, kind="stable")
    held = held[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    return sent, held[first], np.add.reduceat(added[order].astype(np.int64), first)


def answers(requests: DataFrame) -> DataFrame:
    """Counts (64 bits) over all blocks for each message, in the order of its keys."""

    def answer(table: pa.Table) -> pa.Table:
        sent, keys, totals = summed(table)
        totals = totals.astype(np.uint64)
        bucket = table.column("bucket")[0].as_py()
        rows = [(b, bucket, pack(totals[np.searchsorted(keys, k)])) for b, k in zip(table.column("block").to_pylist(), sent)]
        return table_of(rows, ANSWER)

    return requests.groupBy("bucket").applyInArrow(answer, ANSWER)


def answered(table: pa.Table) -> np.ndarray:
    """A block's counts, aligned to its sorted distinct keys. table: the block's answers."""
    order = np.argsort(table.column("bucket").to_numpy())
    raw = table.column("counts")
    return np.concatenate([unpack(raw[int(i)].as_py()) for i in order]) if len(order) else np.zeros(0, np.uint64)
