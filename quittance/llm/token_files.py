"""Token-id files: bit- or byte-plane shuffled blocks under zstandard, with a chunk index.

A file holds the ids of consecutive documents. Fixed-size blocks of ids are
transposed into planes (bytes, or bits) up to the highest one in use, and each plane
is compressed on its own. Layout, all integers little-endian:

    magic "QIDP0001"
    compressed planes, block after block, lowest plane first
    documents: zstandard of doc_id int64 (n), is-null uint8 (n), id count uint32 (n)
    chunk index: uint64 (first byte) and uint32 (compressed length) for each plane of each block
    plane counts: uint8 for each block
    footer: uint64 documents at, uint32 documents length, uint32 n documents,
            uint64 n ids, uint32 block size, uint32 n blocks, uint8 planes are bits,
            uint32 crc32 of all before, magic

Files are written by tasks over range-sorted documents into a shared folder under
names that hold the task attempt; only files that the manifest lists are read,
so lost or repeated attempts do no harm. Readers fetch single blocks by the index.

Cases: null and empty texts hold the end id alone; a document's ids may span blocks,
never files; rows of one doc_id stand next to each other, ordered by text, and may span files; null ids come first;
very long texts are written whole; other columns are not read; an empty table gives an empty manifest and no rows.
A file whose checksum does not hold is an error.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_dir, materialise, slices
from .word_tokens import word_tokenizer

MAGIC = b"QIDP0001"
FOOTER = struct.Struct("<QIIQIIBI8s")
#: tasks that read files at most; more files than that share tasks
MOST_READERS = 20_000
MANIFEST = "part bigint, number bigint, path string, documents bigint, ids bigint, bytes bigint"


def planes_of(block: np.ndarray, bits: bool) -> list[bytes]:
    """A block of uint32 ids as planes, lowest first, without empty planes at the top."""
    top = int(block.max()).bit_length() if len(block) else 0
    if bits:
        return [np.packbits((block >> k & 1).astype(np.uint8)).tobytes() for k in range(top)]
    as_bytes = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    return [np.ascontiguousarray(as_bytes[:, k]).tobytes() for k in range((top + 7) // 8)]


def block_of(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        out = np.zeros(n, np.uint32)
        for k, p in enumerate(planes):
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype(np.uint32) << k
        return out
    as_bytes = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        as_bytes[:, k] = np.frombuffer(p, np.uint8)
    return as_bytes.view("<u4").reshape(-1)


def encode_file(doc_ids: list, counts: list[int], ids: bytes, block_ids: int = 1 << 16, bits: bool = False, level: int = 3) -> bytes:
    """A whole file's bytes. ids: of all documents, little-endian unsigned 32-bit."""
    values, pack = np.frombuffer(ids, "<u4"), zstandard.ZstdCompressor(level=level).compress
    out, index, planes_in, at = [MAGIC], [], [], len(MAGIC)
    for a in range(0, len(values), block_ids):
        planes = [pack(p) for p in planes_of(values[a : a + block_ids], bits)]
        planes_in.append(len(planes))
        for p in planes:
            index.append((at, len(p)))
            at += len(p)
        out += planes
    null = np.array([d is None for d in doc_ids], np.uint8)
    docs = pack(np.array([d or 0 for d in doc_ids], "<i8").tobytes() + null.tobytes() + np.array(counts, "<u4").tobytes())
    out += [docs, b"".join(struct.pack("<QI", *x) for x in index), bytes(planes_in)]
    body = b"".join(out)
    return body + FOOTER.pack(at, len(docs), len(doc_ids), len(values), block_ids, len(planes_in), bits, zlib.crc32(body), MAGIC)


class TokenFile:
    """Random access over an open file-like object of a known size."""

    def __init__(self, source, size: int):
        self.source, self.size = source, size
        at, length, self.n_docs, self.n_ids, self.block_ids, blocks, self.bits, self.crc, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        tail = self._read(at, size - FOOTER.size - at)
        raw = zstandard.ZstdDecompressor().decompress(tail[:length])
        n = self.n_docs
        null = np.frombuffer(raw, np.uint8, n, 8 * n)
        self.doc_ids = [None if z else int(d) for d, z in zip(np.frombuffer(raw, "<i8", n), null)]
        self.counts = np.frombuffer(raw, "<u4", n, 9 * n).astype(np.int64)
        self.planes = np.frombuffer(tail, np.uint8, blocks, len(tail) - blocks)
        self.index = list(struct.iter_unpack("<QI", tail[length : len(tail) - blocks]))
        self.first = np.concatenate([[0], np.cumsum(self.planes, dtype=np.int64)])

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def verify(self) -> None:
        """An error unless the checksum of all before the footer holds; reads the file a piece at a time."""
        found, left = 0, self.size - FOOTER.size
        self.source.seek(0)
        while left:
            piece = self.source.read(min(left, 1 << 20))
            if not piece:
                raise ValueError("a token-id file is cut off")
            found, left = zlib.crc32(piece, found), left - len(piece)
        if found != self.crc:
            raise ValueError("the checksum of a token-id file does not hold")

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        unpack = zstandard.ZstdDecompressor().decompress
        return block_of([unpack(self._read(*x)) for x in self.index[self.first[k] : self.first[k + 1]]], n, self.bits)

    def documents(self):
        """(doc_id, ids) in order, a block at a time."""
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.doc_ids, self.counts):
            parts = [held]
            while sum(map(len, parts)) < n:
                parts.append(self.block(k))
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def _open(folder: str):
    return pa.fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, file_ids: int = 4_000_000, bits: bool = False) -> DataFrame:
    """Writes all documents in ascending doc_id order; the manifest (see MANIFEST) once all is written.

    A file ends after the document with which it holds `file_ids` ids, so a task holds one file.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        context = TaskContext.get()
        encode, (store, root) = word_tokenizer(tokenizer_path).encode, _open(folder)
        store.create_dir(root, recursive=True)
        doc_ids, counts, ids, number = [], [], bytearray(), 0

        def close():
            nonlocal doc_ids, counts, ids, number
            data = encode_file(doc_ids, counts, bytes(ids), bits=bits)
            path = f"{root}/part-{context.partitionId():06d}-{number:05d}-{context.taskAttemptId()}.qid"
            with store.open_output_stream(path) as sink:
                sink.write(data)
            row = [context.partitionId(), number, path, len(doc_ids), len(ids) // 4, len(data)]
            doc_ids, counts, ids, number = [], [], bytearray(), number + 1
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["part", "number", "path", "documents", "ids", "bytes"])

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for a, b in slices(batch, pa.compute.binary_length(texts).fill_null(0).to_pylist()):
                for doc_id, text in zip(keys[a:b], texts.slice(a, b - a).to_pylist()):
                    got = encode(text)
                    doc_ids.append(doc_id)
                    counts.append(len(got) // 4 + 1)
                    ids += got
                    ids += end
                    if len(ids) >= 4 * file_ids:
                        yield close()
        if doc_ids:
            yield close()

    sorted_docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("mark", F.xxhash64("text"))
    # the text's hash spreads rows of one id, or of none, over the ranges
    sorted_docs = sorted_docs.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text").select("doc_id", "text")
    return materialise(sorted_docs.mapInArrow(run, MANIFEST))


def read_token_files(manifest: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """A row per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids if wanted."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", "bytes", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    kinds = [pa.int64()] * 4 + [pa.binary()] * with_ids

    def run(batches):
        store, _ = _open(folder)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns)):
                with store.open_input_file(path) as source:
                    token_file = TokenFile(source, size)
                    token_file.verify()
                    rows, held = [], 0
                    for doc_id, ids in token_file.documents():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((doc_id, start, len(ids), zlib.crc32(raw), raw)[: 4 + with_ids])
                        start, held = start + len(ids), held + len(raw) * with_ids
                        if held > 16 << 20 or len(rows) >= 50_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    # a number of partitions that is given is not coalesced: reading is spread over the cluster
    return files.repartition(max(1, min(manifest.count(), MOST_READERS)), "path").mapInArrow(run, schema)


def round_trip(docs: DataFrame, tokenizer_path: str, with_ids: bool = False, **options) -> DataFrame:
    """Writes the files in a fresh shared folder and reads them back."""
    folder = fresh_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer_path, folder, **options), folder, with_ids)
