"""Token ids in binary files of patched frame-of-reference blocks (operator 7).

A file holds the ids of whole documents, one after the other::

    header   8s magic, u32 ids per block, u32 0, u64 ids, u64 documents, u64 blocks, u64 ids of the same write task before it
    lengths  u32 per document
    keys     i64 per document, then one byte per document (1: the key is null)
    index    u64 per block: where it starts, counted from the first block, and the end of the last
    blocks   u32 minimum, u8 width, u8 0, u16 exceptions, the ids less the minimum packed at that width,
             u8 place per exception, u32 bits beyond the width per exception

The width is the smallest that holds ``PERCENTILE`` per cent of a block's values;
the others are exceptions.  The last block is filled up with its minimum.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import query, table, vocabulary
from fieldmark.llm.encoding import slices, worker_encoder
from fieldmark.session import scratch_path, settle, spread

MAGIC = b"PFORIDS1"
HEADER = struct.Struct("<8sIIQQQQ")
BLOCK = 256
PERCENTILE = 90
#: Ids after which a write task begins a new file.
FILE_IDS = 4_000_000


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))) + 1, 0).astype(np.int64)


def pack_blocks(ids: np.ndarray, percentile: int = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """Blocks as bytes, and where each starts (with the end of the last)."""
    n = len(ids)
    if not n:
        return b"", np.zeros(1, "<u8")
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[(blocks - 1) * BLOCK :].min()
    full = full.reshape(blocks, BLOCK)
    low = full.min(1)
    rest = full - low[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    width = _bits(np.partition(rest, at, axis=1)[:, at])
    over = rest >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_over = over.sum(1)
    size = 8 + width * BLOCK // 8 + 5 * n_over
    start = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    out = np.zeros(start[-1], np.uint8)
    head = np.zeros(blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("over", "<u2")]))
    head["low"], head["width"], head["over"] = low, width, n_over
    out[start[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            bits = np.unpackbits(rest[rows].astype("<u4").view(np.uint8).reshape(len(rows), BLOCK, 4), axis=2, bitorder="little")
            packed = np.packbits(bits[:, :, :w].reshape(len(rows), -1), axis=1, bitorder="little")
            out[(start[rows] + 8)[:, None] + np.arange(packed.shape[1])] = packed
    row, place = np.nonzero(over)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate(([0], np.cumsum(n_over)))[row]
        base = start[row] + 8 + width[row] * BLOCK // 8
        out[base + rank] = place
        high = (rest[row, place] >> width[row].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_over[row] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), start.astype("<u8")


def unpack_blocks(data: np.ndarray, start: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of the blocks that start at ``start`` (with the end of the last) in ``data``."""
    if not n:
        return np.zeros(0, "<u4")
    start = start.astype(np.int64)
    blocks = len(start) - 1
    head = np.ascontiguousarray(data[start[:-1, None] + np.arange(8)]).view(np.dtype([("low", "<u4"), ("width", "u1"), ("zero", "u1"), ("over", "<u2")])).reshape(blocks)
    width, n_over = head["width"].astype(np.int64), head["over"].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if w:
            packed = data[(start[rows] + 8)[:, None] + np.arange(w * BLOCK // 8)]
            bits = np.zeros((len(rows), BLOCK, 32), np.uint8)
            bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            rest[rows] = np.packbits(bits, axis=2, bitorder="little").view("<u4").reshape(len(rows), BLOCK)
    row = np.repeat(np.arange(blocks), n_over)
    if len(row):
        rank = np.arange(len(row)) - np.concatenate(([0], np.cumsum(n_over)))[row]
        base = start[row] + 8 + width[row] * BLOCK // 8
        high = np.ascontiguousarray(data[(base + n_over[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        rest[row, data[base + rank]] |= high << width[row].astype(np.uint32)
    return (rest + head["low"][:, None]).reshape(-1)[:n].astype("<u4")


def file_bytes(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, before: int) -> bytes:
    blocks, index = pack_blocks(ids)
    head = HEADER.pack(MAGIC, BLOCK, 0, len(ids), len(keys), len(index) - 1, before)
    named = np.array([0 if k is None else k for k in keys], "<i8")
    null = np.array([k is None for k in keys], np.uint8)
    return b"".join((head, lengths.astype("<u4").tobytes(), named.tobytes(), null.tobytes(), index.tobytes(), blocks))


class TokenFile:
    """Reads a file's content; ``ids(a, b)`` unpacks only the blocks that hold that range."""

    def __init__(self, content: bytes):
        magic, self.block, _, self.n_ids, self.n_docs, self.n_blocks, self.before = HEADER.unpack_from(content)
        if magic != MAGIC or self.block != BLOCK:
            raise ValueError("not a token file")
        at = HEADER.size
        self.lengths = np.frombuffer(content, "<u4", self.n_docs, at).astype(np.int64)
        at += 4 * self.n_docs
        keys = np.frombuffer(content, "<i8", self.n_docs, at)
        at += 8 * self.n_docs
        null = np.frombuffer(content, np.uint8, self.n_docs, at)
        at += self.n_docs
        self.keys = pa.array(keys, mask=null.astype(bool))
        self.index = np.frombuffer(content, "<u8", self.n_blocks + 1, at)
        self.data = np.frombuffer(content, np.uint8, offset=at + 8 * (self.n_blocks + 1))

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        last = self.n_ids if last is None else min(last, self.n_ids)
        if first >= last:
            return np.zeros(0, "<u4")
        a, b = first // BLOCK, -(-last // BLOCK)
        return unpack_blocks(self.data, self.index[a : b + 1], min(self.n_ids, b * BLOCK) - a * BLOCK)[first - a * BLOCK : last - a * BLOCK]


def write_ids(docs: DataFrame, folder: str, vocab: bytes, end_id: int, key: str = "doc_id", text: str = "text", spaced: bool = True) -> DataFrame:
    """Encode every text, append ``end_id`` and write all ids in ascending order of ``key``.

    Null keys come first and equal keys stand next to each other; a null or empty
    text has the end id alone.  An empty table writes no file.  Returns the
    manifest, settled: part (write task, ascending), file (number in the part),
    path, n_docs, n_ids.  Every attempt of a task writes under names of its own
    and only those of the attempt that counted are in the manifest, so lost
    executors leave no wrong files behind.
    """

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder, part = worker_encoder(vocab, spaced), TaskContext.get().partitionId()
        keys, sizes, ids, held, before, number = [], [], [], 0, 0, 0
        rows = []

        def flush():
            nonlocal keys, sizes, ids, held, before, number
            if keys:
                lengths, flat = np.concatenate(sizes), np.concatenate(ids)
                name = f"part-{part:06d}-{number:05d}-{uuid.uuid4().hex}.pfor"
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(file_bytes(keys, lengths, flat, before))
                rows.append((part, number, f"{folder}/{name}", len(keys), len(flat)))
                keys, sizes, ids, held, before, number = [], [], [], 0, before + len(flat), number + 1

        for batch in batches:
            for cut in slices(batch, text):
                flat, offsets = encoder.encode(cut.column(text))
                ends = np.insert(flat, offsets[1:], np.uint32(end_id))
                keys += cut.column(key).to_pylist()
                sizes.append(np.diff(offsets) + 1)
                ids.append(ends.astype("<u4"))
                held += len(ends)
                if held >= FILE_IDS:
                    flush()
        flush()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["part", "file", "path", "n_docs", "n_ids"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    ordered = rows.repartitionByRange(key, F.xxhash64(text)).sortWithinPartitions(key, F.xxhash64(text))
    return settle(ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long"))


def read_ids(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents of the files in ``manifest``: key, start (ids of all documents before), n_ids, ids (little-endian u32 bytes)."""
    # one row per write task, so this window stays small at any size
    totals = manifest.groupBy("part").agg(F.sum("n_ids").alias("in_part"))
    before = F.sum("in_part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("part", "path").join(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "part")

    def run(batches):
        from pyarrow import fs

        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_stream(place) as f:
                    found = TokenFile(f.read())
                ids = found.ids()
                ends = np.cumsum(found.lengths)
                starts = ends - found.lengths
                raw = pa.py_buffer(ids.tobytes())
                for a in range(0, found.n_docs, 2_000):
                    b = min(a + 2_000, found.n_docs)
                    bounds = np.append(starts[a:b], ends[b - 1]) * 4
                    values = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), raw])
                    yield pa.RecordBatch.from_arrays(
                        [found.keys[a:b], pa.array(starts[a:b] + found.before + base), pa.array(found.lengths[a:b]), values],
                        names=[key, "start", "n_ids", "ids"],
                    )

    return spread(files.select("path", "base"), "path").mapInArrow(run, f"{key} long, start long, n_ids long, ids binary")


@query()
def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    folder = scratch_path(spark, "token-files")
    manifest = write_ids(table(spark, sf_dir, "documents"), folder, vocab, end_id=2)
    read = read_ids(manifest)
    return read.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
