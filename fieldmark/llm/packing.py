"""Sequences of bounded length from whole documents by vector best-fit (operator 8)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import query, table, vocabulary
from fieldmark.llm.encoding import MEMORY_WORDS, slices, worker_encoder

#: Text bytes whose pieces are packed together; the loss against one packing of all is below one bin per share.
SHARE_BYTES = 12_000_000


def best_fit(lengths: np.ndarray, capacity: np.ndarray, weights: np.ndarray, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each piece, longest pieces first.

    A piece needs (its tokens, one document, its tokens squared as attention
    cost).  Among the open bins in which all three fit, ``norm`` takes the one
    that is left with the smallest weighted residual norm and ``dot`` the one whose
    residual has the smallest weighted dot product with the need; ties go to
    the oldest bin.  Only bins into which no remaining piece can go are closed.
    """
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    needs = np.stack((lengths, np.ones_like(lengths), lengths * lengths), axis=1).astype(np.float64)
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    room = np.empty((max(16, len(lengths)), 3))
    fill, label = np.zeros(len(room), np.int64), np.zeros(len(room), np.int64)
    open_, made = 0, 0
    scale = weights / capacity
    least = lengths.min() if len(lengths) else 0
    for k, i in enumerate(order.tolist()):
        need = needs[i]
        if (need > capacity).any():
            raise ValueError(f"a piece of {lengths[i]} tokens does not fit into an empty sequence")
        if k % 512 == 511:
            keep = np.flatnonzero((room[:open_] >= (least, 1, least * least)).all(1))
            room[: len(keep)], fill[: len(keep)], label[: len(keep)] = room[keep], fill[keep], label[keep]
            open_ = len(keep)
        left = room[:open_]
        fits = np.flatnonzero((left[:, 0] >= need[0]) & (left[:, 1] >= 1) & (left[:, 2] >= need[2]))
        if len(fits):
            after = (left[fits] - need) * scale if rule == "norm" else left[fits] * scale * (need * scale)
            b = fits[(after * after).sum(1).argmin() if rule == "norm" else after.sum(1).argmin()]
        else:
            b = open_
            room[b], fill[b], label[b] = capacity, 0, made
            open_, made = open_ + 1, made + 1
        bins[i], places[i] = label[b], fill[b]
        fill[b] += lengths[i]
        room[b] -= need
    return bins, places


def pieces(docs: DataFrame, vocab: bytes, end_id: int, size: int, key: str = "doc_id", text: str = "text", spaced: bool = False, memory_words: int = MEMORY_WORDS) -> DataFrame:
    """Documents as pieces of at most ``size`` ids, only longer documents cut.

    A document's ids are those of its text and ``end_id``; a null or empty text
    has the end id alone.  A worker remembers ``memory_words`` words, whatever
    their number the ids are the same.  Columns: key, piece, start, length, ids (little-endian u32 bytes).
    """

    def run(batches):
        encoder = worker_encoder(vocab, spaced, memory_words)
        for batch in batches:
            for cut in slices(batch, text):
                flat, offsets = encoder.encode(cut.column(text))
                ids = np.insert(flat, offsets[1:], np.uint32(end_id)).astype("<u4")
                sizes = np.diff(offsets) + 1
                first = np.cumsum(sizes) - sizes
                count = -(-sizes // size)
                doc = np.repeat(np.arange(len(sizes)), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, sizes[doc] - start)
                bounds = np.append(first[doc] + start, len(ids)) * 4
                values = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([cut.column(key).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), values], names=[key, "piece", "start", "length", "ids"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"{key} long, piece int, start long, length long, ids binary")


def pack(
    docs: DataFrame,
    vocab: bytes,
    end_id: int,
    tokens: int = 4096,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    rule: str = "norm",
    key: str = "doc_id",
    text: str = "text",
    share_bytes: int = SHARE_BYTES,
    memory_words: int = MEMORY_WORDS,
) -> DataFrame:
    """Pack every piece of every document into sequences under three capacities.

    ``tokens``, ``documents`` (pieces in a sequence) and ``attention`` (sum of
    squared lengths) all hold; the latter two default to what ``tokens`` allows.
    A document longer than a sequence can hold is cut.  Pieces are dealt to
    shares of about ``share_bytes`` of text by a hash of their content, and each
    share is packed by itself, so no task sees more than a share.  Columns: key,
    piece, start, length, ids, sequence_id, offset.  Repeated rows are packed
    each; an empty table gives no rows.
    """
    documents = documents or tokens
    attention = attention or tokens * tokens
    size = min(tokens, math.isqrt(attention))
    n_bytes = docs.agg(F.sum(F.octet_length(text) + 8)).first()[0] or 0
    shares = max(1, math.ceil(n_bytes / share_bytes))
    cut = pieces(docs, vocab, end_id, size, key, text, memory_words=memory_words)
    dealt = cut.withColumn("share", F.pmod(F.xxhash64(key, "piece", F.crc32("ids")), F.lit(shares)))
    capacity = np.array([tokens, documents, attention], np.float64)
    heavy = np.array(weights, np.float64)

    def run(group: pa.Table) -> pa.Table:
        bins, places = best_fit(group.column("length").to_numpy(), capacity, heavy, rule)
        share = group.column("share").to_numpy()
        out = group.drop_columns(["share"])
        return out.append_column("sequence_id", pa.array((share << 32) + bins)).append_column("offset", pa.array(places))

    schema = f"{key} long, piece int, start long, length long, ids binary, sequence_id long, offset long"
    return dealt.repartition(shares, "share").groupBy("share").applyInArrow(run, schema)


@query()
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    packed = pack(table(spark, sf_dir, "documents"), vocab, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
