"""Byte-level BPE by the tiktoken library and a local rank file (operator 10)."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.common import query, table, vocabulary
from fieldmark.llm.encoding import slices

#: Characters after which a long text is cut at the next safe place.
CUT_CHARS = 65_536
#: No piece of the pattern goes on over these places, so both sides can be encoded apart:
#: a visible character before a space or newline, a plain letter before a plain digit, a digit before a letter.
SAFE = re.compile(r"\S(?=[ \n])|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")

#: Rows that are decoded, and bytes of text that are encoded, into one batch.
ROWS, BATCH_BYTES = 256, 1_000_000

_CODECS: dict[int, object] = {}


def codec(ranks: bytes, pattern: str):
    """The library's encoding for a rank file's content, one per Python worker."""
    key = hash((ranks, pattern))
    if key not in _CODECS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        _CODECS.clear()
        _CODECS[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _CODECS[key]


def parts(text: str, limit: int = CUT_CHARS) -> Iterator[str]:
    """Cut a long text at safe places, at least ``limit`` characters apart."""
    start = 0
    while len(text) - start > limit:
        at = SAFE.search(text, start + limit - 1)
        if at is None:
            break
        yield text[start : at.end()]
        start = at.end()
    yield text[start:]


def encode_text(encoding, text: str | None) -> list[int]:
    if not text:
        return []
    if len(text) <= CUT_CHARS:
        return encoding.encode_ordinary(text)
    return [i for part in parts(text) for i in encoding.encode_ordinary(part)]


def encode(df: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Replace the column ``text`` by ``ids`` (array<int>); all other columns stay.

    A null or empty text has no ids; strings of special tokens are ordinary text.
    A column that is already named ``ids`` is replaced.
    """
    schema = T.StructType([f for f in df.schema if f.name not in (text, ids)] + [T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        encoding = codec(ranks, pattern)
        for batch in batches:
            for cut in slices(batch, text, BATCH_BYTES):
                found = [np.array(encode_text(encoding, t), np.int32) for t in cut.column(text).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                flat = np.concatenate(found)
                kept = [cut.column(f.name) for f in schema[:-1]]
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*kept, values], names=schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", content: str = "content") -> DataFrame:
    """Add ``content`` (binary): the raw bytes that the ids stand for, also where they are no valid UTF-8."""
    schema = T.StructType([f for f in df.schema if f.name != content] + [T.StructField(content, T.BinaryType())])

    def run(batches):
        encoding = codec(ranks, pattern)
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                cut = batch.slice(start, ROWS)
                column = cut.column(ids)
                # one row's ids at a time become Python numbers
                bytes_of = [encoding.decode_bytes(x.values.to_pylist()) if x.is_valid else None for x in column]
                kept = [cut.column(f.name) for f in schema[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(bytes_of, pa.binary())], names=schema.names)

    return df.mapInArrow(run, schema)


@query()
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, ranks, public_tokenizers.PATTERN)
    back = decode(coded, ranks, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("content", 256).alias("decoded_sha256"),
    )
