"""Five stages from raw documents to training sequences, each by one operator of ``fieldmark.llm``.

Every stage reads all rows that the one before kept.  Null texts count as empty,
null ids are kept as ids of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm import line_dedup, packing, quality, repeats, simhash
from fieldmark.llm.common import bounded_batches, ship, stored, table, vocabulary
from fieldmark.session import checked_broadcast

#: Near copies: SimHash of shingles of four words, 64 bits in 5 segments, 4 differing bits at most.
SHINGLE_WORDS, BITS, SEGMENTS, DISTANCE = 4, 64, 5, 4
SEQUENCE_TOKENS, END_ID = 4_096, 1
#: Words a worker remembers in packing: all stages share the executors' memory, and workers keep theirs from one to the next.
MEMORY_WORDS = 200_000


def _ready(spark: SparkSession) -> None:
    """The executors' Python has this package and gets rows in small batches."""
    ship(spark)
    bounded_batches(spark)


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The columns of the documents with the new text, and its length where they have one."""
    chosen = []
    for c in columns:
        if c == "text":
            chosen.append(F.col(text).alias(c))
        elif c == "n_chars":
            chosen.append(F.coalesce(F.length(text), F.lit(0)).cast(docs.schema[c].dataType).alias(c))
        else:
            chosen.append(F.col(c))
    return docs.select(*chosen)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good."""
    _ready(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, column="__score")
    return scored.where(F.col("__score") >= quality.THRESHOLD).select(*docs.columns)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur over a source's documents go; the document stays, however little is left of it."""
    found = line_dedup.drop_boilerplate(docs.withColumn("__text", F.col("text")), "source", "__text", lines_column="__lines", dropped_column="__dropped")
    return _with_text(found, docs.columns, "__text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that the SimHash near-dedup operator links; texts without a word are copies of one another.

    Rows without an id, or with one that other rows have too, are known by their
    text instead: equal ones are one document, other texts under the same id are
    judged by themselves.  They stay only where no row of the group has an id of its own.
    """
    _ready(spark)
    own = F.col("doc_id").cast("long")
    again = docs.groupBy(own.alias("__doc")).agg(F.count("*").alias("__n")).where("__doc is not null and __n > 1")
    named = docs.join(checked_broadcast(again), own == F.col("__doc"), "left")
    named = named.withColumn("__key", F.when(F.col("__n").isNull(), own)).withColumn("__id", simhash.row_id("__key", "text"))
    groups = simhash.near_duplicates(named, SHINGLE_WORDS, BITS, SEGMENTS, DISTANCE, key="__key")
    first = groups.where("id = label").select(F.col("id").alias("__id")).distinct()
    return named.join(first, "__id", "left_semi").dropDuplicates(["__id"]).select(*docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere are cut out, in whole characters."""
    _ready(spark)
    found = repeats.with_spans(docs)
    schema = T.StructType([T.StructField(c, t, True) for c, t in ((f.name, f.dataType) for f in docs.schema)] + [T.StructField("__text", T.StringType())])

    def run(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans")):
                data = text.encode()
                texts.append(repeats.cut(data, repeats.whole_characters(data, repeats.merge(spans.as_py()))).decode())
            row = batch.column("row")
            yield pa.RecordBatch.from_arrays([*row.flatten(), pa.array(texts, pa.string())], schema=None, names=schema.names)

    cut = found.mapInArrow(run, schema)
    return _with_text(cut.withColumn("__text", F.when(F.col("text").isNotNull(), F.col("__text"))), docs.columns, "__text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    import public_tokenizers

    _ready(spark)
    vocab = vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(docs, vocab, END_ID, SEQUENCE_TOKENS, memory_words=MEMORY_WORDS).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_boilerplate),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeats),
    ("best-fit packing", packed),
]

#: Compression, fingerprints and tokens have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
