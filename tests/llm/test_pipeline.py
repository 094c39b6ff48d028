"""Every stage of the corpus pipeline against brute force on its own input."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from fieldmark.llm import line_dedup, packing, quality, repeats
from fieldmark.llm.common import ARROW_BYTES, bounded_batches, ship, stored, vocabulary
from tests.llm.conftest import odd_texts, words
from tests.llm.test_duplicates import brute_print, brute_spans, roots
from tests.llm.test_tokens import WORD, library

BY_NAME = dict(cp.STAGES)


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "suffix-array dedup", "best-fit packing"]


@pytest.fixture(scope="module")
def kept(spark, small):
    """Output of every stage over the small documents."""
    ship(spark)
    docs = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in cp.STAGES:
        docs.append(stored(stage(spark, docs[-1], small), "test"))
    return docs


def test_columns_of_documents_stay(kept):
    assert all(d.dtypes == kept[0].dtypes for d in kept[1:-1])


def test_rejected_documents_go_and_others_are_untouched(spark, small, kept):
    model = quality.fit(kept[0], spark.read.parquet(f"{small}/labels.parquet"))
    want = [r for r in kept[0].collect() if model.score(np.array([quality.sizes(r.text, model.bad, model.good)]))[0] >= quality.THRESHOLD]
    assert Counter(want) == Counter(kept[1].collect())


def test_boilerplate_lines_go(kept):
    rows = kept[1].collect()
    pages = {}
    for r in rows:
        pages.setdefault(r.source, {})[r.text] = {x.strip(" ") for x in r.text.split("\n")} - {""}
    bad = {s: {x for x, n in Counter(x for p in ps.values() for x in p).items() if n >= line_dedup.LEAST_PAGES and n > line_dedup.RATIO * len(ps)} for s, ps in pages.items()}
    want = Counter((r.doc_id, "\n".join(x for x in r.text.split("\n") if x.strip(" ") not in bad[r.source])) for r in rows)
    assert Counter((r.doc_id, r.text) for r in kept[2].collect()) == want
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())


def first_of_each_group(rows):
    """Ids that stay, from (id, text): fingerprints with at most 4 differing bits are linked; an id that several rows have counts for none."""
    count = Counter(i for i, _ in rows)
    prints = [brute_print(t) for _, t in rows]
    part = roots(len(rows), [(a, b) for b in range(len(rows)) for a in range(b) if (prints[a] ^ prints[b]).bit_count() <= 4])
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(part[k], []).append((i is None or count[i] > 1, i if i is not None else -1, i))
    return Counter(min(g)[2] for g in groups.values())


def test_one_document_of_each_group_stays(kept):
    rows = {r.doc_id: r for r in kept[2].collect()}
    stay = kept[3].collect()
    assert all(rows[r.doc_id] == r for r in stay)
    assert Counter(r.doc_id for r in stay) == first_of_each_group([(i, r.text) for i, r in rows.items()])
    assert len(stay) < len(rows)


def test_repeats_are_cut_in_whole_characters(kept):
    rows = kept[3].collect()
    spans = brute_spans([r.text.encode() for r in rows], 200)
    want = {r.doc_id: repeats.cut(r.text.encode(), repeats.whole_characters(r.text.encode(), s)).decode() for r, s in zip(rows, spans)}
    assert {r.doc_id: r.text for r in kept[4].collect()} == want


def test_packed_sequences_hold_every_document(kept):
    whole = library(WORD)
    rows = kept[5].collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.length)
    docs = kept[4].collect()
    assert {i: sum(v) for i, v in by.items()} == {r.doc_id: len(whole(r.text)) + 1 for r in docs}
    used = len({r.sequence_id for r in rows})
    assert used <= sum(r.length for r in rows) / 4096 * 1.05 + 1


def test_run_gives_what_the_stages_give(spark, small, kept):
    got = cp.run(spark, small)
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got.collect()) == Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in kept[5].collect())


@pytest.mark.parametrize("name", list(BY_NAME))
def test_odd_rows(spark, small, odd, none, name):
    rows = BY_NAME[name](spark, odd, small)
    assert name == "best-fit packing" or rows.columns == odd.columns
    assert rows.count() > 0
    assert BY_NAME[name](spark, none, small).count() == 0


def test_near_dedup_of_odd_rows(spark, small, odd):
    rows = BY_NAME["SimHash near-dedup"](spark, odd, small).collect()
    assert Counter(r.doc_id for r in rows) == first_of_each_group(odd_texts())


def test_texts_that_share_an_id_are_judged_by_themselves(spark, small):
    ship(spark)
    rows = [(7, words(i, 60), "en", "s", 1) for i in range(4)] + [(7, words(0, 60), "en", "s", 1), (None, words(1, 60), "en", "s", 1), (9, words(2, 60), "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in BY_NAME["SimHash near-dedup"](spark, df, small).collect()]
    assert {t for _, t in got} == {words(i, 60) for i in range(4)} and len(got) == 4 and (9, words(2, 60)) in got


def test_exact_copies_of_a_third_of_all_rows(spark, small):
    ship(spark)
    rows = [(i, words(1_000, 80) if i % 3 == 0 else words(i, 80), "en", "s", 1) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in BY_NAME["SimHash near-dedup"](spark, df, small).collect()}
    assert got == {0} | {i for i in range(90) if i % 3}
    assert BY_NAME["line dedup"](spark, df, small).where(F.length("text") == 0).count() == 0


@pytest.mark.parametrize("name", [n for n in BY_NAME if n != "line dedup"])
def test_python_gets_rows_in_bounded_batches(spark, none, small, name):
    own = spark.newSession()
    BY_NAME[name](own, own.createDataFrame([], none.schema), small)

    def measured(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)]), pa.array([batch.nbytes])], names=["n", "bytes"])

    rows = own.range(0, 3_000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text")).mapInArrow(measured, "n long, bytes long").collect()
    assert sum(r.n for r in rows) == 3_000
    assert max(r.bytes for r in rows) <= ARROW_BYTES < 3_000 * 2_000


def test_a_bound_that_the_session_names_stays(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "5000000")
    bounded_batches(own)
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "5000000"


def test_few_remembered_words_give_the_same_pieces(spark, odd):
    ship(spark)
    vocab = vocabulary(WORD)
    few, many = (packing.pack(odd, vocab, cp.END_ID, 64, memory_words=n).drop("sequence_id", "offset").collect() for n in (10, packing.MEMORY_WORDS))
    assert Counter(few) == Counter(many)
