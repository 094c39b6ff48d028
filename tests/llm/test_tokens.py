"""Operators 7, 8 and 10: every text against the libraries, and round trips."""

import base64
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fieldmark.llm import byte_bpe, packing, token_files
from fieldmark.llm.common import vocabulary
from fieldmark.llm.encoding import WordEncoder
from fieldmark.session import scratch_path
from tests.llm.conftest import odd_texts

BYTE, WORD, RANKS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def library(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoders():
    return [(WordEncoder(vocabulary(BYTE), True), library(BYTE)), (WordEncoder(vocabulary(WORD), False), library(WORD))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text("ab 1.,'\ns É", max_size=40)), max_size=6))
def test_words_encode_like_whole_texts(encoders, texts):
    for own, whole in encoders:
        ids, at = own.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [whole(t) for t in texts]


def test_memory_starts_anew(encoders):
    small = WordEncoder(vocabulary(BYTE), True, memory_words=3)
    texts = [t for _, t in odd_texts()]
    for t in texts + texts:
        ids, _ = small.encode(pa.array([t], pa.string()))
        assert ids.tolist() == encoders[0][1](t)


@pytest.mark.parametrize("text", ["a İ. xİ,", "T\u0308. t\u0308. É.", "ẞ. ß!", "it's. 's.", "12, ½.", "a***\nB*** a\n\nb.", "x\x1cy. z\xa0."])
def test_marks_after_odd_letters(encoders, text):
    for own, whole in encoders:
        assert own.encode(pa.array([text, text]))[0].tolist() == 2 * whole(text)


def test_slices_of_an_array(encoders):
    texts = ["É one. TWO", "Three four", "", "five, Sıx", "Seven É\neight"]
    for own, whole in encoders:
        for a in range(len(texts)):
            some = pa.array(texts).slice(a, 2)
            ids, at = own.encode(some)
            assert [ids[i:j].tolist() for i, j in zip(at, at[1:])] == [whole(t) for t in some.to_pylist()]


class Recorded:
    """A tokenizer that notes the texts it gets."""

    def __init__(self, tokenizer):
        self.tokenizer, self.seen = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.seen += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_marked_words_are_learnt_once():
    for path, spaced, forms in ((BYTE, True, "zq zq. zq, zq*** zq?!"), (WORD, False, "zq Zq. ZQ, zq***\nZq?! zq")):
        own, whole = WordEncoder(vocabulary(path), spaced), library(path)
        own.tokenizer = Recorded(own.tokenizer)
        assert own.encode(pa.array([f"on {forms}"]))[0].tolist() == whole(f"on {forms}")
        assert sum(t.lower().count("zq") for t in own.tokenizer.seen) == 1


def test_words_that_come_again_are_kept():
    own, whole = WordEncoder(vocabulary(BYTE), True, memory_words=100), library(BYTE)
    for k in range(50):  # the last ones go beyond 100 words
        text = f"on new{k}x other{k}x" + " again" * (k < 40)
        assert own.encode(pa.array([text]))[0].tolist() == whole(text)
    own.tokenizer = Recorded(own.tokenizer)
    assert own.encode(pa.array(["on again new0x"]))[0].tolist() == whole("on again new0x")
    assert "".join(own.tokenizer.seen) == " new0x"


def test_rank_file_encoding_and_raw_bytes(odd, none):
    ranks = vocabulary(RANKS)
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    lib = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    coded = byte_bpe.encode(odd, ranks, public_tokenizers.PATTERN)
    assert [c for c in coded.columns if c not in odd.columns] == [] and "text" not in coded.columns
    rows = byte_bpe.decode(coded, ranks, public_tokenizers.PATTERN).collect()
    got = Counter((r.doc_id, tuple(r.ids), bytes(r.content)) for r in rows)
    assert got == Counter((i, tuple(lib.encode_ordinary(t or "")), (t or "").encode()) for i, t in odd_texts())
    assert byte_bpe.encode(none, ranks, public_tokenizers.PATTERN).count() == 0


@given(st.text("ab1 \n'.é", max_size=400), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_cuts_are_safe(text, limit):
    lib = byte_bpe.codec(vocabulary(RANKS), public_tokenizers.PATTERN)
    cut = list(byte_bpe.parts(text, limit))
    assert "".join(cut) == text
    assert [i for p in cut for i in lib.encode_ordinary(p)] == lib.encode_ordinary(text)


@given(st.lists(st.integers(0, 2**32 - 1), max_size=900), st.integers(0, 900), st.integers(0, 900))
@settings(max_examples=150, deadline=None)
def test_blocks_round_trip(ids, a, b):
    ids = np.array(ids, "<u4")
    f = token_files.TokenFile(token_files.file_bytes([None, 7], np.array([0, len(ids)]), ids, 3))
    assert f.ids().tolist() == ids.tolist() and f.ids(a, b).tolist() == ids[a:b].tolist()
    assert f.before == 3 and f.keys.to_pylist() == [None, 7] and f.lengths.tolist() == [0, len(ids)]


def test_exceptions_are_few_and_blocks_small():
    ids = np.where(np.arange(2_560) % 20 == 0, 50_000, np.arange(2_560) % 100).astype("<u4")
    data, start = token_files.pack_blocks(ids)
    assert len(data) < len(ids) * 1.5 and len(start) == 11


def test_files_hold_all_documents_in_order(spark, odd, none):
    whole = library(BYTE)
    manifest = token_files.write_ids(odd, scratch_path(spark, "ids"), vocabulary(BYTE), end_id=2)
    rows = sorted(token_files.read_ids(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((i for i, _ in odd_texts()), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_ids for r in rows])[:-1].tolist()
    want = Counter((i, tuple(whole(t) + [2])) for i, t in odd_texts())
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    empty = token_files.write_ids(none, scratch_path(spark, "ids"), vocabulary(BYTE), end_id=2)
    assert token_files.read_ids(empty).count() == 0


def packed_well(rows, texts, whole, size):
    by, seq = Counter(), defaultdict(list)
    for r in rows:
        by[(r.doc_id, r.piece, r.start, r.length, tuple(np.frombuffer(r.ids, "<u4").tolist()))] += 1
        seq[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for i, t in texts:
        ids = whole(t) + [1]
        want.update((i, k // size, k, len(ids[k : k + size]), tuple(ids[k : k + size])) for k in range(0, len(ids), size))
    assert by == want
    for places in seq.values():
        ends = 0
        for offset, length in sorted(places):
            assert offset == ends
            ends += length
        assert ends <= size
    return seq


def test_packing_whole_documents(odd, none):
    vocab = vocabulary(WORD)
    seq = packed_well(packing.pack(odd, vocab, 1, 4096).collect(), odd_texts(), library(WORD), 4096)
    assert len(seq) <= 1.1 * sum(n for v in seq.values() for _, n in v) / 4096 + 1
    packed_well(packing.pack(odd, vocab, 1, 64, share_bytes=20_000).collect(), odd_texts(), library(WORD), 64)
    assert packing.pack(none, vocab, 1).count() == 0


def test_every_capacity_holds(odd):
    rows = packing.pack(odd, vocabulary(WORD), 1, 512, documents=3, attention=200_000, weights=(1.0, 0.5, 0.5), rule="dot").collect()
    seq = defaultdict(list)
    for r in rows:
        seq[r.sequence_id].append(r.length)
    assert all(sum(v) <= 512 and len(v) <= 3 and sum(x * x for x in v) <= 200_000 for v in seq.values())


@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
@settings(max_examples=60, deadline=None)
def test_best_fit_decreasing(lengths):
    bins, _ = packing.best_fit(np.array(lengths), np.array([50.0, 50, 2500]), np.array([1.0, 0, 0]))
    left, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [b for b in range(len(left)) if left[b] >= lengths[i]]
        b = min(fits, key=lambda b: (left[b], b)) if fits else len(left)
        if b == len(left):
            left.append(50)
        left[b] -= lengths[i]
        want[i] = b
    assert bins.tolist() == [want[i] for i in range(len(lengths))]
