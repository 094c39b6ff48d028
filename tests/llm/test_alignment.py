"""Token spans of two vocabularies against whole-text encodings and all pairs of tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest

from fieldmark.llm import alignment
from fieldmark.llm.common import QUERIES, stored

P = pytest.importorskip("public_tokenizers")
A, B = (open(P.path(name), "rb").read() for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def encoder():
    return alignment.SpanEncoder(alignment.Tokens(A, B))


def whole(encoder, text):
    """Ids and byte ends of both vocabularies from the whole text and its decoded bytes."""
    encoder = encoder.tokens
    if not text:
        return [], [], [], []
    a = encoder.a.encode(" " + text, add_special_tokens=False).ids
    b = encoder.b.encode(text)
    parts = [encoder.bytes_a[i] for i in a], [encoder.bytes_b[i] for i in b]
    if any(b"".join(p) != (" " + text).encode() for p in parts):
        return [], [], [], []
    ends = [[sum(map(len, p[: k + 1])) for k in range(len(p))] for p in parts]
    return a, ends[0], b, ends[1]


def brute(encoder, texts):
    """The query's rows (without ids) from all pairs of tokens."""
    found = []
    for text in texts:
        a, ea, b, eb = whole(encoder, text)
        sa, sb = [0, *ea[:-1]], [0, *eb[:-1]]
        links = [(x, y) for x, s, e in zip(a, sa, ea) for y, t, f in zip(b, sb, eb) if s < f and t < e]
        cuts = sorted(set(ea) & set(eb))
        said = ";".join(
            ",".join(str(x) for x, e in zip(a, ea) if lo < e <= hi) + "|" + ",".join(str(y) for y, f in zip(b, eb) if lo < f <= hi)
            for lo, hi in zip([0, *cuts], cuts)
        )
        found.append((len(a), len(b), len(cuts), links, hashlib.sha256(said.encode()).hexdigest() if a else ""))
    count = Counter(pair for *_, links, _ in found for pair in set(links))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    return [(na, nb, g, len(ls), sum(count[p] == most[p[0]] for p in ls), sum(count[p] for p in ls), h) for na, nb, g, ls, h in found]


def strange(n, seed=7, longest=40):
    r = random.Random(seed)
    alphabet = "ab é日\U0001f600\n\t '1!\x85 ▁\r<>|s"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(1, longest))) for _ in range(n)]


def test_units_give_the_spans_of_whole_texts(encoder):
    texts = [None, "", " ", "\n", "a  b\n\nc", "x▁y", "nul\x00l", "<s> <|endoftext|> </s>", "́a b", " lead", *strange(1500)]
    got = encoder.spans(texts)
    for k, text in enumerate(texts):
        assert tuple(v[p[k] : p[k + 1]].tolist() for v, p in got) == tuple(map(list, whole(encoder, text))), repr(text)


def test_forgetting_units_changes_nothing(encoder):
    small = alignment.SpanEncoder(encoder.tokens, memory_units=3)
    texts = strange(60, seed=3)
    for at in range(0, 60, 10):
        for (v, p), (w, q) in zip(small.spans(texts[at : at + 10]), encoder.spans(texts[at : at + 10])):
            assert v.tolist() == w.tolist() and p.tolist() == q.tolist()


def test_links_of_units_are_those_of_whole_texts(encoder):
    texts = [None, "the cat sat", *strange(300, seed=11)]
    links = alignment.LinkEncoder(encoder.tokens, memory_units=50)
    for at in range(0, 300, 50):
        some = texts[at : at + 50]
        got, want = links.links(some), alignment.meet(encoder.spans(some))
        for c in ("n_a", "n_b", "n_groups", "n_links"):
            assert got[c].tolist() == want[c].tolist()
        assert got["groups_sha256"] == [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in want["groups"]]
        for k in range(len(some)):
            pairs = Counter(want["pairs"][want["places"][k] : want["places"][k + 1]].tolist())
            place = slice(got["places"][k], got["places"][k + 1])
            assert dict(zip(got["pairs"][place].tolist(), got["times"][place].tolist())) == pairs


def test_align_keeps_rows_and_columns(spark, odd, encoder):
    rows = alignment.align(odd, A, B).collect()
    texts = {(r.doc_id, r.n_chars): r.text for r in odd.collect()}
    assert len(rows) == odd.count() and set(rows[0].asDict()) == set(odd.columns) - {"text"} | set(alignment.SPANS)
    for r in rows:
        want = whole(encoder, texts[(r.doc_id, r.n_chars)]) if r.n_chars < 5_000 else None
        if want:
            assert (r.a_ids, r.a_ends, r.b_ids, r.b_ends) == want


def test_counts_match_all_pairs_of_tokens(spark, encoder):
    texts = [None, "", "the cat", "the cat", "the cat sat\non the mat", "日本 café x▁y", "日本 café", *strange(150, longest=25)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    links = stored(alignment.linked(df, A, B), "links")
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    got = {r.doc_id: tuple(r[c] for c in columns) for r in alignment.with_corpus_counts(links).collect()}
    assert got == dict(enumerate(brute(encoder, texts)))


def test_odd_rows_and_an_empty_table(spark, odd, none):
    links = stored(alignment.linked(odd, A, B), "links")
    rows = alignment.with_corpus_counts(links).collect()
    assert len(rows) == odd.count() and all((r.groups_sha256 == "") == (r.n_a == 0) for r in rows)
    assert {"score", "row", "node"} <= set(rows[0].asDict())
    assert alignment.with_corpus_counts(stored(alignment.linked(none, A, B), "links")).count() == 0


def test_registered_query_against_brute_force(spark, small, encoder):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    short = [d for d in docs if len(d.text or "") < 900]
    rows = {r.doc_id: r for r in QUERIES["op11_token_spans"](spark, small).collect()}
    assert len(rows) == len(docs)
    for d, want in zip(short, brute(encoder, [d.text for d in short])):
        r = rows[d.doc_id]
        # counts over the whole corpus are checked by the test above
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*want[:4], want[6])
        assert r.n_best <= r.n_links <= r.count_sum
