"""Token spans of two vocabularies over the same bytes, and which tokens meet (operator 11).

Vocabulary A is a byte-level BPE of the tokenizers library, B a sentencepiece
model that puts a space before a text.  Both are read over a space followed by
the text, so that their bytes are the same.

The libraries' own spans are the coarse cuts: character offsets of A, byte spans
of B's proto.  Several tokens may share one character (parts of a multibyte
character, bytes of B's fallback); there the decoded bytes say where each ends.

A text is cut into units before a space or newline between two visible characters: no
token of either vocabulary crosses such a place, so a unit is read once and
remembered.  A vocabulary that does not promise this gets whole texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldmark.llm.common import discard, query, stored, table, vocabulary
from fieldmark.llm.encoding import slices

#: Units that a worker remembers beside as many older ones before it forgets; bounds its memory, never its results.
MEMORY_UNITS = 250_000
#: Bytes of text that are looked at together, and the size of a chunk whose pairs are counted together.
CHUNK_BYTES = 4_000_000

#: Units that are read as one text, and the visible word before them.
_TOGETHER, _FIRST = 2_000, " a"
_UNITS = re.compile(r"(?<=\S)(?=[ \n]\S)")
_SPACE_PIECE = "▁"
SPANS = ("a_ids", "a_ends", "b_ids", "b_ends")


def byte_characters() -> dict[str, int]:
    """The characters that byte-level entries write their bytes with: visible Latin-1 as it is, the others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def byte_places(text: str, raw: bytes) -> np.ndarray:
    """Where each character starts in the text's UTF-8 bytes, and where the last one ends."""
    if len(raw) == len(text):
        return np.arange(len(raw) + 1)
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    sizes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    return np.concatenate(([0], np.cumsum(sizes)))


Flat = list[tuple[np.ndarray, np.ndarray]]


class Tokens:
    """Ids and byte ends of both vocabularies for units of text."""

    def __init__(self, vocabulary: bytes, model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        said = json.loads(vocabulary)
        self.a = Tokenizer.from_str(vocabulary.decode("utf-8"))
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        of = byte_characters()
        names = self.a.get_vocab()
        self.bytes_a = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            if all(c in of for c in name):
                self.bytes_a[i] = bytes(of[c] for c in name)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(_SPACE_PIECE, " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.fromiter(map(len, parts), np.int64, len(parts)) for parts in (self.bytes_a, self.bytes_b))
        self.space = self.b.piece_to_id(_SPACE_PIECE)
        split = said.get("pre_tokenizer") or {}
        local = said.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        self.local = local and not any("\n" in p or _SPACE_PIECE in p.lstrip(_SPACE_PIECE) for p in pieces)

    def units(self, text: str) -> list[str]:
        return _UNITS.split(text) if self.local else [text]

    def _cuts_a(self, unit: str, raw: bytes, found) -> tuple[np.ndarray, np.ndarray] | None:
        if b"".join(map(self.bytes_a.__getitem__, found.ids)) != raw:
            return None
        ids = np.array(found.ids, np.int32)
        span = np.fromiter(chain.from_iterable(found.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        # a token ends inside a character if the next one starts before its end
        clean = np.append(span[1:, 0], len(unit)) >= span[:, 1]
        return ids, np.where(clean, byte_places(unit, raw)[span[:, 1]], np.cumsum(self.sizes_a[ids]))

    def _cuts_b(self, unit: str, raw: bytes, proto) -> tuple[np.ndarray, np.ndarray] | None:
        found, shift = np.array([(p.id, p.begin, p.end) for p in proto.pieces], np.int64).reshape(-1, 3), 1
        if unit[0] == "\n":  # the space that the model puts first is not there in the text
            if not len(found) or found[0, 0] != self.space:
                return None
            found, shift = found[1:], 0
        ids = found[:, 0]
        if b"".join(map(self.bytes_b.__getitem__, ids.tolist())) != raw:
            return None
        # all but the last byte of a character have an empty span, as has the space put first
        return ids.astype(np.int32), np.where(found[:, 2] > found[:, 1], found[:, 2] + shift, np.cumsum(self.sizes_b[ids]))

    def _read(self, units: Sequence[str]) -> list[tuple | None]:
        """(ids, ends) of A and of B for each unit, None where its bytes are not those of the tokens."""
        of_a = self.a.encode_batch(list(units), add_special_tokens=False)
        of_b = self.b.encode([u if u[0] == "\n" else u[1:] for u in units], return_type="proto", num_threads=1)
        found = []
        for unit, x, y in zip(units, of_a, of_b):
            raw = unit.encode()
            a, b = self._cuts_a(unit, raw, x), self._cuts_b(unit, raw, y)
            found.append(None if a is None or b is None else (*a, *b))
        return found

    def _joined(self, units: Sequence[str], sizes: np.ndarray) -> Flat | None:
        """The same for many units that are one text, cut where they end; None if that does not work out."""
        found = self._read([_FIRST + "".join(units)])[0]
        if found is None:
            return None
        stops = len(_FIRST) + np.cumsum(sizes)
        out: Flat = []
        for ids, ends in (found[:2], found[2:]):
            places = np.searchsorted(ends, np.concatenate(([len(_FIRST)], stops)), side="right")
            if (ends[places - 1] != np.concatenate(([len(_FIRST)], stops))).any():
                return None
            counts = np.diff(places)
            starts = np.repeat(stops - sizes, counts)
            held = slice(places[0], None)
            out += [(ids[held], places - places[0]), ((ends[held] - starts).astype(np.int32), places - places[0])]
        return out

    def read(self, units: Sequence[str]) -> tuple[Flat, np.ndarray]:
        """For each of SPANS the flat values and the places where units start and end; and which units have tokens at all.

        Units that end in a visible character are read as one text, which they
        would be parts of anyway; where that does not give whole units, one by one.
        """
        flats, good = [], np.ones(len(units), bool)
        for i in range(0, len(units), _TOGETHER):
            some = units[i : i + _TOGETHER]
            sizes = np.fromiter((len(u.encode()) for u in some), np.int64, len(some))
            flat = self._joined(some, sizes) if self.local and not any(u[-1].isspace() for u in some) else None
            if flat is None:
                found = self._read(some)
                good[i : i + len(some)] = [f is not None for f in found]
                flat = []
                for k in range(4):
                    values = [f[k] if f else [] for f in found]
                    flat.append((np.fromiter(chain.from_iterable(values), np.int32), np.cumsum([0, *map(len, values)])))
            flats.append(flat)
        out = []
        for k in range(4):
            values = [f[k][0] for f in flats]
            sizes = [np.diff(f[k][1]) for f in flats]
            out.append((np.concatenate(values) if values else np.zeros(0, np.int32), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))) if sizes else np.zeros(1, np.int64)))
        return out, good


class Remembered:
    """Units of texts and what is known of each: read once, then looked up."""

    def __init__(self, tokens: Tokens, memory_units: int = MEMORY_UNITS):
        self.tokens, self.memory_units = tokens, memory_units
        self.memory: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def learn(self, units: Sequence[str]) -> None:
        raise NotImplementedError

    def _known(self, units: list[str]) -> list[tuple | None]:
        """What is known of ``units``; those not used for long are forgotten."""
        if len(self.memory) > self.memory_units:
            self.older, self.memory = self.memory, {}
        for u in units:
            if u not in self.memory and u in self.older:
                self.memory[u] = self.older[u]
        # units that end in a space come last, so that they part no others
        self.learn(sorted((u for u in units if u not in self.memory), key=lambda u: u[-1].isspace()))
        return [self.memory[u] for u in units]

    def look_up(self, texts: Sequence[str | None]) -> tuple[list[tuple | None], np.ndarray, np.ndarray]:
        """What is known of the different units, and for each unit of a text which it is and whose.

        Texts with a unit that either vocabulary cannot give back have none.
        """
        cut = [self.tokens.units(" " + t) if t else [] for t in texts]
        units = pa.array(list(chain.from_iterable(cut)), pa.large_string()).dictionary_encode()
        names, index = units.dictionary.to_pylist(), units.indices.to_numpy().astype(np.int64)
        of_text = np.repeat(np.arange(len(cut)), [len(u) for u in cut])
        known = self._known(names)
        broken = np.fromiter((v is None for v in known), bool, len(known))
        if broken.any():
            bad = np.zeros(len(cut), bool)
            bad[of_text[broken[index]]] = True
            keep = ~bad[of_text]
            index, of_text = index[keep], of_text[keep]
        return known, index, of_text


def _gather(parts: list[bytes], sizes: list[int], index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit values of the units ``index`` one after the other, and how many each has; ``parts`` hold ``sizes`` values for the units in order."""
    flat, n = np.frombuffer(b"".join(parts), "<i4"), np.array(sizes, np.int64)
    start, n = (np.cumsum(n) - n)[index], n[index]
    stop = np.cumsum(n)
    return flat[np.repeat(start - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)], n


def _places(of_text: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.bincount(of_text, n, texts).astype(np.int64))))


class SpanEncoder(Remembered):
    """Ids and byte ends of the tokens of whole texts."""

    def learn(self, units: Sequence[str]) -> None:
        flat, good = self.tokens.read(units)
        raw = [(v.astype("<i4").tobytes(), (4 * p).tolist()) for v, p in flat]
        for k, (unit, fine) in enumerate(zip(units, good.tolist())):
            self.memory[unit] = tuple(v[p[k] : p[k + 1]] for v, p in raw) if fine else None

    def spans(self, texts: Sequence[str | None]) -> Flat:
        """For each of SPANS the flat values and the n + 1 places where texts start and end."""
        known, index, of_text = self.look_up(texts)
        empty = (b"",) * 4
        out: Flat = []
        for k in range(4):
            parts = [(v or empty)[k] for v in known]
            flat, n = _gather(parts, [len(p) // 4 for p in parts], index)
            if k in (1, 3):  # ends count from the start of the text
                last = np.fromiter((int.from_bytes(v[k][-4:], "little") if v else 0 for v in known), np.int64, len(known))[index]
                before = np.cumsum(last) - last
                first = np.searchsorted(of_text, np.arange(len(texts)))
                base = before - before[first[of_text]] if len(index) else before
                flat = (flat + np.repeat(base, n)).astype(np.int32)
            out.append((flat, _places(of_text, n, len(texts))))
        return out


class LinkEncoder(Remembered):
    """Counts, group texts and linked id pairs of whole texts.

    A unit starts and ends with tokens of both vocabularies, so groups and links
    of a text are those of its units.
    """

    def learn(self, units: Sequence[str]) -> None:
        flat, good = self.tokens.read(units)
        found = meet(flat)
        pairs, at = found["pairs"].astype("<i8").tobytes(), (8 * found["places"]).tolist()
        counts = np.stack([found[c] for c in _COUNTS], axis=1).astype("<i4").tobytes()
        size = 4 * len(_COUNTS)
        for k, (unit, fine, said) in enumerate(zip(units, good.tolist(), found["groups"])):
            self.memory[unit] = (counts[k * size : (k + 1) * size], pairs[at[k] : at[k + 1]], said) if fine else None

    def links(self, texts: Sequence[str | None]) -> dict[str, list | np.ndarray]:
        """Counts, a hash of the group text, each linked pair once and how often, and the places where a text's pairs start and end."""
        known, index, of_text = self.look_up(texts)
        rows, nothing = len(texts), (bytes(4 * len(_COUNTS)), b"", "")
        counts = np.frombuffer(b"".join([(v or nothing)[0] for v in known]), "<i4").reshape(-1, len(_COUNTS))[index]
        out = {name: np.bincount(of_text, counts[:, k], rows).astype(np.int64) for k, name in enumerate(_COUNTS)}
        said = [(v or nothing)[2] for v in known]
        places, numbers = _places(of_text, np.ones(len(index)), rows).tolist(), index.tolist()
        texts_of = (";".join([said[u] for u in numbers[i:j]]) for i, j in zip(places, places[1:]))
        out["groups_sha256"] = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts_of]
        parts = [(v or nothing)[1] for v in known]
        kinds, kind = np.unique(np.frombuffer(b"".join(parts), "<i8"), return_inverse=True)
        codes, n = _gather([kind.astype("<i4").tobytes()], [len(p) // 8 for p in parts], index)
        size = max(len(kinds), 1)
        each, times = np.unique(np.repeat(of_text, n) * size + codes, return_counts=True)
        return out | {"pairs": kinds[each % size] if len(each) else each, "times": times.astype(np.int64), "places": np.searchsorted(each, np.arange(rows + 1) * size)}


_WORKERS: dict[tuple, Remembered] = {}


def worker_encoder(kind: type[Remembered], vocabulary: bytes, model: bytes) -> Remembered:
    """The encoder of this Python worker, kept from task to task."""
    key = (kind.__name__, hash(vocabulary), hash(model))
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = kind(Tokens(vocabulary, model))
    return _WORKERS[key]


def _fields(df: DataFrame, *replaced: str) -> list[T.StructField]:
    return [f for f in df.schema if f.name not in replaced]


def align(df: DataFrame, vocabulary: bytes, model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by four arrays: ids and byte ends of A's tokens, then of B's, over a space and the text.

    Other columns stay (columns named like the four are replaced).  A null or
    empty text has no tokens, nor has one whose joined bytes differ from the
    space and the text in A or B, as texts with U+2581 do.  Strings of special
    tokens are plain text.  Texts are used whole, whatever their length.
    """
    ints = T.ArrayType(T.IntegerType(), False)
    kept = _fields(df, text, *SPANS)
    schema = T.StructType(kept + [T.StructField(name, ints) for name in SPANS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(SpanEncoder, vocabulary, model)
        for batch in batches:
            for cut in slices(batch, text, CHUNK_BYTES):
                lists = [pa.ListArray.from_arrays(pa.array(p.astype(np.int32)), pa.array(v)) for v, p in encoder.spans(cut.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*(cut.column(f.name) for f in kept), *lists], names=schema.names)

    return df.mapInArrow(run, schema)


def meet(spans: Flat) -> dict[str, list | np.ndarray]:
    """Counts, group text and links of each text from arrays as ``SpanEncoder.spans`` gives them.

    The ends of both vocabularies cut a text into pieces, and each piece is the
    overlap of one token of A and one of B: their number is the number of links.
    ``pairs`` are the links in order, A's id in the high half of a long.
    """
    (a_ids, a_at), (a_ends, _), (b_ids, b_at), (b_ends, _) = spans
    n = len(a_at) - 1
    last = np.zeros(n, np.int64)
    some = np.diff(a_at) > 0
    last[some] = a_ends[a_at[1:][some] - 1]
    base = np.cumsum(last) - last  # texts one after the other, so that all are cut at once
    at_a, at_b = (e.astype(np.int64) + np.repeat(base, np.diff(p)) for e, p in ((a_ends, a_at), (b_ends, b_at)))
    cuts = np.union1d(at_a, at_b)
    i, j = np.searchsorted(at_a, cuts), np.searchsorted(at_b, cuts)
    of_cut = np.searchsorted(a_at, i, side="right") - 1
    shared = np.flatnonzero((at_a[i] == cuts) & (at_b[j] == cuts)) if len(cuts) else np.zeros(0, np.int64)
    i_ends, j_ends = (i[shared] + 1).tolist(), (j[shared] + 1).tolist()
    a, b = (list(map(str, v.tolist())) for v in (a_ids, b_ids))
    groups = [",".join(a[w:x]) + "|" + ",".join(b[y:z]) for w, x, y, z in zip([0, *i_ends], i_ends, [0, *j_ends], j_ends)]
    group_places = np.searchsorted(of_cut[shared], np.arange(n + 1))
    at = group_places.tolist()
    return {
        "n_a": np.diff(a_at), "n_b": np.diff(b_at), "n_groups": np.diff(group_places), "n_links": np.bincount(of_cut, minlength=n).astype(np.int64),
        "groups": [";".join(groups[x:y]) for x, y in zip(at, at[1:])],
        "pairs": (a_ids[i].astype(np.int64) << 32) | b_ids[j], "places": np.searchsorted(of_cut, np.arange(n + 1)),
    }


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked(df: DataFrame, vocabulary: bytes, model: bytes, text: str = "text") -> DataFrame:
    """Replace ``text`` by counts of tokens, groups and links, a hash of the groups, and the linked id pairs.

    Groups are the runs of tokens between byte offsets where tokens of both
    vocabularies end.  ``pairs`` holds each linked pair once (A's id in the high
    half of a long), ``times`` how often; ``chunk`` numbers rows that were
    looked at together.
    """
    kept = _fields(df, text, *_COUNTS, "groups_sha256", "pairs", "times", "chunk")
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType(
        kept + [T.StructField(c, T.LongType(), False) for c in _COUNTS]
        + [T.StructField("groups_sha256", T.StringType(), False), T.StructField("pairs", longs), T.StructField("times", longs), T.StructField("chunk", T.LongType(), False)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(LinkEncoder, vocabulary, model)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for cut in slices(batch, text, CHUNK_BYTES):
                found = encoder.links(cut.column(text).to_pylist())
                places = pa.array(found["places"].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(cut.column(f.name) for f in kept),
                        *(pa.array(found[c], pa.int64()) for c in _COUNTS),
                        pa.array(found["groups_sha256"], pa.string()),
                        pa.ListArray.from_arrays(places, pa.array(found["pairs"])),
                        pa.ListArray.from_arrays(places, pa.array(found["times"])),
                        pa.array(np.full(len(cut), chunk), pa.int64()),
                    ],
                    names=schema.names,
                )
                chunk += 1

    return df.mapInArrow(run, schema)


def _pairs_of_chunks(links: DataFrame) -> DataFrame:
    """(chunk, pair, n): in how many rows of a chunk a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("pairs").offsets.to_numpy())
            chunk = np.repeat(batch.column("chunk").to_numpy(), sizes)
            pair = batch.column("pairs").flatten().to_numpy()
            for c in np.unique(chunk):
                kinds, n = np.unique(pair[chunk == c], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), c)), pa.array(kinds), pa.array(n.astype(np.int64))], names=["chunk", "pair", "n"])

    rows = links.select("chunk", "pairs").mapInArrow(run, "chunk long, pair long, n long")
    return rows.groupBy("chunk", "pair").agg(F.sum("n").alias("n"))


def with_corpus_counts(links: DataFrame) -> DataFrame:
    """Replace ``pairs`` and ``times`` by ``n_best`` and ``count_sum``; ``links`` is stored already.

    A pair's count is the number of rows of the whole table that hold it linked.  Pairs
    are counted by chunk first, and a chunk gets back the counts of its own
    pairs, so a common pair moves once for each chunk and not for each row.
    """
    rows = _pairs_of_chunks(links)
    counts = rows.groupBy("pair").agg(F.sum("n").alias("count"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("count").alias("most"))  # at most B's vocabulary each
    marked = counts.withColumn("a", F.shiftright("pair", 32)).join(best, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    back = rows.select("chunk", "pair").join(marked, "pair")
    kept = _fields(links, "pairs", "times", "chunk", "n_best", "count_sum")
    schema = T.StructType(kept + [T.StructField(c, T.LongType(), False) for c in ("n_best", "count_sum")])

    def run(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        known = pairs.sort_by("pair")
        names, count, best = (known.column(c).to_numpy() for c in ("pair", "count", "best"))
        held = docs.combine_chunks()
        sizes = np.fromiter((len(x) for x in held.column("pairs")), np.int64, len(held))
        row = np.repeat(np.arange(len(held)), sizes)
        at = np.searchsorted(names, held.column("pairs").combine_chunks().flatten().to_numpy())
        times = held.column("times").combine_chunks().flatten().to_numpy()
        total = np.zeros((2, len(held)), np.int64)
        if len(row):
            np.add.at(total[0], row, times * best[at])
            np.add.at(total[1], row, times * count[at])
        return pa.table([*(held.column(f.name) for f in kept), *map(pa.array, total)], names=schema.names)

    return links.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, schema)


@query()
def op11_token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (vocabulary(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    links = stored(linked(table(spark, sf_dir, "documents").select("doc_id", "text"), a, b), "links")
    out = stored(with_corpus_counts(links), "spans")
    discard(links)
    return out
