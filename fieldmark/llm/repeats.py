"""Repeated byte strings by an enhanced suffix array over anchors (operator 5).

Sorting every suffix of a corpus is not needed to find strings of ``least``
bytes that occur twice.  In every such string the k-gram with the smallest
hash (the last of equals) is its anchor; equal strings have the same anchor at
the same place.  So only suffixes at anchors are compared, with what stands
before them, and only among anchors with the same k-gram.  Anchors whose whole
surroundings repeat are settled by hashes; the rest go into suffix arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import discard, query, release, stored, table, whole_groups
from fieldmark.llm.encoding import slices

#: Bytes of a repeat at least, and of the k-gram that stands for it.
LEAST, GRAM = 200, 64
#: Bytes that are hashed at once; a longer text goes in overlapping cuts.
CUT_BYTES = 250_000
#: Surroundings of one k-gram that are sorted together; more are compared by the hashes of their strings.
TOGETHER = 8_000
#: Anchors that a task gathers by k-gram and surroundings before they are shuffled.
GATHERED = 100_000

_POWERS = [int(x) | 1 for x in np.random.default_rng(5).integers(1 << 62, 1 << 63, 8, dtype=np.int64)]
_BYTES = np.random.default_rng(3).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64)


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes (a power of two)."""
    h, width = _BYTES[data], 1
    for power in _POWERS:
        if width == gram:
            break
        h = h[:-width] * np.uint64(power) + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(_POWERS[-1])
    return h ^ (h >> np.uint64(32))


def last_minimum(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of every ``width`` values, the last of equals."""
    low, at, have = h, np.arange(len(h), dtype=np.int64), 1
    while have < width:
        step = min(have, width - have)
        right = low[step:] <= low[:-step]
        low, at = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


def anchors(texts: list[bytes], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place and hash of every anchor."""
    owner, place, code = [], [], []
    group: list[tuple[int, int, bytes]] = []

    def work():
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        h = gram_hashes(data, gram)
        at = last_minimum(h, least - gram + 1)
        sizes = np.array([len(g[2]) for g in group])
        ends = np.cumsum(sizes)
        # a string of `least` bytes starts here and ends within the same text
        text = np.repeat(np.arange(len(group)), sizes)[: len(at)]
        at = at[np.arange(len(at)) + least <= ends[text]]
        if len(at):
            at = at[np.append(True, at[1:] != at[:-1])]
            text = np.searchsorted(ends, at, side="right")
            owner.append(np.array([g[0] for g in group])[text])
            place.append(at - (ends - sizes)[text] + np.array([g[1] for g in group])[text])
            code.append(h[at])

    held = 0
    for i, data in enumerate(texts):
        for start in range(0, max(1, len(data) - least + 1), CUT_BYTES):
            part = data[start : start + CUT_BYTES + least - 1]
            if len(part) >= least:
                group.append((i, start, part))
                held += len(part)
                if held >= CUT_BYTES:
                    work()
                    group.clear()
                    held = 0
    if group:
        work()
    if not owner:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner, place, code = np.concatenate(owner), np.concatenate(place), np.concatenate(code)
    twice = np.append(False, (owner[1:] == owner[:-1]) & (place[1:] == place[:-1]))  # found in two cuts of a long text
    return owner[~twice], place[~twice], code[~twice]


#: Anchors of one k-gram that a task met together: a list of surroundings, each with all its places.
_MORE = pa.list_(pa.struct([("around", pa.int64()), ("right", pa.int16()), ("places", pa.list_(pa.struct([("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pos", pa.int32())])))]))
_ANCHORS = pa.schema([("gram", pa.int64()), ("around", pa.int64()), ("right", pa.int16()), ("doc", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("pos", pa.int32()), ("more", _MORE)])


def _gathered(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Anchors (gram, around, right, doc, a, b, pos) by k-gram: one alone in its columns, several in ``more``, by ascending surroundings."""
    order = np.lexsort((columns[1], columns[0]))
    gram, around, right, doc, a, b, pos = columns = [c[order] for c in columns]
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
    sizes = np.diff(np.append(starts, len(gram)))
    alone = starts[sizes == 1]
    if len(alone):
        yield pa.RecordBatch.from_arrays([*(pa.array(c[alone]) for c in columns), pa.nulls(len(alone), _MORE)], schema=_ANCHORS)
    if len(alone) < len(starts):
        several = np.repeat(sizes > 1, sizes)
        gram, around, right, doc, a, b, pos = (c[several] for c in columns)
        new_gram = np.append(True, gram[1:] != gram[:-1])
        kinds = np.flatnonzero(new_gram | np.append(True, around[1:] != around[:-1]))
        grams = np.flatnonzero(new_gram[kinds])
        places = pa.StructArray.from_arrays([pa.array(c) for c in (doc, a, b, pos)], fields=list(_MORE.value_type.field("places").type.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.append(kinds, len(gram)).astype(np.int32)), places)
        found = pa.StructArray.from_arrays([pa.array(around[kinds]), pa.array(right[kinds]), lists], fields=list(_MORE.value_type))
        more = pa.ListArray.from_arrays(pa.array(np.append(grams, len(kinds)).astype(np.int32)), found)
        yield pa.RecordBatch.from_arrays([pa.array(gram[kinds[grams]]), *(pa.nulls(len(grams), f.type) for f in list(_ANCHORS)[1:7]), more], schema=_ANCHORS)


def _find_anchors(docs: DataFrame, least: int, gram: int) -> DataFrame:
    """Anchors by k-gram: gram, around (hash of the surroundings), right (bytes from the anchor on), doc, a, b (hashes of the text), pos, more.

    What a task finds is gathered first, so a k-gram that stands in very many
    texts has a row for every ``GATHERED`` anchors of a task, not for each place.
    """

    def run(batches):
        from xxhash import xxh3_64_intdigest

        held, size = [], 0
        for batch in batches:
            for cut in slices(batch, "text"):
                texts = [t.encode() if t else b"" for t in cut.column("text").to_pylist()]
                owner, place, code = anchors(texts, least, gram)
                if not len(owner):
                    continue
                left = np.minimum(place, least - gram)
                right = np.minimum(np.array([len(t) for t in texts], np.int64)[owner] - place, least)
                around = np.fromiter((xxh3_64_intdigest(texts[o][p - x : p + y], x) for o, p, x, y in zip(owner.tolist(), place.tolist(), left.tolist(), right.tolist())), np.uint64, len(owner))
                named = [cut.column(c).to_numpy()[owner] for c in ("doc", "a", "b")]
                held.append([code.view(np.int64), around.view(np.int64), right.astype(np.int16), *named, place.astype(np.int32)])
                size += len(owner)
                if size >= GATHERED:
                    yield from _gathered([np.concatenate(c) for c in zip(*held)])
                    held, size = [], 0
        if held:
            yield from _gathered([np.concatenate(c) for c in zip(*held)])

    more = "array<struct<around: long, right: short, places: array<struct<doc: long, a: long, b: long, pos: int>>>>"
    return docs.mapInArrow(run, f"gram long, around long, right short, doc long, a long, b long, pos int, more {more}")


def _surroundings(docs: DataFrame, asked: DataFrame, least: int, gram: int) -> DataFrame:
    """The bytes around the places in ``asked`` (doc, a, b, pos, gram, around, n, kinds)."""
    wanted = asked.groupBy("doc", "a", "b").agg(F.collect_list(F.struct("pos", "gram", "around", "n", "kinds")).alias("at"))  # at most a document's anchors

    def run(batches):
        for batch in batches:
            for cut in slices(batch, "text"):
                rows = []
                for text, at in zip(cut.column("text"), cut.column("at").to_pylist()):
                    data = text.as_py().encode()
                    for x in at:
                        left = min(x["pos"], least - gram)
                        rows.append((x["gram"], x["around"], x["n"], x["kinds"], left, data[x["pos"] - left : x["pos"] + least]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["gram", "around", "n", "kinds", "left", "bytes"])

    return docs.join(wanted, ["doc", "a", "b"]).select("text", "at").mapInArrow(run, "gram long, around long, n long, kinds long, left long, bytes binary")


def _rows(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings as rows of bytes that are filled up with zeros (a zero byte itself becomes 255, which UTF-8 does not use), and their lengths."""
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    filled = b"".join([s.replace(b"\0", b"\xff").ljust(width, b"\0") for s in strings])
    return np.frombuffer(filled, np.uint8).reshape(len(strings), width), sizes


def _sorted(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and how many bytes each shares with the one before it in that order (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], kind="stable")
    shared = np.zeros(len(rows), np.int64)
    for start in range(1, len(rows), 8_192):
        a, b = order[start : start + 8_192], order[start - 1 : start - 1 + len(order[start : start + 8_192])]
        differ = rows[a] != rows[b]
        first = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
        shared[start : start + len(a)] = np.minimum(first, np.minimum(sizes[a], sizes[b]))
    return order, shared


class _Least:
    """Smallest value between two places, from a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 ** len(self.levels) <= len(values):
            step, last = 2 ** (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over places a + 1 to b, with a < b."""
        level = np.floor(np.log2(b - a)).astype(int)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.levels[k][a[m] + 1], self.levels[k][b[m] + 1 - 2**k])
        return out


def intervals(shared: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int]]:
    """Common-prefix intervals of a suffix array, children before parents: first, last, bytes shared, bytes shared by the parent.

    A stack holds the open intervals; a smaller shared prefix closes those that
    share more.  Only intervals that share ``least`` bytes are given; their
    parent counts as sharing ``least - 1`` at least.
    """
    stack: list[list[int]] = []  # first place, bytes shared
    for i, depth in enumerate([*shared.tolist(), 0]):
        first = i - 1
        while stack and stack[-1][1] > depth:
            first, inner = stack.pop()
            outer = max(depth, stack[-1][1] if stack else 0)
            yield first, i - 1, inner, max(outer, least - 1)
        if depth >= least and (not stack or stack[-1][1] < depth):
            stack.append([first, depth])


def resolve(strings: list[bytes], left: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Repeated strings around anchors: number of the surroundings, and least and most bytes before the anchor.

    Each interval of the suffix array holds all occurrences of a common right side.
    Its occurrences are then put in the order of their left sides: neighbours in that
    order show how far an occurrence can be extended to the left together with
    any other one.  Where left sides are not diverse below the parent's depth, the whole
    interval extends; else each occurrence extends as far as its nearest.
    """
    n = len(strings)
    right_rows, right_size = _rows([s[x:] for s, x in zip(strings, left.tolist())], least)
    left_rows, left_size = _rows([s[:x][::-1] for s, x in zip(strings, left.tolist())], max(1, least - gram))
    order, shared = _sorted(right_rows, right_size)
    left_order, left_shared = _sorted(left_rows, left_size)
    rank = np.empty(n, np.int64)
    rank[left_order] = np.arange(n)
    table_ = _Least(left_shared)
    rank = rank[order]  # by place in the suffix array
    who, low, high = [], [], []
    for first, last, depth, outer in intervals(shared, gram):
        lo, hi = max(0, least - depth), least - 1 - outer
        if lo > hi:
            continue
        inside = np.sort(rank[first : last + 1])
        common = table_.between(inside[:-1], inside[1:])
        reach = np.maximum(np.append(0, common), np.append(common, 0))
        reach = np.minimum(reach, hi)
        keep = np.flatnonzero(reach >= lo)
        if len(keep):
            who.append(left_order[inside[keep]])
            low.append(np.full(len(keep), lo))
            high.append(reach[keep])
    if not who:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(who), np.concatenate(low), np.concatenate(high)


def _resolved(around: DataFrame, least: int, gram: int) -> DataFrame:
    """gram, around, low, high: strings that begin low to high bytes before the anchor occur elsewhere too."""

    def sort(batches):
        for rows in whole_groups(batches, ["gram"], 8_000):
            # a row that stands in the table several times gives its surroundings several times
            names = np.stack([rows.column(c).to_numpy() for c in ("gram", "around")], axis=1)
            _, first = np.unique(names, axis=0, return_index=True)
            rows = rows.take(first)
            who, low, high = resolve(rows.column("bytes").to_pylist(), rows.column("left").to_numpy(), least, gram)
            alone = rows.column("n").to_numpy()[who] == 1
            take = pa.array(who[alone])
            found = pa.table({"gram": rows.column("gram").take(take), "around": rows.column("around").take(take), "low": pa.array(low[alone]), "high": pa.array(high[alone])})
            yield from found.to_batches()

    def strings(batches):
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for g, r, left, data in zip(*(batch.column(c).to_pylist() for c in ("gram", "around", "left", "bytes"))):
                rows += [(g, r, x, xxh3_128_digest(data[left - x : left - x + least])) for x in range(max(0, least - (len(data) - left)), left + 1)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["gram", "around", "low", "string"])

    few, many = around.where(F.col("kinds") <= TOGETHER), around.where(F.col("kinds") > TOGETHER)
    kind = "gram long, around long, low long, high long"
    one = few.select("gram", "around", "n", "left", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(sort, kind)
    # a k-gram with very many different surroundings: equal strings meet by their hashes, in any number of tasks
    every = many.dropDuplicates(["gram", "around"]).mapInArrow(strings, "gram long, around long, low long, string binary")
    # (a string that holds two anchors is looked at from both, so the place of the k-gram counts as well)
    again = every.groupBy("gram", "low", "string").agg(F.count("*").alias("n")).where("n > 1").select("gram", "low", "string")
    two = every.join(again, ["gram", "low", "string"]).select("gram", "around", "low", F.col("low").alias("high"))
    return one.unionAll(two)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, a, b, text: rows by id and content; rows that agree in both are treated alike."""
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("doc"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit("text"), value, F.length(value)).alias("b"), value.alias("text"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """Bytes of each text that lie in a string of ``least`` bytes which occurs anywhere else: a, b, spans.

    a and b are the hashes of the text (see ``_keyed``); spans are byte ranges
    (start, stop), not yet merged.  Texts without a repeat have no row.
    """
    spark, rows = docs.sparkSession, _keyed(docs, key, text)
    found = stored(_find_anchors(rows, least, gram), "anchors")
    low, high = F.coalesce("around", F.element_at("more.around", 1)), F.coalesce("around", F.element_at("more.around", -1))
    grams = found.groupBy("gram").agg(F.count("*").alias("n"), F.max(F.col("more").isNotNull()).alias("several"), F.min(low).alias("x"), F.max(high).alias("y")).where("n > 1 or several")
    # anchors that a task met several of need no look at the others of their k-gram: only single ones move
    single = found.where("more is null").join(grams.select("gram", (F.col("x") == F.col("y")).alias("same")), "gram")
    single = single.select("gram", "same", "around", "right", F.array(F.struct("doc", "a", "b", "pos")).alias("places"))
    several = found.where("more is not null").select("gram", F.lit(False).alias("same"), F.inline("more"))
    shared = stored(single.unionByName(several), "shared")
    discard(found)
    kinds = shared.where("not same").groupBy("gram", "around").agg(F.sum(F.size("places")).alias("n"), F.min(F.array_min("places")).alias("one"))
    kinds = stored(kinds, "kinds")
    open_ = kinds.groupBy("gram").agg(F.min("n").alias("fewest"), F.count("*").alias("kinds")).where("fewest = 1").select("gram", "kinds")
    asked = kinds.join(open_, "gram").select("one.doc", "one.a", "one.b", "one.pos", "gram", "around", "n", "kinds")
    release(spark)
    around = stored(_surroundings(rows, asked, least, gram), "around")
    ranges = stored(_resolved(around, least, gram), "ranges")
    discard(around)
    release(spark)
    left = F.least(F.col("pos"), F.lit(least - gram))
    sure = F.col("same") | (F.size("places") > 1)
    full = shared.where(~sure).join(kinds.where("n > 1").select("gram", "around"), ["gram", "around"], "left_semi").unionByName(shared.where(sure))
    full = full.select("right", F.inline("places")).select("a", "b", (F.col("pos") - left).alias("start"), (F.col("pos") - F.greatest(F.lit(0), F.lit(least) - F.col("right")) + least).alias("stop"))
    # (only surroundings that occur once are in ranges)
    part = shared.where(~sure).join(ranges, ["gram", "around"]).select("low", "high", F.inline("places"))
    part = part.select("a", "b", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + least).alias("stop"))
    return full.unionAll(part).groupBy("a", "b").agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))).alias("spans"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs, ascending."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or []):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def cut(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    """What is left of the bytes."""
    at, kept = 0, []
    for start, stop in runs:
        kept.append(data[at:start])
        at = stop
    return b"".join((*kept, data[at:]))


def whole_characters(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs narrowed to whole UTF-8 characters."""
    out = []
    for start, stop in runs:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def with_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """Every row with its spans: row (all columns), text, spans (null where nothing repeats).

    A null text counts as empty.  Matches never cross rows; rows with equal texts
    repeat each other, also under one id.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), value.alias("text"), F.xxhash64(value).alias("a"), F.xxhash64(F.lit("text"), value, F.length(value)).alias("b"))
    return rows.join(repeated_spans(docs, key, text, least), ["a", "b"], "left").select("row", "text", "spans")


@query()
def op5_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                data = text.as_py().encode()
                runs = merge(spans.as_py())
                kept = cut(data, runs)
                rows.append((len(data), len(data) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in zip(*rows))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
