"""Prefix trie of conversations by peeling turns off their ends (operator 12).

A node is a distinct sequence of first turns and is named by a chained hash of
it, so that a conversation is a path of names from the root.  Equal
conversations are merged into one ended node first.  Then, from the greatest
depth down, ended nodes join the nodes that survive from below, every node of
the depth is finished and written, and its sums go to the node of one turn less.

Peeling runs inside tasks.  Nodes above more than ``limit`` ended nodes are
heavy: each task peels whole groups under one heavy node (at most ``limit`` ended
nodes each), and hands only the finished tops of its groups on.  The heavy nodes, with what
their light children handed up, are the ended nodes of the next round, until a
round has no heavy node left: few rounds, however deep the conversations are and
however many of them start alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import discard, query, stored, table, whole_groups
from fieldmark.session import checked_broadcast, spread

#: Ended nodes that one group may have; a node above more of them is heavy.
LIMIT = 4_000
#: Ended nodes that a task peels together.
BATCH = 8_000
#: Bytes of a node's name.
NAME = 16

#: Stands for the smallest member of a node that has only got heavy children so far.
_NOBODY = (1 << 63) - 1
_NO_ENDS = hashlib.sha256(b"").hexdigest()

_PATH = "name binary, path binary, sizes binary"
_ITEM = f"{_PATH}, n_convs long, conv_id long, n_children long, n_leaves long, saved long, ends_sha256 string"
_NODE = "name binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, top boolean"


def turn_rows(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, said, size): a hash of role and text, and the text's UTF-8 bytes; null role or text is empty.

    Rows without a conversation take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    said = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("size")
    )


def _named(before: bytes, said: bytes) -> bytes:
    return hashlib.blake2b(before + said, digest_size=NAME).digest()


class _Paths:
    """Collects (conv_id, name, path, sizes) rows and hands them on in batches."""

    names = ["conv_id", "name", "path", "sizes"]

    def __init__(self):
        self.rows, self.held = [], 0

    def add(self, conv: int, turns: list[tuple[bytes, int]]) -> None:
        name, path = bytes(NAME), []
        for said, _ in turns:
            name = _named(name, said)
            path.append(name)
        self.rows.append((conv, name, b"".join(path), np.array([s for _, s in turns], "<i8").tobytes()))
        self.held += len(turns) + 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 4
        self.rows, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=self.names)


def paths(turns: DataFrame, family: Column, head: Column) -> DataFrame:
    """(conv_id, name, path, sizes): each conversation rebuilt, as names of its prefixes and bytes of its turns.

    ``turns`` is as turn_rows gives it.  The first ``head`` turns are those of the
    conversation whose id is ``family`` (all of them if there are fewer, none if it is absent);
    the conversation's own turns follow after its first ``head``.  Turns go by
    number (null first), ties by the hash of role and text; repeated rows are repeated turns.
    Two conversations at a time are held: one and the first of its family.
    """
    given = turns.withColumns({"__family": family.cast("long"), "__head": head.cast("int")})
    order = ["__family", "__own", "conv_id", "turn", "said"]
    sorted_turns = spread(given.withColumn("__own", F.col("conv_id") != F.col("__family")), "__family").sortWithinPartitions(*[F.asc_nulls_first(c) for c in order])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Paths()
        base_of, base = None, []  # the first turns of the family's own conversation, which comes first
        current, own, head = None, [], 0

        def finish() -> None:
            nonlocal base_of, base
            conv, fam = current
            if conv == fam:
                base_of, base = fam, own
                out.add(conv, own)
            else:
                out.add(conv, (base[:head] if base_of == fam else []) + own[head:])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "__family", "__head", "said", "size")]
            for conv, fam, h, said, size in zip(*columns):
                if current != (conv, fam):
                    if current is not None:
                        finish()
                        if out.held > 200_000:
                            yield out.batch()
                    current, own, head = (conv, fam), [], h
                own.append((said, size))
        if current is not None:
            finish()
        yield out.batch()

    return sorted_turns.select("conv_id", "__family", "__head", "said", "size").mapInArrow(run, f"conv_id long, {_PATH}")


def ended(rows: DataFrame) -> DataFrame:
    """One row per distinct conversation: how many there are, the smallest id, and a hash of all ids in order.

    The ids of equal conversations are read in order and hashed as they come, so
    copies of any number need no memory; the hash itself is one sequence by its definition.
    """
    ordered = spread(rows, "name").sortWithinPartitions("name", "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, first, n, digest = None, 0, 0, None
        held = []

        def close() -> None:
            held.append((*last, n, first, 0, 0, 0, digest.hexdigest()))

        def batch_of() -> pa.RecordBatch:
            nonlocal held
            columns = list(zip(*held)) or [()] * 9
            held = []
            kinds = [pa.binary()] * 3 + [pa.int64()] * 5 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["name", "path", "sizes", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends_sha256"])

        for batch in batches:
            ids, names = batch.column("conv_id").to_pylist(), batch.column("name").to_pylist()
            for k, (conv, name) in enumerate(zip(ids, names)):
                if last is None or name != last[0]:
                    if last is not None:
                        close()
                        if len(held) >= 10_000:
                            yield batch_of()
                    last = (name, batch.column("path")[k].as_py(), batch.column("sizes")[k].as_py())
                    first, n, digest = conv, 1, hashlib.sha256(str(conv).encode())
                else:
                    n += 1
                    digest.update(b",%d" % conv)
        if last is not None:
            close()
        yield batch_of()

    return ordered.mapInArrow(run, _ITEM)


def _peel(items: pa.Table) -> pa.RecordBatch:
    """All nodes of whole groups, from the greatest depth down to each group's top."""
    columns = {c: items.column(c).to_pylist() for c in ("path", "sizes", "cut", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends_sha256")}
    by_depth: dict[int, list[int]] = {}
    for k, path in enumerate(columns["path"]):
        by_depth.setdefault(len(path) // NAME, []).append(k)
    sizes = [np.frombuffer(s, "<i8") for s in columns["sizes"]]
    written: list[tuple] = []
    # a surviving node: convs, smallest id, children, leaves, saved, hash of ends, an item whose path it is on
    alive: dict[bytes, list] = {}
    for depth in range(max(by_depth, default=-1), -1, -1):
        for k in by_depth.pop(depth, ()):
            path = columns["path"][k]
            name = path[-NAME:] or bytes(NAME)
            add = [columns[c][k] for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends_sha256")]
            node = alive.get(name)
            if node is None:
                alive[name] = [*add, k]
            else:
                node[0] += add[0]
                node[1] = min(node[1], add[1])
                node[2] += add[2]
                node[3] += add[3]
                node[4] += add[4]
                node[5] = add[5]
        above: dict[bytes, list] = {}
        done = []
        for name, (n, conv, children, leaves, saved, ends, k) in alive.items():
            if depth:
                saved += (n - 1) * int(sizes[k][depth - 1])
            leaves = leaves or 1
            top = depth == columns["cut"][k]
            parent = None
            if depth:
                path = columns["path"][k]
                parent = path[(depth - 2) * NAME : (depth - 1) * NAME] if depth > 1 else bytes(NAME)
            done.append((name, parent, depth, conv, n, children, leaves, saved, ends, top))
            if not top:
                node = above.get(parent)
                if node is None:
                    above[parent] = [n, conv, 1, leaves, saved, _NO_ENDS, k]
                else:
                    node[0] += n
                    node[1] = min(node[1], conv)
                    node[2] += 1
                    node[3] += leaves
                    node[4] += saved
        # a node that ends here and survives is merged in the next turn of the loop; its smallest id is known then
        ending = {}
        for k in by_depth.get(depth - 1, ()):
            ending[columns["path"][k][-NAME:] or bytes(NAME)] = columns["conv_id"][k]
        for name, parent, d, conv, n, children, leaves, saved, ends, top in done:
            parent_conv = None if top else min(above[parent][1], ending.get(parent, above[parent][1]))
            written.append((name, parent, d, conv, parent_conv, n, children, leaves, saved, ends, top))
        alive = above
    kinds = [pa.binary(), pa.binary()] + [pa.int64()] * 7 + [pa.string(), pa.bool_()]
    values = list(zip(*written)) or [()] * len(kinds)
    names = ["name", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top"]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=names)


def _peeled(items: DataFrame) -> DataFrame:
    """The nodes of all groups; ``items`` has a ``cut``, the depth of its group's top, and the group's number."""
    ordered = spread(items, "group").sortWithinPartitions("group")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, ["group"], BATCH):
            yield _peel(groups)

    return ordered.mapInArrow(run, _NODE)


def _prefix(depth: Column) -> Column:
    """The name of an item's prefix of ``depth`` turns."""
    return F.when(depth == 0, F.lit(bytes(NAME))).otherwise(F.substring(F.col("path"), (depth - 1) * NAME + 1, F.lit(NAME)))


def trie(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """All nodes of the prefix trie of ``rows`` (conv_id, name, path, sizes), as ``paths`` gives them.

    Per node: name, parent (its name), depth, conv_id (smallest member),
    parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes in
    its subtree), saved_tokens (over its subtree, members less one times the
    bytes of the last turn), ends_sha256 (of the ids that end there, ascending,
    joined by commas).  A conversation without turns is a member of the root
    alone; without conversations there is no node.
    """
    items = stored(ended(rows), "ended")
    layers: list[DataFrame] = []
    deep = F.octet_length("path").cast("int") / NAME
    while True:
        ladder = items.select(F.col("name").alias("item"), "path", F.explode(F.sequence(F.lit(0), deep.cast("int"))).alias("d")).select("item", "d", _prefix(F.col("d")).alias("prefix"))
        heavy = ladder.groupBy("prefix").agg(F.count("*").alias("n"), F.min("item").alias("item"), F.first("d").alias("d")).where(F.col("n") > limit)
        heavy = stored(heavy, "heavy")
        cuts = ladder.select("item", "prefix").join(checked_broadcast(heavy.select("prefix"), settled=True), "prefix").groupBy("item").agg(F.count("*").cast("int").alias("cut"))
        placed = items.join(cuts.withColumnRenamed("item", "name"), "name", "left").fillna(0, ["cut"])
        inside = placed.where(F.col("cut") <= deep).withColumn("group", F.xxhash64(_prefix(F.col("cut"))))
        layers.append(stored(_peeled(inside), "nodes"))
        if heavy.isEmpty():
            discard(heavy)
            discard(items)
            break
        handed = layers[-1].where("top").groupBy(F.col("parent").alias("name")).agg(
            F.sum("n_convs").alias("c"), F.min("conv_id").alias("m"), F.count("*").alias("k"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s")
        )
        # every heavy node is an item of the next round: what ended there itself and what was handed up to it
        routes = heavy.select(F.col("prefix").alias("__at"), "item", "d").join(items.select(F.col("name").alias("item"), "path", "sizes"), "item").select(
            F.col("__at").alias("name"), F.substring("path", F.lit(1), F.col("d") * NAME).alias("path"), F.substring("sizes", F.lit(1), F.col("d") * 8).alias("sizes")
        )
        own = items.select("name", *[F.col(c).alias(f"o_{c}") for c in ("n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends_sha256")])
        zero = F.lit(0).cast("long")
        total = lambda a, b: F.coalesce(F.col(a), zero) + F.coalesce(F.col(b), zero)
        merged = routes.join(handed, "name", "left").join(own, "name", "left").select(
            "name", "path", "sizes", total("c", "o_n_convs").alias("n_convs"), F.coalesce(F.least("m", "o_conv_id"), F.lit(_NOBODY)).alias("conv_id"), total("k", "o_n_children").alias("n_children"),
            total("l", "o_n_leaves").alias("n_leaves"), total("s", "o_saved").alias("saved"), F.coalesce("o_ends_sha256", F.lit(_NO_ENDS)).alias("ends_sha256"),
        )
        upper = stored(merged, "upper")
        discard(items)
        discard(heavy)
        items = upper
    return _joined(layers)


def _joined(layers: list[DataFrame]) -> DataFrame:
    """Nodes of all rounds; the tops of a round find their parents among the nodes of later ones."""
    if len(layers) == 1:
        return layers[0].drop("top")
    upper = layers[1]
    for layer in layers[2:]:
        upper = upper.unionByName(layer)
    ids = checked_broadcast(upper.select(F.col("name").alias("parent"), F.col("conv_id").alias("__parent_conv")))
    every = layers[0].unionByName(upper)
    below = every.where(F.col("top") & F.col("parent").isNotNull()).drop("parent_conv_id").join(ids, "parent", "left").withColumnRenamed("__parent_conv", "parent_conv_id")
    return every.where(~(F.col("top") & F.col("parent").isNotNull())).unionByName(below).drop("top")


_SAID = "md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, ''))"

#: CRC-32 bit by bit, of the digits of an id.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, i: xor(y >> 1, case when y % 2 = 1 then 3988292384 else 0 end))))"""


@query(
    f"""
    with t as (select conv_id, {_SAID} as said, strlen(coalesce(text, '')) as size,
        row_number() over (partition by conv_id order by turn nulls first, {_SAID}) as r from conversations where conv_id is not null),
    ids as (select conv_id, conv_id - conv_id % 5 as family, count(*) as n from t group by 1),
    heads as (select *, {_CRC} % 9 as h from ids),
    rebuilt as (
      select a.conv_id, t.r as d, said, size from heads a join t on t.conv_id = a.family and t.r <= a.h
      union all
      select a.conv_id, least(a.h, coalesce(b.n, 0)) + t.r - a.h, said, size from heads a join t on t.conv_id = a.conv_id and t.r > a.h left join ids b on b.conv_id = a.family),
    paths as (select conv_id, coalesce(list(said order by d) filter (where said is not null), []) as p, list(size order by d) as b from ids left join rebuilt using (conv_id) group by 1),
    members as (select conv_id, unnest(range(0, len(p) + 1)) as depth, p, b from paths),
    nodes as (
      select depth, p[1:depth] as p, min(conv_id) as conv_id, count(*) as n_convs, case when depth > 0 then (count(*) - 1) * any_value(b[depth]) else 0 end as saved,
        sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(p) = depth), '')) as ends_sha256
      from members group by depth, p[1:depth]),
    children as (select p[1:depth - 1] as p, count(*) as n_children from nodes where depth > 0 group by 1),
    whole as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children c on c.p = n.p),
    up as (select p, saved, n_children, unnest(range(0, depth + 1)) as d from whole),
    sums as (select p[1:d] as p, sum(saved) as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from up group by p[1:d])
    select w.conv_id, w.depth, q.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens::bigint as saved_tokens, w.ends_sha256
    from whole w join sums s on s.p = w.p left join nodes q on w.depth > 0 and q.p = w.p[1:w.depth - 1]
    """
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_rows(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    rows = paths(turns, conv - conv % 5, F.crc32(conv.cast("string").cast("binary")) % 9)
    return trie(rows).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
