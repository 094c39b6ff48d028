"""The two-state chain over many histories at once.

A fit reads the same histories in every pass, so they are packed once into blocks of some
thousand histories of one species.  A pass sends a block with the parameters of its
species to a task, which walks the years for all histories of the block together and
returns one row of sums per year.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.session import BROADCAST_ROWS, settle

#: Histories of a block, about, and blocks of a task as long as there are fewer tasks than shuffle partitions.
BLOCK, TASK_BLOCKS = 8192, 4
#: Sums by species and year, in the order of :func:`walked`.
SUMS = ("n", "s", "sk", "st", "x11", "x01", "from1", "from0", "ll")

_DOUBLES = pa.list_(pa.float64())


def packed(h: pa.ListArray, w: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Histories as codes: the different (t, k) as two arrays, nan for a missing count, the codes by year and history, and the weights."""
    weights = w.to_numpy(zero_copy_only=False).astype(float)
    sizes = h.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    entries = h.flatten()
    place = np.arange(len(entries)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row, inside = np.repeat(np.arange(len(h)), sizes), place < n
    counts = np.full((2, n, len(h)), np.nan)
    for c, values in zip(("t", "k"), counts):
        column = entries.flatten()[entries.type.get_field_index(c)].to_numpy(zero_copy_only=False)
        values[place[inside], row[inside]] = column.astype(float)[inside]
    (t, t_code), (k, k_code) = (np.unique(c, return_inverse=True) for c in counts)
    pairs, codes = np.unique(t_code.reshape(n, -1) * len(k) + k_code.reshape(n, -1), return_inverse=True)
    kind = np.uint16 if len(pairs) <= 1 << 16 else np.uint32
    return t[pairs // len(k)], k[pairs % len(k)], codes.reshape(n, -1).astype(kind), weights


def history_blocks(grouped: DataFrame, n: int) -> DataFrame:
    """Weighted histories (species, h, w), which are read twice, as settled blocks (species, t, k, codes, w).

    A species with more histories has more blocks, dealt by a hash of the history, so none is held by one task.
    """
    sizes = settle(grouped.groupBy("species").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("__blocks")))
    blocks, species = sizes.agg(F.coalesce(F.sum("__blocks"), F.lit(0)), F.count("*")).first()
    dealt = grouped.select("species", "h", "w").join(F.broadcast(sizes) if species <= BROADCAST_ROWS else sizes, "species")
    parted = dealt.withColumn("__block", F.pmod(F.xxhash64("h"), F.col("__blocks")))
    tasks = min(int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, -(-blocks // TASK_BLOCKS)))
    rows = parted.repartition(tasks, "species", "__block").sortWithinPartitions("species").select("species", "h", "w").where("w is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            species = batch.column("species")
            starts = np.flatnonzero(np.diff(species.dictionary_encode().indices.to_numpy(zero_copy_only=False), prepend=-1))
            ends = np.append(starts[1:], len(batch))
            found = [packed(batch.column("h").slice(a, b - a), batch.column("w").slice(a, b - a), n) for a, b in zip(starts, ends)]
            columns = [pa.array([x.tolist() for x in y], _DOUBLES) for y in list(zip(*found))[:2]]
            columns += [pa.array([np.ascontiguousarray(f[i]).tobytes() for f in found], pa.binary()) for i in (2, 3)]
            yield pa.RecordBatch.from_arrays([species.take(pa.array(starts)), *columns], names=["species", "t", "k", "codes", "w"])

    kind = dict(grouped.dtypes)["species"]
    return settle(rows.mapInArrow(run, f"`species` {kind}, t array<double>, k array<double>, codes binary, w binary"))


def _known(x: np.ndarray) -> float:
    """The sum of what is known; nan if nothing is."""
    known = x[np.isfinite(x)]
    return known.sum() if len(known) else np.nan


def walked(t: np.ndarray, k: np.ndarray, codes: np.ndarray, w: np.ndarray, psi1: float, phi: np.ndarray, gamma: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Expected sufficient statistics of a block, one row per year with SUMS; nan stands for a sum over nothing.

    The steps are those of :func:`occupancy.forward` and :func:`occupancy.backward`.  A missing
    count makes unknown what follows from it, and sums leave that out.
    """
    n, whole = len(codes), not (np.isnan(t) | np.isnan(k)).any()
    seen, ll = k > 0, np.zeros(len(w))
    pred, filt = np.empty(codes.shape), np.empty(codes.shape)
    pred[0] = psi1
    for i, code in enumerate(codes):
        log_hit = k * np.log(p[i]) + (t - k) * np.log(1 - p[i])
        here = pred[i] * np.where(seen, 1.0, np.exp(log_hit))[code]
        quiet = here + np.where(seen, 0.0, 1.0)[code] * (1 - pred[i])
        # a year with a detection is occupied for sure
        np.divide(here, quiet, out=filt[i], where=quiet != 0)
        filt[i][(quiet == 0) if whole else seen[code]] = 1.0
        ll += np.log(quiet) + np.where(seen, log_hit, 0.0)[code]
        if i + 1 < n:
            pred[i + 1] = gamma[i] + filt[i] * (phi[i] - gamma[i])
    out = np.full((n, len(SUMS)), np.nan)
    out[:, 0], out[0, 8] = w.sum(), _known(w * ll)
    s = filt[-1]
    for i in range(n - 1, -1, -1):
        moved = i + 1 < n
        if moved:
            after, f = s / pred[i + 1], filt[i]
            stay, arrive = f * phi[i] * after, (1 - f) * gamma[i] * after
            s = stay + f * (1 - phi[i]) * ((1 - s) / (1 - pred[i + 1]))
        ws = w * s
        if whole:
            by_pair = np.bincount(codes[i], ws, len(k))
            out[i, 1:4] = ws.sum(), by_pair @ k, by_pair @ t
            if moved:
                out[i, 4:8] = w @ stay, w @ arrive, out[i, 1], out[i, 0] - out[i, 1]
        else:
            out[i, 1:4] = [_known(x) for x in (ws, ws * k[codes[i]], ws * t[codes[i]])]
            if moved:
                out[i, 4:8] = [_known(x) for x in (w * stay, w * arrive, ws + 0 * stay, w - ws + 0 * stay)]
    return out


def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of two blocks, where nan is a sum over nothing."""
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, a + b))


def chain_sums(blocks: DataFrame, parameters: DataFrame, n: int) -> DataFrame:
    """(species, i, SUMS) for each row of ``parameters``: by species, or by a struct that holds the species as __of.

    The result is partitioned by species, so sums over its years need no further shuffle.
    """
    kind = dict(parameters.dtypes)["species"]
    of = "species.__of" if kind.startswith("struct<__of:") else "species"
    table = parameters.selectExpr("species as __key", f"{of} as species", "psi1", "phi", "gamma", "p")
    both = blocks.join(table, "species").drop("species").withColumnRenamed("__key", "species")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, at = {}, []
            for j, name in enumerate(batch.column("species").to_pylist()):
                t, k, phi, gamma, p = (np.array(batch.column(c)[j].as_py(), float) for c in ("t", "k", "phi", "gamma", "p"))
                w, codes = np.frombuffer(batch.column("w")[j].as_buffer()), batch.column("codes")[j].as_buffer()
                codes = np.frombuffer(codes, np.uint32 if codes.size > 2 * n * len(w) else np.uint16).reshape(n, -1)
                with np.errstate(all="ignore"):
                    found = walked(t, k, codes, w, batch.column("psi1")[j].as_py(), phi, gamma, p)
                name = tuple(name.values()) if isinstance(name, dict) else name
                if name not in sums:
                    at.append(j)
                sums[name] = added(sums[name], found) if name in sums else found
            if at:
                key = batch.column("species").take(pa.array(np.repeat(at, n)))
                years = pa.array(np.tile(np.arange(n, dtype=np.int32), len(at)))
                columns = np.ascontiguousarray(np.concatenate([*sums.values()]).T)
                yield pa.RecordBatch.from_arrays([key, years, *(pa.array(c, mask=np.isnan(c)) for c in columns)], names=["species", "i", *SUMS])

    rows = both.mapInArrow(run, f"`species` {kind}, i int, " + ", ".join(f"{c} double" for c in SUMS))
    return rows.repartition("species").groupBy("species", "i").agg(*[F.expr(f"sum({c}) as {c}") for c in SUMS])
