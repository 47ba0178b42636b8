"""Pairs of chunks of which one mentions a name that the other defines, made where two blocks of chunks meet: no pair is moved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import checkpointed

#: Mentions and definitions in a block, about; of a small table at least; pairs that a task makes at once and that it hands over at once.
_ROWS, _FEW, _PAIRS, _BATCH = 800_000, 20_000, 1 << 21, 1 << 16
#: Parts that one side of the meeting is dealt to, at most.
_PARTS = 256


class _Side:
    """Some rows of a block: where their chunk stands among the block's, path, name and rank of weight."""

    def __init__(self, at: np.ndarray, path: np.ndarray, name: np.ndarray, rank: np.ndarray):
        self.at, self.path, self.name, self.rank = at, path, name, rank

    def by_name(self) -> _Side:
        order = np.argsort(self.name, kind="stable")
        return _Side(self.at[order], self.path[order], self.name[order], self.rank[order])


class _Block:
    def __init__(self, data: bytes):
        rows = pa.ipc.open_stream(data).read_all()
        idx, self._path, self._name = (rows.column(c).to_numpy() for c in ("idx", "path", "name"))
        self._w = rows.column("w").to_numpy()
        self.ids, self._at = np.unique(idx, return_inverse=True)
        self._uses = ~np.isnan(self._w)
        self.weights = np.unique(self._w[self._uses])

    def sides(self, weights: np.ndarray) -> tuple[_Side, _Side]:
        """Mentions and definitions, both in the order of chunks."""
        rank = np.searchsorted(weights, self._w)
        mentions, definitions = (_Side(self._at[on], self._path[on], self._name[on], rank[on]) for on in (self._uses, ~self._uses))
        return mentions, definitions


def _packed(table: pa.Table) -> pa.Table:
    """A block as one row of compressed bytes, in the order of its chunks."""
    rows = table.select(["idx", "path", "name", "w"]).sort_by([("idx", "ascending"), ("name", "ascending")]).combine_chunks()
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(rows)
    return pa.table({"block": table.column("block").slice(0, 1), "rows": pa.array([out.getvalue().to_pybytes()], pa.binary())})


def _met(x: _Block, y: _Block, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each pair of a chunk of x and one of y once, with its largest weight. same: x and y are one block, whose pairs count once."""
    weights = np.unique(np.concatenate([x.weights, y.weights]))
    bits, n = max(1, len(weights).bit_length()), len(y.ids)
    (x_uses, x_defs), (y_uses, y_defs) = x.sides(weights), y.sides(weights)
    ways, made = [], np.zeros(len(x.ids), np.int64)
    for own, other, of_own in ((x_uses, y_defs.by_name(), True), (x_defs, y_uses.by_name(), False)):
        first = np.searchsorted(other.name, own.name)
        count = np.searchsorted(other.name, own.name, "right") - first
        made += np.bincount(own.at, count, len(made)).astype(np.int64)
        ways.append((own, other, of_own, first, count))
    # chunks of x, as many at once as make _PAIRS pairs
    total = np.cumsum(made)
    begin = 0
    while begin < len(made):
        done = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, done + _PAIRS, "right")))
        keys = []
        for own, other, of_own, first, count in ways:
            a, b = np.searchsorted(own.at, [begin, end])
            c = count[a:b]
            row = np.repeat(np.arange(a, b), c)
            met = np.arange(len(row)) + np.repeat(first[a:b] - (np.cumsum(c) - c), c)
            on = own.path[row] != other.path[met]
            if same:
                on &= own.at[row] < other.at[met]
            row, met = row[on], met[on]
            keys.append((own.at[row] * n + other.at[met] << bits) + (own.rank[row] if of_own else other.rank[met]))
        key = np.sort(np.concatenate(keys))
        pair = key >> bits
        last = np.append(pair[1:] != pair[:-1], True)[: len(pair)]
        key, pair = key[last], pair[last]
        u, v = x.ids[pair // n], y.ids[pair % n]
        yield np.minimum(u, v), np.maximum(u, v), weights[key & ((1 << bits) - 1)]
        begin = end


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, x = None, None
    for batch in batches:
        for p, q, own, other in zip(*(batch.column(c) for c in ("p", "q", "own", "other")), strict=True):
            if p != number:
                number, x = p, _Block(own.as_buffer())
            for columns in _met(x, x if p == q else _Block(other.as_buffer()), p == q):
                for at in range(0, len(columns[0]), _BATCH):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + _BATCH]) for c in columns], ["i", "j", "w"])


def largest_weights(uses: DataFrame, defs: DataFrame) -> DataFrame:
    """Undirected pairs i < j of chunks of different paths, of which one uses a name that the other defines, with the largest weight: i, j, w.

    uses: idx, path, name, w; defs: idx, path, name; all numbers, without nulls. Rows are dealt to blocks by chunk and packed; every two blocks
    meet in one task, which so has all that concerns a pair. Blocks are read from the shared folder, by parts; what is moved is a copy of each.
    """
    spark = uses.sparkSession
    rows = uses.select("idx", "path", "name", "w").unionByName(defs.select("idx", "path", "name", F.lit(float("nan")).alias("w")))
    rows = checkpointed(rows)
    n, cores = rows.count(), spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // _ROWS), min(2 * cores, n // _FEW))
    packed = rows.withColumn("block", F.expr(f"cast(pmod(xxhash64(idx), {blocks}) as int)"))
    packed = checkpointed(packed.groupBy("block").applyInArrow(_packed, "block int, rows binary"))
    left = packed.select(F.col("block").alias("p"), F.col("rows").alias("own")).repartitionByRange(min(blocks, _PARTS), "p")
    right = packed.select(F.col("block").alias("q"), F.col("rows").alias("other")).hint("shuffle_replicate_nl")
    # around the circle of blocks, each meets those of the half before it: as many for each block
    ahead = f"pmod(q - p, {blocks})"
    met = left.join(right, F.expr(f"2 * {ahead} < {blocks} OR (2 * {ahead} = {blocks} AND p < q)"))
    return met.mapInArrow(_pairs, "i long, j long, w double")
