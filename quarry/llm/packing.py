"""Best-fit packing of tokenised documents, certified by dual-feasible-function bounds.

Pieces are dealt out by a hash to partitions of about PART_ROWS rows; each packs its own best-fit decreasing, compares its bin
count with a lower bound and, if there is a gap, also tries filling bin by bin and keeps the better. The pieces of loosely filled bins of partitions with a gap, and each partition's loosest bin, are
exchanged: they are pooled, dealt out anew and packed again, for as long as that saves bins or until the whole
table's own bound is met. The driver sees counts by length (as many as the capacity) and totals, nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import Tables
from quarry.llm.repeats import NULL_ID
from quarry.llm.tokens import crc_of_ids, id_encoder

CAPACITY = 1024
#: Pieces that one task packs.
PART_ROWS = 65_536
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, _key long"
_PACKED = _PIECE + ", sequence_id long, offset long, _slack long, _gap long, _loosest boolean"


def lower_bound(counts: np.ndarray) -> int:
    """A number of bins that no packing can do with less: the best of two families of dual feasible functions.

    counts[x]: items of size x; the capacity is len(counts) - 1.
    """
    capacity = len(counts) - 1
    sizes = np.arange(capacity + 1)
    counts = counts.astype(np.int64)
    total = np.concatenate([[0], np.cumsum(counts)])
    volume = np.concatenate([[0], np.cumsum(counts * sizes)])
    best = -(-int(volume[-1]) // capacity)
    for a in range(1, capacity // 2 + 1):
        # above capacity - a: a whole bin; below a: nothing; between: its size
        big = int(total[-1] - total[capacity - a + 1])
        between = int(volume[capacity - a + 1] - volume[a])
        best = max(best, big + -(-between // capacity))
    for k in range(1, 33):
        # rounding by k: (k + 1) x / C whole: x; else the floor of it as a share of k
        scaled = (k + 1) * sizes
        whole = scaled % capacity == 0
        value = np.where(whole, sizes * k, scaled // capacity * capacity)  # in units of 1 / (C k)
        best = max(best, -(-int((value * counts).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For lengths in decreasing order: bin and offset of each, and what is left free in each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in enumerate(lengths.tolist()):
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        left = room - size
        free[b] = left
        if left:
            if not open_at[left]:
                mask |= 1 << left
            open_at[left].append(b)
    return bins, offsets, np.array(free, np.int64)


def fill_bins(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same by whole bins: each takes the longest piece left and then the set of others that fits best (reachable sums as bits)."""
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i, size in enumerate(lengths.tolist()):
        held[size].append(i)
    sizes = [x for x in range(capacity, 0, -1) if held[x]]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []
    left, lead = len(lengths), 0
    while left:
        while not held[sizes[lead]]:
            lead += 1
        chosen = [held[sizes[lead]].pop()]
        room = capacity - sizes[lead]
        mask, reach, steps = (1 << room + 1) - 1, 1, []
        for size in sizes[lead:]:
            if size > room or not held[size]:
                continue
            steps.append((size, reach))
            for _ in range(min(len(held[size]), room // size)):
                more = (reach | reach << size) & mask
                if more == reach:
                    break
                reach = more
            if reach >> room & 1:
                break
        best = at = reach.bit_length() - 1
        for size, before in reversed(steps):
            while at and not before >> at & 1:
                at -= size
                chosen.append(held[size].pop())
        place = 0
        for i in chosen:
            bins[i], offsets[i] = len(free), place
            place += int(lengths[i])
        free.append(room - best)
        left -= len(chosen)
    return bins, offsets, np.array(free, np.int64)


def _pieces(path: str, end_id: int, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = id_encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, key, text in zip(batch.column("_id").to_pylist(), batch.column("_row").to_pylist(), batch.column("_text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id))
                start = 0
                first = (len(ids) - 1) % capacity + 1
                for k, end in enumerate(range(first, len(ids) + 1, capacity)):
                    out.append((doc, k, start, end - start, crc_of_ids(ids[start:end]), key))
                    start = end
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "_key"])

    return cut


def _pack(capacity: int, space: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """Pack one partition. space: a number of the round, so that sequence ids of different rounds differ."""

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        length = np.asarray(table.column("length"))
        ids = np.asarray(table.column("doc_id").fill_null(NULL_ID))
        order = np.lexsort((np.asarray(table.column("_key")), np.asarray(table.column("piece")), ids, -length))
        table, length = table.take(pa.array(order)), length[order]
        bound = lower_bound(np.bincount(length, minlength=capacity + 1))
        bins, offsets, free = best_fit_decreasing(length, capacity)
        if len(free) > bound:
            other = fill_bins(length, capacity)
            if len(other[2]) < len(free):
                bins, offsets, free = other
        gap = len(free) - bound
        made = {"sequence_id": (np.int64(space) << 48) + (np.int64(part) << 28) + bins, "offset": offsets, "_slack": free[bins], "_gap": np.full(len(bins), gap, np.int64), "_loosest": bins == int(np.argmax(free))}
        for name, values in made.items():
            table = table.append_column(name, pa.array(values))
        return table.select([x.split()[0] for x in _PACKED.split(", ")])

    return pack


def _packed(pieces: DataFrame, n: int, capacity: int, space: int, part_rows: int, tables: Tables) -> DataFrame:
    parts = max(1, -(-n // part_rows))
    dealt = pieces.select(*[x.split()[0] for x in _PIECE.split(", ")], F.pmod(F.xxhash64("_key", "piece", F.lit(space)), F.lit(parts)).cast("int").alias("_part"))
    return tables.keep(tables.write(dealt.groupBy("_part").applyInArrow(_pack(capacity, space), _PACKED)))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", part_rows: int = PART_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, gap.

    A document is its token ids and then end_id; only one of more than `capacity` is cut, into pieces of `capacity` tokens of which the first may be
    shorter. Sequences hold at most `capacity` tokens, gapless from offset 0. gap: bins of the partition that packed this piece above its
    lower bound; 0 certifies that no packing of that partition has fewer. Null and empty texts are a piece of
    end_id alone; null ids stay null, repeated rows are packed each by itself, an empty table gives no rows. Other columns
    aren't read. The returned rows lie in the shared folder.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_row"))
    with Tables(docs.sparkSession) as tables:
        pieces = tables.write(rows.mapInArrow(_pieces(path, end_id, capacity), _PIECE))
        counts = np.zeros(capacity + 1, np.int64)
        for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
            counts[r["length"]] = r["count"]
        bound = lower_bound(counts)
        packed = _packed(pieces, int(counts.sum()), capacity, 0, part_rows, tables)
        done, used = [], 0
        for space in count(1):
            total = packed.where("offset = 0").count()
            if used + total <= bound:
                break
            loose = F.col("_slack").__gt__(0) & (F.col("_gap").__gt__(0) | F.col("_loosest"))
            freed = packed.where(loose)
            n, bins = freed.agg(F.count("*"), F.count_if(F.col("offset") == 0)).first()
            if bins < 2:
                break
            again = _packed(freed, n, capacity, space, part_rows, tables)
            if again.where("offset = 0").count() >= bins:
                break
            done.append(packed.where(~loose))
            used += total - bins
            packed = again
    for part in done:
        packed = packed.unionByName(part)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.col("_gap").alias("gap"))
