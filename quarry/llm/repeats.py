"""Earlier-occurrence search: which runs of consecutive units (words, lines), of one of some widths, also start earlier.

A window travels as 8 bytes of hash and about two of position, packed in
one binary row per chunk of texts and bucket, so the shuffle moves arrays, not one row per window. Inside a chunk only the
earliest of equal windows travels (pre-aggregation): a passage shared by a third of all texts reaches its bucket once
per chunk. The bucket comes from a second, independent hash of the window's units, so that the bits that tell windows apart grow with the
number of buckets, which follows the size of the input (64 bits and log2 of the buckets). Verdicts go back to the chunk as position gaps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.frames import Tables, merged, parallelism

PACKED = "bucket int, chunk long, kind int, a binary, b binary, c binary, d binary, e binary"
_REPLY = "chunk long, kind int, a binary, b binary, c binary, d binary, e binary"
_SPANS = "_id long, _row long, spans binary"
#: Order of null ids: after all others.
NULL_ID = (1 << 63) - 1
#: Buckets for each shuffle partition at least, so that each gets some, and units (words, lines) for each bucket at most: what one task holds.
BUCKETS_PER_PARTITION, BUCKET_UNITS = 4, 12_000_000
#: Bytes of text that make a word, at least: for the number of buckets before words are cut.
_WORD_BYTES = 5

#: From a batch's bytes and offsets: units, hash of each window, its place (rising), hash that chooses the bucket. With m
#: widths, the place of a window of the k-th width that begins at unit u is m * u + k, which for one width is u.
Windows = Callable[[np.ndarray, np.ndarray], tuple[T.Units, np.ndarray, np.ndarray, np.ndarray]]


def buckets_for(spark, units: int) -> int:
    return max(BUCKETS_PER_PARTITION * parallelism(spark), -(-units // BUCKET_UNITS))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns _id, _text and _row, a hash of both that tells rows apart whose ids repeat.

    Chunks are named by their rows, so a task that runs again after an executor is lost must see its rows in the same
    order: they are sorted within their partitions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("_row"))
    return rows.sortWithinPartitions("_id", "_row")


def ids_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("_id")
    return np.asarray(column.fill_null(NULL_ID) if column.null_count else column, np.int64)


def first_of_equal(keys: np.ndarray, ids: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of entries whose key has an entry with a smaller (id, place), and of all entries that share a key."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    same = np.zeros(len(held) + 1, bool)
    same[1:-1] = held[1:] == held[:-1]
    shared = order[same[1:] | same[:-1]]
    if not len(shared):
        return shared, shared
    shared = shared[np.lexsort((places[shared], ids[shared], keys[shared]))]
    k, d, p = keys[shared], ids[shared], places[shared]
    lead = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    lead = np.repeat(lead, np.diff(np.append(lead, len(k))))
    return shared[(d != d[lead]) | (p != p[lead])], shared


def chunk_name(rows: np.ndarray) -> int:
    """An xor-fold of the rows and their places: the same texts in the same order give the same name."""
    return int(T.mix(np.bitwise_xor.reduce(T.mix(rows.view(np.uint64) + np.arange(len(rows), dtype=np.uint64)))[None]).view(np.int64)[0])


def packed(name: int, ids: np.ndarray, rows: np.ndarray, count: np.ndarray, keys: np.ndarray, at: np.ndarray, deal: np.ndarray, buckets: int, m: int) -> pa.RecordBatch:
    """A chunk's windows as one row for each bucket, and one row that describes the chunk. count: units of each text; at: places (see Windows)."""
    unit_base = np.concatenate([[0], np.cumsum(count)])
    row = np.searchsorted(unit_base, at // m, side="right") - 1
    base = unit_base * m
    place = at - base[row]
    gone, _ = first_of_equal(keys, ids[row], place)
    sent = np.ones(len(keys), bool)
    sent[gone] = False
    sent = np.flatnonzero(sent)
    bucket = (deal[sent] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    out: list[tuple] = []
    for a, b in zip(begin, [*begin[1:], len(bucket)], strict=True):
        own = sent[a:b]
        r = row[own]
        first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        used = r[first]
        out.append((int(bucket[a]), name, 0, keys[own].tobytes(), T.deltas(at[own], np.uint32), T.planes(np.diff(first, append=len(r)).astype(np.uint32)), T.deltas(ids[used], np.int64), T.deltas(base[used], np.uint32)))
    gone.sort()
    out.append((name % buckets, name, 1, T.deltas(ids, np.int64), rows.tobytes(), T.planes(count.astype(np.uint32)), T.deltas(at[gone], np.uint32), b""))
    return _rows(out, (pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 5), ("bucket", "chunk", "kind", "a", "b", "c", "d", "e"))


def _pack(find: Windows, buckets: int, m: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, "_text"):
            rows = np.asarray(batch.column("_row"), np.int64)
            units, keys, at, deal = find(*T.utf8(batch.column("_text")))
            if len(keys):
                yield packed(chunk_name(rows), ids_of(batch), rows, units.count, keys, at, deal, buckets, m)

    return pack


def _rows(rows: list[tuple], kinds: tuple, names: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


_REPLY_KINDS = ((pa.int64(), pa.int32(), *[pa.binary()] * 5), ("chunk", "kind", "a", "b", "c", "d", "e"))


def _judge(table: pa.Table) -> pa.Table:
    """A bucket: every window that another one precedes, as its chunk and place."""
    out: list[tuple] = []
    keys, at, ids, places, where, names = [], [], [], [], [], []
    for x in table.to_pylist():
        if x["kind"] == 1:
            out.append((x["chunk"], 1, x["a"], x["b"], x["c"], x["d"], x["e"]))
            continue
        key, place, run = np.frombuffer(x["a"], np.uint64), T.undeltas(x["b"], np.uint32), T.unplanes(x["c"], np.uint32).astype(np.int64)
        keys.append(key)
        at.append(place)
        ids.append(np.repeat(T.undeltas(x["d"], np.int64), run))
        places.append(place - np.repeat(T.undeltas(x["e"], np.uint32), run))
        where.append(np.full(len(key), len(names), np.int32))
        names.append(x["chunk"])
    if keys:
        gone, _ = first_of_equal(np.concatenate(keys), np.concatenate(ids), np.concatenate(places))
        gone.sort()
        where, at = np.concatenate(where)[gone], np.concatenate(at)[gone]
        edge = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1], [True]])) if len(where) else []
        out += [(names[where[i]], 0, T.deltas(at[i:j], np.uint32), b"", b"", b"", b"") for i, j in zip(edge[:-1], edge[1:], strict=True)]
    return pa.Table.from_batches([_rows(out, *_REPLY_KINDS)])


def _assemble(widths: tuple[int, ...]) -> Callable[[pa.Table], pa.Table]:
    wide = np.array(widths, np.int64)

    def assemble(table: pa.Table) -> pa.Table:
        """A chunk: the spans of units covered by windows that start earlier elsewhere, for each text that has any."""
        kinds = np.asarray(table.column("kind"))
        whole = table.filter(pa.array(kinds == 1)).slice(0, 1).to_pylist()[0]
        ids, rows, count = T.undeltas(whole["a"], np.int64), np.frombuffer(whole["b"], np.int64), T.unplanes(whole["c"], np.uint32).astype(np.int64)
        base = np.concatenate([[0], np.cumsum(count)])
        depth = np.zeros(base[-1] + 1, np.int64)
        for held in [whole["d"], *table.filter(pa.array(kinds == 0)).column("a").to_pylist()]:
            at, k = np.divmod(T.undeltas(held, np.uint32), len(wide))
            np.add.at(depth, at, 1)
            np.add.at(depth, at + wide[k], -1)
        covered = np.cumsum(depth[:-1]) > 0
        # runs must not cross rows, so each row's first unit begins a new one
        begin, end = T.runs(covered)
        owner, last = np.searchsorted(base, begin, side="right") - 1, np.searchsorted(base, end - 1, side="right") - 1
        out: dict[int, list] = {}
        for b, e, first, final in zip(begin.tolist(), end.tolist(), owner.tolist(), last.tolist(), strict=True):
            for r in range(first, final + 1):
                s, t = max(b, int(base[r])), min(e, int(base[r + 1]))
                if s < t:
                    out.setdefault(r, []).extend((s - int(base[r]), t - int(base[r])))
        return pa.Table.from_batches([_rows([(None if ids[r] == NULL_ID else int(ids[r]), int(rows[r]), np.array(v, np.int32).tobytes()) for r, v in out.items()], (pa.int64(), pa.int64(), pa.binary()), ("_id", "_row", "spans"))])

    return assemble


def judged(windows: DataFrame, widths: tuple[int, ...], tables: Tables) -> DataFrame:
    """From rows of packed(): _id, _row and spans, the covered units as int32 pairs (begin, end); texts without any are left out."""
    replies = windows.groupBy("bucket").applyInArrow(_judge, _REPLY)
    return tables.write(replies.groupBy("chunk").applyInArrow(_assemble(widths), _SPANS))


def earlier_spans(rows: DataFrame, find: Windows, width: int, tables: Tables) -> DataFrame:
    """The spans of judged() for rows of keyed(), of all windows of one width."""
    size = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    windows = rows.mapInArrow(_pack(find, buckets_for(rows.sparkSession, size // _WORD_BYTES), 1), PACKED)
    return judged(windows, (width,), tables)


def with_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of keyed() once, with its spans or null. Repeated rows have equal spans, so one of them serves all."""
    one = spans.groupBy(F.col("_row").alias("_key"), F.col("_id").alias("_owner")).agg(F.first("spans").alias("spans"))
    return rows.join(merged(one), (F.col("_row") == F.col("_key")) & F.col("_id").eqNullSafe(F.col("_owner")), "left").select("_id", "_text", "spans")
