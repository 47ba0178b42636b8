"""Benchmark decontamination with a distributed positional inverted index.

The training texts are indexed once: a table in the shared folder holds a segment for each chunk of texts, with its terms in order and, for each
term, the rising positions of its tokens. Segments are rows, so the index is dealt out by texts and a phrase never needs another
one. The benchmark's windows are broadcast a block of bounded size at a time, and each block searches the stored index, never
the texts: for each window the list of its rarest term, moved back by the term's place, is intersected with the moved lists of the
others, from rare to frequent. All windows are intersected together, step by step, so that a step is a few array operations. The driver
holds one block; with several, their hits are written down one after another and joined for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.frames import Tables, fresh, merged
from quarry.llm.repeats import NULL_ID, ids_of

WINDOW = 13
#: A text is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Words that may stand between those of a window, all in all, in a proximity match.
SLACK = 3
#: Windows broadcast at once: 13 term hashes and an item number each, some 30 MB at most.
BLOCK_WINDOWS = 250_000
#: Windows in one piece of an item, so that an item of any length spreads over blocks.
_PIECE_WINDOWS = 4_096
#: Bytes of text in a segment; a longer single text is a segment by itself.
_SEGMENT_BYTES = 2 << 20
#: Candidate places held at once while lists are intersected.
_CANDIDATES = 1 << 19
_NONE = np.iinfo(np.int64).max
_INDEX = "segment long, ids binary, rows binary, count binary, terms binary, frequency binary, positions binary"
_FOUND = "segment long, place int, spans binary, items array<string>, near array<string>"


def _pieces(width: int):
    """The word hashes of each item, long items in pieces that overlap by width - 1 words, so that each window is in one piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, "_text"):
            words = T.Units(*T.utf8(batch.column("_text")), T.ALNUM_WORDS)
            hashes, items, held = words.hashes(T.LOWER), batch.column("_item").to_pylist(), []
            for k, item in enumerate(items):
                own = hashes[words.base[k] : words.base[k + 1]]
                held += [(item, own[s : s + _PIECE_WINDOWS + width - 1].tobytes()) for s in range(0, max(1, len(own) - width + 1), _PIECE_WINDOWS) if len(own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.string()), pa.array([x[1] for x in held], pa.binary())], ["item", "hashes"])

    return pieces


class Windows:
    """Distinct windows of benchmark words as rows of term numbers (-1 pads short ones), the items they belong to and the terms' hashes."""

    def __init__(self, pieces: list[tuple[str, np.ndarray]], width: int):
        self.names = sorted({i for i, _ in pieces})
        number = {x: k for k, x in enumerate(self.names)}
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *(h for _, h in pieces)]))
        rows, owner = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for item, hashes in pieces:
            terms = np.searchsorted(self.terms, hashes).astype(np.int32)
            held = np.lib.stride_tricks.sliding_window_view(terms, width) if len(terms) >= width else np.pad(terms, (0, width - len(terms)), constant_values=-1)[None, :]
            rows.append(held)
            owner.append(np.full(len(held), number[item]))
        self.rows, group = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        # items of each distinct window, as a list of lists in one array
        pairs = np.unique(np.stack([group.reshape(-1), np.concatenate(owner)], 1), axis=0)
        self.items = pairs[:, 1]
        self.items_at = np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))
        self.size = (self.rows >= 0).sum(1)


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, width: int, limit: int) -> Iterator[Windows]:
    """The benchmark's windows in blocks of bounded size, read a partition at a time."""
    named = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(text_col).cast("string").alias("_text")).where("_item IS NOT NULL AND _text IS NOT NULL")
    held, size = [], 0
    for r in named.mapInArrow(_pieces(width), "item string, hashes binary").toLocalIterator():
        held.append((r["item"], np.frombuffer(r["hashes"], np.uint64)))
        size += len(held[-1][1])
        if size >= limit:
            yield Windows(held, width)
            held, size = [], 0
    if held:
        yield Windows(held, width)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One segment for each chunk of texts. Positions count the chunk's words through; `count` tells the texts apart."""
    for batch in T.chunks(batches, "_text", _SEGMENT_BYTES):
        words = T.Units(*T.utf8(batch.column("_text")), T.ALNUM_WORDS)
        terms, number, frequency = np.unique(words.hashes(T.LOWER), return_inverse=True, return_counts=True)
        positions = np.argsort(number, kind="stable").astype(np.uint32)
        rows = np.asarray(batch.column("_row"), np.int64)
        name = int(T.mix(np.bitwise_xor.reduce(T.mix(rows.view(np.uint64) + np.arange(len(rows), dtype=np.uint64)))[None]).view(np.int64)[0])
        out = (name, T.deltas(ids_of(batch), np.int64), rows.tobytes(), T.planes(words.count.astype(np.uint32)), terms.tobytes(), T.planes(frequency.astype(np.uint32)), T.deltas(positions.astype(np.int64), np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int64(), *[pa.binary()] * 6), strict=True)], [x.split()[0] for x in _INDEX.split(", ")])


def positional_index(docs: DataFrame, tables: Tables, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all words of all texts: one row for each segment."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), _row_key(id_col, text_col).alias("_row"))
    # read back as packed rows, so each partition's segments must have names of their own
    return tables.write(rows.mapInArrow(_indexed, _INDEX).withColumn("segment", F.xxhash64("segment", F.spark_partition_id(), F.monotonically_increasing_id())))


class Segment:
    """A stored segment: the sorted places of each term as (term number, position) in one sorted array."""

    def __init__(self, row: dict):
        self.ids, self.rows = T.undeltas(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.count = T.unplanes(row["count"], np.uint32).astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(self.count)])
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.frequency = T.unplanes(row["frequency"], np.uint32).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.frequency)])
        self.positions = np.cumsum(T.unplanes(row["positions"], np.int32).astype(np.int64))
        self.postings = (np.repeat(np.arange(len(self.terms)), self.frequency) << 32) | self.positions

    def numbers(self, windows: Windows) -> np.ndarray:
        """The windows with this segment's term numbers; -1 pads, -2 stands for terms that it hasn't."""
        if not len(self.terms) or not len(windows.terms):
            return np.full(windows.rows.shape, -2)
        at = np.minimum(np.searchsorted(self.terms, windows.terms), len(self.terms) - 1)
        known = np.where(self.terms[at] == windows.terms, at, -2)
        return np.where(windows.rows >= 0, known[windows.rows], -1)

    def candidates(self, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Windows all of whose terms are here, with their places by rarity and each position of the rarest one, some at a time."""
        load = np.where(numbers >= 0, self.frequency[np.maximum(numbers, 0)] if len(self.terms) else 0, _NONE)
        live = np.flatnonzero((numbers != -2).all(1))
        by_rarity = np.argsort(load[live], axis=1, kind="stable")
        rarest = numbers[live, by_rarity[:, 0]] if len(live) else live
        edges, at = np.cumsum(self.frequency[rarest]) if len(live) else live, 0
        while at < len(live):
            to = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + _CANDIDATES, side="right")))
            own = np.arange(at, to)
            n = self.frequency[rarest[own]]
            which = np.repeat(own, n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            yield live[which], by_rarity[which], self.positions[self.begin[rarest[which]] + step], which
            at = to

    def following(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """The first position of each term at or after the given one; _NONE if there is none."""
        at = np.searchsorted(self.postings, (term << 32) | np.maximum(position, 0))
        held = self.postings[np.minimum(at, len(self.postings) - 1)]
        return np.where((at < len(self.postings)) & (held >> 32 == term), held & 0xFFFFFFFF, _NONE)

    def phrases(self, numbers: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All exact occurrences: windows and first positions."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, order, seat, _ in self.candidates(numbers):
            first = seat - order[:, 0]
            ok = first >= 0
            window, order, first = window[ok], order[ok], first[ok]
            for k in range(1, numbers.shape[1]):
                term = numbers[window, order[:, k]]
                place = first + order[:, k]
                ok = (term < 0) | (self.following(np.maximum(term, 0), place) == place)
                window, order, first = window[ok], order[ok], first[ok]
            # a match may not run over the end of the text it begins in
            ok = first + size[window] <= self.base[np.searchsorted(self.base, first, side="right")]
            found.append((window[ok], first[ok]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def near(self, numbers: np.ndarray, size: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Proximity matches: windows all of whose terms stand, in any order, within their number of words and `slack` more of one text; with a position of the rarest."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for window, order, seat, _ in self.candidates(numbers):
            end = self.base[np.searchsorted(self.base, seat, side="right")]
            start = self.base[np.searchsorted(self.base, seat, side="right") - 1]
            for k in range(1, numbers.shape[1]):  # each term lies somewhere around the rarest one, rare ones first
                term, reach = numbers[window, order[:, k]], size[window] + slack
                after = self.following(np.maximum(term, 0), np.maximum(seat - reach + 1, start))
                ok = (term < 0) | (after < np.minimum(seat + reach, end))
                window, order, seat, start, end = (x[ok] for x in (window, order, seat, start, end))
            hit = np.zeros(len(window), bool)
            for back in range(int(size.max(initial=0)) + slack):  # and all of them within one stretch that holds it
                left = np.flatnonzero(~hit & (back < size[window] + slack) & (seat - back >= start))
                for k in range(1, numbers.shape[1]):
                    term, first = numbers[window[left], order[left, k]], seat[left] - back
                    after = self.following(np.maximum(term, 0), first)
                    left = left[(term < 0) | (after < np.minimum(first + size[window[left]] + slack, end[left]))]
                hit[left] = True
            found.append((window[hit], seat[hit]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _items(windows: Windows, found: np.ndarray, row: np.ndarray, rows: int) -> list[np.ndarray]:
    """The distinct items of the windows found in each row."""
    load = np.diff(windows.items_at)[found]
    step = np.arange(load.sum()) - np.repeat(np.cumsum(load) - load, load)
    item = windows.items[np.repeat(windows.items_at[:-1][found], load) + step]
    pairs = np.unique(np.stack([np.repeat(row, load), item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    edge = np.searchsorted(pairs[:, 0], np.arange(rows + 1))
    return [pairs[a:b, 1] for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _search(shared, slack: int | None):
    """For each text that a block hits: the words hit as int32 numbers, the items of exact matches, and those of proximity or exact matches."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = shared.value
        names = np.array(windows.names, object)
        listed = lambda x: names[x].tolist()
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                s = Segment(row)
                numbers = s.numbers(windows)
                window, first = s.phrases(numbers, windows.size)
                owner = lambda x: np.searchsorted(s.base, x, side="right") - 1  # noqa: B023, E731
                own = _items(windows, window, owner(first), len(s.count))
                near = own
                if slack is not None:
                    found, seat = s.near(numbers, windows.size, slack)
                    near = [np.union1d(a, b) for a, b in zip(own, _items(windows, found, owner(seat), len(s.count)), strict=True)]
                depth = np.zeros(s.base[-1] + 1, np.int64)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + windows.size[window], -1)
                at = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
                edge = np.searchsorted(at, s.base)
                on = [i for i in range(len(s.count)) if len(own[i]) or len(near[i])]
                out = [(row["segment"], i, (at[edge[i] : edge[i + 1]] - s.base[i]).astype(np.int32).tobytes(), listed(own[i]), listed(near[i])) for i in on]
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], kind) for j, kind in enumerate(kinds)], [x.split()[0] for x in _FOUND.split(", ")])

    return search


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of each segment."""
    for batch in batches:
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            ids, rows, n = T.undeltas(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64), T.unplanes(row["count"], np.uint32).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["segment"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids, mask=ids == NULL_ID), pa.array(rows), pa.array(n)], ["segment", "place", "doc_id", "_row", "n_words"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_hit: the distinct words that one block or another has hit."""
    for batch in batches:
        n = [len(np.unique(np.frombuffer(b"".join(x), np.int32))) for x in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("segment", "place")), pa.array(n, pa.int64()), *(batch.column(x) for x in ("items", "near"))], ["segment", "place", "n_hit", "items", "near"])


_CONTAMINATED = f"n_hit > 0 AND {SHARE} * n_hit >= n_words"


def _row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string"))


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str, item_col: str, slack: int | None, block_windows: int) -> DataFrame:
    """doc_id, _row (a hash of id and text), n_words, n_hit, items, near of each row; lies in the shared folder."""
    context = docs.sparkSession.sparkContext
    with Tables(docs.sparkSession) as tables:
        index = positional_index(docs, tables, id_col, text_col)
        held, done = [], []

        def finished(shared, part: DataFrame) -> DataFrame:
            part = tables.write(part)
            shared.unpersist()
            return part

        for windows in _blocks(benchmark, item_col, "text", window, block_windows):
            shared = context.broadcast(windows)
            held.append((shared, index.mapInArrow(_search(shared, slack), _FOUND)))
            if len(held) > 1:  # several blocks: the one before is searched and let go before the next is broadcast
                done.append(finished(*held.pop(0)))
        found = held[0][1] if held and not done else None
        if done:
            done.append(finished(*held.pop()))
            found = reduce(DataFrame.unionByName, done)
        members = index.mapInArrow(_members, "segment long, place int, doc_id long, _row long, n_words long")
        none = F.array().cast("array<string>")
        if found is None:
            return tables.keep(tables.write(members.select("doc_id", "_row", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), none.alias("near"))))
        at = ["segment", "place"]
        every = found.groupBy(*at).agg(F.collect_list("spans").alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
        every = every.mapInArrow(_counted, "segment long, place int, n_hit long, items array<string>, near array<string>")
        joined = members.join(every, at, "left").select("doc_id", "_row", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("near", none).alias("near"))
        return tables.keep(tables.write(joined))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", slack: int = SLACK, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any benchmark window), n_items, items_sha256, contaminated, n_near.

    A-Z are lower-cased; words are runs of digits, letters and non-ASCII characters. A window is `window` consecutive item
    words, or a whole shorter item; an item without words has none. contaminated: n_hit > 0 and 20 n_hit >= n_words.
    n_near: items with a window all of whose words stand, in any order, in some stretch of the text that is `slack` words longer than the window.
    Null texts have no words, items with null id or text no window; empty tables give no rows or no hits.
    Repeated rows give a row each, an item id that repeats counts once; other columns aren't read.
    """
    found = _hits(docs, benchmark, window, id_col, text_col, item_col, slack, block_windows)
    digest = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), F.expr(_CONTAMINATED).alias("contaminated"), F.size("near").cast("long").alias("n_near"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows that contamination() doesn't find contaminated, with all their columns."""
    own_id, own_row = fresh(docs, "_hit_id", "_hit_row")
    found = _hits(docs, benchmark, window, id_col, text_col, item_col, None, block_windows).where(_CONTAMINATED).select(F.col("doc_id").alias(own_id), F.col("_row").alias(own_row)).distinct()
    return docs.join(merged(found), (_row_key(id_col, text_col) == F.col(own_row)) & F.col(id_col).cast("long").eqNullSafe(F.col(own_id)), "left_anti")
