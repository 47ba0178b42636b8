"""Line dedup by winnowing over line hashes.

Of each window of `run` lines the line of least hash is selected (the rightmost of equal ones), so two texts that share such a window have
selected the same line at the same place of it: a guaranteed fingerprint. A chunk's line hashes are stored once; from
them only the selected ones travel, each distinct one once for a chunk, and meet by hash. Fingerprints that no other place has are
done with. Each of the others is extended both ways, to every window of lines whose least one it is: these travel under a
hash of all their lines, dealt out by a second one, so that a line that a third of all texts hold, each time
among other lines, spreads over all buckets and no two places are ever paired. Each window is tied to its earliest occurrence; later ones
go, and those that overlap or touch join to maximal runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.frames import Tables, fresh, merged
from quarry.llm.repeats import PACKED, buckets_for, chunk_name, ids_of, judged, keyed, packed, with_spans

#: Shortest run of lines that counts as repeated.
RUN = 3
#: Words from which a shorter run, a single line too, counts as well; None: never.
WORDS = 20
_LINES = "chunk long, n_lines long, ids binary, rows binary, count binary, hashes binary, words binary"


def fingerprints(hashes: np.ndarray, at: np.ndarray, run: int) -> np.ndarray:
    """For each window of `run` units that begins at `at`, the index of its least hash, the rightmost of equal ones."""
    best = at.copy()
    for k in range(1, run):
        best = np.where(hashes[at + k] <= hashes[best], at + k, best)
    return best


def _widths(run: int, words: int | None) -> tuple[int, ...]:
    return (run,) if words is None else (run, *range(1, run))


def _hashed(words: int | None):
    """One row for each chunk of texts: ids, row hashes, lines of each text, the lines' hashes and, up to `words`, their words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, "_text", T.CHUNK_BYTES // 2):
            data, offsets = T.utf8(batch.column("_text"))
            lines = T.trimmed_lines(data, offsets)
            if not len(lines):
                continue
            rows, held = np.asarray(batch.column("_row"), np.int64), np.zeros(len(lines), np.int64)
            if words is not None:
                begins = np.zeros(len(data) + 1, np.int64)
                solid = T.SPACE_WORDS[data]
                np.cumsum(solid[1:] & ~solid[:-1], out=begins[2:])
                # a line begins with a word, so only the words after it are looked up
                held = np.minimum(1 + begins[lines.end] - begins[lines.start + 1], words)
            out = (chunk_name(rows), len(lines), T.deltas(ids_of(batch), np.int64), rows.tobytes(), T.planes(lines.count.astype(np.uint32)), lines.hashes().tobytes(), T.planes(held.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], [x.split()[0] for x in _LINES.split(", ")])

    return hashed


class _Chunk:
    """A stored chunk and its windows: for each width their first lines and their fingerprints."""

    def __init__(self, row: dict, run: int, words: int | None):
        self.name = row["chunk"]
        self.ids, self.rows = T.undeltas(row["ids"], np.int64), np.frombuffer(row["rows"], np.int64)
        self.count = T.unplanes(row["count"], np.uint32).astype(np.int64)
        self.hashes = np.frombuffer(row["hashes"], np.uint64)
        self.base = np.concatenate([[0], np.cumsum(self.count)])
        self.windows = []
        held = np.concatenate([[0], np.cumsum(T.unplanes(row["words"], np.uint32).astype(np.int64))])
        for k, width in enumerate(_widths(run, words)):
            key, at = T.windows(self.hashes, self.base, width)
            chosen = held[at + width] - held[at] >= words if k else np.ones(len(at), bool)
            self.windows.append((width, key[chosen], at[chosen], fingerprints(self.hashes, at[chosen], width)))
        selected = np.unique(np.concatenate([x[3] for x in self.windows]))
        #: The distinct fingerprints, and whether several places of the chunk have them.
        self.prints, n = np.unique(self.hashes[selected], return_counts=True)
        self.several = n > 1


def _bucket(prints: np.ndarray, buckets: int) -> np.ndarray:
    return (T.salted(prints, 5) % np.uint64(buckets)).astype(np.int64)


def _selected(run: int, words: int | None, buckets: int):
    """The fingerprints of each chunk, one row for each bucket."""

    def selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = _Chunk(row, run, words)
                bucket = _bucket(chunk.prints, buckets)
                out = [(int(k), chunk.name, chunk.prints[own := np.flatnonzero(bucket == k)].tobytes(), chunk.several[own].tobytes()) for k in np.unique(bucket)]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "prints", "several"])

    return selected


def _meet(table: pa.Table) -> pa.Table:
    """A bucket of fingerprints: those of each chunk that some other place has as well."""
    prints = [np.frombuffer(x, np.uint64) for x in table.column("prints").to_pylist()]
    several = np.concatenate([np.frombuffer(x, bool) for x in table.column("several").to_pylist()])
    _, number, n = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
    shared = (n[number] > 1) | several
    edge = np.cumsum([0, *map(len, prints)])
    out = [(c, p[s].tobytes()) for c, p, s in zip(table.column("chunk").to_pylist(), prints, (shared[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)), strict=True) if s.any()]
    return pa.table({"chunk": pa.array([x[0] for x in out], pa.int64()), "prints": pa.array([x[1] for x in out], pa.binary())})


def _extend(run: int, words: int | None, buckets: int):
    """The windows around a chunk's shared fingerprints, named by all their lines."""
    m = len(_widths(run, words))

    def extend(lines: pa.Table, met: pa.Table) -> pa.Table:
        if not met.num_rows or not lines.num_rows:
            return pa.schema([("bucket", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32()), *((x, pa.binary()) for x in "abcde")]).empty_table()
        chunk = _Chunk(lines.slice(0, 1).to_pylist()[0], run, words)
        shared = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in met.column("prints").to_pylist()]))
        other = T.salted(chunk.hashes, 3)
        keys, places, deal = [], [], []
        for k, (width, key, at, least) in enumerate(chunk.windows):
            held = chunk.hashes[least]
            on = shared[np.minimum(np.searchsorted(shared, held), len(shared) - 1)] == held
            first, wide = at[on], T.windows(other, chunk.base, width)
            keys.append(T.salted(key[on], width))
            deal.append(wide[0][np.searchsorted(wide[1], first)])
            places.append(m * first + k)
        keys, places, deal = (np.concatenate(x) for x in (keys, places, deal))
        order = np.argsort(places)
        return pa.Table.from_batches([packed(chunk.name, chunk.ids, chunk.rows, chunk.count, keys[order], places[order], deal[order], buckets, m)])

    return extend


def repeated_spans(docs: DataFrame, run: int, id_col: str, text_col: str, words: int | None) -> DataFrame:
    """The solid lines of each text that go: _id, _row (a hash of id and text) and spans (int32 pairs begin, end). The rows lie in the shared folder."""
    with Tables(docs.sparkSession) as tables:
        lines = tables.write(keyed(docs, id_col, text_col).mapInArrow(_hashed(words), _LINES))
        buckets = buckets_for(docs.sparkSession, lines.agg(F.sum("n_lines")).first()[0] or 0)
        prints = lines.mapInArrow(_selected(run, words, buckets), "bucket int, chunk long, prints binary, several binary")
        met = tables.write(prints.groupBy("bucket").applyInArrow(_meet, "chunk long, prints binary"))
        windows = lines.groupBy("chunk").cogroup(met.groupBy("chunk")).applyInArrow(_extend(run, words, buckets), PACKED)
        return tables.keep(judged(windows, _widths(run, words), tables))


def _cut(text: pa.Array, spans: pa.Array) -> tuple[list[int], list[int], list[str | None]]:
    """Solid lines, lines that go, and what is left of each text."""
    n, gone, out = [], [], []
    for value, held in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        lines = [] if value is None else value.split("\n")
        solid = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        drop: set[int] = set()
        if held:
            pairs = np.frombuffer(held, np.int32).tolist()
            for begin, end in zip(pairs[::2], pairs[1::2], strict=True):
                drop.update(solid[begin:end])
        n.append(len(solid))
        gone.append(len(drop))
        out.append(None if value is None else value if not drop else "\n".join(x for i, x in enumerate(lines) if i not in drop))
    return n, gone, out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone, text = _cut(batch.column("_text"), batch.column("spans"))
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_lines", "n_removed", "text"])


def _edited(text_col: str, chars_col: str, spans_col: str):
    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, text = _cut(batch.column(text_col), batch.column(spans_col))
            columns, names = [], []
            for field, column in zip(batch.schema, batch.columns, strict=True):
                if field.name == spans_col:
                    continue
                if field.name == text_col:
                    column = pa.array(text, field.type)
                elif field.name == chars_col:
                    column = pa.array([None if x is None else len(x) for x in text], field.type)
                columns.append(column)
                names.append(field.name)
            yield pa.RecordBatch.from_arrays(columns, names)

    return edited


def dedup_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", words: int | None = WORDS) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed and text without the lines of later repeated runs.

    Lines are cut at line feeds; a line counts without the ASCII white space at its ends, and lines of white space alone
    neither count nor go. All lines of `run` consecutive ones go whose sequence also starts earlier
    (smaller id, or same id and earlier line), as judged on the input; so do those of a shorter sequence, a single line too, that holds at least `words` words
    (between ASCII white space). Null text stays null with 0 lines. Null ids come after all others; rows whose id repeats count as one
    place and remove nothing from each other at equal places. An empty table gives none. Other columns aren't read.
    """
    return with_spans(keyed(docs, id_col, text_col), repeated_spans(docs, run, id_col, text_col, words)).mapInArrow(_kept, "doc_id long, n_lines long, n_removed long, text string")


def without_repeated_lines(docs: DataFrame, run: int = RUN, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", words: int | None = WORDS) -> DataFrame:
    """The rows themselves, all columns kept, with the text cut as dedup_lines() does and chars_col, if there is one, counted anew. Every row stays, if with an empty text."""
    own_id, own_row, held = fresh(docs, "_id", "_row", "_spans")
    spans = repeated_spans(docs, run, id_col, text_col, words)
    one = spans.groupBy(F.col("_row").alias(own_row), F.col("_id").alias(own_id)).agg(F.first("spans").alias(held))
    named = F.col(id_col).cast("long")
    met = docs.join(merged(one), (F.xxhash64(named, F.col(text_col).cast("string")) == F.col(own_row)) & named.eqNullSafe(F.col(own_id)), "left")
    return met.select(*docs.columns, held).mapInArrow(_edited(text_col, chars_col, held), docs.schema)
