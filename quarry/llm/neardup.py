"""Near-dedup of texts by BagMinHash signatures of word shingles, banding, and exact multiset overlap.

A text is the multiset of its runs of five words. For every shingle and every dyadic interval of weights (0,1], (1,2], (2,4],
(4,8], ... that its count reaches, one Poisson process emits points in rising order; a point falls on a random
signature component and, inside the interval, on a random weight level, and counts if the text's weight reaches that
level. A component keeps its least point, so two texts agree in it with the probability of their weighted Jaccard
similarity. A process stops once its points pass the text's largest component, so a long text needs little more than
one point for each shingle. All texts of a chunk are drawn together with numpy.

Texts with equal multisets are collapsed to one representative first. In a bucket of equal bands every
representative is compared with the one that shares most buckets: a group of thousands of near copies costs one comparison for each
of them. Only where that leaves a bucket in several components do its members meet again, block by block, with sketches of
their signatures; pairs of different components whose sketches don't rule out the threshold are compared exactly too. A sketch holds the
signature's low bits, for an estimate, and the counts of the shingles by 256 hash values (large ones rounded up), which bound the overlap from above for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.frames import Tables, components, fresh, merged, parallelism

SHINGLE = 5
#: 32 bands of 5: a pair of similarity 0.8 is missed with probability 3e-6.
BANDS, ROWS = 32, 5
#: The threshold as a fraction.
SIMILARITY = (4, 5)
#: Bits of each signature component in a sketch.
SKETCH_BITS = 4
#: Sketches rule out a pair whose estimate is further below the threshold: over four standard deviations.
SLACK = 0.15
#: Counts that a byte can stand for: exact to 127, then rounded up by steps of 4 %, the last beyond any.
_LEVELS = np.concatenate([np.arange(128), np.ceil(127 * 1.04 ** np.arange(1, 128)).astype(np.int64), [1 << 30]])
#: Members of a bucket whose sketches meet in one unit of work.
BLOCK = 2048
_SLICE = 256
#: Texts compared with one representative in one part; a representative of more has several parts.
PART_TEXTS = 256
#: Slots of the filter that spares texts without a candidate the shuffle: at most so many rows are broadcast.
_SLOTS = 1 << 18


def shingles(data: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, shingle and count of each text's distinct shingles, ordered by both, and the words of each row. A text of fewer words is one shingle."""
    words = T.Units(data, offsets, T.SPACE_WORDS)
    hashes = words.hashes()
    key, at = T.windows(hashes, words.base, width)
    row = words.row[at]
    for k in range(1, width):
        if (words.count == k).any():
            short, at = T.windows(hashes, words.base, k)
            own = words.row[at]
            fits = words.count[own] == k
            key, row = np.concatenate([key, T.salted(short[fits], k)]), np.concatenate([row, own[fits]])
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], key[begin], np.diff(begin, append=len(key)), words.count


def bag_minhash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, m: int) -> np.ndarray:
    """Signatures (rows x m) of multisets given as rows, elements and counts; an empty one is infinite throughout."""
    least = np.full((rows, m), np.inf)
    top = np.full(rows, np.inf)
    seed, owner, base, span, held = [], [], [], [], []
    level, low = 0, 0
    while len(weight) and (weight > low).any():
        own = np.flatnonzero(weight > low)
        high = 1 << level
        seed.append(T.salted(key[own], 1000 + level))
        owner.append(row[own])
        base.append(np.full(len(own), float(low)))
        span.append(np.full(len(own), float(high - low)))
        held.append(weight[own].astype(float))
        level, low = level + 1, high
    if not seed:
        return least
    seed, owner, base, span, held = (np.concatenate(x) for x in (seed, owner, base, span, held))
    time, drawn, size = np.zeros(len(seed)), 0, 1
    while len(seed):
        # the block sizes depend on the count of points drawn alone, so every text sums its times in the same order
        step = np.arange(drawn, drawn + size, dtype=np.uint64) * np.uint64(3) + np.uint64(1)
        noise = seed[:, None] + (step * np.uint64(0xA0761D6478BD642F))[None, :]
        gap = -np.log(T.unit(T.mix(noise))) / (m * span)[:, None]
        gap[:, 0] += time
        point = np.cumsum(gap, axis=1)
        fall = T.mix(noise ^ np.uint64(0x2545F4914F6CDD1D))
        fits = (point < top[owner][:, None]) & (base[:, None] + T.unit(T.mix(fall)) * span[:, None] <= held[:, None])
        a, b = np.nonzero(fits)
        where = owner[a] * m + (fall[a, b] % np.uint64(m)).astype(np.int64)
        np.minimum.at(least.reshape(-1), where, point[a, b])
        changed = np.unique(owner)
        top[changed] = least[changed].max(1)
        time = point[:, -1]
        on = time < top[owner]
        seed, owner, base, span, held, time = (x[on] for x in (seed, owner, base, span, held, time))
        drawn += size
        size = 1 if drawn < 2 else min(64, drawn)
    return least


def _sign(width: int, bands: int, per_band: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, "_text", T.CHUNK_BYTES // 4):
            data, offsets = T.utf8(batch.column("_text"))
            row, key, weight, count = shingles(data, offsets, width)
            names = []
            for salt in (11, 12):
                total = np.zeros(batch.num_rows, np.uint64)
                np.add.at(total, row, T.salted(key, salt) * (2 * weight.astype(np.uint64) + np.uint64(1)))
                names.append(pa.array(total.view(np.int64)))
            least = bag_minhash(row, key, weight, batch.num_rows, bands * per_band)
            parts = least.view(np.uint64).reshape(batch.num_rows, bands, per_band)
            band = np.zeros((batch.num_rows, bands), np.uint64)
            for k in range(per_band):
                band = T.mix(band + parts[:, :, k] + np.uint64(k + 1))
            bits = T.mix(parts.reshape(batch.num_rows, -1))[:, :, None] >> np.arange(SKETCH_BITS, dtype=np.uint64)[None, None, :] & np.uint64(1)
            packed = np.packbits(bits.astype(bool).reshape(batch.num_rows, -1), axis=1)
            spread = np.zeros(batch.num_rows * 256, np.int64)
            np.add.at(spread, row * 256 + (key >> np.uint64(56)).astype(np.int64), weight)
            spread = np.searchsorted(_LEVELS, spread).astype(np.uint8).reshape(-1, 256)
            size = np.bincount(row, weight, batch.num_rows).astype("<u8").view(np.uint8).reshape(-1, 8)
            packed = np.concatenate([size, spread, packed], axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_row"), *names, pa.array(count), lists, pa.array([x.tobytes() for x in packed], pa.binary())], ["id", "row", "k1", "k2", "words", "bands", "sketch"])

    return sign


def _compare(width: int, similarity: tuple[int, int]):
    num, den = similarity

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, keys, counts = None, None, None
        for batch in T.chunks(batches, "_text", T.CHUNK_BYTES // 4):
            data, offsets = T.utf8(batch.column("_text"))
            row, key, weight, _ = shingles(data, offsets, width)
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            out_a, out_b = [], []
            for k, (a, ar, b, br, salt) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("a", "ar", "b", "br", "salt")), strict=True)):
                own, n = key[edge[k] : edge[k + 1]], weight[edge[k] : edge[k + 1]]
                if a == b and ar == br:
                    lead, keys, counts = (a, ar, salt), own.copy(), n.copy()
                    continue
                if lead != (a, ar, salt) or not len(keys) or not len(own):
                    continue
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                both = int(np.where(keys[at] == own, np.minimum(counts[at], n), 0).sum())
                if both * (num + den) >= num * (int(counts.sum()) + int(n.sum())):
                    out_a.append(a)
                    out_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return compare


def verified(pairs: DataFrame, texts: DataFrame, tables: Tables, width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose multiset Jaccard similarity, counted exactly, reaches the threshold.

    pairs: ids a, b and the hashes ar, br of the texts meant; texts: _id, _row (that hash) and _text. Each pair moves one text: b's goes
    to a's group, and a's text once to each of its salted parts. Only texts with more than PART_TEXTS partners have several.
    """
    large = tables.write(pairs.groupBy(F.col("a").alias("_a"), F.col("ar").alias("_ar")).agg(F.ceil(F.count("*") / PART_TEXTS).cast("int").alias("parts")).where("parts > 1"))
    asked = pairs.join(large, (F.col("a") == F.col("_a")) & (F.col("ar") == F.col("_ar")), "left")
    asked = asked.select("a", "ar", "b", "br", F.pmod(F.xxhash64("b", "br"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    asked = asked.union(asked.select("a", "ar", "a", "ar", "salt").distinct())
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_SLOTS)).cast("int")
    needed = pairs.select(slot("a").alias("_slot")).union(pairs.select(slot("b"))).distinct()
    texts = texts.withColumn("_slot", slot("_id")).join(F.broadcast(needed), "_slot", "left_semi").drop("_slot")
    met = texts.join(merged(asked), (F.col("_id") == F.col("b")) & (F.col("_row") == F.col("br"))).select("a", "ar", "b", "br", "salt", "_text")
    n = parallelism(pairs.sparkSession)
    lead = (F.col("a") == F.col("b")) & (F.col("ar") == F.col("br"))
    ordered = met.repartition(n, "a", "ar", "salt").sortWithinPartitions("a", "ar", "salt", ~lead, "b")
    return ordered.mapInArrow(_compare(width, similarity), "a long, b long")


def _promising(similarity: tuple[int, int]):
    least = similarity[0] / similarity[1] - SLACK
    names = ["band", "bucket", "p", "q"]

    def unit(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts)
        band, p, q = (table.column(x)[0].as_py() for x in ("band", "p", "q"))
        rep, hashed, component, own = (np.asarray(table.column(x)) for x in ("rep", "row", "component", "own"))
        if len(rep) < 2:
            return
        bands = np.asarray(table.column("bands").combine_chunks().flatten(), np.int64).reshape(len(rep), -1)[:, :band]
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(rep), -1)
        size = np.ascontiguousarray(sketch[:, :8]).view("<u8").reshape(-1).astype(np.int64)
        spread, sketch = _LEVELS[sketch[:, 8:264]].astype(np.int32), sketch[:, 264:]
        bits = 8 * sketch.shape[1]
        words = np.ascontiguousarray(np.pad(sketch, ((0, 0), (0, -sketch.shape[1] % 8)))).view(np.uint64)
        most = int(bits * (1 - least) / 2)
        for at in range(0, len(rep), _SLICE):
            apart = np.zeros((min(_SLICE, len(rep) - at), len(rep)), np.uint16)
            for k in range(words.shape[1]):
                apart += np.bitwise_count(words[at : at + _SLICE, k][:, None] ^ words[None, :, k])
            a, b = np.nonzero((apart <= most) & (component[at : at + _SLICE][:, None] != component[None, :]))
            a = a + at
            ok = (rep[a] < rep[b]) if p == q else (rep[a] < rep[b]) & (own[a] != own[b])
            a, b = a[ok], b[ok]
            for k in range(band):  # a pair counts in the first band in which it meets
                ok = bands[a, k] != bands[b, k]
                a, b = a[ok], b[ok]
            ok = np.zeros(len(a), bool)
            for k in range(0, len(a), 1 << 15):
                x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
                both = np.minimum(spread[x], spread[y]).sum(1, dtype=np.int64)
                ok[k : k + (1 << 15)] = both * sum(similarity) >= similarity[0] * (size[x] + size[y])
            a, b = a[ok], b[ok]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[a], hashed[a], rep[b], hashed[b])], ["a", "ar", "b", "br"])

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in T.grouped(batches, names):
            yield from unit(group)

    return promising


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest id linked directly or through others, itself included), kept (doc_id = class_id).

    Two texts are linked if the weighted Jaccard similarity of their word shingle multisets reaches similarity[0] / similarity[1]. Words are cut at
    ASCII white space and unchanged. A text of fewer than `width` words is one shingle; null and empty texts are linked with nothing and are kept. Null ids
    are linked with nothing, class null, kept. Rows whose id repeats are one document, with the links of all its texts: each gets a row, of the same class. An
    empty table gives no rows; other columns aren't read. Tables written on the way are deleted; the returned rows lie in the shared folder.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.xxhash64(F.col(text_col).cast("string")).alias("_row"))
    with Tables(docs.sparkSession) as tables:
        return tables.keep(tables.write(_classified(texts, tables, width, similarity, bands, rows)))


def _classified(texts: DataFrame, tables: Tables, width: int, similarity: tuple[int, int], bands: int, rows: int) -> DataFrame:
    spot = ["band", "bucket"]
    signed = tables.write(texts.mapInArrow(_sign(width, bands, rows), "id long, row long, k1 long, k2 long, words long, bands array<long>, sketch binary"))
    solid = signed.where("words > 0 AND id IS NOT NULL")
    # a class of equal multisets stands as its smallest id and the hash of one of that id's texts
    classes = tables.write(solid.groupBy("k1", "k2").agg(F.min(F.struct("id", "row")).alias("first"), F.first("bands").alias("bands")).select("k1", "k2", F.col("first.id").alias("rep"), F.col("first.row").alias("row"), "bands"))
    banded = classes.select("rep", "row", F.posexplode("bands").alias(*spot))
    shared = tables.write(banded.groupBy(*spot).agg(F.count("*").alias("m")).where("m > 1"))
    members = tables.write(banded.join(merged(shared), spot))
    met = members.groupBy("rep", "row").agg(F.sum("m").alias("met"))
    leads = tables.write(members.join(merged(met), ["rep", "row"]).groupBy(*spot).agg(F.max_by(F.struct("rep", "row"), F.struct("met", -F.col("rep"))).alias("lead")))
    stars = tables.write(members.join(merged(leads), spot).select(F.col("lead.rep").alias("a"), F.col("lead.row").alias("ar"), F.col("rep").alias("b"), F.col("row").alias("br")).where("a <> b").distinct())
    tables.drop(shared, leads)
    # ids that repeat with different texts tie these texts' classes together
    repeated = signed.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    tied = solid.join(repeated, "id").select("id", "k1", "k2").distinct().join(classes.select("k1", "k2", "rep"), ["k1", "k2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    links = tables.write(verified(stars, texts, tables, width, similarity).union(tied).distinct())
    linked = components(links, tables)
    # buckets that the first comparisons have left in several components
    placed = members.join(linked, members["rep"] == linked["node"], "left").select(*spot, "m", "rep", "row", F.coalesce("component", "rep").alias("component"))
    mixed = tables.write(placed.where("m > 2").groupBy(*spot).agg(F.min("component").alias("c"), F.max("component").alias("d")).where("c < d").select(*spot))
    again = placed.join(mixed, spot)
    sketches = signed.select(F.col("id").alias("rep"), "row", "bands", "sketch").join(again.select("rep", "row").distinct(), ["rep", "row"], "left_semi").dropDuplicates(["rep", "row"])
    again = again.join(sketches, ["rep", "row"])
    again = again.withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    again = again.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    again = again.select(*spot, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "rep", "row", "component", "bands", "sketch")
    again = again.repartition(parallelism(texts.sparkSession), *spot, "p", "q").sortWithinPartitions(*spot, "p", "q")
    ends = ["a", "ar", "b", "br"]
    tested = stars.select(*ends).union(stars.select("b", "br", "a", "ar"))
    cross = tables.write(again.mapInArrow(_promising(similarity), "a long, ar long, b long, br long").distinct().join(tested, ends, "left_anti"))
    tables.drop(members, mixed, stars)
    if not cross.isEmpty():
        more = tables.write(verified(cross, texts, tables, width, similarity))
        linked = components(links.union(more), tables)
    named = classes.select("k1", "k2", "rep").join(linked, F.col("rep") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("class_id"))
    known = signed.select("id", "k1", "k2", ((F.col("words") > 0) & F.col("id").isNotNull()).alias("solid"))
    joined = known.where("solid").join(named, ["k1", "k2"]).select(F.col("id").alias("doc_id"), "class_id")
    # a repeated id may also stand on a row without words
    alone = known.where("NOT solid").join(linked, F.col("id") == F.col("node"), "left").select(F.col("id").alias("doc_id"), F.coalesce("component", "id").alias("class_id"))
    return joined.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that near_duplicates() keeps, with all their columns; rows with a null id all stay."""
    (name,) = fresh(docs, "_dropped_id")
    dropped = near_duplicates(docs, id_col, text_col).where("NOT kept").select(F.col("doc_id").alias(name))
    return docs.join(merged(dropped), F.col(id_col).cast("long") == F.col(name), "left_anti")
