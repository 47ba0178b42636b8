"""Embedding near-dedup: Euclidean p-stable hashing into several tables, then exact cosines inside buckets.

Normalised vectors are projected on Gaussian directions, shifted, and cut into steps; `k` steps make a table's key. Two
vectors of cosine c lie sqrt(2 - 2c) apart and meet in a table with a known probability, from which the number of tables
follows so that a pair just at the threshold is missed with probability MISS; nearer pairs are missed far more rarely. k
grows with the logarithm of the table so that unrelated vectors stay about COMPANY to a bucket. Equal vectors are
collapsed first. Only names travel while buckets are formed; a bucket of more than BLOCK vectors is compared block by block, each pair
of blocks a unit of its own, and a vector is fetched once for each of its units, in single precision where that is exact. A pair
counts in the first table in which it meets, so counts need no list of pairs; the keys of earlier tables are drawn
again for linked vectors alone, so a vector's bytes grow with the number of tables and no faster. Links leave a bucket as a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.frames import Tables, components, least_labels, merged, parallelism

THRESHOLD = 0.9
#: Probability that a pair just at the threshold is missed.
MISS = 1e-5
COMPANY = 1000
#: Width of a step, in units of the (normalised) vectors.
STEP = 1.5
BLOCK = 2048
_SLICE = 128
#: Tables whose keys are drawn at once when linked pairs are looked up in earlier ones.
_TABLES = 4
_SEED = 20_240_601


def meeting(distance: float, step: float = STEP) -> float:
    """The probability that one p-stable hash value of two vectors at this distance is the same."""
    r = step / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_of(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> tuple[int, int]:
    """Hash values for each key and number of tables, for n vectors."""
    near, far = meeting(math.sqrt(2 - 2 * threshold)), meeting(math.sqrt(2))
    k = max(2, math.ceil(math.log(max(n, 1) / COMPANY) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log1p(-(near**k)))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector as a byte for the width of a component (4 if single precision holds it exactly, else 8) and the components; null for one that can't be compared."""
    for batch in batches:
        out = []
        for x in batch.column("_vec"):
            held = None
            if x.is_valid and len(x) and x.values.null_count == 0:
                v = np.asarray(x.values, np.float64)
                norm = math.sqrt(float(v @ v)) if np.isfinite(v).all() else 0.0
                if norm > 0 and math.isfinite(norm):
                    v = v + 0.0
                    with np.errstate(over="ignore"):
                        short = v.astype("<f4")
                    held = b"\x04" + short.tobytes() if (short == v).all() else b"\x08" + v.astype("<f8").tobytes()
            out.append(held)
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.binary())], ["id", "vec"])


def _doubles(held: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<f4" if x[0] == 4 else "<f8", offset=1).astype(np.float64) for x in held]


_drawn: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
#: Units and directions are rounded to these binary places: sums of their products are whole numbers that doubles hold exactly,
#: so a vector falls into the same cell whatever is multiplied along with it.
_UNIT_BITS, _DIRECTION_BITS = 20, 14


def _table(dim: int, k: int, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and shifts of one table, drawn from a seed of its own."""
    if (dim, k, at) not in _drawn:
        rng = np.random.default_rng([_SEED, dim, at])
        _drawn[dim, k, at] = np.rint(rng.standard_normal((dim, k)) * 2.0**_DIRECTION_BITS), rng.uniform(0, 1, k)
    return _drawn[dim, k, at]


def _rounded(vectors: np.ndarray) -> np.ndarray:
    return np.rint(vectors / np.sqrt((vectors * vectors).sum(1))[:, None] * 2.0**_UNIT_BITS)


def _keys(rounded: np.ndarray, k: int, first: int, last: int, step: float) -> np.ndarray:
    """Key of each vector (rows of _rounded(), of one dimension) in the tables from first to last."""
    dim = rounded.shape[1]
    drawn = [_table(dim, k, t) for t in range(first, last)]
    place = rounded @ np.concatenate([d for d, _ in drawn], 1) / (step * 2.0 ** (_UNIT_BITS + _DIRECTION_BITS)) + np.concatenate([s for _, s in drawn])
    cell = np.floor(place).astype(np.int64).astype(np.uint64).reshape(len(rounded), last - first, k)
    key = np.full((len(rounded), last - first), dim, np.uint64) + np.arange(first, last, dtype=np.uint64)[None, :] * np.uint64(1 << 32)
    for j in range(k):
        key = T.mix(key + cell[:, :, j])
    return key.view(np.int64)


def _first_met(rounded: np.ndarray, a: np.ndarray, b: np.ndarray, k: int, tab: int, step: float) -> np.ndarray:
    """The pairs (a, b) that meet in none of the tables before `tab`. Near pairs meet early, so few are left after some tables."""
    left = np.arange(len(a))
    for first in range(0, tab, _TABLES):
        if not len(left):
            break
        met, number = np.unique(np.concatenate([a[left], b[left]]), return_inverse=True)
        keys = _keys(rounded[met], k, first, min(tab, first + _TABLES), step)
        left = left[(keys[number[: len(left)]] != keys[number[len(left) :]]).all(1)]
    return left


def _hashed(k: int, count: int, step: float):
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held = _doubles(part.column("vec").to_pylist())
                size = np.array([len(x) for x in held])
                for dim in np.unique(size):
                    own = np.flatnonzero(size == dim)
                    key = _keys(_rounded(np.stack([held[i] for i in own])), k, 0, count, step)
                    again = pa.array(np.repeat(own, count))
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), len(own))), pa.array(key.reshape(-1)), part.column("rep").take(again), part.column("hash").take(again)], ["tab", "key", "rep", "hash"])

    return hashed


def _compare(threshold: float, k: int, step: float):
    names = ["tab", "key", "p", "q"]

    def unit(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        tab, p, q = (table.column(x)[0].as_py() for x in ("tab", "p", "q"))
        rep, hashed, n, block = (np.asarray(table.column(x)) for x in ("rep", "hash", "n", "own"))
        if len(rep) < 2:
            return
        held = _doubles(table.column("vec").to_pylist())
        if len({len(x) for x in held}) > 1:  # different lengths met by a colliding key: they link with nothing
            size = np.array([len(x) for x in held])
            for dim in np.unique(size):
                yield from unit(table.filter(pa.array(size == dim)).to_batches())
            return
        v = np.stack(held)
        norm, rounded = np.sqrt((v * v).sum(1)), _rounded(v)
        links, label, found = np.zeros(len(rep), np.int64), np.arange(len(rep)), []
        for at in range(0, len(rep), _SLICE):
            cosine = v[at : at + _SLICE] @ v.T / (norm[at : at + _SLICE, None] * norm[None, :])
            a, b = np.nonzero(cosine >= threshold)
            a = a + at
            ok = (a < b) & ((block[a] != block[b]) if p != q else True)
            a, b = a[ok], b[ok]
            if tab and len(a):
                left = _first_met(rounded, a, b, k, tab, step)
                a, b = a[left], b[left]
            if len(a):
                np.add.at(links, a, n[b])
                np.add.at(links, b, n[a])
                label = least_labels(a, b, label)
        held = np.flatnonzero(links)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rep[held], hashed[held], rep[label[held]], links[held])], ["a", "ah", "b", "links"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in T.grouped(batches, names):
            yield from unit(group)

    return compare


def vector_links(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of cosine >= threshold), component_id (smallest id reached by links), kept.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null id, link with nothing, nor do vectors of
    different lengths. Each row counts, also one whose id repeats (such rows share a component). An empty table
    gives no rows; other columns, labels too, aren't read. Tables written on the way are deleted; the returned rows lie in the shared folder.
    """
    vectors = table.select(F.col(id_col).cast("long").alias("_id"), F.col(vec_col).cast("array<double>").alias("_vec"))
    with Tables(table.sparkSession) as tables:
        return tables.keep(tables.write(_linked(vectors, tables, threshold, miss, block)))


def _linked(vectors: DataFrame, tables: Tables, threshold: float, miss: float, block: int) -> DataFrame:
    bucket, name = ["tab", "key"], ["rep", "hash"]
    vectors = tables.write(vectors.mapInArrow(_packed, "id long, vec binary"))
    solid = vectors.where("id IS NOT NULL AND vec IS NOT NULL")
    # a class of equal vectors is named by its smallest id and the hash of its components
    classes = tables.write(solid.groupBy("vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("hash", F.xxhash64("vec")))
    k, count = tables_of(classes.count(), threshold, miss)
    keys = tables.write(classes.mapInArrow(_hashed(k, count, STEP), "tab int, key long, rep long, hash long"))
    met = tables.write(keys.groupBy(*bucket).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.count("*").alias("m")).where("m > 1").select(*bucket, "blocks"))
    dealt = keys.join(merged(met), bucket).withColumn("own", F.pmod(F.xxhash64(*name), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(*bucket, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", *name).join(merged(classes.select(*name, "n", "vec")), name)
    units = dealt.repartition(parallelism(vectors.sparkSession), *bucket, "p", "q").sortWithinPartitions(*bucket, "p", "q")
    found = tables.write(units.mapInArrow(_compare(threshold, k, STEP), "a long, ah long, b long, links long"))
    tables.drop(keys, met)
    links = found.groupBy(F.col("a").alias("rep"), F.col("ah").alias("hash")).agg(F.sum("links").alias("links"))
    # ids that repeat with different vectors tie those vectors' classes together
    repeated = solid.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    tied = solid.join(repeated, "id").join(classes.select("vec", "rep"), "vec").where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    linked = components(found.select("a", "b").union(tied), tables).withColumnRenamed("node", "member")
    named = classes.join(links, name, "left").join(linked, F.col("rep") == F.col("member"), "left")
    named = named.select(F.col("vec").alias("_vec"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    joined = vectors.join(named, (vectors["vec"] == named["_vec"]) & vectors["id"].isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
