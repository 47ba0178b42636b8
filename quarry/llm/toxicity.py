"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon of insults is learned from the labelled sample (whole words and word beginnings that occur in toxic texts far more
often than chance allows; near copies in the sample count once), so it follows the corpus' languages. Features
are lexicon densities, second-person words and their nearness to lexicon hits, capitals, punctuation and obfuscation rates.
The trees are fitted on features whose lexicon was learned without the text's own fold; the calibration on margins of
trees that haven't seen the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.labelled import SAMPLE_ROWS, fold_of, labelled_sample

CUT = 0.5
FOLDS = 4
_CHUNK = T.CHUNK_BYTES // 4
#: Bytes of the word beginnings that may enter the lexicon.
_BEGINNINGS = (4, 5, 6, 7)
#: Second-person words (fixed values).
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "sie", "usted", "ustedes", "vosotros", "tus", "ti")
#: Words between a second-person word and a hit that count as near.
_NEAR = 4
#: Lower case, and digits read as the letters that they often stand for (fixed values).
_PLAIN = T.LOWER.copy()
for _digit, _letter in zip(b"013457", b"oieast", strict=True):
    _PLAIN[_digit] = _letter

FEATURES = ("hits", "density", "strength", "distinct", "second", "near", "words", "capitals", "shouted", "marks", "exclamations", "masked", "stretched", "length")


class Words:
    """Words of a chunk with the hashes that the lexicon is looked up by."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.units = u = T.Units(data, offsets, T.ALNUM_WORDS)
        self.names = [T.salted(u.hashes(_PLAIN), 1)]
        end, size = u.end, u.end - u.start
        for k in _BEGINNINGS:
            u.end = np.minimum(end, u.start + k)
            self.names.append(np.where(size > k, T.salted(u.hashes(_PLAIN), k), self.names[0]))
        u.end = end
        self.offsets = offsets


_KEY = np.uint64((1 << 44) - 1)


def entries(w: Words) -> np.ndarray:
    """The distinct lexicon keys (44 bits) of each row, as row * 2**44 + key."""
    row = w.units.row.astype(np.uint64) << np.uint64(44)
    return np.unique(np.concatenate([np.unique(row | (x >> np.uint64(20))) for x in w.names]))


def learn(held: list[np.ndarray], chosen: list[np.ndarray], labels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and strengths (log ratios) of the lexicon, from the entries of each chunk's chosen rows."""
    every: list[np.ndarray] = []
    toxic: list[np.ndarray] = []
    n = np.zeros(2)
    for pairs, rows, y in zip(held, chosen, labels, strict=True):
        n += np.bincount(y[rows], minlength=2)[:2]
        row = (pairs >> np.uint64(44)).astype(np.int64)
        every.append(pairs[rows[row]] & _KEY)
        toxic.append(pairs[rows[row] & (y[row] > 0)] & _KEY)
    if not n[0] or not n[1]:
        return np.zeros(0, np.uint64), np.zeros(0)
    # only keys of toxic texts can enter; all others count for the number of candidates alone
    name, bad = np.unique(np.concatenate(toxic), return_counts=True)
    whole = np.sort(np.concatenate(every))
    both = np.searchsorted(whole, name, side="right") - np.searchsorted(whole, name, side="left")
    step = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1], [True]]))
    candidates = max(2, int((np.diff(step) >= 3).sum()))
    good, base = both - bad, n[1] / n.sum()
    gain = bad * np.log(bad / both / base) + good * np.log(np.maximum(good, 1e-9) / both / (1 - base))
    keep = (bad >= 3) & (bad / both > 0.5) & (gain > np.log(candidates) + 1)
    return name[keep], np.log((bad[keep] + 0.5) / (good[keep] + 0.5) * n[0] / n[1])


def features(w: Words, data: np.ndarray, lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of FEATURES for each text; an empty text is zeros throughout."""
    u, rows = w.units, w.units.rows
    name, strength = lexicon
    found = np.zeros(len(u))
    if len(name):
        for x in w.names:
            key = x >> np.uint64(20)
            at = np.minimum(np.searchsorted(name, key), len(name) - 1)
            found = np.where(name[at] == key, np.maximum(found, strength[at]), found)
    hit = found > 0
    total = lambda mask, weight=None: np.bincount(u.row[mask], None if weight is None else weight[mask], rows)
    n = np.maximum(1, u.count)
    second = np.isin(w.names[0], _second())
    reach = np.concatenate([[0], np.cumsum(second)])
    at = np.flatnonzero(hit)
    low, high = np.maximum(at - _NEAR, u.base[u.row[at]]), np.minimum(at + _NEAR + 1, u.base[u.row[at] + 1])
    near = np.bincount(u.row[at], reach[high] > reach[low], rows)
    pairs = np.unique((u.row[at].astype(np.uint64) << np.uint64(44)) | (w.names[1][at] >> np.uint64(20)))
    distinct = np.bincount((pairs >> np.uint64(44)).astype(np.int64), minlength=rows)
    strongest = np.zeros(rows)
    np.maximum.at(strongest, u.row[at], found[at])

    edges = w.offsets

    def rate(mask: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(mask)])
        return (seen[edges[1:]] - seen[edges[:-1]]) / np.maximum(1, np.diff(edges))

    upper, lower = (data >= 0x41) & (data <= 0x5A), (data >= 0x61) & (data <= 0x7A)
    up, low_case = (np.concatenate([[0], np.cumsum(x)]) for x in (upper, lower))
    shouted = (up[u.end] - up[u.start] > 1) & (low_case[u.end] == low_case[u.start])
    letter = upper | lower | (data >= 0x80)
    space = ~T.SPACE_WORDS[data]
    mark = ~letter & ~space & ~((data >= 0x30) & (data <= 0x39))
    odd = np.zeros(len(data), bool)  # a mark or digit between letters
    odd[1:-1] = ~letter[1:-1] & ~space[1:-1] & letter[:-2] & letter[2:] & (data[1:-1] != 0x27) & (data[1:-1] != 0x2D)
    triple = np.zeros(len(data), bool)
    triple[2:] = letter[2:] & (data[2:] == data[1:-1]) & (data[2:] == data[:-2])
    return np.stack([total(hit), total(hit) / n, strongest, distinct, total(second) / n, near, np.log1p(u.count), rate(upper), total(shouted) / n, rate(mark), rate(data == 0x21), rate(odd), rate(triple), total(np.ones(len(u), bool), (u.end - u.start).astype(float)) / n], axis=1)


_held: dict[str, np.ndarray] = {}


def _second() -> np.ndarray:
    if "s" not in _held:
        data, offsets = T.utf8(pa.array(SECOND_PERSON))
        _held["s"] = np.sort(Words(data, offsets).names[0])
    return _held["s"]


class Trees:
    """Boosted regression trees on the logistic loss, with histogram splits and Newton leaves."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: float = 2.0, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        cuts = [np.unique(np.concatenate([np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1]), [c.min()]])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        margin = np.full(len(y), self.start)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p) + 1e-6
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            for d in range(self.depth):
                first = 2**d - 1
                for k in range(first, 2 * first + 1):
                    own = node == k
                    best = 1e-6
                    bin_cut = -1
                    if own.sum() >= 2:
                        gs, hs = g[own].sum(), h[own].sum()
                        for f in range(x.shape[1]):
                            size = len(cuts[f]) + 1
                            gl = np.cumsum(np.bincount(binned[own, f], g[own], size))[:-1]
                            hl = np.cumsum(np.bincount(binned[own, f], h[own], size))[:-1]
                            gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - gs**2 / (hs + self.ridge)
                            nl = np.cumsum(np.bincount(binned[own, f], minlength=size))[:-1]
                            gain[(nl < self.least) | (own.sum() - nl < self.least)] = 0
                            if len(gain) and gain.max() > best:
                                best, bin_cut, feature[k] = gain.max(), int(gain.argmax()), f
                    if bin_cut >= 0:
                        cut[k] = cuts[feature[k]][bin_cut]
                    node[own] = 2 * k + 1 + (x[own, feature[k]] > cut[k])
            leaf = node - inner
            value = -np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge) * self.rate
            self.trees.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[at, feature[node]] > cut[node])
            out += value[node - len(cut)]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on margin (pool adjacent violators); scores between knots are interpolated."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum, count, least and largest margin
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([v, 1.0, m, m])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            v2, n2, _, hi = blocks.pop()
            blocks[-1][0] += v2
            blocks[-1][1] += n2
            blocks[-1][3] = hi
    # a block's share, drawn in by half a case so that no score is certain
    return np.array([b[i] for b in blocks for i in (2, 3)]), np.array([(b[0] + 0.5 * (b[0] > 0)) / (b[1] + 1) if b[0] < b[1] else (b[0] + 0.5) / (b[1] + 1) for b in blocks for _ in (2, 3)])


def fit(texts: pa.Array, labels: list[int]) -> dict:
    """The model: lexicon, trees and calibration. With labels of one class only, or none, a constant score."""
    y = np.array(labels, int)
    if len(np.unique(y)) < 2:
        return {"constant": float(y[0]) if len(y) else 0.5}
    parts, found, at = [], [], 0
    lead: set[tuple[int, int]] = set()
    batch = pa.RecordBatch.from_arrays([texts], ["_text"])
    for part in T.chunks(iter([batch]), "_text", _CHUNK):
        data, offsets = T.utf8(part.column("_text"))
        w = Words(data, offsets)
        shingle, place = T.windows(w.names[0], w.units.base, 5)
        # near copies share their least shingle: the first of them counts for the lexicon
        least = np.full(part.num_rows, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, w.units.row[place], shingle)
        fresh = np.ones(part.num_rows, bool)
        for r in range(part.num_rows):
            name = (int(least[r]), int(y[at + r]))
            if w.units.count[r] >= 5:
                fresh[r] = name not in lead
                lead.add(name)
        parts.append((data, offsets, at, part.num_rows, fresh))
        found.append(entries(w))
        at += part.num_rows
    fold = np.arange(len(y)) % FOLDS
    label = [y[a : a + n] for _, _, a, n, _ in parts]
    lexica = [learn(found, [fresh & (fold[a : a + n] != k) for *_, a, n, fresh in parts], label) for k in range(FOLDS)]
    x = np.zeros((len(y), len(FEATURES)))
    for data, offsets, a, n, _ in parts:
        w = Words(data, offsets)
        for k in range(FOLDS):
            own = fold[a : a + n] == k
            x[a : a + n][own] = features(w, data, lexica[k])[own]
    margin = np.zeros(len(y))
    for k in range(FOLDS):
        held = fold == k
        if len(np.unique(y[~held])) == 2:
            margin[held] = Trees().fit(x[~held], y[~held]).margin(x[held])
    knots, share = isotonic(margin, y)
    return {"lexicon": learn(found, [fresh for *_, fresh in parts], label), "trees": Trees().fit(x, y), "knots": knots, "share": share}


def _scores(model: dict, text: pa.Array) -> np.ndarray:
    if "constant" in model:
        return np.full(len(text), model["constant"])
    data, offsets = T.utf8(text)
    margin = model["trees"].margin(features(Words(data, offsets), data, model["lexicon"]))
    return np.interp(margin, model["knots"], model["share"])


def _score(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, "_text", _CHUNK):
            p = _scores(shared.value, batch.column("_text"))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    return score


def _keep(shared, text_col: str, cut: float):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.chunks(batches, text_col, _CHUNK):
            yield batch.filter(pa.array(_scores(shared.value, batch.column(text_col)) < cut))

    return keep


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text modulo 5 is 0), score (0 to 1, higher: label 1 likelier), predicted (score >= cut).

    Fitted on at most `sample_rows` labelled rows that aren't held out (see labelled_sample); every whole text is scored, by its
    text alone. Null texts score as empty ones; null ids give held_out null; repeated rows give a row each; an empty table
    gives none; without labels of both classes the score is constant (that class, or 0.5). Other columns aren't read.
    """
    model = fit(*labelled_sample(docs, labels, label_col, 5, 0, id_col, text_col, sample_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), (fold_of(id_col, 5) == 0).alias("held_out"))
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """The rows that toxicity_scores() wouldn't predict as toxic, with all their columns; texts are scored where they lie, nothing is shuffled.

    Without labels of both classes there is no model to reject by, so all rows stay. Null and empty texts are scored as empty ones; repeated
    rows share a score; a row whose score is just the cut goes; an empty table gives none.
    """
    model = fit(*labelled_sample(docs, labels, label_col, 5, 0, id_col, text_col, sample_rows))
    if "constant" in model:
        return docs
    return docs.mapInArrow(_keep(docs.sparkSession.sparkContext.broadcast(model), text_col, cut), docs.schema)
