"""Quality classifier: naive Bayes support vectors (NB-SVM).

N-gram indicators are scaled by the log-count ratio of the two classes, and a linear hinge-loss model is fitted to them by dual
coordinate descent; a sigmoid fitted on cross-validated margins makes the score. N-grams are of words, of their
shapes (case, digits, the punctuation itself), and of repeats of the word before, hashed to a fixed number of features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import textops as T
from quarry.llm.labelled import SAMPLE_ROWS, fold_of, labelled_sample

BITS = 18
CUT = 0.7
_CHUNK = T.CHUNK_BYTES // 4
_PUNCTUATION = T.SPACE_WORDS & ~T.ALNUM_WORDS


def indicators(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature number of every n-gram indicator, each once, ordered by both."""
    rows = len(offsets) - 1
    words, marks = T.Units(data, offsets, T.ALNUM_WORDS), T.Units(data, offsets, _PUNCTUATION)
    lower = words.hashes(T.LOWER)
    up = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    low = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
    digit = np.concatenate([[0], np.cumsum((data >= 0x30) & (data <= 0x39))])
    n_up, n_low, n_digit = (x[words.end] - x[words.start] for x in (up, low, digit))
    shape = np.where(n_digit > 0, 4, np.where((n_up > 0) & (n_low == 0), 3, np.where(n_up > 1, 2, np.where(n_up == 1, 1, 0)))).astype(np.uint64)
    again = np.zeros(len(words), bool)
    again[1:] = (lower[1:] == lower[:-1]) & (words.row[1:] == words.row[:-1])
    shape[again] = 9
    start = np.concatenate([words.start, marks.start])
    order = np.argsort(start, kind="stable")
    stream = np.concatenate([shape, T.salted(marks.hashes(), 5)])[order]
    stream_row = np.concatenate([words.row, marks.row])[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def grams(values: np.ndarray, row: np.ndarray, n: int, salt: int) -> None:
        if len(values) < n:
            return
        key = values[: len(values) - n + 1].copy()
        for k in range(1, n):
            key = T.mix(key) + values[k : len(values) - n + 1 + k]
        same = row[: len(row) - n + 1] == row[n - 1 :]
        found.append((row[: len(row) - n + 1][same], T.salted(key[same], salt)))

    grams(lower, words.row, 1, 21)
    grams(lower, words.row, 2, 22)
    grams(stream, stream_row, 1, 23)
    grams(stream, stream_row, 3, 24)
    grams(shape, words.row, 4, 25)
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.concatenate([a for a, _ in found])
    feature = (np.concatenate([b for _, b in found]) >> np.uint64(64 - bits)).astype(np.int64)
    held = np.unique((row << bits) | feature)
    return held >> bits, held & ((1 << bits) - 1)


def _by_row(texts: pa.Array, bits: int) -> list[np.ndarray]:
    out = []
    batch = pa.RecordBatch.from_arrays([texts], ["_text"])
    for part in T.chunks(iter([batch]), "_text", _CHUNK):
        row, feature = indicators(*T.utf8(part.column("_text")), bits)
        edge = np.searchsorted(row, np.arange(part.num_rows + 1))
        out += [feature[a:b].astype(np.int32) for a, b in zip(edge[:-1], edge[1:], strict=True)]
    return out


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, bits: int, alpha: float = 1.0, least: int = 3) -> np.ndarray:
    """Log ratio of each feature's share in the two classes; 0 for features in fewer than `least` texts. The smoothing is split by class size, so an unseen feature says nothing."""
    size = 1 << bits
    total = [np.zeros(size), np.zeros(size)]
    for x, label in zip(rows, y, strict=True):
        total[int(label)][x] += 1
    n = np.array([max(1, (y == c).sum()) for c in (0, 1)], float)
    share = [(total[c] + alpha * n[c] / n.sum()) / (n[c] + alpha * n[c] / n.sum()) for c in (0, 1)]
    return np.where(total[0] + total[1] >= least, np.log(share[1] / share[0]), 0.0)


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: float = 1.0, epochs: int = 40) -> np.ndarray:
    """Weights of a linear hinge-loss model over scaled indicators, each text at unit indicator length; classes weigh the same.

    Each step maximises the dual in one text's multiplier, which stays between 0 and the text's share of the cost; it ends
    when no multiplier moves its margin by more than a thousandth, or after `epochs` passes.
    """
    sign = np.where(y == 1, 1.0, -1.0)
    weight = np.zeros(len(scale))
    value = [scale[x] / np.sqrt(max(1, len(x))) for x in rows]
    most = cost * len(y) / (2 * np.array([max(1, (y == c).sum()) for c in (0, 1)], float))[y]
    square = np.array([float(v @ v) for v in value])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(4)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(np.flatnonzero(square)):
            x, v = rows[i], value[i]
            new = min(max(alpha[i] - (sign[i] * float(weight[x] @ v) - 1) / square[i], 0.0), most[i])
            if new != alpha[i]:
                weight[x] += (new - alpha[i]) * sign[i] * v
                moved = max(moved, abs(new - alpha[i]) * square[i])
                alpha[i] = new
        if moved < 1e-3:
            break
    return weight * scale


def _margins(rows: list[np.ndarray], weight: np.ndarray) -> np.ndarray:
    return np.array([weight[x].sum() / np.sqrt(max(1, len(x))) for x in rows])


def sigmoid_fit(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic curve through margins, by Newton steps with a small ridge."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()])
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def fit(texts: pa.Array, labels: list[int], bits: int = BITS, folds: int = 3) -> dict:
    """The model: weights and the sigmoid. With labels of one class only, or none, a constant score."""
    y = np.array(labels, int)
    if len(np.unique(y)) < 2:
        return {"constant": float(y[0]) if len(y) else 0.5}
    rows = _by_row(texts, bits)
    margin = np.zeros(len(y))
    for k in range(folds):
        held = np.arange(len(y)) % folds == k
        train = [x for x, h in zip(rows, held, strict=True) if not h]
        if len(np.unique(y[~held])) == 2:
            weight = dual_coordinate_descent(train, y[~held], log_count_ratio(train, y[~held], bits))
            margin[held] = _margins([x for x, h in zip(rows, held, strict=True) if h], weight)
    weight = dual_coordinate_descent(rows, y, log_count_ratio(rows, y, bits))
    a, b = sigmoid_fit(margin, y)
    return {"weight": weight.astype(np.float32), "a": a, "b": b}


def _score(shared, bits: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in T.chunks(batches, "_text", _CHUNK):
            if "constant" in model:
                p = np.full(batch.num_rows, model["constant"])
            else:
                row, feature = indicators(*T.utf8(batch.column("_text")), bits)
                total = np.bincount(row, model["weight"][feature], minlength=batch.num_rows)
                n = np.maximum(1, np.bincount(row, minlength=batch.num_rows))
                p = 1 / (1 + np.exp(-np.clip(model["a"] * total / np.sqrt(n) + model["b"], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("held_out"), pa.array(p)], ["doc_id", "held_out", "score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out (crc32 of the id as text modulo 4 is 2), score (0 to 1, higher: label 1 likelier), predicted (score >= cut).

    Fitted on at most `sample_rows` labelled rows that aren't held out (see labelled_sample); every whole text is scored, by its
    text alone. Null texts score as empty ones; null ids give held_out null; repeated rows give a row each; an empty table
    gives none; without labels of both classes the score is constant (that class, or 0.5). Other columns aren't read.
    """
    model = fit(*labelled_sample(docs, labels, label_col, 4, 2, id_col, text_col, sample_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), (fold_of(id_col, 4) == 2).alias("held_out"))
    scored = rows.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), BITS), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))
