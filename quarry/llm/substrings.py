"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark; repeats merge into removal spans."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm import textops as T
from quarry.llm.frames import Tables
from quarry.llm.repeats import earlier_spans, keyed, with_spans

WINDOW = 20


def _word_windows(width: int):
    def find(data: np.ndarray, offsets: np.ndarray):
        words = T.Units(data, offsets, T.SPACE_WORDS)
        hashes = words.hashes()
        keys, at = T.windows(hashes, words.base, width)
        return words, keys, at, T.windows(T.salted(hashes, 1), words.base, width)[0]

    return find


def removal_spans(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The maximal runs of words to remove: _id, _row (a hash of id and text) and spans (int32 pairs begin, end).

    Words are the runs of bytes between ASCII white space, unchanged. A window is `window` consecutive words of one text;
    all words of a window go whose sequence also starts earlier (smaller id, or same id and earlier start). Windows are
    judged on the input. Texts of fewer words, null and empty texts have no window. Null ids come after all
    others; rows whose id repeats count as one place: equal windows at an equal place remove nothing from each other.
    """
    with Tables(docs.sparkSession) as tables:
        return tables.keep(earlier_spans(keyed(docs, id_col, text_col), _word_windows(window), window, tables))


def _kept(with_text: bool):
    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, digest, text = [], [], [], []
            for value, spans in zip(batch.column("_text"), batch.column("spans"), strict=True):
                words = (value.as_py() or "").encode().split()
                n.append(len(words))
                if spans.is_valid:
                    pairs = np.frombuffer(spans.as_py(), np.int32).tolist()
                    left, at = [], 0
                    for begin, end in zip(pairs[::2], pairs[1::2], strict=True):
                        left += words[at:begin]
                        at = end
                    words = left + words[at:]
                gone.append(n[-1] - len(words))
                joined = b" ".join(words)
                digest.append(hashlib.sha256(joined).hexdigest())
                if with_text:
                    text.append(joined)
            columns = [batch.column("_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())]
            if with_text:
                columns.append(pa.array(text, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "text"][: len(columns)])

    return kept


def dedup_substrings(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and, unless with_text is false, text: the kept words joined by one space.

    See removal_spans for what goes. Null and empty texts give 0 words and the digest of nothing; an empty table gives none.
    Other columns of the input are neither read nor returned.
    """
    spans = removal_spans(docs, window, id_col, text_col)
    return with_spans(keyed(docs, id_col, text_col), spans).mapInArrow(_kept(with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text)
