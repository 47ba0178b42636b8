"""Tokens of whole texts by a public tokenizer file: lengths, and ids for packing.

Texts are encoded in Arrow functions, in batches of about equal bytes. A text longer than a batch is cut where no token
can cross: before a white space character that follows another kind of character. The pre-tokenizer never joins the
two, so the pieces' tokens are the text's tokens. A text without such a place is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text handed to the tokenizer at once.
BATCH_BYTES = 1 << 18
_BOUNDARY = re.compile(r"(?<=\S)[ \n]")


def pieces(text: str, limit: int) -> list[str]:
    """The text cut at safe boundaries into pieces of about `limit` characters; joined they are the text."""
    if len(text) <= limit:
        return [text]
    out, at = [], 0
    while len(text) - at > limit:
        cut = _BOUNDARY.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    out.append(text[at:])
    return out


_held: dict[tuple[str, str], object] = {}


def tokenizer(path: str):
    """The tokenizer of a .json file (tokenizers) or .model file (sentencepiece), loaded once in each process."""
    if ("t", path) not in _held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _held["t", path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _held["t", path] = Tokenizer.from_file(path)
    return _held["t", path]


def _lengths(path: str) -> Callable[[list[str]], list[int]]:
    t = tokenizer(path)
    if path.endswith(".model"):
        return lambda texts: [len(x) for x in t.encode(texts, num_threads=1)]
    return lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]


def balanced(texts: list[str | None], cut: bool) -> Iterator[tuple[list[str], list[int]]]:
    """Batches of pieces with about BATCH_BYTES bytes each, and the row of each piece. cut: long texts may be cut."""
    held, owner, size = [], [], 0
    for row, text in enumerate(texts):
        for piece in pieces(text, BATCH_BYTES) if text and cut else [text or ""]:
            held.append(piece)
            owner.append(row)
            size += len(piece.encode(errors="surrogatepass"))
            if size >= BATCH_BYTES:
                yield held, owner
                held, owner, size = [], [], 0
    if held:
        yield held, owner


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(path)
        # only byte-level BPE is cut: its pre-tokenizer never joins white space to what stands before it
        cut = not path.endswith(".model") and byte_level(path)
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            for texts, owner in balanced(batch.column("_text").to_pylist(), cut):
                np.add.at(n, owner, lengths(texts))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return count


def byte_level(path: str) -> bool:
    """Whether a tokenizers file cuts texts by the usual byte-level pattern and changes nothing before that."""
    if ("b", path) not in _held:
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind = made.get("pre_tokenizer") or {}
        plain = kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        _held["b", path] = bool(plain and made.get("normalizer") is None and not any(x["lstrip"] or x["rstrip"] or " " in x["content"] or "\n" in x["content"] for x in made["added_tokens"]))
    return bool(_held["b", path])


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    path: a tokenizer file that every worker can read. No special tokens are added; special strings inside texts are
    handled as the library does by default. Null and empty texts count 0. Repeated rows give a row each, null ids stay null,
    an empty table gives no rows; other columns aren't read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)).cast("long").alias("_bytes"))
    return rows.mapInArrow(_count(path), "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


#: The pre-tokenizer's published pattern for byte-level BPE (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of characters below this are encoded by the faster library; above it the libraries' tables of letters may differ.
SAME_BELOW = "԰"
_OTHER = re.compile("[^\x00-ԯ‐-‧]")


def _byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ids_are_ranks(model: dict) -> bool:
    """Whether the ids of merged words rise in the order of the merges, each made by one merge of two words."""
    vocab = model["vocab"]
    pairs = [tuple(x.split(" ", 1)) if isinstance(x, str) else tuple(x) for x in model["merges"]]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    return all(x < y for x, y in zip([-1, *ids], ids, strict=False)) and not any(model.get(x) for x in ("byte_fallback", "dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))


def id_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a text as `tokenizers` gives them for the file at `path`, without added special tokens.

    Where the ids of a byte-level BPE file are its merge ranks, which is checked as the file is read, texts of common characters go through tiktoken with the ranks
    from that file (some four times as fast, tested equal); all other texts and files go through tokenizers itself.
    """
    slow = tokenizer(path)
    if ("f", path) not in _held:
        _held["f", path] = None
        if byte_level(path):
            import tiktoken

            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            names, special = _byte_names(), {x["content"]: x["id"] for x in made["added_tokens"]}
            ranks = {bytes(names[c] for c in word): i for word, i in made["model"]["vocab"].items() if word not in special}
            if ids_are_ranks(made["model"]):
                _held["f", path] = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    fast = _held["f", path]
    special = set(fast.special_tokens_set) if fast is not None else set()

    def encode(text: str) -> np.ndarray:
        if fast is None or _OTHER.search(text) is not None:
            return np.array(slow.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        if any(x in text for x in special):
            return np.array(fast.encode(text, allowed_special="all"), np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


def crc_of_ids(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
