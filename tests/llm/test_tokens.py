import zlib

import numpy as np
import pytest

from quarry.llm import tokens as K
from quarry.llm.packing import best_fit_decreasing, fill_bins, lower_bound, pack_documents
from quarry.llm.queries import tokenizer_path
from quarry.llm.tokens import token_counts


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, rows, name):
    path = tokenizer_path(name)
    t = K.tokenizer(path)
    size = (lambda x: len(t.encode(x))) if name.endswith(".model") else (lambda x: len(t.encode(x, add_special_tokens=False).ids))
    want = [(i, len((x or "").encode()), size(x or ""), size(x or "") > 1024) for i, x in rows]
    assert sorted(map(tuple, token_counts(docs, path).collect()), key=str) == sorted(want, key=str)


def test_cut_texts_have_the_same_tokens(monkeypatch):
    path = tokenizer_path()
    t = K.tokenizer(path)
    text = "hello <|endoftext|> it's  \n\n x\t\ty 12 34" * 40 + "z" * 3000 + " é中文 end\n\n\n" * 30
    cut = K.pieces(text, 100)
    assert len(cut) > 10 and "".join(cut) == text
    assert sum((t.encode(x, add_special_tokens=False).ids for x in cut), []) == t.encode(text, add_special_tokens=False).ids


def test_fast_ids_equal_the_library():
    path = tokenizer_path()
    slow, fast = K.tokenizer(path), K.id_encoder(path)
    held = [f"a{chr(c)}b 1{chr(c)}{chr(c)}2 {chr(c)} .{chr(c)}'s" for c in [*range(0, 0x600), *range(0x1F00, 0x2100), 0x3000, 0x4E2D, 0x1F600]] + ["", "<|endoftext|>x <|endoftext|>", "it's  \n\n we'll " * 50]
    for text in held:
        assert fast(text).tolist() == slow.encode(text, add_special_tokens=False).ids, repr(text)


def test_bound_and_fit():
    rng = np.random.default_rng(1)
    for sizes in (rng.integers(1, 101, 500), np.full(30, 51), np.array([34] * 9), rng.integers(30, 60, 200)):
        sizes = -np.sort(-sizes)
        for pack in (best_fit_decreasing, fill_bins):
            bins, offsets, free = pack(sizes, 100)
            for b in range(len(free)):
                own = np.argsort(offsets[bins == b])
                assert (offsets[bins == b][own] == np.cumsum(sizes[bins == b][own]) - sizes[bins == b][own]).all()
                assert sizes[bins == b].sum() == 100 - free[b] and free[b] >= 0
            assert lower_bound(np.bincount(sizes, minlength=101)) <= len(free) <= 1.25 * lower_bound(np.bincount(sizes, minlength=101)) + 1
    assert lower_bound(np.bincount(np.full(30, 51), minlength=101)) == 30
    assert lower_bound(np.bincount(np.full(9, 34), minlength=101)) == 5


@pytest.mark.parametrize("part_rows", [65_536, 40])
def test_packing_round_trip(docs, rows, part_rows):
    path = tokenizer_path()
    t = K.tokenizer(path)
    got = pack_documents(docs.where("doc_id IS NULL OR doc_id <> 126"), path, part_rows=part_rows).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    for i, text in rows:
        if i == 126:  # the repeated row
            continue
        ids, at = [*t.encode(text or "", add_special_tokens=False).ids, 2], 0
        for k, r in enumerate(sorted(pieces[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 1024 or k == 0)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    bound = lower_bound(np.bincount([r.length for r in got], minlength=1025))
    assert bound <= len(sequences) <= bound + 3


def test_repeated_and_empty(docs, empty):
    assert pack_documents(docs.where("doc_id = 126"), tokenizer_path()).where("piece = 0").count() == 2
    assert pack_documents(empty, tokenizer_path()).count() == token_counts(empty, tokenizer_path()).count() == 0
