import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import textops as T

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t\x0b中", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_windows(texts):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    units = T.Units(data, offsets, T.SPACE_WORDS)
    want = [(t or "").encode().split() for t in texts]
    got = [bytes(data[a:b]) for a, b in zip(units.start, units.end, strict=True)]
    assert got == [w for x in want for w in x] and units.count.tolist() == [len(x) for x in want]
    h = units.hashes()
    assert len(set(h.tolist())) == len(set(got))
    keys, at = T.windows(h, units.base, 3)
    runs = [(tuple(x[i : i + 3]), r) for r, x in enumerate(want) for i in range(len(x) - 2)]
    assert len(keys) == len(runs) and units.row[at].tolist() == [r for _, r in runs]
    assert len(set(keys.tolist())) == len({k for k, _ in runs})


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_lines(texts):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    lines = T.trimmed_lines(data, offsets)
    blank = " \t\n\r\x0b\x0c"
    want = [x.strip(blank).encode() for t in texts for x in (t or "").split("\n") if x.strip(blank)]
    assert [bytes(data[a:b]) for a, b in zip(lines.start, lines.end, strict=True)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=20))
def test_packing_of_numbers(values):
    x = np.array(sorted(values), np.int64)
    assert T.undeltas(T.deltas(x, np.uint32), np.uint32).tolist() == x.tolist()
    assert T.unplanes(T.planes(x.astype(np.uint32)), np.uint32).tolist() == x.tolist()


def test_chunks_and_slices():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c" * 10])], ["t"])
    assert [b.num_rows for b in T.chunks(iter([batch]), "t", 20)] == [2, 1, 2]
    data, offsets = T.utf8(batch.slice(2).column("t"))
    assert bytes(data) == b"b" * 50 + b"c" * 10 and offsets.tolist() == [0, 50, 50, 60]


def test_hashing_in_stretches(monkeypatch):
    data, offsets = T.utf8(pa.array([" ".join(f"w{i}" for i in range(300)), "x" * 500 + " y"]))
    units = T.Units(data, offsets, T.SPACE_WORDS)
    whole = units.hashes()
    monkeypatch.setattr(T, "_HASH_BYTES", 50)
    assert (units.hashes() == whole).all()
