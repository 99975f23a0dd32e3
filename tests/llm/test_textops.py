"""Byte primitives against plain Python."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from gridproof.llm import textops

TEXTS = st.lists(st.text(alphabet="ab \n\té \x1c漢", max_size=30), max_size=6)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_bytes_split(texts):
    data, offsets = textops.column_bytes(pa.array(texts, pa.string()))
    starts, ends, doc = textops.spans(data, offsets)
    got = [[] for _ in texts]
    for s, e, d in zip(starts, ends, doc, strict=True):
        got[d].append(data[s:e].tobytes())
    assert got == [t.encode().split() for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_shingle_sets(texts):
    data, offsets = textops.column_bytes(pa.array(texts, pa.large_string()))
    grams, at = textops.text_shingles(data, offsets, 3)
    for k, t in enumerate(texts):
        w = t.encode().lower().split()
        expected = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
        own = grams[at[k] : at[k + 1]]
        assert len(set(own.tolist())) == len(own) == len(expected)


def test_hash_depends_on_content_only():
    data = np.frombuffer(b"abcXabc", np.uint8)
    prefix = textops.prefix_hash(data)
    h = textops.range_hash(prefix, np.array([0, 4, 1]), np.array([3, 7, 4]))
    assert h[0] == h[1] != h[2]


def test_nulls_and_slices():
    data, offsets = textops.column_bytes(pa.array(["ab", None, "c"]).slice(1))
    assert data.tobytes() == b"c" and offsets.tolist() == [0, 0, 1]
    assert list(textops.slices(np.array([0, 5, 5, 9, 30, 31]), 10)) == [(0, 3), (3, 4), (4, 5)]
    assert list(textops.slices(np.array([0]))) == []
