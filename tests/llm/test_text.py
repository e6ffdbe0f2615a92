import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from faultline.llm import _text
from faultline.llm._text import ALNUM_WORDS, SPACE_WORDS, chunks, gram_hash, words_of

LOWER = {c: c + 32 for c in range(65, 91)}
texts = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbB zZ09\t\n-_é日\U0001f600"), max_size=40)), max_size=12)


@settings(max_examples=150, deadline=None)
@given(texts, st.booleans(), st.integers(1, 60))
def test_words_as_by_pattern(rows, spaces, limit):
    """Words, their rows and their hashes, however the rows are cut into chunks."""
    table, pattern = (SPACE_WORDS, "[^\x20\x09-\x0d]+") if spaces else (ALNUM_WORDS, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    column = pa.array(rows, pa.string())
    expected = [re.findall(pattern, (t or "").translate(LOWER)) for t in rows]
    old, _text.CHUNK_BYTES = _text.CHUNK_BYTES, limit
    try:
        found, hashes = [], {}
        for low, high, w in words_of(column, table):
            for r in range(high - low):
                a, b = int(w.bounds[r]), int(w.bounds[r + 1])
                own = [w.text(i, i + 1) for i in range(a, b)]
                found.append(own)
                for word, h in zip(own, w.hash[a:b].tolist()):
                    assert hashes.setdefault(word, h) == h
            assert w.gram_mask(2).sum() == sum(max(0, len(x) - 1) for x in found[low:high])
    finally:
        _text.CHUNK_BYTES = old
    assert found == expected and len(set(hashes.values())) == len(hashes)


def test_slices_and_grams():
    column = pa.array(["x", "one two three", None, "two three four"], pa.string()).slice(1)
    ((low, high, w),) = words_of(column, SPACE_WORDS)
    assert (low, high) == (0, 3) and int(w.grams(2)[1]) == gram_hash(["two", "three"]) == int(w.grams(2)[3])
    assert w.gram_mask(2).tolist() == [True, True, False, True, True]


def test_chunks_cover_rows():
    offsets = np.array([0, 5, 5, 30, 31, 31])
    assert [*chunks(offsets, 6)] == [(0, 2), (2, 3), (3, 5)] and [*chunks(np.array([0]))] == []
