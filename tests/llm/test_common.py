import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.llm import common as c


def test_words_are_those_of_the_pattern():
    texts = ["Hello, World! ça été", "", None, "abc", "def ghi", "“quoted” text—dash…end 日本、語", "x" * 10, "…", "naïve café's", "a b"]
    h, o = c.word_hashes(pa.array(texts))
    for i, t in enumerate(texts):
        assert list(h[o[i] : o[i + 1]]) == [c.hash_of(w) for w in c.WORD_RE.findall((t or "").lower())]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB9é -\n…、ü’", max_size=30), min_size=1, max_size=6))
def test_rows_are_hashed_alone(texts):
    h, o = c.word_hashes(pa.array(texts))
    for i, t in enumerate(texts):
        assert list(h[o[i] : o[i + 1]]) == [c.hash_of(w) for w in c.WORD_RE.findall(t.lower())]


def test_long_rows_and_slices():
    texts = pa.array(["w%d " % i * 200_000 for i in range(3)] + [None, "end"])
    h, o = c.word_hashes(texts)
    assert np.diff(o).tolist() == [200_000] * 3 + [0, 1]
    h2, o2 = c.word_hashes(texts.slice(1, 2))
    assert (h2 == h[o[1] : o[3]]).all() and np.diff(o2).tolist() == [200_000] * 2
    assert (c.word_bounds(texts) == o).all()


def test_grams_and_windows_agree_on_equality():
    h = np.array([1, 2, 3, 1, 2, 3, 4], dtype=np.uint64)
    g = c.grams(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4
    w = c.window_hashes(h, np.arange(5), 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 4
    keys, row, at = c.row_grams(h, np.array([0, 4, 7]), 3)
    assert row.tolist() == [0, 0, 1] and at.tolist() == [0, 1, 4]
