"""Word splitting and winnowing against plain loops."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import words as W
from tests.llm.helpers import words

texts = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 -_\néK", max_size=40)), max_size=12)


@given(texts, st.integers(1, 60))
@settings(max_examples=150, deadline=None)
def test_words_and_hashes_follow_the_word_class(rows, most):
    seen = {}
    for row, stop, found in W.chunks(pa.array(rows, type=pa.string()), most):
        hashes = found.hashes()
        for d in range(row, stop):
            own = hashes[found.first[d - row]:found.first[d - row + 1]]
            expected = words(rows[d])
            assert len(own) == len(expected)
            for word, h in zip(expected, own.tolist()):
                assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_prefix_hashes_join_words_of_one_stem():
    found = next(W.chunks(pa.array(["lostra lostrum los"])))[2]
    whole, stem = found.hashes(), found.hashes(5)
    assert len(set(whole.tolist())) == 3 and stem[0] == stem[1] != stem[2]


@given(st.lists(st.sampled_from("abcd"), min_size=10, max_size=60), st.integers(0, 50), st.integers(2, 10))
@settings(max_examples=100, deadline=None)
def test_winnowing_keeps_a_common_gram_of_every_shared_window(run, shift, n):
    k, w = (n + 1) // 2, n - (n + 1) // 2 + 1
    one, other = " ".join(run), " ".join(["x"] * (shift % 7) + run + ["y"])
    kept = []
    for text in (one, other):
        found = next(W.chunks(pa.array([text])))[2]
        at, h = W.winnow(found, found.hashes(), k, w)
        kept.append(set(zip(at.tolist(), h.tolist())))
    for i in range(len(run) - n + 1):
        inside = {(p, h) for p, h in kept[0] if i <= p <= i + n - k}
        assert any((p + shift % 7, h) in kept[1] for p, h in inside)


def test_window_minima_takes_the_leftmost():
    assert W.window_minima(np.array([3, 1, 1, 2, 0]), 3).tolist() == [1, 1, 4]
