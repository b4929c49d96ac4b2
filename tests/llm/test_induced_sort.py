import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm.induced_sort import repeated, suffix_array


def brute(text):
    return sorted(range(len(text)), key=lambda i: list(text[i:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array_matches_sorting(values):
    assert suffix_array(np.array(values, np.int64)).tolist() == brute(values)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab", max_size=12), st.integers(1, 40))
def test_suffix_array_of_powers(part, times):
    text = np.frombuffer((part * times).encode(), np.uint8)
    assert suffix_array(text).tolist() == brute(text.tolist())


def test_large_alphabet():
    values = np.random.default_rng(1).integers(0, 3000, 5000)
    assert suffix_array(values).tolist() == brute(values.tolist())


@pytest.mark.parametrize("length", [1, 5, 20, 50])
def test_repeated_matches_counting(length):
    rng = np.random.default_rng(2)
    for _ in range(20):
        base = rng.integers(0, 4, 120)
        text = np.concatenate([base, rng.integers(0, 4, 60), base[10:90], rng.integers(0, 4, 40), base[5:70]]).astype(np.uint8)
        raw, n = text.tobytes(), len(text)
        grams = [raw[i : i + length] for i in range(n - length + 1)]
        want = [grams.count(g) > 1 for g in grams] + [False] * (length - 1)
        assert repeated(text, length).tolist() == want
