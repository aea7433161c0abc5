"""Vectorised words and shingles against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shelfmetrics.llm import words

TEXTS = st.lists(st.one_of(st.none(), st.text("abAB é\n\t\x0b\x1c.,1", max_size=40)), max_size=12)


def expected(text: str | None) -> list[bytes]:
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in word) for word in found]


@settings(max_examples=60, deadline=None)
@given(TEXTS, st.integers(1, 30))
def test_words_and_shingles(texts, most_bytes):
    wanted, names, shingles = [], {}, {}
    for text in texts:
        wanted.append(expected(text))
    rows = 0
    for part in words.slices(pa.array(texts, pa.string()), most_bytes):
        hashes, firsts = words.word_hashes(part)
        runs, before = words.shingle_hashes(hashes, firsts, 3)
        for i in range(part.size):
            own = wanted[part.first + i]
            found = hashes[firsts[i] : firsts[i + 1]].tolist()
            assert len(found) == len(own)
            for word, number in zip(own, found):
                assert names.setdefault(word, number) == number
            spans = [tuple(own[k : k + 3]) for k in range(max(len(own) - 2, min(len(own), 1)))]
            for span, number in zip(spans, runs[before[i] : before[i + 1]].tolist(), strict=True):
                assert shingles.setdefault(span, number) == number
        rows += part.size
    assert rows == len(texts)
    assert len(set(names.values())) == len(names) and len(set(shingles.values())) == len(shingles)


def test_distinct_values_per_document():
    values = np.array([3, 1, 3, 2, 2], np.uint64)
    found, begins = words.distinct_sorted(values, np.array([0, 3, 3, 5]))
    assert found.tolist() == [1, 3, 2] and begins.tolist() == [0, 2, 2, 3]


def test_plain_words_part_at_punctuation():
    part = next(words.slices(pa.array(["It's 5-fold: ÉTÉ_2"])))
    starts, ends = words.word_bounds(part, words.NO_WORD)
    found = [part.data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert found == ["It", "s", "5", "fold", "ÉTÉ", "2"]
