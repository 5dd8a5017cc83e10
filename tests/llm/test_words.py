import random
import re

import numpy as np
import pyarrow as pa
from helpers_llm import awkward

from panelyard.llm import words as W


def test_words_are_runs_between_ascii_spaces_and_hash_by_value():
    texts = [t for _, t, _, _ in awkward()]
    hashes, bounds = W.word_hashes(pa.array(texts))
    seen: dict[str, int] = {}
    for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
        found = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert len(found) == b - a
        for word, value in zip(found, hashes[a:b].tolist(), strict=True):
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)


def test_a_long_text_hashes_like_its_words_alone(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abc", k=5)) for _ in range(4000))
    whole, _ = W.word_hashes(pa.array([text]))
    monkeypatch.setattr(W, "SLICE_BYTES", 100)
    pieces, _ = W.word_hashes(pa.array([text]))
    assert (whole == pieces).all()


def test_ngrams_stay_inside_rows():
    hashes, bounds = W.word_hashes(pa.array(["a b c d", "", None, "a b", "b c d e f"]))
    grams, cuts = W.ngrams(hashes, bounds, 3, short=True)
    assert np.diff(cuts).tolist() == [2, 0, 0, 1, 3]
    assert grams[1] == grams[3]
    plain, cuts = W.ngrams(hashes, bounds, 3)
    assert np.diff(cuts).tolist() == [2, 0, 0, 0, 3] and plain.tolist() == [*grams[:2].tolist(), *grams[3:].tolist()]


def test_slices_cover_all_rows():
    texts = pa.array(["x" * n for n in (5, 0, 30, 1, 1, 1)])
    assert list(W.slices(texts, 10)) == [(0, 2), (2, 3), (3, 6)]
    assert list(W.slices(texts.slice(2), 10)) == [(0, 1), (1, 4)]
