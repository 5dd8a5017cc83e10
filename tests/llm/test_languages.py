import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import awkward, documents

from panelyard.llm import languages as L

SOUNDS = {"en": "the ing ha er st wh", "fr": "eau ç é oi qu ez", "de": "sch ung ü ß ich ein", "es": "ción ñ ado ue ll ar", "pl": "cz sz ł ą rz ow", "it": "zione gli ch ella etto ia", "tr": "lar ş ğ ı yor ki"}
SMALL = L.Codes(rows=300, bits=10, steps=80)


def corpus(names, count=40, seed=2):
    rng = random.Random(seed)
    out = []
    for k, name in enumerate(names):
        for i in range(count):
            text = " ".join("".join(rng.choices(SOUNDS[name].split(), k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60)))
            out.append((k * count + i, text, name, "s"))
    return out


@pytest.mark.parametrize("names", [["en", "fr", "de", "es"], list(SOUNDS), ["en", "fr"]])
def test_held_out_accuracy(spark, names):
    rows = corpus(names)
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in L.identify(docs, L.fit(docs, SMALL)).collect()}
    held = [(d, lang) for d, _, lang, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert sum(got[d].lang_pred == lang for d, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_codewords_are_far_apart():
    for count in (2, 3, 4, 6, 7, 30):
        codes = L.codewords(count)
        apart = (codes.shape[1] - codes @ codes.T) / 2 + 99 * np.eye(count)
        assert (np.abs(codes.sum(axis=0)) < count).all() and apart.min() >= {2: 1, 3: 2, 4: 4, 6: 16}.get(count, 4)


def test_decoding_corrects_a_wrong_bit_and_ties_go_to_the_first():
    codes = L.codewords(4)
    margins = codes * 3.0
    margins[2, 1] *= -1
    best, first, second = L.decode(margins, codes, np.ones(codes.shape[1]))
    assert best.tolist() == [0, 1, 2, 3] and (first > second).all()
    best, first, second = L.decode(np.zeros((1, codes.shape[1])), codes, np.ones(codes.shape[1]))
    assert best[0] == 0 and first[0] == pytest.approx(0.25) == second[0]


def test_awkward_rows(spark):
    rows = awkward() + [(2000, "123 --- !!", "en", "s"), (2001, None, "fr", "s")]
    docs = documents(spark, rows)
    got = L.identify(docs, L.fit(documents(spark, corpus(["en", "fr"])), SMALL)).collect()
    assert len(got) == len(rows)
    no_letter = sum(1 for _, t, _, _ in rows if not any(c.isalpha() for c in t or ""))
    assert sum(r.lang_pred == "und" and r.score == 0 for r in got) == no_letter
    for learned in (L.fit(documents(spark, []), SMALL), L.fit(documents(spark, [(d, t, None, s) for d, t, _, s in rows]), SMALL)):
        assert {(r.lang_pred, r.score) for r in L.identify(docs, learned).collect()} == {("und", 0.0)}
    one = L.fit(documents(spark, corpus(["de"])), SMALL)
    assert {r.lang_pred for r in L.identify(docs, one).collect()} == {"und", "de"}
    assert L.identify(documents(spark, []), one).count() == 0


def plain_grams(text, bits):
    """Shares of character n-grams, counted one at a time."""
    low = text.lower().encode()
    signs = [b if (97 <= b <= 122 or b >= 128) else 32 for b in low]
    counts = {}
    for n in (2, 3, 4):
        for k in range(len(signs) - n + 1):
            gram = signs[k : k + n]
            if any(b != 32 for b in gram):
                counts[n, tuple(gram)] = counts.get((n, tuple(gram)), 0) + 1
    return counts


def test_gram_counts_equal_a_plain_count():
    texts = ["Aba aba", "", "123 !!", "ünï ñandú", "x", "Ab-ab  ab"]
    got = list(L.gram_counts(pa.array(texts), 16))
    for text, line in zip(texts, got, strict=True):
        want = plain_grams(text, 16)
        total = sum(want.values())
        assert (line**2).sum() == pytest.approx(1 if total else 0, abs=1e-5)
        shares = sorted(v / total for v in want.values()) if total else []
        assert sorted((line[line > 0] ** 2).tolist()) == pytest.approx(shares, abs=1e-5)


def test_decoding_equals_weighted_loss_in_plain_sums():
    rng = np.random.default_rng(4)
    codes, margins, weights = L.codewords(7), rng.normal(size=(2100, L.codewords(7).shape[1])), rng.uniform(0.5, 1, L.codewords(7).shape[1])
    best, first, second = L.decode(margins, codes, weights)
    for r in (0, 5, 1023, 1024, 2099):
        loss = [sum(w * math.log1p(math.exp(-m * c)) for m, c, w in zip(margins[r], code, weights)) for code in codes]
        share = sorted(math.exp(-v) / sum(math.exp(-u) for u in loss) for v in loss)
        assert best[r] == int(np.argmin(loss)) and first[r] == pytest.approx(share[-1]) and second[r] == pytest.approx(share[-2])


def test_training_lowers_the_loss_of_every_bit():
    rng = np.random.default_rng(6)
    x = rng.random((80, 32)).astype(np.float32)
    signs = np.where(x[:, :3] > 0.5, 1, -1).astype(np.float32)
    p = L.Codes(bits=5, steps=400)
    w, right = L.train(x, signs, p)
    z = np.c_[x, np.ones(80)] @ w
    assert np.log1p(np.exp(-signs * z)).mean() < 0.35 and (right == (z * signs > 0).mean(axis=0)).all() and (right > 0.9).all()


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = []
    for k in range(300):
        sounds = [a + b + letters[k % 26] for a, b in zip(rng.sample(letters, 5), rng.sample(letters, 5))]
        rows += [(k * 6 + i, " ".join("".join(rng.choices(sounds, k=2)) for _ in range(40)), f"l{k:03}", "s") for i in range(6)]
    model = L.fit(documents(spark, rows), L.Codes(rows=100, least=4, bits=10, steps=30))
    learned = {lang for d, _, lang, _ in rows if zlib.crc32(str(d).encode()) % 5}
    assert set(model.languages) == learned and len(learned) > 256
    got = L.identify(documents(spark, rows[:60]), model)
    assert got.count() == 60
