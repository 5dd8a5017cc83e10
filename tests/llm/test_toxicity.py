import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import awkward, documents, sentence

from panelyard.llm import toxicity as T

SMALL = T.Instances(rows=500, bits=14)
INSULTS = ["scum", "moron", "loser"]


def corpus(count=500, seed=3):
    """Documents of several sentences; a toxic one has insults in one or two of them."""
    rng = random.Random(seed)
    rows, labels, planted = [], [], {}
    for i in range(count):
        parts = [sentence(rng, rng.randint(4, 12)) for _ in range(rng.randint(2, 9))]
        toxic = i % 4 == 0
        if toxic:
            planted[i] = set(rng.sample(range(len(parts)), rng.randint(1, 2)))
            for k in planted[i]:
                words = parts[k].split()
                words.insert(rng.randrange(len(words)), rng.choice(INSULTS))
                parts[k] = " ".join(words)
        rows.append((i, ". ".join(parts), "en", "s"))
        labels.append((i, 1, int(toxic)))
    return rows, labels, planted


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def plain_sentences(text, most=64):
    """Words per sentence, read from the rule of the docstring."""
    out = []
    for part in re.split(rb"[.!?\n]", text.encode()):
        words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", part)]
        out += [words[k : k + most] for k in range(0, len(words), most)]
    return out


def test_sentences_hold_the_features_of_their_words():
    texts = [t or "" for _, t, _, _ in awkward()] + ["A b. C!d?\n\n. e", "a" * 9 + " " + "b c " * 100, "É ß. x"]
    got = T.sentences(pa.array(texts), 20, 64)
    want = [(r, s) for r, t in enumerate(texts) for s in plain_sentences(t)]
    assert got.row.tolist() == [r for r, _ in want]
    number = {}
    for k, (r, words) in enumerate(want):
        mine = set(got.numbers[got.owner == k].tolist())
        body = texts[r].encode()[got.first[k] : got.last[k]]
        assert [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", body)] == words
        keys = {("w", w) for w in words} | {("p", *p) for p in zip(words, words[1:])} | {("h", n, w[:n]) for n in T.HEADS for w in words if len(w) >= n}
        assert 0 < len(mine) <= len(keys)
        number.setdefault(frozenset(keys), mine)
        assert number[frozenset(keys)] == mine


def plain_train(texts, labels, p):
    """The same updates, one coordinate at a time, on dictionaries."""
    z, n = {}, {}
    bias = 1 << p.bits

    def weight(f):
        first = p.start if f == bias else 0.0
        pull = z.get(f, 0.0)
        if abs(pull) <= p.l1:
            return first
        return first - (pull - math.copysign(p.l1, pull)) / ((p.beta + math.sqrt(n.get(f, 0.0))) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        for r in np.random.default_rng(epoch).permutation(len(texts)):
            found = T.sentences(pa.array([texts[r]]), p.bits, p.most)
            bags = [found.numbers[found.owner == k].tolist() for k in range(len(found.row))]
            if not bags:
                continue
            w = {f: weight(f) for f in {bias, *(f for bag in bags for f in bag)}}
            own = [1 / (1 + math.exp(-(w[bias] + sum(w[f] for f in bag)))) for bag in bags]
            whole = 1 - math.prod(1 - q for q in own)
            gradient = dict.fromkeys(w, 0.0)
            for bag, q in zip(bags, own):
                pull = q if not labels[r] else -q * (1 - whole) / whole
                for f in [*bag, bias]:
                    gradient[f] += pull
            for f, g in gradient.items():
                before = n.get(f, 0.0)
                n[f] = before + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(before)) / p.alpha * (w[f] - (p.start if f == bias else 0.0))
    return {f: weight(f) for f in z}


def test_training_equals_plain_updates():
    rows, labels, _ = corpus(30)
    p = T.Instances(bits=12, epochs=3, l1=0.05)
    y = np.array([t for _, _, t in labels])
    got = T.train(pa.array([t for _, t, _, _ in rows] + [""]), np.append(y, 1), p)
    want = plain_train([t for _, t, _, _ in rows] + [""], np.append(y, 1), p)
    for f, w in want.items():
        assert got[f] == pytest.approx(w, abs=1e-6)
    assert set(np.flatnonzero(got)) <= set(want)


def test_held_out_documents_and_their_sentences(spark):
    rows, labels, planted = corpus()
    docs = documents(spark, rows)
    scored = T.score(docs, T.fit(docs, label_table(spark, labels), SMALL))
    got = {r._doc: r for r in scored.select("_doc", "_score", "_sentences").collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]._score >= 0.5) == (i in planted) for i in held) >= 0.97 * len(held)
    assert all(got[i]._sentences == len(plain_sentences(t)) for i, t, _, _ in rows)
    found = {}
    for r in T.offending_sentences(scored).collect():
        found.setdefault(r.doc_id, []).append(r)
        assert rows[r.doc_id][1].encode()[r.start : r.end].decode() == r.sentence and r.score >= 0.5
    hits = [any(w in s.sentence.split() for w in INSULTS) for i in held for s in found.get(i, [])]
    assert hits and sum(hits) >= 0.9 * len(hits)
    located = [len(found.get(i, [])) >= len(planted[i]) for i in held if i in planted]
    assert sum(located) >= 0.9 * len(located)
    assert all(a.score >= b.score for each in found.values() for a, b in zip(sorted(each, key=lambda r: r.rank), sorted(each, key=lambda r: r.rank)[1:]))


def test_score_is_the_noisy_or_of_the_sentences(spark):
    rows = awkward()
    weights = np.random.default_rng(5).normal(size=(1 << 12) + 1) / 4
    got = sorted(r._score for r in T.score(documents(spark, rows), weights, whole=False).collect())
    want = []
    for _, t, _, _ in rows:
        found = T.sentences(pa.array([t or ""]), 12, 64)
        z = [weights[-1] + sum(weights[f] for f in found.numbers[found.owner == k]) for k in range(len(found.row))]
        want.append(1 - math.prod(1 / (1 + math.exp(v)) for v in z))
    assert got == pytest.approx(sorted(want), abs=1e-9)


def test_held_out_labels_do_not_matter(spark):
    rows, labels, _ = corpus(120)
    docs = documents(spark, rows)
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert (T.fit(docs, label_table(spark, labels), SMALL) == T.fit(docs, label_table(spark, turned), SMALL)).all()


def test_the_sample_is_bounded_and_several_learners_agree(spark):
    rows, labels, planted = corpus()
    docs = documents(spark, rows)
    w = T.fit(docs, label_table(spark, labels + labels), T.Instances(rows=300, each=100, bits=14))
    got = {r._doc: r._score for r in T.score(docs, w, whole=False).collect()}
    assert sum((got[i] >= 0.5) == (i in planted) for i in got) >= 0.97 * len(got)


def test_awkward_rows(spark):
    rows = awkward()
    docs = documents(spark, rows)
    none = label_table(spark, [])
    assert T.fit(docs, none, SMALL) is None
    scored = T.score(docs, None)
    assert {r._score for r in scored.collect()} == {0.0} and scored.count() == len(rows)
    assert scored.select("_row.*").columns == docs.columns and T.offending_sentences(scored).count() == 0
    taught = T.fit(docs, label_table(spark, [(63, 1, 1), (65, 1, 0), (None, 1, 1), (1, 1, None), (2, 1, 0), (60, 1, 1), (61, 1, 1)]), SMALL)
    got = T.score(docs, taught).collect()
    assert len(got) == len(rows) and all(0 <= r._score <= 1 for r in got)
    assert {r._score for r in got if not (r._row.text or "").split()} == {0.0}
    empty = documents(spark, [])
    assert T.fit(empty, label_table(spark, [(1, 1, 1)]), SMALL) is None
    assert T.score(empty, taught).count() == 0
