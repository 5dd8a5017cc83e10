import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers_llm import awkward, documents, sentence

from panelyard.llm import quality as Q

SMALL = Q.Ftrl(rows=400, shards=3, bits=14)


def corpus(count=400):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(count):
        good = i % 4 != 0
        text = sentence(rng, rng.randint(20, 60))
        if not good:
            text = " ".join(w + rng.choice(["***", "$$", "&&&"]) for w in text.split()) if i % 8 else " ".join([text.split()[0]] * 40)
        rows.append((i, text, "en", "s"))
        labels.append((i, int(good), 0))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs = documents(spark, rows)
    got = {r._doc: r._score for r in Q.score(docs, Q.fit(docs, label_table(spark, labels), SMALL), whole=False).collect()}
    held = [(i, y) for i, y, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and sum((got[i] >= 0.3) == bool(y) for i, y in held) >= 0.95 * len(held)


def test_held_out_labels_do_not_matter(spark):
    rows, labels = corpus(120)
    docs = documents(spark, rows)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    assert (Q.fit(docs, label_table(spark, labels), SMALL) == Q.fit(docs, label_table(spark, turned), SMALL)).all()


def test_scores_are_sparse_dot_products(spark):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1 << 14) + 1)
    rows = awkward()
    got = Q.score(documents(spark, rows), weights, whole=False).collect()
    texts = [t or "" for _, t, _, _ in rows]
    want = [1 / (1 + np.exp(-(weights[at] @ x))) for at, x in Q.rows_of(pa.array(texts), 14)]
    assert sorted(r._score for r in got) == pytest.approx(sorted(want))
    assert len(got) == len(rows)


def test_shapes_shrink_letters_and_mark_repeats():
    kinds = Q.features(pa.array(["Abc abcd ab12!! ab12!!", "Xyzz a bb7!! b8!!"]), 18)
    shapes, cuts = kinds[2]
    first, second = shapes[cuts[0] : cuts[1]], shapes[cuts[1] : cuts[2]]
    assert (first[:3] == second[:3]).all() and first[3] != second[3]


def test_without_labels_or_documents(spark):
    docs = documents(spark, awkward())
    none = label_table(spark, [])
    assert {r._score for r in Q.score(docs, Q.fit(docs, none, SMALL), whole=False).collect()} == {0.5}
    kept = Q.good_documents(docs, none, SMALL)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    empty = documents(spark, [])
    assert Q.good_documents(empty, label_table(spark, [(1, 1, 0), (None, 1, 0), (2, None, 0)]), SMALL).count() == 0


def plain_train(rows, labels, p):
    """The same updates, one coordinate at a time, on dictionaries."""
    z, n = {}, {}

    def weight(f):
        pull = z.get(f, 0.0)
        if abs(pull) <= p.l1:
            return 0.0
        return -(pull - math.copysign(p.l1, pull)) / ((p.beta + math.sqrt(n.get(f, 0.0))) / p.alpha + p.l2)

    for epoch in range(p.epochs):
        for r in np.random.default_rng(epoch).permutation(len(rows)):
            found = dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True))
            w = {f: weight(f) for f in found}
            error = 1 / (1 + math.exp(-sum(w[f] * x for f, x in found.items()))) - labels[r]
            for f, x in found.items():
                before, g = n.get(f, 0.0), error * x
                n[f] = before + g * g
                z[f] = z.get(f, 0.0) + g - (math.sqrt(n[f]) - math.sqrt(before)) / p.alpha * w[f]
    return {f: weight(f) for f in z}


def test_training_equals_plain_updates():
    rows, labels = corpus(40)
    p = Q.Ftrl(bits=12, epochs=3, l1=1e-3)
    texts, y = pa.array([t for _, t, _, _ in rows] + ["", None]), np.array([q for _, q, _ in labels] + [1, 0])
    got = Q.train(texts, y, p)
    want = plain_train(list(Q.rows_of(texts, p.bits)), y, p)
    assert set(np.flatnonzero(got)) <= set(want)
    for f, w in want.items():
        assert got[f] == pytest.approx(w, abs=1e-9)


def test_features_are_shares_of_words_and_pairs():
    texts = ["a b a", "Tall x1 tall", "", "one"]
    for text, (_, x) in zip(texts, Q.rows_of(pa.array(texts), 20), strict=True):
        kinds = (len(text.split()) > 0) * 2 + (len(text.split()) > 1) * 2
        assert x.sum() == pytest.approx(1 + kinds)
    (at, x), (same, y) = Q.rows_of(pa.array(["a b a b", "a b a b a b a b"]), 20)
    assert len(at) == len(same)


def test_a_repeated_id_teaches_one_text_per_label(spark):
    rows, labels = corpus(60)
    extra = [(1, "zz " + rows[1][1], "en", "s")] * 30
    docs = documents(spark, rows + extra)
    one = Q.fit(documents(spark, rows), label_table(spark, labels), SMALL)
    assert (one == Q.fit(docs, label_table(spark, labels + labels), SMALL)).all()
