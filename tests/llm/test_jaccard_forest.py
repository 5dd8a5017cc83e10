import random
from collections import Counter

import numpy as np
import pytest
from helpers_llm import awkward, documents, sentence

from panelyard.llm import jaccard_forest as J
from panelyard.llm.tables import components


def grams(text, n=5):
    words = (text or "").split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_force(rows, similarity=0.8):
    """Links per text and classes of documents, from all pairs of texts."""
    texts = list(dict.fromkeys(t or "" for _, t, _, _ in rows))
    copies = Counter(t or "" for _, t, _, _ in rows)
    sets = {t: grams(t) for t in texts}
    near = {t: [u for u in texts if u != t and sets[t] and len(sets[t] & sets[u]) >= similarity * len(sets[t] | sets[u])] for t in texts}
    root = {}
    for t in texts:
        if t not in root:
            todo = [t]
            while todo:
                u = todo.pop()
                if u not in root:
                    root[u] = t
                    todo += near[u]
    least = {}
    for d, t, _, _ in rows:
        if d is not None:
            r = root[t or ""]
            least[r] = min(least.get(r, d), d)
    return {t: (least.get(root[t]), copies[t] - 1 + sum(copies[u] for u in near[t])) for t in texts}


def check(spark, rows, forest=None):
    found = J.similar_texts(documents(spark, rows), forest).collect()
    want = brute_force(rows)
    expected = Counter((d, *want[t or ""]) for d, t, _, _ in rows)
    assert Counter((r.doc_id, r.class_id, r.links) for r in found) == expected


def test_awkward_rows_equal_brute_force(spark):
    check(spark, awkward())


def test_a_large_group_in_blocks_equals_brute_force(spark):
    rng = random.Random(3)
    base = sentence(rng, 60).split()
    rows = []
    for i in range(150):
        near = list(base)
        for _ in range(rng.randint(0, 3)):
            near[rng.randrange(len(near))] = f"w{rng.randrange(400)}"
        rows.append((i, " ".join(near), "en", "s"))
    check(spark, rows, J.Forest(block_texts=16))


def test_empty_table(spark):
    empty = documents(spark, [])
    assert J.similar_texts(empty).count() == 0 and J.one_per_class(empty).columns == empty.columns
    assert J.one_per_class(empty).count() == 0


def test_one_text_of_each_class_stays_whatever_the_ids(spark):
    rng = random.Random(21)
    base = sentence(rng, 60).split()
    near = [" ".join([*base[:k], f"w{k}", *base[k + 1 :]]) for k in (5, 20, 35)]
    rows = awkward() + [(None, t, "en", "s0") for t in near]
    rows += [(7, "an unrelated text under the id of another " + sentence(rng, 20), "en", "s0"), (None, sentence(rng, 30), "en", "s0")]
    kept = [r.text or "" for r in J.one_per_class(documents(spark, rows)).collect()]
    texts = list(dict.fromkeys(t or "" for _, t, _, _ in rows))
    sets = {t: grams(t) for t in texts}
    classes = {t: {t} for t in texts}
    for t in texts:
        for u in texts:
            if sets[t] and classes[t] is not classes[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u]):
                classes[t] |= classes[u]
                for v in classes[u]:
                    classes[v] = classes[t]
    want = {id(c): c for c in classes.values()}
    assert Counter(id(classes[t]) for t in kept) == Counter(want.keys())
    # of the documents with the smallest id of a class one stays
    for t in kept:
        ids = [(d is None, d or 0) for d, u, _, _ in rows if (u or "") in classes[t]]
        assert min(ids) in [(d is None, d or 0) for d, u, _, _ in rows if (u or "") == t]


def test_prefix_is_the_longest_that_reaches_the_recall():
    forest = J.Forest()
    length = forest.prefix()
    assert forest.recall_at(length) >= forest.recall > forest.recall_at(length + 1)
    with pytest.raises(ValueError):
        J.Forest(trees=1).prefix()


def test_overlaps_count_common_elements_across_a_split():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(9)]
    for split in (None, 4):
        i, j, common = J.overlaps(sets, split)
        got = dict(zip(zip(i.tolist(), j.tolist(), strict=True), common.tolist(), strict=True))
        pairs = [(a, b) for a in range(9) for b in range(a + 1, 9) if split is None or a < split <= b]
        assert got == {(a, b): n for a, b in pairs if (n := len(np.intersect1d(sets[a], sets[b])))}


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 130)] + [(200, 200), (301, 300), (300, 301)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(21)}, **{k: 100 for k in range(100, 130)}, 300: 300, 301: 300}
