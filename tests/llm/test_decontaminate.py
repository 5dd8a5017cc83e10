import itertools
import random

import numpy as np
from helpers_llm import awkward, documents, sentence

from panelyard.llm import decontaminate as D


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, doc_id long")


def longest(agree, share):
    best = 0
    for a in range(len(agree)):
        for b in range(a + 1, len(agree) + 1):
            if agree[a] and agree[b - 1] and sum(agree[a:b]) >= share * (b - a) - 1e-9:
                best = max(best, b - a)
    return best


def test_stretch_equals_all_runs():
    rng = random.Random(2)
    for _ in range(300):
        agree = np.array([rng.random() < 0.7 for _ in range(rng.randint(0, 30))], float)
        a, b = D.best_stretch(agree, 0.75)
        assert b - a == longest(agree.tolist(), 0.75)


def test_planted_passages_are_found_and_clean_documents_stay(spark):
    rng = random.Random(4)
    bench = [(k, sentence(rng, 40), 1) for k in range(6)]
    rows = awkward()
    hit = {}
    for k, (item, text, _) in enumerate(bench):
        words = text.split()
        for place in range(3, 40, 9 - k):
            words[place] = "other"
        body = [sentence(rng, 50), " ".join(words).upper() if k == 2 else " ".join(words), sentence(rng, 30)]
        rows.append((900 + k, "\n".join(body[: 3 if k % 2 else 2]), "en", "s"))
        if 1 - 1 / (9 - k) > 0.75:
            hit[900 + k] = item
    rows.append((950, sentence(rng, 20) + " " + " ".join(bench[0][1].split()[5:25]), "en", "s"))
    rows.append((951, sentence(rng, 20) + " " + " ".join(bench[0][1].split()[5:13]) + " " + sentence(rng, 20), "en", "s"))
    docs = documents(spark, rows)
    found = D.overlaps(docs, items(spark, [*bench, (90, None, 1), (91, "", 1), (92, "too short", 1), (None, "no id but long enough to be " + sentence(rng, 20), 1)])).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    assert {(d, i) for d, i in hit.items()} | {(950, 0)} <= pairs and {d for d, _ in pairs} <= {*range(900, 906), 950}
    at = next(r for r in found if r.doc_id == 950)
    assert (at.doc_start, at.item_start, at.words, at.agreeing) == (20, 5, 20, 20)
    kept = D.clean_documents(docs, items(spark, bench))
    assert kept.columns == docs.columns and kept.count() == len(rows) - len({d for d, _ in pairs})


def test_masks_tolerate_a_substitution():
    seeds = D.Seeds()
    assert len({len(m) for m in seeds.masks}) == 1 and len({m.count("1") for m in seeds.masks}) == 1
    # every single position is ignored by some mask, so one substitution leaves a hit in place
    assert all(any(m[k] == "0" for m in seeds.masks) for k in range(1, seeds.span - 1))


def met(seeds, length, changed):
    """Whether some mask, somewhere inside the stretch, counts none of the changed words."""
    return any(not any(m[p - k] == "1" for p in changed if 0 <= p - k < r) for m, r in zip(seeds.masks, seeds.reach, strict=True) for k in range(length - r + 1))


def test_masks_meet_every_overlap_that_counts():
    seeds = D.Seeds()
    # shorter parts of 12 to 23 words hold one of these, and longer overlaps hold such a part
    for length in (12, 16, 20):
        assert all(met(seeds, length, changed) for changed in itertools.combinations(range(length), length // 4))
    rng = random.Random(11)
    for length in (13, 14, 15, 17, 18, 19, 21, 22, 23, 24, 40, 200):
        allowed = int(length * (1 - seeds.share))
        assert all(met(seeds, length, [p for p in range(length) if p % 4 == k][:allowed]) for k in range(4))
        assert all(met(seeds, length, rng.sample(range(length), allowed)) for _ in range(300))
        middle = (length - allowed) // 2
        assert met(seeds, length, range(middle, middle + allowed))


def test_overlaps_with_any_substitutions_are_found(spark):
    """Periods, adjacent words and random places, in documents that are the overlap alone or hold words around it."""
    rng = random.Random(12)
    patterns = [(12, (3, 6, 9)), (24, (11, 12)), (16, (4, 5, 6, 7)), (14, (5, 8)), (20, range(3, 19, 4)), (40, range(3, 39, 4)), (200, range(3, 199, 4))]
    patterns += [(n, rng.sample(range(1, n - 1), n // 4)) for n in range(12, 25) for _ in range(6)]
    bench, rows = [], []
    for k, (length, changed) in enumerate(patterns):
        words = [f"q{k}w{p}" for p in range(length)]
        bench.append((k, " ".join(words), 1))
        for p in changed:
            words[p] = f"c{p}"
        rows.append((2 * k, " ".join(words), "en", "s"))
        rows.append((2 * k + 1, " ".join([sentence(rng, 30), *words, sentence(rng, 30)]), "en", "s"))
    found = D.overlaps(documents(spark, rows), items(spark, bench)).collect()
    assert {(r.doc_id, r.item_id, r.words) for r in found} == {(2 * k + e, k, n) for k, (n, _) in enumerate(patterns) for e in (0, 1)}


def test_only_contaminated_texts_go_where_ids_repeat_or_are_missing(spark):
    rng = random.Random(13)
    passage = sentence(rng, 40)
    leaks = [sentence(rng, 20) + " " + passage, passage + " " + sentence(rng, 20)]
    clean = [(None, sentence(rng, 50)), (None, None), (None, ""), (5, sentence(rng, 50)), (5, "short"), (6, sentence(rng, 50)), (6, None)]
    dirty = [(None, leaks[0]), (5, leaks[1]), (7, leaks[1]), (7, leaks[1])]
    docs = documents(spark, [(d, t, "en", "s") for d, t in clean + dirty])
    kept = D.clean_documents(docs, items(spark, [(1, passage, 1)])).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == sorted((str(d), str(t)) for d, t in clean)


def test_empty_tables(spark):
    bench = items(spark, [(1, "a b c d e f g h i j k l m n o", 1)])
    assert D.overlaps(documents(spark, []), bench).count() == 0
    docs = documents(spark, awkward())
    assert D.clean_documents(docs, items(spark, [])).count() == docs.count()


def longest_overlap(doc, item, seeds):
    """Longest stretch of any alignment, by going through all of them."""
    best = (0, 0, 0, 0)
    for shift in range(-len(item) + 1, len(doc)):
        a, b = max(shift, 0), min(shift + len(item), len(doc))
        agree = np.array([doc[k] == item[k - shift] for k in range(a, b)], float)
        low, high = D.best_stretch(agree, seeds.share)
        best = max(best, (high - low, int(agree[low:high].sum()), -(a + low), shift - (a + low)))
    return best[0], best[1], -best[2], -best[3]


def test_extents_of_long_overlaps_equal_brute_force(spark):
    rng = random.Random(31)
    seeds = D.Seeds()
    bench, rows, want = [], [], {}
    for k, (length, gap) in enumerate([(1000, (200, 350)), (700, (300, 380)), (150, (60, 75)), (400, (0, 0)), (90, (20, 24))]):
        words = [f"q{k}w{p}" for p in range(length)]
        bench.append((k, " ".join(words), 1))
        body = [f"gap{p}" if gap[0] <= p < gap[1] else w for p, w in enumerate(words)]
        for e, (front, back) in enumerate([(0, 0), (300, 0), (37, 500)]):
            text = [f"f{rng.random()}" for _ in range(front)] + body + [f"b{rng.random()}" for _ in range(back)]
            rows.append((10 * k + e, " ".join(text), "en", "s"))
            want[10 * k + e, k] = longest_overlap(text, words, seeds)
    found = {(r.doc_id, r.item_id): (r.words, r.agreeing, r.doc_start, r.item_start) for r in D.overlaps(documents(spark, rows), items(spark, bench), seeds).collect()}
    assert found == want and want[0, 0][0] == 1000


def test_the_bitmap_grows_with_the_items():
    assert D.bitmap_size(0, (24, 28)) == D.bitmap_size(1000, (24, 28)) == 1 << 24
    assert D.bitmap_size(3 << 20, (24, 28)) == 1 << 26 and D.bitmap_size(1 << 40, (24, 28)) == 1 << 28
