import re
from collections import defaultdict

import pytest
from helpers_llm import awkward, documents

from panelyard.llm import mixing as M
from panelyard.llm import shards as S
from panelyard.llm.tables import with_range


def expected_targets(sizes):
    """Sizes by source; caps and resharing step by step."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        if not over:
            return target | share
        target |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return target


def test_targets_and_cut(spark):
    rows = awkward() + [(500 + k, "word " * (k % 50), "en", f"t{k % 9}") for k in range(300)]
    docs = documents(spark, rows)
    got = M.mix(docs, whole=False).collect()
    again = M.mix(docs, whole=False).collect()
    key = lambda r: (r._doc is None, r._doc or 0, r._size, r._times, r._part)
    assert [key(r) for r in sorted(got, key=key)] == [key(r) for r in sorted(again, key=key)]
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    targets = expected_targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r._source_size == sizes[r._source] and r._target == pytest.approx(targets[r._source])
        words = r._times * r._size + r._part
        assert 0 <= words <= 2 * r._size
        taken[r._source] += words
    assert len(got) == len(rows) and all(taken[s] == int(t + 1e-9) for s, t in targets.items())


def test_documents_are_taken_whole_and_repeated(spark):
    docs = documents(spark, awkward())
    plan = M.mix(docs, cut_documents=False, whole=False).collect()
    out = M.mixed_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r._times for r in plan) and all(r._part == 0 for r in plan)
    assert M.mixed_documents(documents(spark, [])).count() == 0


def test_many_texts_without_an_id_spread_over_the_ranges(spark):
    rows = [(None if k % 3 == 0 else k, f"text {k} " * (k % 7), "en", "s") for k in range(30_000)]
    docs = documents(spark, rows)
    for measured in (docs.select(*M.measures()), docs.select(*S.measures(docs))):
        parts = with_range(measured, "_at", 4).groupBy("_range").count().collect()
        # texts of a zero count are equal and share a place, a seventh of those without an id
        assert len(parts) == 16 and max(r["count"] for r in parts) < 30_000 / 21 + 2.5 * 30_000 / 16
