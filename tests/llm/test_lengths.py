import os

import numpy as np
import pytest
from helpers_llm import awkward, documents

from panelyard.llm import lengths as L

pytestmark = pytest.mark.skipif(not os.path.exists(L.VOCABULARY), reason="vocabulary not present")


def test_suffix_sums_equal_brute_force(spark):
    rows = awkward()
    encode = L.encoding(L.VOCABULARY).encode_ordinary
    by = {}
    for _, t, _, s in rows:
        by.setdefault(s, []).append(len(encode(t)) if t is not None else 0)
    table = L.length_table(documents(spark, rows)).cache()
    got = table.collect()
    assert {(r.source, r.tokens) for r in got} == {(s, n) for s, v in by.items() for n in v} and len(got) == len({(r.source, r.tokens) for r in got})
    for r in got:
        n = np.array(by[r.source])
        assert (r.docs, r.docs_from, r.tokens_from) == ((n == r.tokens).sum(), (n >= r.tokens).sum(), n[n >= r.tokens].sum())
        assert (r.docs_all, r.tokens_all, r.docs_cut, r.tokens_kept) == (len(n), n.sum(), (n > r.tokens).sum(), np.minimum(n, r.tokens).sum())
        assert r.share_upto == pytest.approx((n <= r.tokens).mean())
    for r in L.totals_at(table, [0, 10, 77, 10**7]).collect():
        n = np.array(by[r.source])
        assert (r.docs_all, r.tokens_all, r.docs_cut, r.tokens_kept) == (len(n), n.sum(), (n > r.limit).sum(), np.minimum(n, r.limit).sum())
    for r in L.quantiles(table, [0.0, 0.3, 0.5, 1.0]).collect():
        n = np.sort(by[r.source])
        assert r.tokens == n[max(0, int(np.ceil(r.share * len(n) - 1e-9)) - 1)]


def test_empty_table(spark):
    assert L.length_table(documents(spark, [])).count() == 0
