import math
import random

import numpy as np
import pytest

from panelyard.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int, _n int, _z string, `_id` int, `a b` int"
NAN, INF = math.nan, math.inf


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "z", 3, 4) for i, v in rows], SCHEMA)


def some(count=60, dims=6, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(k, 0.2 + 0.4 * k) for k in range(dims)]) for i in range(count)]


def awkward():
    rows = some()
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(7, rows[7][1]), (7, rows[7][1]), (None, rows[9][1]), (None, [0.5] * 6)]
    # the same integers from other values
    rows += [(140, [v + 1e-9 if math.floor(256 * (v + 1e-9)) == math.floor(256 * v) else v for v in rows[5][1]])]
    return rows + [(200, None), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (202, [NAN] * 6), (203, [1.0, INF, 0.0, 0.0, 0.0, 0.0]), (204, [-INF] * 6)]


def steps(v):
    return tuple(math.floor(256 * c) for c in v)


def usable(rows):
    return [(i, steps(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def brute(rows, weight="_one"):
    kept = usable(rows)
    found = sorted({x for _, x in kept})
    w = np.array([1 if weight == "_one" else sum(x == y for _, y in kept) for x in found], float)
    x = np.array(found, float)
    n = int(w.sum())
    mean = (x * w[:, None]).sum(0) / n
    cov = ((x - mean) * w[:, None]).T @ (x - mean) / n
    values, axes = np.linalg.eigh(cov)
    return kept, found, n, mean, cov, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("weight", ["_one", "_copies"])
def test_equals_a_dense_fit(spark, weight):
    rows = awkward()
    kept, found, n, mean, cov, values, axes = brute(rows, weight)
    got = W.whiten(vectors(spark, rows), weight=weight).collect()
    assert sorted((r._id is None, r._id or 0) for r in got) == sorted((i is None, i or 0) for i, _ in kept)
    sums = [sum(x[k] * (1 if weight == "_one" else sum(x == y for _, y in kept)) for x in found) for k in range(6)]
    signs = {}
    for r in got:
        x = steps(r._row.embedding)
        assert r._n == n and int(r._deviation) == sum((n * a - s) ** 2 for a, s in zip(x, sums))
        assert r._explained == pytest.approx(values[:4] / np.trace(cov), rel=1e-9)
        want = (np.array(x) - mean) @ axes[:, :4] / np.sqrt(values[:4])
        for k in range(4):
            if abs(want[k]) > 1e-6:
                signs.setdefault(k, set()).add(round(r._z[k] / want[k], 6))
        assert r._identity_error < 1e-9
    assert all(len(s) == 1 and abs(abs(s.pop()) - 1) < 1e-6 for s in signs.values()) and len(signs) == 4
    assert W.whiten(vectors(spark, rows)).select("_row.*").columns == vectors(spark, []).columns


def test_whitened_vectors_have_unit_covariance(spark):
    rows = awkward()
    z = {}
    for r in W.whiten(vectors(spark, rows), components=6).collect():
        z[steps(r._row.embedding)] = r._z
    y = np.array(list(z.values()))
    y = y - y.mean(0)
    assert np.abs(y.T @ y / len(y) - np.eye(6)).max() < 1e-9


def test_frequent_and_rare_vectors_both_come_back(spark):
    rows = some(3000, 3, 5)
    rows += [(10_000 + i, rows[0][1]) for i in range(1500)]
    got = W.whiten(vectors(spark, rows), whole=False).collect()
    assert sorted(r._id for r in got) == sorted(i for i, _ in rows)
    assert len({tuple(r._z) for r in got if r._id >= 10_000 or r._id == 0}) == 1


def test_rank_lengths_and_size(spark):
    line = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)]
    got = W.whiten(vectors(spark, line)).collect()
    assert {len(r._z) for r in got} == {1} and {round(r._explained[0], 12) for r in got} == {1.0}
    same = W.whiten(vectors(spark, [(1, [1.0, 2.0])] * 4)).collect()
    assert len(same) == 4 and {(r._n, len(r._z), int(r._deviation), r._identity_error) for r in same} == {(1, 0, 0, 0.0)}
    mixed = line + [(50 + i, v[:2]) for i, v in some(20, 4, 8)] + [(90, []), (91, [])]
    got = {r._id: r for r in W.whiten(vectors(spark, mixed)).collect()}
    assert got[0]._n == 9 and got[50]._n == 20 and len(got[50]._z) == 2 and got[90]._n == 1 and got[90]._z == []
    big = [(i, [v * 1e13 for v in vs]) for i, vs in some(12, 3, 4)]
    kept, found, n, *_ = brute(big)
    sums = [sum(x[k] for x in found) for k in range(3)]
    for r in W.whiten(vectors(spark, big)).collect():
        assert int(r._deviation) == sum((n * a - s) ** 2 for a, s in zip(steps(r._row.embedding), sums))
    huge = W.whiten(vectors(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])])).collect()
    assert len(huge) == 3


def test_empty(spark):
    assert W.whiten(vectors(spark, [])).count() == 0
    assert W.whiten(vectors(spark, [(1, None), (2, [NAN])])).count() == 0
