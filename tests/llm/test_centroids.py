import hashlib
import math
import random

import numpy as np
import pytest

from panelyard.llm import centroids as C
from panelyard.llm.queries import lloyd_sql

SCHEMA = "vec_id long, embedding array<double>, label int, _cluster int, _x string, `a b` int"
SMALL = C.Lloyd(clusters=7, rounds=5, dims=5, lead=2)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 4) for i, v in rows], SCHEMA)


def some(count=200, dims=5, seed=1, groups=9):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(groups)]
    return [(i, [c + rng.gauss(0, 0.1) for c in centres[i % groups]]) for i in range(count)]


def awkward():
    rows = some()
    rows += [(1000 + i, rows[3][1]) for i in range(90)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[8][1]), (None, rows[9][1])]
    return rows + [(2000, None), (2001, [1.0] * 4), (2002, [1.0] * 6), (2003, [1.0, None, 1.0, 1.0, 1.0]), (2004, [math.nan] * 5), (2005, [math.inf] * 5), (2006, [])]


def brute(rows, p):
    kept = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows if v is not None and len(v) == p.dims and all(c is not None and math.isfinite(c) for c in v)]
    at = sorted((hashlib.sha256(f"{p.seed}:{'null' if i is None else i}".encode()).hexdigest(), x) for i, x in kept)
    centres = [x for _, x in at[: p.clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centres)) for _, x in kept]

    for _ in range(p.rounds):
        mine = assign()
        for k in range(len(centres)):
            own = [x for (_, x), (_, c) in zip(kept, mine) if c == k]
            if own:
                centres[k] = tuple(sum(v) // len(own) for v in zip(*own))
    mine = assign()
    inertia = [sum(d for d, c in mine if c == k) for k in range(len(centres))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i is None, i or 0), c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (d, c) in zip(kept, mine))


def result(df):
    return sorted(((r._id is None, r._id or 0), r._cluster, int(r._distance), int(r._cluster_inertia), int(r._inertia), r._centroid_sha256) for r in df.collect())


@pytest.mark.parametrize("lead", [0, 2, 5])
def test_equals_plain_rounds(spark, lead):
    p = C.Lloyd(clusters=7, rounds=5, dims=5, lead=lead)
    found = C.cluster(vectors(spark, awkward()), p)
    assert result(found) == brute(awkward(), p)
    assert found.select("_row.*").columns == vectors(spark, []).columns


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(i % 3), 0.0]) for i in range(30)]
    p = C.Lloyd(clusters=12, rounds=3, dims=2, lead=1)
    assert result(C.cluster(vectors(spark, rows), p, whole=False)) == brute(rows, p)


def test_large_entries_stay_exact(spark):
    rng = random.Random(4)
    for size in (1e6, 1e13):
        rows = [(i, [rng.uniform(-size, size) for _ in range(5)]) for i in range(60)]
        assert result(C.cluster(vectors(spark, rows), SMALL, whole=False)) == brute(rows, SMALL)


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = some(4)
    assert result(C.cluster(vectors(spark, rows), SMALL)) == brute(rows, SMALL)
    assert C.cluster(vectors(spark, []), SMALL).count() == 0
    assert C.cluster(vectors(spark, [(1, None), (2, [1.0])]), SMALL).count() == 0


def test_the_bound_never_exceeds_the_distance_and_prunes():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 12)) * np.r_[np.full(4, 300.0), np.full(8, 20.0)]).astype(np.int64)
    centres = x[:25]
    rotation = C.Rotation(x.mean(axis=0), C.principal_axes(np.cov(x.T))[1][:, :4])
    leads, centre_leads = rotation(x), rotation(centres)
    bounds = ((leads[:, None, :] - centre_leads[None]) ** 2).sum(axis=2)
    exact = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (bounds <= exact * (1 + 1e-9) + 1e-6).all()
    cluster, distance, measured = C.nearest(x, leads, centres, centre_leads)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert measured < 0.25 * exact.size


def test_sql_holds_the_same_rounds(spark):
    import duckdb

    rows = [(i, v) for i, v in awkward() if i is not None and i != 5]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = con.execute(lloyd_sql(clusters=7, rounds=5, dims=5)).fetchall()
    assert sorted(((False, i), *rest) for i, *rest in got) == brute(rows, SMALL)
