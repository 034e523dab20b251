import hashlib
import itertools
import math

import numpy as np
import pytest

from ledgerlens.llm import zone_clustering as zc

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, id string, v string"


def brute(rows, rule):
    """Lloyd's rounds with Python integers, vector by vector."""
    kept = [(i, [max(-(1 << 27), min(1 << 27, math.floor(rule.scale * x))) for x in v]) for i, v, *_ in rows
            if v is not None and len(v) == rule.dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"{rule.salt}{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)
    centroids = [q for _, q in starts[:rule.k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids)) for _, q in kept]

    for _ in range(rule.rounds):
        places = assign()
        for n in range(len(centroids)):
            mine = [q for (_, q), (_, at) in zip(kept, places) if at == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    places = assign() if centroids else []
    inertia = [sum(d for d, at in places if at == n) for n in range(len(centroids))]
    short = lambda n: n if n < 1 << 63 else None
    return [(i, n, d, short(inertia[n]), short(sum(inertia)), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest())
            for (i, _), (d, n) in zip(kept, places)]


def vectors(seed, n=700, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, dims))
    rows = [(3 * i, (centres[i % 9] * 0.4 + rng.standard_normal(dims) * rng.choice([0.02, 0.3])).tolist()) for i in range(n)]
    rows += [(5000 + i, rows[1][1]) for i in range(300)]                                     # a third are one vector
    rows += [(7000 + i, [x * 0.0 for x in rows[0][1]]) for i in range(5)]
    rows += [(8000, None), (8001, []), (8002, rows[1][1][:-1]), (8003, rows[1][1] + [0.0]), (8004, [None] + rows[1][1][1:]),
             (8005, [float("nan")] + rows[1][1][1:]), (8006, [float("-inf")] + rows[1][1][1:]), (None, rows[2][1]), (None, rows[2][1]),
             (3, rows[4][1]), (3, rows[5][1])]
    return [(i, v, 1, "x", "y", "z") for i, v in rows]


def as_rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("block,k,rounds", [(256, 12, 5), (7, 5, 3), (1, 30, 2), (64, 1, 1), (16, 4, 0)])
def test_against_brute_force(spark, monkeypatch, block, k, rounds):
    monkeypatch.setattr(zc, "BLOCK", block)
    rule = zc.Rule(k=k, rounds=rounds, dims=8)
    rows = vectors(block)
    got = zc.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(5), rule)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert as_rows(got) == sorted(brute(rows, rule), key=str)


def test_very_large_components(spark):
    rule = zc.Rule(k=3, rounds=2, dims=4)
    rows = [(i, [x * (1 if i % 2 else 1e30) for x in v[:4]], 1, "", "", "") for i, v, *_ in vectors(5, 60) if i is not None and v and len(v) == 8 and None not in v]
    rows += [(100 + i, [float(1 << 17) * i, 1.0, -float(1 << 18), 0.5], 1, "", "", "") for i in range(20)]
    assert as_rows(zc.cluster_vectors(spark.createDataFrame(rows, SCHEMA), rule)) == sorted(brute(rows, rule), key=str)


def test_few_and_no_vectors(spark):
    rule = zc.Rule(k=40, dims=2)
    assert zc.cluster_vectors(spark.createDataFrame([], SCHEMA), rule).count() == 0
    assert zc.cluster_vectors(spark.createDataFrame([(1, None, 1, "", "", "")], SCHEMA), rule).count() == 0
    assert zc.cluster_vectors(spark.createDataFrame([(None, [1.0, 2.0], 1, "", "", "")], SCHEMA), rule).count() == 0
    two = [(1, [1.0, 2.0], 1, "", "", ""), (2, [1.0, 2.0], 1, "", "", "")]
    got = as_rows(zc.cluster_vectors(spark.createDataFrame(two, SCHEMA), rule))
    assert got == brute(two, rule) and {r[1] for r in got} == {0}


def test_the_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2), (5, 1), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = [k.tobytes() for k in zc.hilbert_keys(cells, bits)]
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(4)
    fewer = 0
    for _ in range(200):
        q, centroids = rng.integers(-20, 20, (10, 3)), rng.integers(-60, 60, (15, 3))
        near = zc.candidates(q.min(0), q.max(0), centroids)
        best, far = zc.nearest(q, centroids)
        assert set(best) <= set(near) and (zc.nearest(q, centroids[near])[1] == far).all() and (near[zc.nearest(q, centroids[near])[0]] == best).all()
        fewer += len(near) < 15
    assert fewer > 100


def test_blocks_are_small_and_whole(spark):
    rows = spark.createDataFrame(vectors(2), SCHEMA)
    rule = zc.Rule(dims=8)
    kept = zc.cut(zc.kept_vectors(rows, rule, "vec_id", "embedding"))
    low, high = zc._bounds(kept, 8)
    blocks = zc.zone_blocks(kept, low, high, 8).collect()
    assert sum(len(b.ids) for b in blocks) == kept.count() and max(len(b.ids) for b in blocks) <= zc.BLOCK
    for b in blocks:
        q = zc.from_bytes(bytes(b.vectors), 8)
        assert b.low == q.min(0).tolist() and b.high == q.max(0).tolist() and b.total == q.sum(0).tolist()
