import numpy as np
import pytest

from ledgerlens.llm import embedding_dedup as ed

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold):
    usable = {}
    for k, (i, v, label, _) in enumerate(rows):
        if i is not None and v is not None and label is not None and None not in v and len(v) and np.isfinite(v).all() and any(v):
            usable[k] = (i, np.array(v, np.float32).astype(float), label)
    links = {k: 0 for k in range(len(rows))}
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, v, a) in usable.items():
        for m, (j, w, b) in usable.items():
            if m < k and a == b and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= threshold:
                links[k] += 1
                links[m] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted(((r[0], links[k], None if r[0] is None else find(r[0])) for k, r in enumerate(rows)), key=str)


def vectors(seed, n=900, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = rng.standard_normal(dim) if i % 3 == 0 else centres[i % 12] + rng.standard_normal(dim) * rng.choice([0.05, 0.2, 0.35])
        rows.append((5000 - 3 * i, v.astype(np.float32).tolist(), int(i % 12 > 8), "c"))
    rows += [(7000 + i, rows[1][1], rows[1][2], None) for i in range(200)]                       # one vector many times
    rows += [(8000, [0.0] * dim, 0, None), (8001, None, 0, None), (8002, rows[1][1], None, None), (8003, [float("nan")] * dim, 0, None),
             (8004, [None] + rows[1][1][1:], 0, None), (8005, [], 0, None), (8006, [float("inf")] * dim, 0, None),
             (8007, [x * 3 for x in rows[1][1]], rows[1][2], None), (8008, rows[1][1][:8], rows[1][2], None), (None, rows[1][1], 0, None)]
    return rows


@pytest.mark.parametrize("leaf", [1024, 50])
def test_against_all_pairs(spark, monkeypatch, leaf):
    monkeypatch.setattr(ed, "LEAF", leaf)
    rows = vectors(leaf)
    got = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    found = sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)
    want = brute(rows, 0.93)
    assert sum(r[1] for r in found) >= 0.999 * sum(r[1] for r in want)
    assert found == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall_of_the_tables(spark):
    """With more vectors a label gets bits and tables; pairs at the threshold must still meet."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        v = rng.standard_normal(64)
        w = rng.standard_normal(64)
        w -= v * (w @ v) / (v @ v)
        w *= np.linalg.norm(v) / np.linalg.norm(w)
        rows += [(2 * i, v.tolist(), 1, None), (2 * i + 1, (v * 0.935 + w * np.sqrt(1 - 0.935 ** 2)).tolist(), 1, None)]
    got = ed.near_duplicates(spark.createDataFrame(rows, SCHEMA.replace("float", "double")))
    assert got.where("n_links > 0").count() >= 0.998 * len(rows)
    bits, tables = ed.table_plan(6000, 0.93, 64)
    assert bits == 7 and tables > 10 and ed.table_plan(10, 0.93, 64) == (0, 1)


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(2)
    d = 64
    errors, inside = [], []
    for k in range(300):
        x, y = rng.standard_normal((2, d))
        y = x + y * rng.uniform(0.1, 2)
        x, y = x / np.linalg.norm(x), y / np.linalg.norm(y)
        turn = ed.rotation(d, k)
        a, b = turn @ x, turn @ y
        code = np.where(a >= 0, 1, -1) / np.sqrt(d)
        f = code @ a
        error = code @ b / f - x @ y
        errors.append(error)
        inside.append(abs(error) <= ed.BOUND * np.sqrt((1 - f * f) / (f * f) / (d - 1)))
    assert abs(np.mean(errors)) < 0.01 and all(inside)


def test_empty(spark):
    assert ed.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in ed.near_duplicates(spark.createDataFrame([(4, None, 1, None)], SCHEMA)).collect()] == [(4, 0, 4, True)]
