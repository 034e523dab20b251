import numpy as np
import pytest

from ledgerlens.llm import jaccard_join as jj
from ledgerlens.llm.graph import connected_components


def shingle_set(text, size):
    words = (text or "").encode().lower().split()
    k = min(size, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if k else frozenset()


def brute(rows, rule):
    """(doc_id, size, component) of every row, by comparing all pairs."""
    sets = [(d, shingle_set(t, rule.words)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and rule.whole * len(s & t) >= rule.part * len(s | t):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(400)])
    common = " ".join(rng.choice(words, 25))
    rows, number = [], iter(rng.permutation(5000).tolist())
    for _ in range(6):
        base = rng.choice(words, rng.integers(40, 160))
        rows += [(next(number), " ".join(base).upper())] * 2 + [(next(number), "\t".join(base))]
        for _ in range(14):
            copy = base.copy()
            for k in rng.integers(0, len(copy), rng.integers(0, 6)):
                copy[k] = rng.choice(words)
            rows.append((next(number), " ".join(copy)))
    rows += [(next(number), common + " " + " ".join(rng.choice(words, rng.integers(5, 60)))) for _ in range(25)]
    return rows + [(next(number), t) for t in ("a", "A", "a b", "", "  \n ", None, "b a", common, common)] + [(None, common), (None, None)]


def as_rows(spark, rows):
    return spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, id string, component_id int")


@pytest.mark.parametrize("rule", [jj.Rule(3, 90, 100), jj.Rule(5, 80, 100)])
@pytest.mark.parametrize("leaf", [512, 3])
def test_against_all_pairs(spark, monkeypatch, rule, leaf):
    monkeypatch.setattr(jj, "LEAF", leaf)
    rows = corpus(leaf + rule.words)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_classes(as_rows(spark, rows), rule).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(got, key=key) == sorted(brute(rows, rule), key=key)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jj, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jj, "BROADCAST_REGIONS", -1)
    monkeypatch.setattr(jj, "LEAF", 3)
    rule, rows = jj.Rule(3, 90, 100), corpus(11)
    got = {r.doc_id: r.component_id for r in jj.jaccard_classes(as_rows(spark, rows), rule).collect()}
    assert got == {d: c for d, _, c in brute(rows, rule)}


def test_keep_one_where_ids_repeat(spark):
    """Whole rows: a text of its own stays, of equal texts the row with the least id does, once."""
    schema = "doc_id long, text string, _row int, id string"
    a, b, c = "the cat sat on the mat today", "quite another text of several words", "Third one with words enough to count"
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, a, 1, "x"), (1, a, 2, "y"), (2, a.upper(), 3, "z"), (2, b, 4, ""), (3, c, 5, ""), (3, b, 6, ""), (5, None, 7, ""), (5, "", 8, ""), (None, a, 9, ""),
            (None, a, 9, ""), (7, near, 10, ""), (7, near + " end", 11, ""), (6, near + " end end", 12, "")]
    rule = jj.Rule(words=3, part=90, whole=100)
    kept = jj.keep_one(spark.createDataFrame(rows, schema), rule)
    assert kept.columns == ["doc_id", "text", "_row", "id"]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in kept.collect())
    assert [x for x in got if x[1] == a or x[1] == a.upper()] == [(-1, a), (-1, a), (1, a)]
    assert [x for x in got if x[1] == b] == [(2, b)] and [x for x in got if x[1] == c] == [(3, c)]
    assert sorted(x[0] for x in got if not x[1]) == [5, 5] and [x for x in got if (x[1] or "").startswith("w0")] == [(6, near + " end end")]
    assert len(got) == 8
    four = [(1, "a"), (1, "a"), (2, "a"), (2, "b")]
    assert sorted(map(tuple, jj.keep_one(spark.createDataFrame(four, "doc_id long, text string"), rule).collect())) == [(1, "a"), (2, "b")]


def test_keep_one(spark):
    rule, rows = jj.Rule(5, 80, 100), corpus(4)
    docs = as_rows(spark, rows)
    kept = jj.keep_one(docs, rule)
    assert kept.columns == docs.columns
    want = sorted(str(d) for d, _, c in brute(rows, rule) if d is None or d == c)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_empty_table_and_long_text(spark):
    none = as_rows(spark, [])
    assert jj.jaccard_classes(none, jj.Rule()).count() == 0 and jj.keep_one(none, jj.Rule()).count() == 0
    long = " ".join(f"t{i}" for i in range(120_000))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jj.jaccard_classes(as_rows(spark, [(2, long), (1, long + " end"), (3, "x")]), jj.Rule()).collect()}
    assert got == {2: (119_996, 1), 1: (119_997, 1), 3: (1, 3)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (3, 3), (8, 7), (7, 3), (20, 21), (None, 4), (30, 31), (31, 30)] + [(100 + i, 101 + i) for i in range(60)] + [(500, 500 + i) for i in range(1, 300)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {r.id: r.component for r in connected_components(frame).collect()}
    want = {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 20: 20, 21: 20, 30: 30, 31: 30} | {100 + i: 100 for i in range(61)} | {500 + i: 500 for i in range(300)}
    assert got == want and connected_components(frame.where("u = 3")).count() == 0
    far = spark.createDataFrame([((1 << 62) + i, (1 << 62) + i + 1) for i in range(8)], frame.schema)
    assert {r.component for r in connected_components(far).collect()} == {1 << 62}
