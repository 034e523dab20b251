import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontaminate as dc


def tokens(text):
    return dc.item_tokens([text])[0] if text else np.zeros(0, np.uint64)


def brute(doc, item):
    """Best stretch over all diagonals, without seeds."""
    d, i = tokens(doc), tokens(item)
    if len(i) < dc.MIN_TOKENS:
        return False
    return any(dc.agreement(d, i, g)[2] > dc.agreement(d, i, g)[1] for g in range(-len(i), len(d)))


def test_masks_hit_every_stretch():
    n, k = dc.WINDOW, dc.WINDOW - dc.leak_at(dc.WINDOW)
    places = [[sum(1 << (o + m) for m in mask) for o in range(n - mask[-1])] for mask in dc.MASKS]
    for gone in itertools.combinations(range(n), k):
        bits = sum(1 << g for g in gone)
        assert any(not bits & p for mask in places for p in mask)


@pytest.mark.parametrize("limit", [dc.BROADCAST_TOKENS, 0])
def test_against_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(dc, "BROADCAST_TOKENS", limit)
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(60)])
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([30, 25, 20, 15, 9, 8, 5, 0, 40])] + [(100, None), (101, "")]
    docs = []
    for d in range(60):
        words = list(rng.choice(vocabulary, rng.integers(0, 60)))
        if d % 3:
            part = (items[d % 9][1] or "").split()
            for k in rng.choice(max(len(part), 1), min(d % 7, len(part)), replace=False):
                part[k] = "zz"
            at = rng.integers(0, len(words) + 1)
            words[at:at] = part
        docs.append((d, "  ".join(words).upper()))
    docs += [(60, None), (61, ""), (None, items[0][1]), (62, "x " * 50_000 + items[1][1]), (62, "x " * 50_000 + items[1][1])]
    frame = spark.createDataFrame([(*r, "c") for r in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = [(r.doc_id, [x.item_id for x in r.leaks]) for r in dc.find_leaks(frame, bench, limit).collect()]
    want = [(d, [i for i, t in items if t and brute(text, t)] if text else []) for d, text in docs if d != 62] + [(62, [1])] * 2
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    for frame in (frame, frame.withColumn("_row", F.lit(1)).withColumn("__row", F.lit("x"))):
        assert dc.drop_leaking(frame, bench).columns == frame.columns
        assert sorted(r.doc_id for r in dc.drop_leaking(frame, bench).collect() if r.doc_id is not None) == sorted(d for d, x in want if not x)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.find_leaks(none, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], none.schema)
    assert dc.find_leaks(some, bench).first().leaks == []
    assert dc.drop_leaking(some, bench).columns == some.columns
