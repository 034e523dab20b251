import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import profile

AT = (0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0)


def least_reaching(values, q):
    ordered = sorted((v for v in values if v is not None), key=lambda v: (math.isnan(v), v))
    return ordered[max(-(-round(q * 10 ** 6) * len(ordered) // 10 ** 6), 1) - 1]


def same(a, b):
    return a == b or (math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize("kind", ["normal", "wide", "few", "odd", "equal", "tiny"])
def test_against_a_sorted_list(spark, kind):
    rng = random.Random(kind)
    values = {"normal": lambda: rng.gauss(0, 1), "wide": lambda: rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300), "few": lambda: float(rng.randrange(50)),
              "odd": lambda: rng.choice([0.0, -0.0, float("inf"), float("-inf"), float("nan"), None, 5e-324, -5e-324, 1.5, None]), "equal": lambda: 7.25,
              "tiny": lambda: 1.0 + rng.randrange(1000) * 2.0 ** -52}[kind]
    x = [values() for _ in range(3000)]
    df = spark.createDataFrame([(v, i, None) for i, v in enumerate(x)], "`a.b` double, i int, none double").repartition(5)
    got, passes = profile.select_quantiles(df, ["a.b", "i", "none"], AT)
    assert set(got) == {(c, q) for c in ("a.b", "i") for q in AT} and passes <= 5
    for q in AT:
        assert same(got["a.b", q], least_reaching(x, q)) and got["i", q] == least_reaching(list(map(float, range(3000))), q)
    frame = profile.exact_quantiles(df, ["a.b", "none"], (0.25, 0.5))
    assert frame.columns == ["column_name", "p25", "p50"] and [r.column_name for r in frame.collect()] == ["a.b"]


def test_empty_frames(spark):
    df = spark.createDataFrame([], "x double, y int")
    assert profile.select_quantiles(df, ["x", "y"])[0] == {} and profile.exact_quantiles(df, ["x", "y"]).count() == 0


def test_keys_keep_the_order_of_doubles():
    x = np.array([-np.inf, -1e300, -1.5, -5e-324, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    keys = profile._ordered(x)
    assert (np.diff(keys.astype(object)) > 0).all() and profile._ordered(np.array([-0.0]))[0] == keys[4]
    assert profile._ordered(np.array([-np.nan]))[0] == keys[-1]
    assert all(same(profile._value(int(k)), v) for k, v in zip(keys, x.tolist()))


def test_what_moves_does_not_grow_with_the_distinct_values(spark, monkeypatch):
    sent = []
    histogram = profile._histogram

    def counted(*args):
        out = histogram(*args)
        sent.append(sum(map(len, out.values())))
        return out

    monkeypatch.setattr(profile, "_histogram", counted)
    df = spark.range(300_000).select((F.xxhash64("id") / 1e6).alias("x"))              # all different
    _, passes = profile.select_quantiles(df, ["x"])
    assert passes <= 4 and sent[0] < 4000 and all(n <= 3 * (1 << profile.MORE_BITS) for n in sent[1:]) and sum(sent) < 20_000
