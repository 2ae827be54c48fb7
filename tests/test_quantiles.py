"""Exact percentiles against sorted lists."""

import math
import random

import pytest

from tracelight.operators import quantiles


def place(values, k):
    return sorted(values, key=lambda v: (math.isnan(v), v))[k]


def expected(values, q, kind):
    n = len(values)
    if not n:
        return None
    if kind == "disc":
        return place(values, max(math.ceil(q * n) - 1, 0))
    if kind == "1/3":
        return place(values, n // 3)
    at = q * (n - 1)
    low, high = place(values, math.floor(at)), place(values, min(math.floor(at) + 1, n - 1))
    return low if at == math.floor(at) else low + (high - low) * (at - math.floor(at))


WANTED = {"a": ("v", 0.5, "disc"), "b": ("v", 0.9, "disc"), "c": ("v", 0.99, "disc"), "d": ("v", 0.5, "median"), "e": ("v", 0.95, "cont"), "f": ("-v", 0.25, "cont"), "g": ("v", 0.0, "disc"), "h": ("v", 1.0, "disc"), "i": ("v", 0, "1/3")}


@pytest.mark.parametrize("seed", range(4))
def test_percentiles(spark, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.gauss(0, 1), lambda: float(rng.randint(-3, 3)), lambda: rng.choice((1e-300, -1e300, 5e-324, 0.0, 1.0)), lambda: 10 ** rng.uniform(-5, 5), lambda: 100 + rng.random() / 1e6]
    groups = {k: [rng.choice(kinds)() for _ in range(rng.randint(1, 120))] for k in ("x", "y", None)} | {"one": [2.5], "none": []}
    rows = [(k, v, 1) for k, vs in groups.items() for v in vs] + [("x", None, 1), ("none", None, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double, n int").repartition(3)
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], WANTED).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        for name, (value, q, kind) in WANTED.items():
            want = expected([-v for v in vs] if value == "-v" else vs, 0.5 if kind == "median" else q, "cont" if kind == "median" else kind)
            assert got[k][name] == (None if want is None else pytest.approx(want, rel=1e-12, abs=0)), (k, name)


def test_ends_and_empty(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (nan, inf, -inf, 0.0, -0.0, 1.0)], "v double")
    r = quantiles.percentiles(df, [], {"low": ("v", 0.0, "disc"), "mid": ("v", 0.5, "disc"), "high": ("v", 0.8, "disc"), "top": ("v", 1.0, "disc")}).first()
    assert (r.low, r.mid, r.high) == (-inf, 0.0, inf) and math.isnan(r.top)
    assert quantiles.percentiles(df.limit(0).selectExpr("'a' AS k", "v"), ["k"], WANTED).count() == 0
    s = {r.k: r for r in quantiles.numeric_summary(spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("b", None)], "k string, v double"), ["k"], "v").collect()}
    assert (s["a"].n, s["a"].mean, s["a"].p50, s["a"].p99) == (2, 2.0, 1.0, 3.0) and (s["b"].n, s["b"].p50) == (0, None)
    assert tuple(quantiles.terciles(spark.createDataFrame([(float(v),) for v in (5, 1, 1, 2, 9, 9)], "v double"), "v").first()) == (2.0, 9.0)


def test_buckets_keep_the_order(spark):
    rng = random.Random(1)
    values = sorted({0.0, 5e-324, 1e308, *(rng.choice((1, -1)) * 10 ** rng.uniform(-300, 300) for _ in range(2000)), *(1 + k / 1e4 for k in range(200))})
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").select("i", quantiles.bucket(quantiles.F.col("v")).alias("b"))
    b = [r.b for r in sorted(df.collect())]
    assert b == sorted(b) and len(set(b)) > 1500
