"""Column functions against plain Python."""

import math
import random
import statistics
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracelight.functions import geometry, stats, text, tokens, vectors
from tracelight.operators import quantiles


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


REGISTRY = (("bb", "B"), ("a", "A"), ("b", "B2"), ("c", "A"))


@pytest.mark.parametrize("buffer, first, ordered", [("xbb", "B", ["B", "B2"]), ("ca", "A", ["A"]), ("", None, []), ("zzz", None, []), ("cb", "B2", ["B2", "A"])])
def test_registries(spark, buffer, first, ordered):
    for binary in (False, True):
        col = F.lit(bytearray(buffer.encode())) if binary else F.lit(buffer)
        row = one(spark, tokens.first_match(col, REGISTRY, binary).alias("f"), tokens.ordered_matches(col, REGISTRY, binary).alias("o"), tokens.sorted_matches(col, REGISTRY, binary).alias("s"))
        assert (row.f, row.o, row.s) == (first, ordered, sorted(ordered))


def test_contains_any(spark):
    row = one(spark, tokens.contains_any(F.lit("abc"), ["x", "bc"]).alias("a"), tokens.contains_any(F.lit("abc"), []).alias("b"), tokens.contains_any(F.lit(None).cast("string"), ["x"]).alias("c"))
    assert (row.a, row.b, row.c) == (True, False, None)


@pytest.mark.parametrize("k, n", [(0, 0), (0, 5), (5, 5), (3, 10), (999, 1000)])
def test_wilson(spark, k, n):
    low, high = one(spark, stats.wilson(F.lit(k), F.lit(n)).alias("w")).w
    if not n:
        assert (low, high) == (0, 0)
        return
    p, z = k / n, 1.96
    centre, half, bottom = p + z * z / (2 * n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    assert low == pytest.approx(max(0, (centre - half) / bottom)) and high == pytest.approx(min(1, (centre + half) / bottom))


def test_safe_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.5, 5.0), (3.0, 5.0, 5.0), (None, 1.0, 5.0)], "x double, y double, c double")
    row = df.agg(stats.safe_corr(F.col("x"), F.col("y")).alias("r"), stats.safe_corr(F.col("x"), F.col("c")).alias("n"), stats.safe_corr(F.col("x"), F.col("y"), 4).alias("few")).first()
    assert row.r == pytest.approx(statistics.correlation([1, 2, 3], [2, 4.5, 5])) and row.n is None and row.few is None


def test_safe_corr_of_a_constant_over_partitions(spark):
    """49 * (1 / 49) is not 1: the mean of a constant differs between partitions of 49 rows, so its deviation is not 0."""
    df = spark.range(0, 98, 1, 2).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 5 != 0, 0.1).alias("c"))
    for a, b in (("x", F.lit(1.0)), (F.lit(1.0), "x"), ("x", "c")):
        assert df.agg(stats.safe_corr(*(F.col(v) if isinstance(v, str) else v for v in (a, b))).alias("r")).first().r is None
    assert df.agg(stats.safe_corr(F.col("x"), F.col("x") * 2).alias("r")).first().r == pytest.approx(1)


def test_terciles(spark):
    for n in (1, 2, 5, 30, 100):
        v = [(i * 7 % 10) / 2 for i in range(n)]
        row = quantiles.terciles(spark.createDataFrame([(x,) for x in v], "v double"), "v").first()
        assert tuple(row) == (sorted(v)[n // 3], sorted(v)[2 * n // 3])


def test_bucketize(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (5.0,)], "v double")
    assert [r[0] for r in df.select(stats.bucketize(F.col("v"), (1, 2), ("a", "b", "c"))).collect()] == ["unknown", "a", "b", "c"]


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=12), st.text(max_size=12))
def test_edit_distance(spark, a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    got = one(spark, text.edit_distance_normalized(F.lit(a), F.lit(b)).alias("d")).d
    assert got == pytest.approx(d[-1] / max(len(a), len(b)) if a or b else 0)


def test_text(spark):
    df = spark.createDataFrame([("Straßé  X",), (None,), ("ABC d",)], "t string")
    want = [None if t is None else "".join(unicodedata.normalize("NFC", t).casefold().split()) for t in ("Straßé  X", None, "ABC d")]
    assert [r[0] for r in df.select(text.normalize_text("t")).collect()] == want
    row = one(spark, *(text.stem(F.lit(x)).alias(f"s{i}") for i, x in enumerate(("a_src.png", "a.b_clean.jpg", "plain"))), text.credit_code(F.lit("0011" + "9" * 18 + "x")).alias("c"), text.credit_code(F.lit("short")).alias("d"), text.aspect_class(F.lit(10), F.lit(20)).alias("a"), text.clipped(F.lit("x" * 300)).alias("k"))
    assert list(row)[:3] == ["a", "a.b", "plain"] and row.c == "9" * 18 and row.d == "short" and row.a == "portrait" and len(row.k) == 201
    row = one(spark, text.character_error_rate(F.lit("a b"), F.lit("abc")).alias("e"), text.character_error_rate(F.lit(""), F.lit("")).alias("z"), text.script_language(F.lit("ab 中")).alias("s"), text.stable_reading(F.array(F.lit("a"), F.lit("a")), F.array(F.lit(0.9), F.lit(0.86))).alias("r"))
    assert row.e == pytest.approx(1 / 3) and row.z == 0 and row.s == "zh" and row.r


def test_geometry(spark):
    box = lambda *v: F.struct(*(F.lit(x).alias(n) for x, n in zip(v, "xywh", strict=True)))
    row = one(spark, geometry.iou(box(0, 0, 10, 10), box(5, 0, 10, 10)).alias("i"), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("z"), geometry.padded(box(2, 2, 4, 4), F.lit(3), F.lit(8), F.lit(20)).alias("p"), geometry.centre_distance(box(0, 0, 2, 2), box(3, 4, 2, 2)).alias("d"), geometry.corner_box(F.lit(1), F.lit(2), F.lit(4), F.lit(8)).alias("c"))
    assert row.i == pytest.approx(1 / 3) and row.z == 0 and tuple(row.p) == (0, 0, 8, 9) and row.d == 5 and tuple(row.c) == (1, 2, 3, 6)


@pytest.mark.parametrize("length", [1, 63, 64, 65, 112, 113, 160, 500])
def test_tiles_cover(spark, length):
    starts = one(spark, geometry.tile_starts(F.lit(length).cast("long"), 64, 16).alias("s")).s
    covered = set()
    for s in starts:
        covered |= set(range(s, min(s + 64, length)))
    assert covered == set(range(length)) and starts == sorted(set(starts)) and starts[-1] + 64 >= length
    assert length <= 64 or starts[-1] + 64 == length


def test_vectors(spark):
    a, b = [1.0, 2.0, 3.0], [2.0, 1.0, 4.5]
    col = lambda v: F.array(*map(F.lit, v))
    row = one(spark, vectors.cosine(col(a), col(b)).alias("c"), vectors.ncc(col(a), col(b)).alias("n"), vectors.ncc(col(a), col([1.0])).alias("x"), vectors.cosine(col([0.0]), col([0.0])).alias("z"), stats.psnr(vectors.mean_squared_error(col(a), col(a))).alias("p"), vectors.bits_match(F.lit(5), F.lit(4), 8).alias("b"))
    assert row.c == pytest.approx(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)) and row.n == pytest.approx(np.corrcoef(a, b)[0, 1])
    assert row.x == 0 and row.z == 0 and row.p == float("inf") and row.b == 7


def test_gates(spark):
    from tracelight.operators.verdict import is_ai_key

    keys = ["Prompt", "Software", "my_OpenAI_tag", "Author", "SD:Seed"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(is_ai_key(F.col("k"))).collect()] == [True, True, True, False, True]
    line = lambda *v: one(spark, text.preserves_line(*map(F.lit, v)).alias("k")).k
    assert line("Total 12", "total 12", 0.9, "TOTAL12", 0.8) and not line("Total 12", "total 12", 0.9, "TOTAL12", 0.7)
    assert not line("Total 12", "xxxxxx", 0.9, "xxxxxx", 0.9) and not line("Total", "total", 0.9, "totol", 0.9)
