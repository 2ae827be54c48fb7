"""Exact percentiles of groups of any size, without one task that holds a group.

A value's bucket is its sign and its binary logarithm in steps of 1/256, which keeps the order of the values. A histogram
of the buckets, some thousands of rows a group at most, says in which bucket the wanted places are; only the values of those
buckets are then counted and ranked. Equal values meet before the shuffle. Both passes are plain aggregates, so a hot
group is reduced where its rows are read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 256


def bucket(value: Column) -> Column:
    """A long that does not decrease as the value grows; infinities and NaN (above all, as Spark orders it) have buckets of their own."""
    # the logarithm of a double is between -1075 and 1024
    size = F.floor((F.log2(F.abs(value)) + 1100) * STEPS)
    ends = F.when(F.isnan(value), 1 << 40).when(F.abs(value) == float("inf"), F.signum(value).cast("long") * (1 << 39))
    return F.coalesce(ends.cast("long"), F.when(value == 0, F.lit(0).cast("long")).otherwise(F.signum(value).cast("long") * size))


def _same(a: str, b: str, names: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


def percentiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str | Column, float, str]]) -> DataFrame:
    """(keys, a column for each of ``wanted``): percentiles of each group by name -> (value, share, kind).

    Kind ``disc`` is the nearest rank: the smallest value that the share of the values does not exceed; ``cont`` interpolates between
    the two nearest; ``median`` is ``cont`` at one half; ``1/3`` is the value at the place n // 3, from 0. Null values have no part; a group without values has NULL. Null keys are a group.
    """
    values = {}  # each distinct value once
    for name, (value, _, _) in wanted.items():
        values.setdefault(str(value), (len(values), value))
    column = lambda v: F.expr(v) if isinstance(v, str) else v
    own = [f"__k{i}" for i in range(len(keys))]
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), column(v).cast("double").alias("v")) for i, v in values.values())))
    long = rows.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True)), each.alias("e"))
    long = long.select(*own, F.col("e.m").alias("__m"), F.col("e.v").alias("__v"), bucket(F.col("e.v")).alias("__b"))
    group = [*own, "__m"]
    known = long.where(F.col("__v").isNotNull())
    whole = Window.partitionBy(*group)
    hist = known.groupBy(*group, "__b").agg(F.count("*").alias("n"))
    hist = hist.select("*", F.sum("n").over(whole).alias("all"), F.sum("n").over(whole.orderBy("__b")).alias("upto"))

    # the places (from 0) whose values make up each percentile
    def places(q: float, kind: str) -> list[Column]:
        if kind == "disc":
            return [F.greatest(F.ceil(F.lit(q) * F.col("all")) - 1, F.lit(0))]
        if "/" in kind:
            return [F.floor(F.lit(int(kind.split("/")[0])) * F.col("all") / int(kind.split("/")[1]))]
        low = F.floor(F.lit(q) * (F.col("all") - 1))
        return [low, F.least(low + 1, F.col("all") - 1)]

    asked = []
    for name, (value, q, kind) in wanted.items():
        i, kind = values[str(value)][0], "cont" if kind == "median" else kind
        for end, place in enumerate(places(q, kind)):
            asked.append(F.when(F.col("__m") == i, F.struct(F.lit(name).alias("name"), F.lit(end).alias("end"), place.cast("long").alias("place"))))
    spots = hist.select(*group, "__b", "all", (F.col("upto") - F.col("n")).alias("before"), "upto", F.explode(F.array_compact(F.array(*asked))).alias("a"))
    spots = spots.where((F.col("a.place") >= F.col("before")) & (F.col("a.place") < F.col("upto")))
    spots = spots.select(*group, "__b", "all", "a.name", "a.end", (F.col("a.place") - F.col("before")).alias("place"))

    near = known.alias("x").join(spots.select(*group, "__b").distinct().alias("s"), _same("x", "s", [*group, "__b"]), "left_semi")
    counted = near.groupBy(*group, "__b", "__v").agg(F.count("*").alias("n"))
    ranked = counted.withColumn("upto", F.sum("n").over(Window.partitionBy(*group, "__b").orderBy("__v")))
    found = ranked.alias("x").join(spots.alias("s"), _same("x", "s", [*group, "__b"]) & (F.col("s.place") < F.col("x.upto")) & (F.col("s.place") >= F.col("x.upto") - F.col("x.n")))
    ends = found.groupBy(*(F.col(f"x.{o}").alias(o) for o in own)).agg(
        *(F.max(F.when((F.col("s.name") == name) & (F.col("s.end") == e), F.col("x.__v"))).alias(f"__{j}_{e}") for j, name in enumerate(wanted) for e in (0, 1)),
        *(F.max(F.when(F.col("s.name") == name, F.col("s.all"))).alias(f"__{j}_n") for j, name in enumerate(wanted)),
    )

    def made(j: int, q: float, kind: str) -> Column:
        low, high, n = (F.col(f"__{j}_{x}") for x in (0, 1, "n"))
        if kind == "disc" or "/" in kind:
            return low
        part = F.lit(q) * (n - 1) - F.floor(F.lit(q) * (n - 1))
        return F.when(part == 0, low).otherwise(low + (high - low) * part)

    out = ends.select(*own, *(made(j, q, kind).alias(name) for j, (name, (_, q, kind)) in enumerate(wanted.items())))
    groups = rows.select(*(F.col(k).alias(o) for k, o in zip(keys, own, strict=True))).distinct()
    both = groups.alias("g").join(out.alias("o"), _same("g", "o", own), "left") if own else out
    return both.select(*(F.col(f"g.{o}").alias(k) for k, o in zip(keys, own, strict=True)), *wanted)


def with_percentiles(rows: DataFrame, keys: Sequence[str], wanted: Mapping[str, tuple[str | Column, float, str]], *others: Column) -> DataFrame:
    """``percentiles`` and other aggregates (named columns) of the same groups."""
    a, b = percentiles(rows, keys, wanted), rows.groupBy(*keys).agg(*others)
    return b.alias("x").join(a.alias("s"), _same("x", "s", keys)).select(*(f"x.{c}" for c in b.columns), *wanted)


def numeric_summary(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n, mean, p50, p90, p99) of the non-NULL values; percentiles by nearest rank."""
    wanted = {f"p{round(100 * q)}": (value, q, "disc") for q in (0.5, 0.9, 0.99)}
    return with_percentiles(rows, keys, wanted, F.expr(f"count({value})").alias("n"), F.expr(f"avg({value})").alias("mean"))


def terciles(rows: DataFrame, value: str) -> DataFrame:
    """One row (low, high): the values at the places n // 3 and 2n // 3 of the sorted values. Ties share a label, so ``ntile`` does not do."""
    return percentiles(rows, [], {"low": (value, 1 / 3, "1/3"), "high": (value, 2 / 3, "2/3")})
