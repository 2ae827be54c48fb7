"""Audits of verdict tables and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def diff_classes(old: Column, new: Column) -> Column:
    """lost_x for what only ``old`` has, new_x for what only ``new`` has; NULL arrays count as empty."""
    none = F.array().cast("array<string>")
    old, new = F.coalesce(old, none), F.coalesce(new, none)
    return F.concat(F.transform(F.array_except(old, new), lambda x: F.concat(F.lit("lost_"), x)), F.transform(F.array_except(new, old), lambda x: F.concat(F.lit("new_"), x)))


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys are not done yet."""
    return todo.join(done, keys, "left_anti")


def first_per_key(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key, the one with the least ``order``: an aggregate with partial results, so a hot key is reduced before the shuffle."""
    best = F.min(F.struct(order, *columns)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *(F.col(f"_b.{c}").alias(c) for c in (order, *columns)))


def ingest(existing: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """The rows of a batch to append: first of each key within the batch, and none that exists."""
    w = Window.partitionBy(key).orderBy(order)
    return batch.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").join(existing.select(key), key, "left_anti")


def keyed_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int) -> DataFrame:
    """n rows of each stratum in the order of md5(key:seed).

    Each input partition keeps its own best n of each stratum first, so a hot stratum sends n rows a partition to the shuffle.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary"))
    rows = df.withColumn("_h", h).withColumn("_part", F.spark_partition_id())
    local = Window.partitionBy("_part", *strata).orderBy("_h", key)
    best = rows.withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= n)
    whole = Window.partitionBy(*strata).orderBy("_h", key)
    return best.withColumn("_r", F.row_number().over(whole)).where(F.col("_r") <= n).drop("_h", "_r", "_part")


def count_tokens_of(df: DataFrame, tokens: Column) -> DataFrame:
    return df.select(F.explode(tokens).alias("token")).where(F.col("token") != "").groupBy("token").agg(F.count("*").alias("n"))


def verdict_changes(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, changed): rows of two verdict tables matched by key, and the fields that differ, null-safely."""
    a = old.select(F.col(key), *(F.col(f).alias(f"_o_{f}") for f in fields), F.lit(True).alias("_old"))
    b = new.select(F.col(key), *(F.col(f).alias(f"_n_{f}") for f in fields), F.lit(True).alias("_new"))
    both = a.join(b, key, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_o_{f}").eqNullSafe(F.col(f"_n_{f}")), F.lit(f)) for f in fields)))
    status = F.when(F.col("_old").isNull(), "only_new").when(F.col("_new").isNull(), "only_old").when(F.size(changed) > 0, "differs").otherwise("same")
    return both.select(key, status.alias("status"), F.when(status == "differs", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def near_hashes(df: DataFrame, key: str, code: str, width: int = 48, most: int = 3) -> DataFrame:
    """(a, b, distance): rows whose hashes of ``width`` bits differ in ``most`` bits at most.

    The least key of each hash stands for its rows: pairs of such keys with their distance, and each other key with the
    one that stands for it, at distance 0. So no link between different hashes is lost, and copies make no pairs among themselves.
    Of most + 2 bands of the bits two must be equal, so pairs come from an equi-join on two bands together instead of all pairs.
    """
    known = df.where(F.col(code).isNotNull()).select(F.col(key).alias("key"), F.col(code).alias("code"))
    rows = known.groupBy("code").agg(F.min("key").alias("least"))
    copies = known.join(rows, "code").where(F.col("key") > F.col("least")).select(F.col("least").alias("a"), F.col("key").alias("b"), F.lit(0).alias("distance")).distinct()
    step = -(-width // (most + 2))
    band = [F.shiftright("code", i * step).bitwiseAND((1 << step) - 1) for i in range(most + 2)]
    two = [F.struct(F.lit(i * width + j).alias("i"), (F.shiftleft(band[i], step) + band[j]).alias("v")) for i in range(most + 2) for j in range(i)]
    cut = rows.select("least", "code", F.explode(F.array(*two)).alias("band")).select("least", "code", "band.i", "band.v")
    other = cut.select(F.col("least").alias("key2"), F.col("code").alias("code2"), "i", "v")
    distance = F.bit_count(F.col("code").bitwiseXOR(F.col("code2")))
    near = cut.join(other, ["i", "v"]).where((F.col("least") < F.col("key2")) & (distance <= most))
    return near.select(F.col("least").alias("a"), F.col("key2").alias("b"), distance.alias("distance")).distinct().unionByName(copies)
