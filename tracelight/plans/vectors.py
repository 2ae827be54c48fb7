"""Boxes, tiles and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.geometry import iou, tile_plan as plan_tiles
from ..functions.stats import psnr
from ..functions.vectors import bits_match, centred, cosine, dot, mean_squared_error, ncc
from ..operators.temporal import greedy_suppress, match_one_to_one
from . import query, table

_BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"


def _box(k):
    return F.struct((k * 7 % 50).alias("x"), (k * 11 % 40).alias("y"), (k % 30 + 5).alias("w"), (k % 20 + 5).alias("h"))


@query("""
WITH b AS (SELECT p_partkey AS k, p_partkey * 7 % 50 AS x, p_partkey * 11 % 40 AS y, p_partkey % 30 + 5 AS w, p_partkey % 20 + 5 AS h FROM part),
p AS (SELECT a.k, a.w * a.h + b.w * b.h AS s, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS i FROM b a JOIN b ON b.k = a.k + 1)
SELECT k, round(i / (s - i), 9) AS iou FROM p
""")
def iou_pairs(spark, sf):
    k = F.col("p_partkey")
    a = table(spark, sf, "part").select(k.alias("k"), _box(k).alias("a"))
    b = table(spark, sf, "part").select((k - 1).alias("k"), _box(k).alias("b"))
    return a.join(b, "k").select("k", F.round(iou(F.col("a"), F.col("b")), 9).alias("iou"))


@query("""
WITH f AS (SELECT p_partkey AS k, 40 + p_partkey % 200 AS w, 30 + p_partkey % 90 AS h FROM part),
s AS (SELECT k, w, h, CASE WHEN w <= 64 THEN [0] ELSE list_distinct(list_append(range(0, w - 64 + 1, 48), w - 64)) END AS xs, CASE WHEN h <= 64 THEN [0] ELSE list_distinct(list_append(range(0, h - 64 + 1, 48), h - 64)) END AS ys FROM f)
SELECT k, x::BIGINT AS x, y::BIGINT AS y, least(w, 64)::BIGINT AS w, least(h, 64)::BIGINT AS h FROM (SELECT k, w, h, unnest(xs) AS x, ys FROM s), unnest(ys) AS u(y)
""")
def tile_plan(spark, sf):
    k = F.col("p_partkey")
    tiles = plan_tiles((k % 200 + 40).cast("long"), (k % 90 + 30).cast("long"), 64, 16)
    return table(spark, sf, "part").select(k.alias("k"), F.explode(tiles).alias("t")).select("k", "t.x", "t.y", F.col("t.w").cast("long").alias("w"), F.col("t.h").cast("long").alias("h"))


@query("""
WITH RECURSIVE o AS (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, x, y, w, h, k) AS i
  FROM (SELECT p_brand, p_partkey * 7 % 50 AS x, p_partkey * 11 % 40 AS y, p_partkey % 30 + 5 AS w, p_partkey % 20 + 5 AS h, p_retailprice AS score, p_partkey AS k FROM part)
),
r AS (
  SELECT p_brand, 0::BIGINT AS i, []::STRUCT(x BIGINT, y BIGINT, w BIGINT, h BIGINT)[] AS kept, NULL::BIGINT AS taken FROM (SELECT DISTINCT p_brand FROM part)
  UNION ALL
  SELECT p_brand, i, CASE WHEN free THEN list_append(kept, {'x': x, 'y': y, 'w': w, 'h': h}) ELSE kept END, CASE WHEN free THEN k END FROM (
    SELECT o.*, kept, len(list_filter(list_transform(kept, lambda b: [greatest(0, least(b.x + b.w, o.x + o.w) - greatest(b.x, o.x)) * greatest(0, least(b.y + b.h, o.y + o.h) - greatest(b.y, o.y)), b.w * b.h + o.w * o.h]), lambda p: p[1] / (p[2] - p[1]) >= 0.5)) = 0 AS free
    FROM r JOIN o ON o.p_brand = r.p_brand AND o.i = r.i + 1)
)
SELECT o.p_brand, o.x, o.y, o.w, o.h, o.score, o.k FROM o JOIN r ON r.taken = o.k
""")
def nms(spark, sf):
    """Greedy suppression of overlapping boxes in each brand."""
    k = F.col("p_partkey")
    boxes = table(spark, sf, "part").select("p_brand", *(_box(k)[c].alias(c) for c in "xywh"), F.col("p_retailprice").alias("score"), k.alias("k"))
    return greedy_suppress(boxes, ["p_brand"])


@query("""
WITH RECURSIVE near AS (
  SELECT s_nationkey AS nation, s_suppkey, c_custkey, round(abs(s_acctbal - c_acctbal), 6) AS distance FROM supplier JOIN customer ON s_nationkey = c_nationkey WHERE round(abs(s_acctbal - c_acctbal), 6) <= 500
),
o AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY distance, s_suppkey, c_custkey) AS i FROM near),
r AS (
  SELECT nation, 0::BIGINT AS i, []::BIGINT[] AS s, []::BIGINT[] AS c, false AS taken FROM (SELECT DISTINCT nation FROM near)
  UNION ALL
  SELECT o.nation, o.i, CASE WHEN free THEN list_append(s, o.s_suppkey) ELSE s END, CASE WHEN free THEN list_append(c, o.c_custkey) ELSE c END, free
  FROM (SELECT o.*, s, c, NOT list_contains(s, o.s_suppkey) AND NOT list_contains(c, o.c_custkey) AS free FROM r JOIN o ON o.nation = r.nation AND o.i = r.i + 1) o
)
SELECT o.nation, o.s_suppkey, o.c_custkey, o.distance FROM o JOIN r ON r.nation = o.nation AND r.i = o.i WHERE r.taken
""")
def assign_one_to_one(spark, sf):
    """Greedy matching of a supplier's nearest customers in each nation, nearest balance first; balances meet in neighbouring bands."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal", F.floor(F.col("s_acctbal") / 500).alias("own"))
    s = s.withColumn("band", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1))).drop("own")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal", F.floor(F.col("c_acctbal") / 500).alias("band"))
    near = s.join(c, ["nation", "band"]).withColumn("distance", F.round(F.abs(F.col("s_acctbal") - F.col("c_acctbal")), 6)).where("distance <= 500")
    return match_one_to_one(near.select("nation", "s_suppkey", "c_custkey", "distance"), ["nation"], "s_suppkey", "c_custkey", "distance")


_NEXT = "SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1"


def _pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x")).join(e.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").cast("array<double>").alias("y")), "id")


@query(f"SELECT id, round(list_cosine_similarity(x, y), 9) AS cosine FROM ({_NEXT})")
def cosine_pairs(spark, sf):
    return _pairs(spark, sf).select("id", F.round(cosine(F.col("x"), F.col("y")), 9).alias("cosine"))


@query(f"SELECT id, round(list_cosine_similarity(list_transform(x, lambda v: v - list_avg(x)), list_transform(y, lambda v: v - list_avg(y))), 8) AS ncc FROM ({_NEXT})")
def ncc_pairs(spark, sf):
    return _pairs(spark, sf).select("id", F.round(ncc(F.col("x"), F.col("y")), 8).alias("ncc"))


@query(f"SELECT id, round(10 * log10(65025.0 / list_avg(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 7) AS psnr FROM ({_NEXT})")
def psnr_pairs(spark, sf):
    return _pairs(spark, sf).select("id", F.round(psnr(mean_squared_error(F.col("x"), F.col("y"))), 7).alias("psnr"))


@query("SELECT label, i::BIGINT AS i, round(avg(v), 7) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i")
def mean_template(spark, sf):
    rows = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    return rows.groupBy("label", (F.col("i") + 1).cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 7).alias("mean"))


@query("""
WITH q AS (SELECT vec_id AS q, embedding::DOUBLE[] AS x, label FROM embeddings WHERE vec_id % 20 = 0)
SELECT q, vec_id, round(list_cosine_similarity(x, embedding::DOUBLE[]), 7) AS cosine FROM q JOIN embeddings e ON e.label = q.label AND vec_id <> q
QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(x, embedding::DOUBLE[]), 9) DESC, vec_id) <= 5
""")
def cosine_topk(spark, sf):
    """The five nearest of every twentieth vector among all of its label; each input partition keeps its own best first."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label", F.col("y").alias("x"))
    near = q.join(e, "label").where("vec_id <> q").select("q", "vec_id", cosine(F.col("x"), F.col("y")).alias("c"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("c", 9)), "vec_id")
    return near.withColumn("r", F.row_number().over(w)).where("r <= 5").select("q", "vec_id", F.round("c", 7).alias("cosine"))


@query("SELECT p_partkey, 48 - bit_count(xor(p_partkey * 2654435761 % 281474976710656, (p_partkey * 2654435761 % 281474976710656) // 2))::INT AS matching FROM part")
def bit_hamming(spark, sf):
    h = F.expr("p_partkey * 2654435761 % 281474976710656")
    return table(spark, sf, "part").select("p_partkey", bits_match(h, F.expr("(p_partkey * 2654435761 % 281474976710656) div 2"), 48).alias("matching"))


@query("""
WITH h AS (SELECT p_partkey AS k, p_partkey % 1900 * 40503 % 65536 * 257 % 16777216 AS c FROM part), d AS (SELECT c, min(k) AS k FROM h GROUP BY c)
SELECT x.k AS a, y.k AS b, bit_count(xor(x.c, y.c))::INT AS distance FROM d x JOIN d y ON x.k < y.k AND bit_count(xor(x.c, y.c)) <= 2
UNION ALL SELECT d.k, h.k, 0 FROM h JOIN d ON h.c = d.c AND h.k > d.k
""")
def near_hash_pairs(spark, sf):
    """Perceptual hashes that differ in two bits at most, by banded equi-joins."""
    from ..operators.audit import near_hashes

    hashes = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.expr("p_partkey % 1900 * 40503 % 65536 * 257 % 16777216").alias("c"))
    return near_hashes(hashes, "k", "c", 24, 2)


__all__ = ["centred", "dot"]
