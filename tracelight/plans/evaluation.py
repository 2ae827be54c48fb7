"""Evaluation statistics: percentiles, intervals, confusion, grids, operating points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import safe_corr, tercile_label, wilson
from ..operators.quantiles import numeric_summary, percentiles, terciles, with_percentiles
from . import query, table


@query("""
SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean
FROM events GROUP BY event_type
""")
def nearest_rank_percentile(spark, sf):
    return numeric_summary(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value").withColumn("mean", F.round("mean", 6))


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'flag' WHEN grouping(l_linestatus) = 0 THEN 'status' WHEN grouping(size) = 0 THEN 'size' ELSE 'all' END AS segment_kind,
       coalesce(l_returnflag, l_linestatus, size, 'all') AS segment, count(*) AS n, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.9) AS p90,
       quantile_disc(l_extendedprice, 0.99) AS p99, round(avg(l_extendedprice), 4) AS mean
FROM (SELECT *, CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS size FROM lineitem)
GROUP BY GROUPING SETS ((), (l_returnflag), (l_linestatus), (size))
""")
def timing_segments(spark, sf):
    """The same statistics for everything and for independent segmentations, in one pass over the table."""
    q = F.col("l_quantity")
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", F.when(q < 10, "small").when(q < 30, "medium").otherwise("large").alias("size"))
    segment = lambda kind, v: F.struct(F.lit(kind).alias("segment_kind"), v.alias("segment"))
    each = rows.select("l_extendedprice", F.explode(F.array(segment("all", F.lit("all")), segment("flag", F.col("l_returnflag")), segment("status", F.col("l_linestatus")), segment("size", F.col("size")))).alias("s"))
    each = each.select("s.segment_kind", "s.segment", "l_extendedprice")
    return numeric_summary(each, ["segment_kind", "segment"], "l_extendedprice").withColumn("mean", F.round("mean", 4))


@query("""
SELECT l_returnflag, CASE WHEN count(*) >= 3 THEN round(corr(l_quantity, l_extendedprice), 8) END AS r, NULL::DOUBLE AS r_constant FROM lineitem GROUP BY l_returnflag
""")
def safe_correlation(spark, sf):
    x = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(safe_corr(x, F.col("l_extendedprice")), 8).alias("r"), F.round(safe_corr(x, F.lit(1.0)), 8).alias("r_constant"))


_WILSON = """
round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 9) AS low,
round(CASE WHEN n = 0 THEN 0 ELSE least(1, (k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n)) END, 9) AS high
"""


def _bounded(df):
    return df.withColumn("w", wilson(F.col("k"), F.col("n"))).withColumns({"low": F.round("w.low", 9), "high": F.round("w.high", 9)}).drop("w")


@query(f"SELECT lang, k, n, {_WILSON} FROM (SELECT lang, count(*) FILTER (quality = 1) AS k, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY lang)")
def wilson_ci(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return _bounded(rows.groupBy("lang").agg(F.count_if(F.col("quality") == 1).alias("k"), F.count("*").alias("n")))


@query("""
SELECT lang, count(*) FILTER (fired AND bad) AS tp, count(*) FILTER (fired AND NOT bad) AS fp, count(*) FILTER (NOT fired AND bad) AS fn,
       round(count(*) FILTER (fired AND bad) / nullif(count(*) FILTER (fired), 0), 9) AS precision, round(count(*) FILTER (fired AND bad) / nullif(count(*) FILTER (bad), 0), 9) AS recall
FROM (SELECT lang, quality = 0 AS bad, contains(text, '!!') OR contains(text, ' | ') OR contains(text, '***') AS fired FROM documents JOIN labels USING (doc_id)) GROUP BY lang
""")
def confusion_scope(spark, sf):
    """A detector against labels, within the documents that were judged."""
    from ..functions.tokens import contains_any

    fired = table(spark, sf, "documents").select("doc_id", "lang", contains_any(F.col("text"), ["!!", " | ", "***"]).alias("fired"))
    rows = fired.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    tp = F.count_if(F.col("fired") & F.col("bad"))
    return rows.groupBy("lang").agg(
        tp.alias("tp"), F.count_if(F.col("fired") & ~F.col("bad")).alias("fp"), F.count_if(~F.col("fired") & F.col("bad")).alias("fn"),
        F.round(F.try_divide(tp, F.count_if("fired")), 9).alias("precision"), F.round(F.try_divide(tp, F.count_if("bad")), 9).alias("recall"),
    )


@query(f"""
SELECT event_type, hour, k, n, {_WILSON} FROM (
  SELECT event_type, CASE WHEN hour(ts) < 8 THEN 'night' WHEN hour(ts) < 16 THEN 'day' ELSE 'evening' END AS hour, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY ALL)
""")
def rate_grid(spark, sf):
    """Rate and interval of each cell of a grid."""
    h = F.hour("ts")
    cell = F.when(h < 8, "night").when(h < 16, "day").otherwise("evening")
    return _bounded(table(spark, sf, "events").groupBy("event_type", cell.alias("hour")).agg(F.count_if(F.col("value") > 50).alias("k"), F.count("*").alias("n")))


@query("""
WITH v AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS n FROM events WHERE value IS NOT NULL),
t AS (SELECT max(value) FILTER (i = n // 3) AS low, max(value) FILTER (i = 2 * n // 3) AS high FROM v)
SELECT CASE WHEN value <= low THEN 'low' WHEN value <= high THEN 'mid' ELSE 'high' END AS tercile, count(*) AS n, count(*) FILTER (event_type = 'click') AS clicks FROM events, t WHERE value IS NOT NULL GROUP BY ALL
""")
def tercile_recall(spark, sf):
    events = table(spark, sf, "events").where(F.col("value").isNotNull())
    cut = F.broadcast(terciles(events, "value"))  # one row
    rows = events.join(cut, F.lit(True)).select(tercile_label(F.col("value"), F.col("low"), F.col("high")).alias("tercile"), "event_type")
    return rows.groupBy("tercile").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))


@query("SELECT l_returnflag, round(median(l_extendedprice * (1 - l_discount) - l_extendedprice), 6) AS median_diff, count(*) AS n FROM lineitem WHERE isfinite(l_extendedprice) GROUP BY l_returnflag")
def paired_median_diff(spark, sf):
    """The median of differences, not the difference of medians."""
    p = F.col("l_extendedprice")
    finite = p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf"))
    rows = table(spark, sf, "lineitem").where(finite).select("l_returnflag", (p * (1 - F.col("l_discount")) - p).alias("d"))
    return with_percentiles(rows, ["l_returnflag"], {"median_diff": ("d", 0.5, "median")}, F.count("*").alias("n")).withColumn("median_diff", F.round("median_diff", 6))


@query("""
WITH g AS (SELECT event_type, quantile_cont(value, 0.95) AS gate FROM events WHERE user_id % 2 = 0 GROUP BY event_type)
SELECT e.event_type, round(any_value(gate), 6) AS gate, round(avg(CASE WHEN user_id % 2 = 0 THEN (value >= gate)::INT END), 9) AS clean_rate, round(avg(CASE WHEN user_id % 2 = 1 THEN (value >= gate)::INT END), 9) AS marked_rate
FROM events e JOIN g ON e.event_type = g.event_type GROUP BY e.event_type
""")
def operating_points(spark, sf):
    """The gate at a percentile of the clean arm, and both arms' share above it."""
    e = table(spark, sf, "events").select("event_type", "user_id", "value")
    gate = percentiles(e.where("user_id % 2 = 0").select("event_type", "value"), ["event_type"], {"gate": ("value", 0.95, "cont")})
    above = (F.col("value") >= F.col("gate")).cast("int")
    arm = lambda k: F.round(F.avg(F.when(F.col("user_id") % 2 == k, above)), 9)
    return e.join(gate, "event_type").groupBy("event_type").agg(F.round(F.max("gate"), 6).alias("gate"), arm(0).alias("clean_rate"), arm(1).alias("marked_rate"))


@query("""
SELECT floor_v, count(*) FILTER (value >= floor_v * 0.7 AND value < floor_v AND event_type = 'click') AS recovered, count(*) FILTER (value >= floor_v * 0.7 AND value < floor_v AND event_type <> 'click') AS added_false
FROM events, (VALUES (50.0::DOUBLE), (70.0::DOUBLE), (90.0::DOUBLE)) l(floor_v) GROUP BY floor_v
""")
def ladder_tradeoff(spark, sf):
    """What each candidate threshold would recover and add; the ladder is an array, so rows are read once and nothing is crossed."""
    v = F.col("value")
    rows = table(spark, sf, "events").select(F.explode(F.array(F.lit(50.0), F.lit(70.0), F.lit(90.0))).alias("floor_v"), "value", "event_type")
    inside = (v >= F.col("floor_v") * 0.7) & (v < F.col("floor_v"))
    return rows.groupBy("floor_v").agg(F.count_if(inside & (F.col("event_type") == "click")).alias("recovered"), F.count_if(inside & (F.col("event_type") != "click")).alias("added_false"))


@query("""
SELECT base, round(stddev_pop(v) / nullif(avg(v), 0), 9) AS cv FROM (
  SELECT unnest(['quantity', 'price', 'discount']) AS base, unnest([l_quantity, l_extendedprice, l_discount + 1]) AS v FROM lineitem) GROUP BY base
""")
def geometry_cv(spark, sf):
    """Bases ranked by coefficient of variation."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("base"), v.alias("v")) for n, v in (("quantity", F.col("l_quantity")), ("price", F.col("l_extendedprice")), ("discount", F.col("l_discount") + 1)))))
    return table(spark, sf, "lineitem").select(each.alias("b")).groupBy("b.base").agg(F.round(F.try_divide(F.stddev_pop("b.v"), F.avg("b.v")), 9).alias("cv"))


@query("""
SELECT o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN 'final' WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_totalprice > 300000 THEN 'dear' ELSE 'kept' END AS reason, count(*) AS n FROM orders GROUP BY ALL
""")
def gate_arms(spark, sf):
    p = F.col("o_totalprice")
    reason = F.when(F.col("o_orderstatus") == "F", "final").when(p < 50_000, "cheap").when(p > 300_000, "dear").otherwise("kept")
    return table(spark, sf, "orders").groupBy("o_orderpriority", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT event_type, round(kurtosis_pop(value), 6) AS kurtosis, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY event_type")
def population_moments(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.round(F.kurtosis("value"), 6).alias("kurtosis"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@query("""
SELECT pool, quantile_disc(a, 0.5) AS a50, quantile_disc(a, 0.9) AS a90, quantile_disc(b, 0.5) AS b50, round(quantile_disc(a - b, 0.5), 6) AS d50, count(*) FILTER (a >= 30000 AND b >= 20) AS both_fire
FROM (SELECT l_linestatus AS pool, l_extendedprice AS a, l_quantity AS b FROM lineitem) GROUP BY pool
""")
def crossfire(spark, sf):
    """Percentiles of two detectors' scores and of their difference in each pool."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("pool"), F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"))
    wanted = {"a50": ("a", 0.5, "disc"), "a90": ("a", 0.9, "disc"), "b50": ("b", 0.5, "disc"), "d50": ("a - b", 0.5, "disc")}
    out = with_percentiles(rows, ["pool"], wanted, F.count_if((F.col("a") >= 30_000) & (F.col("b") >= 20)).alias("both_fire"))
    return out.withColumn("d50", F.round("d50", 6))


@query("""
WITH a AS (SELECT lang, count(*) FILTER (quality = 0 AND contains(text, '!!')) / nullif(count(*) FILTER (contains(text, '!!')), 0) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang),
b AS (SELECT lang, count(*) FILTER (quality = 0 AND contains(text, ' | ')) / nullif(count(*) FILTER (contains(text, ' | ')), 0) AS p FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT a.lang, round(a.p, 9) AS precision, round(a.p - b.p, 9) AS delta FROM a LEFT JOIN b ON a.lang = b.lang
""")
def precision_delta(spark, sf):
    """Precision now against a snapshot of another detector's."""
    has = lambda mark: F.contains("text", F.lit(mark))
    flags = table(spark, sf, "documents").select("doc_id", "lang", has("!!").alias("a"), has(" | ").alias("b"))
    rows = flags.join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("bad")), "doc_id")
    at = lambda c: F.try_divide(F.count_if(F.col("bad") & F.col(c)), F.count_if(c))
    now, snapshot = rows.groupBy("lang").agg(at("a").alias("p")), rows.groupBy("lang").agg(at("b").alias("q"))
    return now.join(snapshot, "lang", "left").select("lang", F.round("p", 9).alias("precision"), F.round(F.col("p") - F.col("q"), 9).alias("delta"))


@query("""
SELECT seen, count(*) AS false_fires FROM (
  SELECT CASE WHEN contains(text, 'License') THEN 'license' WHEN contains(text, '@') THEN 'contact' ELSE 'nothing' END AS seen FROM documents JOIN labels USING (doc_id)
  WHERE quality = 1 AND (contains(text, 'http') OR contains(text, '.\n'))) GROUP BY seen
""")
def confusion_detail(spark, sf):
    """False fires by what was there instead."""
    from ..functions.tokens import contains_any, first_match

    fires = contains_any(F.col("text"), ["http", ".\n"])
    seen = F.coalesce(first_match(F.col("text"), (("License", "license"), ("@", "contact"))), F.lit("nothing"))
    fired = table(spark, sf, "documents").where(fires).select("doc_id", seen.alias("seen"))
    rows = fired.join(table(spark, sf, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("seen").agg(F.count("*").alias("false_fires"))


@query("""
SELECT event_type, count(*) FILTER (value > 50) AS detected, count(*) FILTER (value > 50 AND value % 7 < 1) AS not_maskable, round(median(CASE WHEN value > 50 THEN value END), 6) AS median_hit FROM events GROUP BY event_type
""")
def detected_not_maskable(spark, sf):
    v = F.col("value")
    rows = table(spark, sf, "events").select("event_type", "value")
    out = with_percentiles(rows, ["event_type"], {"median_hit": ("CASE WHEN value > 50 THEN value END", 0.5, "median")}, F.count_if(v > 50).alias("detected"), F.count_if((v > 50) & (v % 7 < 1)).alias("not_maskable"))
    return out.withColumn("median_hit", F.round("median_hit", 6))


@query("""
SELECT l_returnflag, arg_max(l_discount, (l_extendedprice, -l_linenumber, -l_orderkey)) AS rung, max(l_extendedprice) AS best FROM lineitem GROUP BY l_returnflag
""")
def best_of_ladder(spark, sf):
    """The best rung; the earliest of equals."""
    order = F.struct("l_extendedprice", -F.col("l_linenumber"), -F.col("l_orderkey"))
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.max_by("l_discount", order).alias("rung"), F.max("l_extendedprice").alias("best"))


@query("""
SELECT label, round(10 * log10(65025.0 / (sum(se) / sum(n))), 7) AS psnr, count(*) AS frames FROM (
  SELECT label, list_sum(list_transform(list_zip(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS se, len(embedding) AS n FROM embeddings) GROUP BY label
""")
def pooled_video_fidelity(spark, sf):
    """One PSNR over all frames of a group, not the mean of theirs; a frame that one side lacks would fail the query."""
    from ..functions.vectors import mean_squared_error
    from ..operators.video import matched_frames, pooled_psnr

    e = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("x"))
    both = matched_frames(e, e.select("label", "vec_id", F.reverse("x").alias("y")), ["label", "vec_id"])
    n = F.size("x")
    frames = both.select("label", (mean_squared_error(F.col("x"), F.col("y")) * n).alias("squared_error"), n.alias("n_values"), F.lit(None).cast("double").alias("ssim"))
    return pooled_psnr(frames, "label").select("label", F.round("psnr", 7).alias("psnr"), "frames")


@query("SELECT o_orderstatus, o_orderpriority || '/' || year(o_orderdate) AS key, count(*) AS n FROM orders GROUP BY ALL")
def composite_key_counts(spark, sf):
    key = F.concat("o_orderpriority", F.lit("/"), F.year("o_orderdate").cast("string"))
    return table(spark, sf, "orders").groupBy("o_orderstatus", key.alias("key")).agg(F.count("*").alias("n"))
