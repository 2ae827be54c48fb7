"""Runs, carries and windows over ordered rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.temporal import first_stable_mark as first_mark
from ..operators.temporal import line_groups as group_lines
from ..operators.registries import STABLE_GAP, VIDEO_POLICIES
from ..operators.temporal import stable_regions
from . import query, table

_POLICY = ", ".join(f"('{mark}', {weak}, {strong}, {frames}, {str(carries).lower()}, {i})" for i, (mark, weak, _, strong, _, frames, carries, *_) in enumerate(VIDEO_POLICIES))
#: In these frames boxes are equal for thirty frames and hardly overlap after that, so the overlap rules say whether a block is the same.
_RUNS = f"""
WITH p(mark, weak, strong, min_frames, carries, place) AS (VALUES {_POLICY}),
f AS (
  SELECT user_id::VARCHAR AS video, (['veo', 'dola', 'sora'])[user_id % 3 + 1] AS mark, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fr, value / 100 AS confidence, event_type <> 'logout' AS shown FROM events
),
s AS (
  SELECT f.*, min_frames, strong, CASE WHEN lag(fr) OVER w IS NULL OR fr - lag(fr) OVER w > {STABLE_GAP} + 1 OR fr // 30 <> lag(fr // 30) OVER w THEN 1 ELSE 0 END AS new
  FROM f JOIN p USING (mark) WHERE shown AND confidence >= weak WINDOW w AS (PARTITION BY video ORDER BY fr)
),
r AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY fr) AS run FROM s),
k AS (SELECT video, max(fr) - min(fr) + 1 AS covered FROM r GROUP BY video, run HAVING count(*) >= any_value(min_frames) AND max(confidence) >= any_value(strong)),
c AS (SELECT video, sum(covered) AS covered FROM k GROUP BY video),
a AS (SELECT f.video, mark, any_value(place) AS place, count(*) AS frames, (CASE WHEN any_value(covered) IS NULL THEN 0 WHEN any_value(carries) THEN count(*) ELSE any_value(covered) END)::BIGINT AS accepted FROM f JOIN p USING (mark) LEFT JOIN c ON c.video = f.video GROUP BY f.video, mark)
"""


@query("""
WITH e AS (SELECT user_id, event_id, ts, value, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)
SELECT user_id, run::BIGINT AS run, count(*) AS n, max(value) AS strongest, count(*) >= 3 AND max(value) >= 60 AS stable FROM r GROUP BY user_id, run
""")
def ordered_runs(spark, sf):
    """Runs of rows less than a day apart, accepted when long and strong enough."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "value").withColumn("prev", F.lag("ts").over(w))
    new = F.col("prev").isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev").cast("timestamp")) > 86_400_000_000)
    e = e.withColumn("run", F.sum(new.cast("long")).over(w))
    return e.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.max("value").alias("strongest"), ((F.count("*") >= 3) & (F.max("value") >= 60)).alias("stable"))


@query("""
SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),
  first_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS carried FROM events
""")
def carry_fill(spark, sf):
    """The last confirmed value carried on; leading rows take the first."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sure = F.when(F.col("event_type") == "click", F.col("value"))
    last = F.last(sure, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(sure, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return table(spark, sf, "events").select("user_id", "event_id", F.coalesce(last, first).alias("carried"))


@query("""
WITH t AS (SELECT conv_id, turn, role, length(text) AS h, turn * 40 AS top FROM conversations),
g AS (SELECT conv_id, turn, CASE WHEN lag(role) OVER w IS NULL OR role <> lag(role) OVER w OR top - lag(top + h) OVER w > greatest(60.0, 1.1 * lag(h) OVER w) THEN 1 ELSE 0 END AS new FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, h))
SELECT conv_id, turn, sum(new) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS line FROM g
""")
def line_groups(spark, sf):
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("h"), (F.col("turn") * 40).alias("top"))
    return group_lines(rows, ["conv_id"], ["turn", "role", "h"], "role", "top", "h").select("conv_id", "turn", "line")


def _frames(spark, sf):
    """Events as frame detections: two marks, a box that jumps now and then, a gap where the box is missing."""
    marks = F.element_at(F.array(F.lit("veo"), F.lit("dola"), F.lit("sora")), (F.col("user_id") % 3 + 1).cast("int"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").select("user_id", "event_id", "value", "ts", "event_type")
    e = e.withColumn("frame_index", F.row_number().over(order).cast("int"))
    shown = F.col("event_type") != "logout"
    x = F.when(shown, F.floor(F.col("frame_index") / 30).cast("int") * 40)
    return e.select(
        F.col("user_id").cast("string").alias("video"), marks.alias("mark"), "frame_index", (F.col("value") / 100).alias("confidence"),
        x.alias("x"), F.when(shown, 10).alias("y"), F.when(shown, 50).alias("w"), F.when(shown, 20).alias("h"),
    )


@query(f"{_RUNS} SELECT video, mark, frames, accepted FROM a")
def anchored_runs(spark, sf):
    """The anchored fold with gap filling and carrying; tests/test_temporal.py holds it against hand-made frames that drift."""
    return stable_regions(_frames(spark, sf)).groupBy("video", "mark").agg(F.count("*").alias("frames"), F.count_if("accepted").alias("accepted"))


@query(f"{_RUNS} SELECT video, arg_min(mark, place) FILTER (accepted > 0) AS mark FROM a GROUP BY video")
def first_stable_mark(spark, sf):
    return first_mark(stable_regions(_frames(spark, sf)))


@query("""
WITH e AS (SELECT user_id, ts, event_id, value, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session
""")
def session_windows(spark, sf):
    """Sessions that end after four quiet hours."""
    e = table(spark, sf, "events").select("user_id", "ts", "value")
    return e.groupBy("user_id", F.session_window("ts", "4 hours")).agg(F.min("ts").alias("started"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("session_window")


@query("""
SELECT time_bucket(INTERVAL '1 day', ts) AS day, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL
""")
def tumbling_windows(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean")).select(F.col("w.start").alias("day"), "event_type", "n", "mean")
