"""Stable marks from hand-made frames, as a table and as a stream."""

import time

import pytest
from pyspark.sql import functions as F

from tracelight.operators import temporal
from tracelight.streaming import stable_marks

BOX = (10, 10, 40, 20)


def frames(n, confidence=0.9, box=BOX, start=0):
    return [(start + i, confidence, box) for i in range(n)]


def run(rows, **kw):
    p = {"provenance": False, "weak": 0.5, "strong": 0.6, "transition": 0.4, "min_frames": 5, "carries": False, "anchor_iou": None} | kw
    return temporal.stabilise(rows, **p)


def test_short_and_weak_runs_go():
    assert run(frames(4)) == [None] * 4
    assert run(frames(6, 0.55)) == [None] * 6
    assert run(frames(6, 0.55), provenance=True) == [BOX] * 6
    assert run(frames(6)) == [BOX] * 6


def test_weak_frames_are_skipped_not_breakers():
    rows = frames(3) + [(3, 0.1, BOX)] + frames(3, start=4)
    assert run(rows) == [BOX] * 7


def test_gap_breaks_a_run():
    assert run(frames(4) + frames(4, start=9)) == [None] * 8
    assert run(frames(4) + frames(4, start=7)) == [BOX] * 8


def test_fill_from_the_nearer_side():
    moved = (14, 10, 40, 20)
    rows = frames(5) + [(5, 0.0, None), (6, 0.0, None), (7, 0.0, None)] + frames(5, box=moved, start=8)
    assert run(rows)[5:8] == [BOX, BOX, moved]


def test_anchor():
    drift = [(i, 0.9, (10 + 4 * i, 10, 40, 20)) for i in range(8)]
    assert all(run(drift, anchor_iou=None))
    assert not any(run(drift, anchor_iou=0.8))


def test_carry():
    rows = [(0, 0.0, None), *frames(5, start=1), (6, 0.45, (11, 10, 40, 20)), (7, 0.45, (200, 10, 40, 20))]
    assert run(rows) == [None, *[BOX] * 5, None, None]
    assert run(rows, carries=True) == [BOX, *[BOX] * 5, (11, 10, 40, 20), BOX]


SCHEMA = "video string, mark string, frame_index int, confidence double, x int, y int, w int, h int"


@pytest.fixture
def table(spark):
    rows = [("v", "veo", i, 0.9, *BOX) for i in range(14)] + [("v", "sora", i, 0.9, *BOX) for i in range(3)] + [("u", "kling", i, 0.9, None, None, None, None) for i in range(5)]
    return spark.createDataFrame(rows, SCHEMA)


def test_table(spark, table):
    out = temporal.stable_regions(table)
    assert {(r.video, r.mark, r.accepted) for r in out.collect()} == {("v", "veo", True), ("v", "sora", False), ("u", "kling", False)}
    assert {(r.video, r.mark) for r in temporal.first_stable_mark(out).collect()} == {("v", "veo"), ("u", None)}
    known = spark.createDataFrame([("v", "veo")], "video string, mark string")
    low = table.where("mark = 'veo'").withColumn("confidence", table.confidence * 0 + 0.46)
    assert not any(r.accepted for r in temporal.stable_regions(low).collect())
    assert all(r.accepted for r in temporal.stable_regions(low, known).collect())


def test_stream(spark, table, tmp_path):
    src = str(tmp_path / "in")
    table.where("frame_index < 7").write.parquet(src)
    out = stable_marks(spark.readStream.schema(SCHEMA).parquet(src))
    q = out.writeStream.format("memory").queryName("marks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        assert spark.sql("SELECT * FROM marks").count() == 0
        time.sleep(1)
        table.where("frame_index >= 7").write.mode("append").parquet(src)
        q.processAllAvailable()
        assert [tuple(r) for r in spark.sql("SELECT * FROM marks").collect()] == [("v", "veo", 11, 12)]
    finally:
        q.stop()


def test_lines_and_greedy(spark):
    rows = spark.createDataFrame([(1, 0, "en", 0, 50), (1, 1, "en", 100, 50), (1, 2, "zh", 160, 50), (1, 3, "zh", 400, 50)], "k int, i int, s string, top int, h int")
    assert [r.line for r in temporal.line_groups(rows, ["k"], ["i"], "s", "top", "h").orderBy("i").collect()] == [1, 1, 2, 3]
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10, 0.9), (1, 1, 0, 10, 10, 0.8), (1, 50, 0, 10, 10, 0.7)], "k int, x int, y int, w int, h int, score double")
    assert sorted(r.score for r in temporal.greedy_suppress(boxes, ["k"]).collect()) == [0.7, 0.9]
    pairs = spark.createDataFrame([(1, "a", "x", 1.0), (1, "a", "y", 0.5), (1, "b", "y", 0.6), (1, "b", "x", 2.0)], "k int, l string, r string, d double")
    assert sorted((p.l, p.r) for p in temporal.match_one_to_one(pairs, ["k"], "l", "r", "d").collect()) == [("a", "y"), ("b", "x")]


def test_equal_boxes_are_suppressed_in_a_fixed_order(spark):
    """Of copies of a box the first by the other columns stays; nulls come last, and columns without an order do not count."""
    rows = [(1, 0, 0, 10, 10, 0.9, name, i, [i]) for name, i in (("b", 1), (None, 0), ("a", 3), ("a", 2))]
    for given in (rows, rows[::-1]):
        boxes = spark.createDataFrame(given, "k int, x int, y int, w int, h int, score double, name string, id int, more array<int>").coalesce(1)
        assert [(r.name, r.id) for r in temporal.greedy_suppress(boxes, ["k"]).collect()] == [("a", 2)]


def test_nms_of_copied_parts(spark, sf, tmp_path):
    """Parts repeated with shifted keys: the smallest key of equal boxes, as in the SQL."""
    import duckdb

    from tracelight import plans

    plans.load()
    part = spark.read.parquet(f"{sf}/part.parquet")
    part.crossJoin(spark.range(3).withColumnRenamed("id", "copy")).withColumn("p_partkey", F.col("p_partkey") + 6000 * (2 - F.col("copy"))).drop("copy").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    names = ["p_brand", "k", "x", "y", "w", "h", "score"]
    got = [tuple(r) for r in plans.QUERIES["nms"](spark, str(tmp_path)).select(names).collect()]
    assert sorted(got) == sorted(con.sql(plans.SQL["nms"]).select(*names).fetchall())


def test_videos(spark, table):
    from tracelight.operators import video

    marks = temporal.stable_regions(table)
    rows = [("v", {}), ("u", {"issuer": "Google LLC", "claim_generator": "x", "source_type": "trainedAlgorithmicMedia"}), ("w", None)]
    videos = spark.createDataFrame(rows, "video string, markers map<string,string>")
    got = {r.video: r for r in video.identify_videos(videos, marks).collect()}
    assert (got["v"].is_ai_generated, got["v"].confidence, got["v"].platform, got["v"].visible_mark, got["v"].detected_frames) == (True, "high", "Google Veo", "veo", 14)
    assert got["u"].platform == "Google (Gemini / Imagen)" and got["w"].is_ai_generated is None and got["w"].confidence == "unknown" and len(got["w"].caveats) == 2
    assert [r[0] for r in videos.orderBy("video").select(video.metadata_provenance(videos.markers)).collect()] == [["veo"], [], []]
    ts = spark.createDataFrame([("a", i, i * 0.04) for i in range(10)] + [("b", i, i * 0.04 + (0.03 if i == 5 else 0)) for i in range(10)], "video string, frame_index int, ts double")
    assert {r.video: r.variable for r in video.variable_rate(ts).collect()} == {"a": False, "b": True}
    words = spark.createDataFrame([(1, 0, 0, 10, 10), (1, 14, 1, 20, 11), (1, 0, 40, 10, 50), (1, 200, 0, 220, 10)], "k int, x1 int, y1 int, x2 int, y2 int")
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in video.merge_words(words, ["k"]).collect()) == [(0, 0, 20, 11), (0, 40, 10, 50), (200, 0, 220, 10)]


@pytest.mark.parametrize("seed", range(3))
def test_windows_are_the_fold(spark, seed):
    """Random frames of marks without an anchor rule: windows against the fold, with and without provenance."""
    import random

    rng = random.Random(seed)
    rows, known = [], []
    for v in range(25):
        mark = rng.choice(("sora", "veo"))
        if rng.random() < 0.4:
            known.append((f"v{v}", mark))
        x = 10
        for i in range(rng.randint(1, 80)):
            if rng.random() < 0.1:
                continue
            x += rng.choice((0, 0, 0, 0, 2, 30)) * (rng.random() < 0.3)
            shown = rng.random() < 0.85
            box = (x, 10, 40, 20) if shown else (None,) * 4
            rows.append((f"v{v}", mark, i, rng.choice((None, 0.2, 0.4, 0.5, 0.6, 0.7)), *box))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sure = spark.createDataFrame(known, "video string, mark string") if known else None
    policy = {p[0]: p for p in temporal.VIDEO_POLICIES}
    want = []
    for v, mark in sorted({r[:2] for r in rows}):
        own = sorted((r for r in rows if r[:2] == (v, mark)), key=lambda r: r[2])
        _, weak, prov_weak, strong, transition, frames_, carries, anchor, accepts = policy[mark]
        yes = (v, mark) in known and accepts
        out = temporal.stabilise([(r[2], r[3] or 0.0, r[4:] if r[4] is not None else None) for r in own], yes, prov_weak if yes else weak, strong, transition, frames_, carries, anchor)
        want += [(v, mark, r[2], b is not None, *(b or (None,) * 4)) for r, b in zip(own, out, strict=True)]
    got = sorted(map(tuple, temporal.stable_regions(df, sure).collect()), key=str)
    assert got == sorted(want, key=str)
    assert any(r[3] for r in want) and not all(r[3] for r in want)
