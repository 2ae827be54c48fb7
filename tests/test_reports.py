"""Report operators on hand-made rows."""

import math
import random

import pytest

from tracelight.operators import reports
from tracelight.operators.video import matched_frames


def test_ground_truth(spark):
    labels = spark.createDataFrame([("a", 1, "doubao", 0), ("a", 1, "pill", 1), ("a", 2, "uncertain", 0), ("b", 1, "nothing", 0), ("b", 9, "sparkle", 0)], "round string, idx int, seen string, line int")
    manifest = spark.createDataFrame([("a", 1, "u", "p", "doubao"), ("a", 2, "u", "p", "gemini"), ("b", 1, "u", "p", "new"), ("b", 2, "v", "q", "gemini")], "round string, idx int, uid string, path string, key string")
    (r,) = reports.ground_truth(labels, manifest).collect()
    assert (r.uid, r.path, r.present, r.seen, r.rounds, r.adjudicated) == ("u", "p", ["jimeng_pill"], ["nothing", "pill"], ["a", "b"], ["doubao", "jimeng", "new"])


def test_sidecar_status(spark):
    old = spark.createDataFrame([(1, True, True, ["a"], "x", "high"), (2, False, None, None, None, None), (3, True, None, [], None, "none"), (4, True, True, [], "x", "high"), (5, True, None, None, None, "none")], "uid int, readable boolean, ai boolean, families array<string>, platform string, confidence string")
    new = spark.createDataFrame([(1, None, None, ["b"], "x", "none"), (2, None, None, None, None, None), (4, "E", None, None, None, None), (5, None, None, [], None, "none")], "uid int, error string, ai boolean, families array<string>, platform string, confidence string")
    got = {r.uid: (r.status, r.classes) for r in reports.sidecar_status(old, new).collect()}
    assert got == {1: ("ok", ["lost_ai", "lost_signal", "new_signal", "confidence"]), 2: ("sidecar_unreadable", None), 3: ("image_missing", None), 4: ("identify_raised", None), 5: ("ok", ["unchanged"])}


def test_the_last_baseline_row_wins(spark):
    log = spark.createDataFrame([("a", 1, "x", None), ("a", 2, "y", None), ("a", 3, "z", "failed"), ("b", 1, None, None)], "k string, line int, v string, error string")
    new = spark.createDataFrame([("a", "x"), ("b", None), ("c", "x")], "k string, v string")
    (r,) = reports.against_baseline(new, log, "k", ["line"], ["v"], "error").collect()
    assert (r.k, r.v.before, r.v.after) == ("a", "y", "x")


def test_frames_must_match(spark):
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "i int, x double"), spark.createDataFrame([(1, 3.0), (2, 4.0)], "i int, y double")
    assert sorted(map(tuple, matched_frames(a, b, ["i"]).collect())) == [(1, 1.0, 3.0), (2, 2.0, 4.0)]
    for x, y in ((a, b.where("i = 1")), (a.where("i = 1"), b)):
        with pytest.raises(Exception, match="frames do not match at 2"):
            matched_frames(x, y, ["i"]).count()


def test_fidelity_and_batches(spark):
    variants = spark.createDataFrame([("v", 0.1, 0.2, 0.9, 30.0), ("w", None, 0.3, 0.8, 20.0)], "variant string, cer double, lpips double, ssim double, psnr double")
    faces = spark.createDataFrame([("v", 0.5, 0.1, 1.0), ("v", None, 0.3, 0.5)], "variant string, identity double, lpips double, lapvar_ratio double")
    got = {r.variant: tuple(r)[1:6] for r in reports.fidelity_table(variants, faces).collect()}
    assert got == {"v": (0.1, 2, 0.5, pytest.approx(0.2), 0.75), "w": (None, 0, None, None, None)}
    files = spark.createDataFrame([("b", None, "late"), ("a", "unavailable", "early"), ("c", "unavailable", None), ("d", None, None)], "path string, outcome string, error string")
    assert tuple(reports.batch_summary(files).first()) == (2, 2, 1, "early")
    assert tuple(reports.batch_summary(files.limit(0)).first()) == (0, 0, 0, None)


def test_merge_detections(spark):
    schema = "image string, text string, score double, x int, y int, w int, h int"
    en = spark.createDataFrame([("i", "good ", 0.9, 0, 0, 10, 10), ("i", " ", 0.99, 0, 0, 10, 10), ("j", "a", 0.2, 0, 0, 5, 5)], schema)
    ru = spark.createDataFrame([("i", "worse", 0.8, 1, 0, 10, 10), ("i", "far", 0.7, 50, 0, 10, 10)], schema)
    assert sorted(r.text for r in reports.merge_detections([en, ru], ["image"], 0.5).collect()) == ["far", "good"]


def test_cohorts_and_sides(spark):
    members = spark.createDataFrame([(p, "c1" if p != "z" else "c2", p in "ab") for p in "abcdz"], "path string, uscc string, product boolean")
    fired = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("q", "x")], "path string, detector string")
    got = {r.uscc: tuple(r)[1:] for r in reports.cohort_report(members, fired, "uscc", "product", 2, 1).collect()}
    assert got == {"c1": (4, 0.5, "x:2", 2, True), "c2": (1, 0.0, "", 1, False)}
    side = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert {r.k: r.status for r in reports.paired_sides(side("a", "b", "b", "c"), side("a", "b", "d"), "k").collect()} == {"a": "paired", "b": "ambiguous", "c": "only_left", "d": "only_right"}


def test_coverage(spark):
    values = [0.1, 0.11, 0.12, 0.13, 0.5, 0.52]
    (r,) = reports.coverage_fit(spark.createDataFrame([("k", v) for v in values] + [("k", None)], "k string, v double"), "k", "v", 0.8, 1.2).collect()
    grid = [0.09 + 0.002 * i for i in range(2000) if 0.09 + 0.002 * i < 0.52 * 1.1]
    best = max(grid, key=lambda f: sum(0.8 * f <= v <= 1.2 * f for v in values))
    assert r.fraction == pytest.approx(best) and r.coverage == pytest.approx(4 / 6)


def test_first_wins(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(reports.first_wins([F.create_map(F.lit("a"), F.lit("1")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))]).alias("m")).first()
    assert row.m == {"a": "1", "b": "3"}


FACE = "k int, id int, x double, y double, w double, h double"


def nearest_first(before, after, most=0.6):
    """All pairs of a key, nearest first, each face once."""
    pairs = []
    for k, a, x, y, w, h in before:
        for l, b, x2, y2, w2, h2 in after:
            if k == l and None not in (x, x2):
                dx, dy = x + w / 2 - x2 - w2 / 2, y + h / 2 - y2 - h2 / 2
                d = math.sqrt(dx * dx + dy * dy)
                if d <= most * math.sqrt(w * w + h * h):
                    pairs.append((k, d, a, b))
    used, out = set(), []
    for k, d, a, b in sorted(pairs):
        if not {(k, 0, a), (k, 1, b)} & used:
            used |= {(k, 0, a), (k, 1, b)}
            out.append((k, a, b, d))
    return out


def test_face_matches_by_brute_force(spark):
    """Boxes of all sizes, copies, equal distances, ids in several boxes, nulls, points and keys of one side."""
    r = random.Random(5)
    sides = []
    for side in (0, 1):
        rows = [(k, i, r.uniform(-300, 300), r.uniform(-300, 300), s := 2.0 ** r.uniform(-6, 9), s * r.uniform(0.5, 2)) for k in (1, 2) for i in range(150)]
        rows += [(3, r.randrange(400), *(float(r.randrange(n)) for n in (4, 4, 5, 3))) for _ in range(400)]  # few places, so many copies and ties
        rows += [(3, 1000 + i, 8.0 * (i % 9) - 40, 16.0 * (i % 3), 10.0, 5.0) for i in range(40)]
        sides.append([*rows, rows[0], (4 + side, 1, 0.0, 0.0, 5.0, 5.0), (1, 999, None, 0.0, 1.0, 1.0)])
    want = nearest_first(*sides)
    got = reports.match_faces(*(spark.createDataFrame(x, FACE) for x in sides), "k").collect()
    assert {g.k for g in got} == {1, 2, 3} and len(want) > 300
    assert sorted(map(tuple, got)) == sorted(want)


def test_copied_faces_meet_as_one(spark, monkeypatch):
    """What is matched are pairs of boxes, not of their copies, and boxes out of reach of each other do not meet."""
    from tracelight.operators import temporal

    seen = []
    for name in ("match_one_to_one", "match_classes"):
        real = getattr(temporal, name, None)
        monkeypatch.setattr(temporal, name, lambda pairs, *a, real=real: seen.append(pairs) or real(pairs, *a), raising=False)
    faces = spark.range(400).selectExpr("1 k", "id", "(id % 4) * 100 x", "0 y", "20 w", "20 h")
    got = reports.match_faces(faces, faces.selectExpr("k", "id + 1000 id", "x + 1 x", "y", "w", "h"), "k").collect()
    assert sorted((g.a, g.b, g.distance) for g in got) == [(i, i + 1000, 1.0) for i in range(400)]
    (pairs,) = seen
    assert pairs.count() == 4
    joins = [line for line in pairs._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any("i#" in j and "j#" in j for j in joins), joins


def test_face_matches_of_copied_parts(spark, sf, tmp_path):
    """Parts repeated with shifted keys: copies and equal distances, against the SQL."""
    import duckdb

    from tracelight import plans

    plans.load()
    part = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey < 150")
    part.crossJoin(spark.range(4).withColumnRenamed("id", "copy")).selectExpr("p_partkey + 6000 * copy AS p_partkey", "concat('Brand#', p_partkey div 2 % 2) AS p_brand").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
    got = [tuple(r) for r in plans.QUERIES["face_matches"](spark, str(tmp_path)).select("k", "a", "b", "distance").collect()]
    assert got and sorted(got) == sorted(con.sql(plans.SQL["face_matches"]).select("k", "a", "b", "distance").fetchall())
