"""Joins and rollups of evaluation runs, as functions of tables and columns.

Arrays in results are sorted or in a stated order, so that rows do not depend on how the input was dealt.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import wilson
from .audit import diff_classes
from .quantiles import percentiles, with_percentiles
from .temporal import greedy_suppress

# What a labeller saw to the mark it names, and the marks that one crop lets a labeller rule on.
SEEN_MARKS = (("doubao", "doubao"), ("jimeng", "jimeng"), ("pill", "jimeng_pill"), ("sparkle", "gemini"))
ADJUDICATES = (("doubao", ("doubao", "jimeng")), ("jimeng", ("doubao", "jimeng")), ("jimeng_pill", ("jimeng_pill",)), ("gemini", ("gemini",)), ("samsung", ("samsung",)))
UNCERTAIN = "uncertain"


def _case(value: Column, pairs: Sequence[tuple], other: Column | None = None) -> Column:
    out = F.lit(None) if other is None else other
    for key, made in reversed(pairs):
        out = F.when(value == key, made if isinstance(made, Column) else F.lit(made)).otherwise(out)
    return out


def ground_truth(labels: DataFrame, manifest: DataFrame, order: str = "line") -> DataFrame:
    """(uid, path, present, seen, rounds, adjudicated): what labellers saw on each asset over all rounds.

    ``labels`` (round, idx, seen, order) and ``manifest`` (round, idx, uid, path, key) meet on round and idx; of several labels of one idx the
    last counts. A doubtful label says nothing and is left out. A crop lets its labeller rule only on marks of its own
    corner, so ``adjudicated`` lists those; a mark outside it is neither present nor absent.
    """
    last = labels.groupBy("round", "idx").agg(F.max_by("seen", order).alias("seen"))
    both = manifest.join(last, ["round", "idx"]).where(F.col("seen") != UNCERTAIN)
    marks = _case(F.col("key"), [(k, F.array(*map(F.lit, v))) for k, v in ADJUDICATES], F.array("key"))
    rows = both.select("uid", "path", "round", "seen", _case(F.col("seen"), SEEN_MARKS).cast("string").alias("mark"), marks.alias("ruled"))
    each = lambda c: F.array_sort(F.collect_set(c))
    out = rows.groupBy("uid").agg(F.min("path").alias("path"), each("mark").alias("present"), each("seen").alias("seen"), each("round").alias("rounds"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("ruled")))).alias("adjudicated"))
    return out


# What a recorded watermark says of marks, by the text that it holds.
SIDECAR_MARKS = (("China AIGC label", ("doubao", "jimeng")), ("C2PA Content Credentials (Google LLC", ("gemini",)), ("Samsung Galaxy AI", ("samsung",)))


def sidecar_provenance(truth: DataFrame, sidecars: DataFrame) -> DataFrame:
    """``truth`` with ``provenance``: the marks that the metadata of each asset confirms, in a stated order, from its sidecar (uid, watermarks).

    It comes from the recorded verdict and never from the labels, which would hand a detector the answer. Without a sidecar it is empty.
    """
    said = F.array_join("watermarks", " | ")
    marks = F.flatten(F.array_compact(F.array(*(F.when(F.contains(said, F.lit(t)), F.array(*map(F.lit, m))) for t, m in SIDECAR_MARKS))))
    found = sidecars.groupBy("uid").agg(F.min(marks).alias("provenance"))
    return truth.join(found, "uid", "left").withColumn("provenance", F.coalesce("provenance", F.array().cast("array<string>")))


def match_faces(before: DataFrame, after: DataFrame, key: str, most: float = 0.6) -> DataFrame:
    """(key, a, b, distance): faces (key, id, x, y, w, h) of two versions of an image, nearest centres first, each once, and none farther
    than a share of the first one's diagonal.

    Faces of equal boxes meet as one. A box looks in the nine cells around its centre of a grid whose step is the next power of two above
    its reach; the other side is in the grid of each step that its key has.
    """
    from ..functions.geometry import centre_distance, diagonal
    from .temporal import match_classes

    def boxes(faces: DataFrame) -> DataFrame:
        sets = faces.dropna(subset=[key, *"xywh"]).groupBy(key, *"xywh").agg(F.collect_set("id").alias("ids"))
        return sets.select(key, "ids", F.concat_ws(",", *"xywh").alias("class"), F.struct(*"xywh").alias("box"))

    def cell(at: str, size: str) -> Column:
        return F.floor((F.col(f"box.{at}") + F.col(f"box.{size}") / 2) / F.pow(F.lit(2.0), F.col("level")))

    around = lambda c: F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda n: c + n))
    p, q = boxes(before).withColumn("reach", most * diagonal(F.col("box"))), boxes(after)
    level = F.coalesce(F.floor(F.log2(F.col("reach") * 1.01)) + 1, F.lit(0))  # a hundredth more than needed, for rounding
    steps = p.select(key, level.alias("level"))
    asked = p.withColumn("level", level).withColumn("i", around(cell("x", "w"))).withColumn("j", around(cell("y", "h")))
    asked = asked.select(key, "level", "i", "j", "reach", F.col("class").alias("a"), F.col("box").alias("_p"))
    held = q.join(steps.distinct(), key).select(key, "level", cell("x", "w").alias("i"), cell("y", "h").alias("j"), F.col("class").alias("b"), F.col("box").alias("_q"))
    pairs = asked.join(held, [key, "level", "i", "j"]).withColumn("distance", centre_distance(F.col("_p"), F.col("_q"))).where("distance <= reach")
    members = p.select(key, "class", F.col("ids").alias("left")).unionByName(q.select(key, "class", F.col("ids").alias("right")), allowMissingColumns=True)
    return match_classes(pairs.select(key, "a", "b", "distance"), members, key)


def sidecar_status(sidecars: DataFrame, fresh: DataFrame) -> DataFrame:
    """(uid, status, classes) of every recorded verdict against a fresh one.

    ``sidecars`` (uid, readable, ai, families, platform, confidence) has one row a recorded file, ``fresh`` (uid, error, ai, families, platform,
    confidence) one for each image found. A row is never lost: what cannot be compared has a status that says why.
    """
    fields = ("ai", "families", "platform", "confidence")
    a = sidecars.select("uid", "readable", *(F.col(f).alias(f"old_{f}") for f in fields))
    b = fresh.select("uid", F.lit(True).alias("found"), "error", *(F.col(f).alias(f"new_{f}") for f in fields))
    status = F.when(~F.coalesce("readable", F.lit(False)), "sidecar_unreadable").when(F.col("found").isNull(), "image_missing").when(F.col("error").isNotNull(), "identify_raised").otherwise("ok")
    old, new = (F.coalesce(c, F.lit(False)) for c in ("old_ai", "new_ai"))
    moved = diff_classes(F.col("old_families"), F.col("new_families"))
    lost, gained = F.exists(moved, lambda x: F.startswith(x, F.lit("lost_"))), F.exists(moved, lambda x: F.startswith(x, F.lit("new_")))
    other = lambda f: ~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}"))
    classes = F.array_compact(
        F.array(F.when(old & ~new, "lost_ai"), F.when(~old & new, "new_ai"), F.when(lost, "lost_signal"), F.when(gained, "new_signal"), F.when(other("platform"), "platform"), F.when(other("confidence"), "confidence"))
    )
    classes = F.when(F.size(classes) > 0, classes).otherwise(F.array(F.lit("unchanged")))
    return a.join(b, "uid", "left").select("uid", status.alias("status"), F.when(status == "ok", classes).alias("classes"))


def against_baseline(new: DataFrame, baseline: DataFrame, key: str, order: Sequence[str], fields: Sequence[str], error: str | None = None) -> DataFrame:
    """(key, field...) of the rows of ``new`` whose fields differ from the baseline's last row of the key, as struct(before, after) or NULL where equal.

    A baseline is a log that was added to, so of several rows of a key the last by ``order`` counts; rows with an ``error`` do not.
    Keys that only one side has are not changes.
    """
    known = baseline if error is None else baseline.where(F.col(error).isNull())
    last = known.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_before"))
    both = new.select(key, F.struct(*fields).alias("_after")).join(last, key)
    change = [F.when(~F.col(f"_before.{f}").eqNullSafe(F.col(f"_after.{f}")), F.struct(F.col(f"_before.{f}").alias("before"), F.col(f"_after.{f}").alias("after"))).alias(f) for f in fields]
    return both.where(~F.col("_before").eqNullSafe(F.col("_after"))).select(key, *change)


def paired_sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, n_left, n_right, status): originals and cleaned files by stem, with how many files each side has of it."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    both = a.join(b, key, "full_outer").select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right")))
    status = F.when(F.col("n_right") == 0, "only_left").when(F.col("n_left") == 0, "only_right").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "ambiguous").otherwise("paired")
    return both.withColumn("status", status)


def fidelity_table(variants: DataFrame, faces: DataFrame) -> DataFrame:
    """One row a variant of ``variants`` (variant, cer, lpips, ssim, psnr) with the faces (variant, identity, lpips, lapvar_ratio) of it.

    A face without a match has a null identity and still counts; a variant without faces has n_faces 0 and NULL means.
    """
    of = faces.groupBy("variant").agg(F.count("*").alias("n_faces"), F.avg("identity").alias("identity"), F.avg("lpips").alias("face_lpips"), F.avg("lapvar_ratio").alias("lapvar_ratio"))
    return variants.join(of, "variant", "left").select("variant", "cer", F.coalesce("n_faces", F.lit(0)).alias("n_faces"), "identity", "face_lpips", "lapvar_ratio", "lpips", "ssim", "psnr")


def batch_summary(outcomes: DataFrame) -> DataFrame:
    """One row (processed, failed, unavailable, first_error) of per-file outcomes (path, outcome, error): a file with an error failed, any other was processed."""
    failed = F.col("error").isNotNull()
    return outcomes.agg(F.count_if(~failed).alias("processed"), F.count_if(failed).alias("failed"), F.count_if(~failed & (F.col("outcome") == "unavailable")).alias("unavailable"), F.min_by("error", F.when(failed, F.col("path"))).alias("first_error"))


def merge_detections(detections: Sequence[DataFrame], keys: list[str], least: float, threshold: float = 0.5) -> DataFrame:
    """The detections (keys, text, score, x, y, w, h) of several models over the same images: of those at one place the best score stays."""
    rows = detections[0]
    for more in detections[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("text", F.trim("text")).where((F.col("score") >= least) & (F.col("text") != ""))
    return greedy_suppress(rows, keys, threshold)


def cohort_report(members: DataFrame, fired: DataFrame, cohort: str, product: str, least: int, top: int = 4) -> DataFrame:
    """(cohort, n, share, detectors, products, shown) of ``members`` (path, cohort, product) and the detectors that ``fired`` (path, detector).

    ``share`` is that of members where some detector fires; ``detectors`` names the ``top`` ones as detector:count, most first. Cohorts below
    ``least`` come with shown = false, so that they can be counted.
    """
    fires = fired.select("path", "detector").distinct()
    any_of = fires.select("path").distinct().withColumn("_hit", F.lit(1))
    base = members.join(any_of, "path", "left").groupBy(cohort).agg(F.count("*").alias("n"), F.count("_hit").alias("hits"), F.count_distinct(product).alias("products"))
    counts = members.select("path", cohort).join(fires, "path").groupBy(cohort, "detector").agg(F.count("*").alias("k"))
    place = Window.partitionBy(cohort).orderBy(F.desc("k"), "detector")
    best = counts.withColumn("r", F.row_number().over(place)).where(F.col("r") <= top)
    names = best.groupBy(cohort).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat("detector", F.lit(":"), F.col("k").cast("string")).alias("t")))), lambda x: x["t"]), ", ").alias("detectors"))
    return base.join(names, cohort, "left").select(cohort, "n", (F.col("hits") / F.col("n")).alias("share"), F.coalesce("detectors", F.lit("")).alias("detectors"), "products", (F.col("n") >= least).alias("shown"))


def coverage_fit(rows: DataFrame, key: str, value: str, low: float, high: float, step: float = 0.002) -> DataFrame:
    """(key, fraction, coverage): the fraction f of a grid with the most values in [f * low, f * high], the smallest of equals.

    The grid runs from 0.9 of the least to 1.1 of the largest value. A value is covered by a run of the grid's points, so each row is
    two steps of a running sum, and no row meets the whole grid.
    """
    ends = rows.where(F.col(value).isNotNull()).groupBy(key).agg((F.min(value) * 0.9).alias("_start"), F.max(value).alias("_max"), F.count("*").alias("_n"))
    points = F.ceil((F.col("_max") * 1.1 - F.col("_start")) / step)
    at = rows.where(F.col(value).isNotNull()).join(ends, key).withColumn("_points", points)
    first = F.greatest(F.lit(0), F.ceil((F.col(value) / high - F.col("_start")) / step))
    after = F.least(F.col("_points"), F.floor((F.col(value) / low - F.col("_start")) / step) + 1)
    steps = at.where(after > first).select(key, F.explode(F.array(F.struct(first.cast("long").alias("i"), F.lit(1).alias("d")), F.struct(after.cast("long").alias("i"), F.lit(-1).alias("d")))).alias("s"))
    sums = steps.groupBy(key, "s.i").agg(F.sum("s.d").alias("d"))
    covered = sums.withColumn("c", F.sum("d").over(Window.partitionBy(key).orderBy("i")))
    best = covered.groupBy(key).agg(F.max_by("i", F.struct("c", (-F.col("i")).alias("first"))).alias("i"), F.max("c").alias("c"))
    return ends.join(best, key, "left").select(key, (F.col("_start") + F.coalesce("i", F.lit(0)) * step).alias("fraction"), (F.coalesce("c", F.lit(0)) / F.col("_n")).alias("coverage"))


def arms(rows: DataFrame, score: str = "score") -> DataFrame:
    """(arm, n, p50, p75, p90, p95, p99, top) of rows (arm, score): how a probe's scores lie in each arm, by linear interpolation."""
    wanted = {f"p{q}": (score, q / 100, "cont") for q in (50, 75, 90, 95, 99)}
    return with_percentiles(rows, ["arm"], wanted, F.count("*").alias("n"), F.max(score).alias("top")).select("arm", "n", *wanted, "top")


def probe_points(rows: DataFrame, score: str = "score", clean: str = "clean", probed: str = "uncovered", at: Sequence[float] = (0.95, 0.975, 0.99, 0.995, 0.999)) -> DataFrame:
    """(quantile, threshold, clean_rate, probed_rate, candidates): thresholds at percentiles of the clean arm, and what fires above each in both arms."""
    wanted = {f"q{i}": (score, q, "cont") for i, q in enumerate(at)}
    gates = percentiles(rows.where(F.col("arm") == clean).select(score), [], wanted)
    each = F.explode(F.array(*(F.struct(F.lit(q).alias("quantile"), F.col(f"q{i}").alias("threshold")) for i, q in enumerate(at))))
    gates = F.broadcast(gates.select(each.alias("g")).select("g.*"))  # a row a point
    over = rows.where(F.col("arm").isin(clean, probed)).join(gates, F.lit(True)).withColumn("_fires", F.col(score) >= F.col("threshold"))
    rate = lambda arm: F.avg(F.when(F.col("arm") == arm, F.col("_fires").cast("int")))
    return over.groupBy("quantile").agg(F.max("threshold").alias("threshold"), rate(clean).alias("clean_rate"), rate(probed).alias("probed_rate"), F.count_if((F.col("arm") == probed) & F.col("_fires")).alias("candidates"))


def gate_quality(rows: DataFrame, keys: Sequence[str], fired: Column, true: Column) -> DataFrame:
    """(keys, tp, fp, fn, precision, recall and the ends of their 95 % intervals) of a gate against the truth."""
    counts = rows.groupBy(*keys).agg(F.count_if(fired & true).alias("tp"), F.count_if(fired & ~true).alias("fp"), F.count_if(~fired & true).alias("fn"))
    named = {}
    for name, other in (("precision", "fp"), ("recall", "fn")):
        n = F.col("tp") + F.col(other)
        w = wilson(F.col("tp"), n)
        named |= {name: F.try_divide(F.col("tp"), n), f"{name}_low": w["low"], f"{name}_high": w["high"]}
    return counts.withColumns(named)


def first_wins(maps: Sequence[Column]) -> Column:
    """One map of several: of a key that more than one has, the value of the first. NULL maps count as empty."""
    entries = F.concat(*(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))) for m in maps))
    return F.aggregate(
        entries, F.create_map().cast("map<string,string>"), lambda done, e: F.when(F.map_contains_key(done, e["key"]), done).otherwise(F.map_concat(done, F.map_from_entries(F.array(e))))
    )
