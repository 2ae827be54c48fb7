"""Stable marks in ordered frames.

Detections are rows (video, mark, frame_index, confidence, x, y, w, h); a frame without a region has NULLs. Runs
whose mark has no anchor rule are gaps and islands and stay windows; the anchored fold depends on the first row of the
current run and is a group function over one (video, mark).
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import iou
from .registries import STABLE_GAP, STABLE_IOU, VIDEO_POLICIES

POLICY = "mark string, weak double, prov_weak double, strong double, transition double, min_frames int, carries boolean, anchor_iou double, accepts_provenance boolean"
OUT = "video string, mark string, frame_index int, accepted boolean, x int, y int, w int, h int"


def policies(spark) -> DataFrame:
    return spark.createDataFrame(list(VIDEO_POLICIES), POLICY)


def plain_regions(rows: DataFrame) -> DataFrame:
    """The accepted boxes of marks without an anchor rule, by windows over the frames of each (video, mark).

    ``rows`` are detections with their policy and ``sure``, whether metadata confirms the mark. Gaps and islands make the runs, so
    Spark sorts and spills them; nothing holds a video.
    """
    w = Window.partitionBy("video", "mark").orderBy("frame_index")
    box = F.when(F.col("x").isNotNull(), F.struct("x", "y", "w", "h"))
    weak = F.when(F.col("sure"), F.coalesce("prov_weak", "weak")).otherwise(F.col("weak"))
    rows = rows.withColumns({"box": box, "confidence": F.coalesce("confidence", F.lit(0.0))})
    rows = rows.withColumns({"seen": F.col("box").isNotNull() & (F.col("confidence") >= weak), "pos": F.row_number().over(w)})
    here = F.when(F.col("seen"), F.struct("frame_index", "pos", "box"))
    # what follows is what precedes in the reverse order: a frame that ends unbounded is computed anew for every row
    back = Window.partitionBy("video", "mark").orderBy(F.desc("frame_index"))
    rows = rows.withColumn("prev", F.last(here, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.col("prev").isNull() | (F.col("frame_index") - F.col("prev.frame_index") > STABLE_GAP + 1) | (iou(F.col("prev.box"), F.col("box")) < STABLE_IOU)
    rows = rows.withColumn("new", F.col("seen") & new)
    run = Window.partitionBy("video", "mark", "run")
    rows = rows.withColumn("run", F.sum(F.col("new").cast("int")).over(w))
    strongest = F.max(F.when(F.col("seen"), F.col("confidence"))).over(run)
    rows = rows.withColumn("ok", (F.count(F.when(F.col("seen"), 1)).over(run) >= F.col("min_frames")) & (F.col("sure") | (strongest >= F.col("strong"))))
    # what is missing inside a run takes the box of its nearer end, if both ends agree
    rows = rows.withColumn("next", F.last(F.when(F.col("seen"), F.struct("pos", "box", "new")), True).over(back.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.col("ok") & ~F.col("seen") & F.col("next").isNotNull() & ~F.col("next.new") & (iou(F.col("prev.box"), F.col("next.box")) >= STABLE_IOU)
    nearer = F.when(F.col("pos") - F.col("prev.pos") <= F.col("next.pos") - F.col("pos"), F.col("prev.box")).otherwise(F.col("next.box"))
    rows = rows.withColumn("kept", F.when(F.col("seen") & F.col("ok"), F.col("box")).when(inside, nearer))
    # a confirmed mark is there in all frames: where a weaker box overlaps a known one, that box, else the last known, at first the first
    rows = rows.withColumn("spread", (F.col("sure") | F.col("carries")) & F.col("kept").isNull())
    weaker = F.col("spread") & F.col("box").isNotNull() & (F.col("confidence") >= F.col("transition"))
    known = rows.where(F.col("kept").isNotNull()).select("video", "mark", F.col("kept").alias("known")).distinct()
    near = rows.where(weaker).select("video", "mark", "frame_index", "box").join(known, ["video", "mark"]).where(iou(F.col("box"), F.col("known")) >= STABLE_IOU)
    near = near.select("video", "mark", "frame_index", F.lit(True).alias("near")).distinct()
    rows = rows.join(near, ["video", "mark", "frame_index"], "left")
    carried = F.coalesce(F.last("kept", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("kept", True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    out = F.when(F.col("spread") & F.col("near"), F.when(F.max(F.col("kept").isNotNull()).over(Window.partitionBy("video", "mark")), F.col("box"))).when(F.col("spread"), carried).otherwise(F.col("kept"))
    return rows.withColumn("out", out).select("video", "mark", F.col("frame_index").cast("int").alias("frame_index"), F.col("out").isNotNull().alias("accepted"), *(F.col(f"out.{c}").cast("int").alias(c) for c in "xywh"))


def _iou(a, b) -> float:
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = a[2] * a[3] + b[2] * b[3] - both
    return both / union if union > 0 else 0.0


def stabilise(frames: list[tuple], provenance: bool, weak: float, strong: float, transition: float, min_frames: int, carries: bool, anchor_iou: float | None) -> list:
    """The accepted box or None of each frame of (frame_index, confidence, box or None), in order."""
    runs: list[list[int]] = []
    for i, (at, confidence, box) in enumerate(frames):
        if box is None or confidence < weak:
            continue
        run = runs[-1] if runs else None
        last = frames[run[-1]] if run else None
        if last and at - last[0] <= STABLE_GAP + 1 and _iou(last[2], box) >= STABLE_IOU and (anchor_iou is None or _iou(frames[run[0]][2], box) >= anchor_iou):
            run.append(i)
        else:
            runs.append([i])
    out: list = [None] * len(frames)
    for run in runs:
        if len(run) < min_frames or not (provenance or max(frames[i][1] for i in run) >= strong):
            continue
        for i in run:
            out[i] = frames[i][2]
        for a, b in zip(run, run[1:], strict=False):
            if _iou(frames[a][2], frames[b][2]) >= STABLE_IOU:
                for i in range(a + 1, b):
                    out[i] = frames[a if i - a <= b - i else b][2]
    sure = [i for i, box in enumerate(out) if box is not None]
    if sure and (provenance or carries):
        known = list(dict.fromkeys(out[i] for i in sure))  # a still mark has few different boxes
        carry = out[sure[0]]
        confirmed = set(sure)
        for i, (_, confidence, box) in enumerate(frames):
            if i in confirmed:
                carry = out[i]
            elif box is not None and confidence >= transition and any(_iou(box, k) >= STABLE_IOU for k in known):
                out[i] = box
            else:
                out[i] = carry
    return out


def stable_regions(detections: DataFrame, provenance: DataFrame | None = None) -> DataFrame:
    """(video, mark, frame_index, accepted, x, y, w, h): the accepted box of each frame by its mark's policy.

    ``provenance`` (video, mark) names marks that metadata confirms. Marks without an anchor rule go through windows; where a run also
    depends on its own first box, a fold takes one mark of one video at a time.
    """
    rows = detections.join(F.broadcast(policies(detections.sparkSession)), "mark")
    if provenance is not None:
        rows = rows.join(provenance.select("video", "mark", F.lit(True).alias("known")).distinct(), ["video", "mark"], "left")
    else:
        rows = rows.withColumn("known", F.lit(False))
    rows = rows.withColumn("sure", F.coalesce("known", F.lit(False)) & F.col("accepts_provenance")).drop("known")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        p = pdf.iloc[0]
        weak = p.prov_weak if p.sure and not pd.isna(p.prov_weak) else p.weak
        shown = pdf.x.notna().tolist()
        boxes = [tuple(b) if ok else None for ok, *b in zip(shown, *(pdf[c].fillna(0).astype(int).tolist() for c in "xywh"), strict=True)]
        frames = list(zip(pdf.frame_index.tolist(), pdf.confidence.fillna(0.0).tolist(), boxes, strict=True))
        out = stabilise(frames, bool(p.sure), weak, p.strong, p.transition, int(p.min_frames), bool(p.carries), None if pd.isna(p.anchor_iou) else p.anchor_iou)
        made = {k: pd.array([None if b is None else b[j] for b in out], "Int32") for j, k in enumerate("xywh")}
        return pd.DataFrame({"video": pdf.video.to_numpy(), "mark": pdf.mark.to_numpy(), "frame_index": pdf.frame_index.astype("int32").to_numpy(), "accepted": [b is not None for b in out], **made})

    anchored = rows.where(F.col("anchor_iou").isNotNull()).groupBy("video", "mark").applyInPandas(fold, OUT)
    return plain_regions(rows.where(F.col("anchor_iou").isNull())).unionByName(anchored)


def first_stable_mark(stable: DataFrame) -> DataFrame:
    """(video, mark): the first mark, in the order of the policies, with an accepted frame; NULL for none."""
    order = F.array(*(F.lit(p[0]) for p in VIDEO_POLICIES))
    place = F.when(F.col("accepted"), F.array_position(order, F.col("mark")))
    return stable.groupBy("video").agg(F.min_by("mark", place).alias("mark"))


def line_groups(rows: DataFrame, keys: list[str], order: list[str], script: str, top: str, height: str, floor: float = 60.0, factor: float = 1.1) -> DataFrame:
    """``rows`` with ``line``: a new group on a change of script or a vertical gap above max(floor, factor * previous height)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col(top) - F.lag(F.col(top) + F.col(height)).over(w)
    new = F.lag(script).over(w).isNull() | (F.col(script) != F.lag(script).over(w)) | (gap > F.greatest(F.lit(floor), factor * F.lag(height).over(w)))
    return rows.withColumn("_new", new.cast("int")).withColumn("line", F.sum("_new").over(w)).drop("_new")


def greedy_suppress(boxes: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression in each group: rows (x, y, w, h, score) that no better kept row overlaps. A kept row meets all
    that are left at once, so the work of a group is its kept rows times its rows. Of equal boxes with equal scores the first by the other
    columns of plain types, in their order, is kept, however the rows arrive."""
    order = ["score", "x", "y", "w", "h"]
    order += [f.name for f in boxes.schema if f.name not in [*keys, *order] and isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.BinaryType)]

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ascending=[c != "score" for c in order])
        x, y, w, h = (pdf[c].to_numpy(float) for c in "xywh")
        kept, left = [], np.arange(len(pdf))
        while len(left):
            i, left = left[0], left[1:]
            kept.append(i)
            wide = np.minimum(x[i] + w[i], x[left] + w[left]) - np.maximum(x[i], x[left])
            high = np.minimum(y[i] + h[i], y[left] + h[left]) - np.maximum(y[i], y[left])
            both = np.maximum(wide, 0) * np.maximum(high, 0)
            union = w[i] * h[i] + w[left] * h[left] - both
            left = left[np.divide(both, union, out=np.zeros(len(left)), where=union > 0) < threshold]
        return pdf.iloc[kept]

    return boxes.groupBy(*keys).applyInPandas(keep, boxes.schema)


def match_one_to_one(pairs: DataFrame, keys: list[str], left: str, right: str, distance: str) -> DataFrame:
    """Greedy one-to-one assignment of candidate pairs in each group: nearest first, ids break ties."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([distance, left, right])
        used_l, used_r, kept = set(), set(), []
        for i, a, b in zip(pdf.index, pdf[left], pdf[right], strict=True):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                kept.append(i)
        return pdf.loc[kept]

    return pairs.groupBy(*keys).applyInPandas(assign, pairs.schema)


def match_classes(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The assignment of ``match_one_to_one`` where equal rows meet as a class: ``pairs`` (key, a, b, distance) are of classes, and
    ``members`` (key, class, left, right) has the ids of each, in ``left`` for classes of a and in ``right`` for those of b. Rows
    (key, a, b, distance) are of ids.

    At each distance the smallest free id that has a free one in reach takes the smallest of these, class by class from the front, so the
    work of a group is its pairs of classes and its matches, not its pairs of ids.
    """
    ids = lambda c: members.schema[c].dataType.elementType
    schema = T.StructType([pairs.schema[key], T.StructField("a", ids("left")), T.StructField("b", ids("right")), pairs.schema["distance"]])

    def assign(of: tuple, pairs: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        left, right = ({c: sorted(v.tolist(), reverse=True) for c, v in zip(members["class"], members[side], strict=True) if v is not None} for side in ("left", "right"))
        used_l, used_r, out = set(), set(), []

        def first(free: list, used: set) -> list:
            """The smallest id that is free, as a list of at most one."""
            while free and free[-1] in used:  # an id can be in several classes
                free.pop()
            return free[-1:]

        pairs = pairs.sort_values("distance")
        for distance, level in groupby(zip(pairs["distance"].tolist(), pairs["a"], pairs["b"], strict=True), itemgetter(0)):
            near = {}
            for _, a, b in level:
                near.setdefault(a, []).append(b)
            waiting = [(i, a) for a in near for i in first(left[a], used_l)]
            heapify(waiting)
            while waiting:
                i, a = heappop(waiting)
                of_i = [a]
                while waiting and waiting[0][0] == i:
                    of_i.append(heappop(waiting)[1])
                found = [(j, a) for a in of_i for b in near[a] for j in first(right[b], used_r)]
                if not found:
                    continue
                j = min(found)[0]
                used_l.add(i)
                used_r.add(j)
                out.append((*of, i, j, distance))
                for a in {a for _, a in found}:
                    for i in first(left[a], used_l):
                        heappush(waiting, (i, a))
        return pd.DataFrame(out, columns=schema.names)

    members = members.select(F.col(key).alias("_key"), "class", "left", "right")  # another name, as both come from the same rows
    return pairs.groupBy(key).cogroup(members.groupBy("_key")).applyInPandas(assign, schema)
