"""Boxes as struct<x, y, w, h> and tile layouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 for two empty boxes, NULL if a box is."""
    both = intersection(a, b)
    union = a["w"] * a["h"] + b["w"] * b["h"] - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / F.nullif(union.cast("double"), F.lit(0.0)))


def corner_box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.alias("x"), y1.alias("y"), (x2 - x1).alias("w"), (y2 - y1).alias("h"))


def centre_distance(a: Column, b: Column) -> Column:
    dx = a["x"] + a["w"] / 2 - b["x"] - b["w"] / 2
    dy = a["y"] + a["h"] / 2 - b["y"] - b["h"] / 2
    return F.sqrt(dx * dx + dy * dy)


def diagonal(a: Column) -> Column:
    return F.sqrt((a["w"] * a["w"] + a["h"] * a["h"]).cast("double"))


def padded(a: Column, pad: Column, width: Column, height: Column) -> Column:
    """The box grown on each side and clipped to the frame."""
    x, y = F.greatest(a["x"] - pad, F.lit(0)), F.greatest(a["y"] - pad, F.lit(0))
    right, bottom = F.least(a["x"] + a["w"] + pad, width), F.least(a["y"] + a["h"] + pad, height)
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(right - x, F.lit(0)).alias("w"), F.greatest(bottom - y, F.lit(0)).alias("h"))


def tile_starts(length: Column, tile: int, overlap: int) -> Column:
    """Where tiles start along one side: every tile - overlap, the last one flush with the edge."""
    step = tile - overlap
    last = length - tile
    return F.when(length <= tile, F.array(F.lit(0).cast("long"))).otherwise(F.array_union(F.sequence(F.lit(0).cast("long"), last - F.pmod(last, F.lit(step)), F.lit(step).cast("long")), F.array(last)))


def tile_plan(width: Column, height: Column, tile: int, overlap: int) -> Column:
    """array<struct<x, y, w, h>> of uniform tiles that cover a frame, row by row."""
    w, h = F.least(width, F.lit(tile)), F.least(height, F.lit(tile))
    return F.flatten(F.transform(tile_starts(height, tile, overlap), lambda y: F.transform(tile_starts(width, tile, overlap), lambda x: F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h")))))
