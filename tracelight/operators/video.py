"""Video verdicts from metadata markers and stable marks.

A video's confidence is high or unknown: no local decoder can rule marks out, so there is no negative verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import first_match_folded
from .quantiles import percentiles
from .registries import ISSUER_PLATFORMS
from .temporal import first_stable_mark

#: The platform that a stable visible mark names.
MARK_PLATFORMS = (
    ("sora", "OpenAI Sora"), ("veo", "Google Veo"), ("seedance", "ByteDance Seedance"), ("dola", "ByteDance Dola"), ("hailuo", "MiniMax Hailuo"), ("kling", "Kuaishou Kling"),
)
CAVEAT = "No public local decoder can verify proprietary pixel watermarks such as video SynthID."
UNKNOWN = "No supported signal was found; absence is unknown, not proof that the video is clean."


def _marker(markers: Column, key: str) -> Column:
    return F.lower(F.coalesce(F.element_at(markers, F.lit(key)), F.lit("")))


def metadata_provenance(markers: Column) -> Column:
    """array<string> of the marks that a video's metadata (map) confirms: sora, veo, seedance and dola."""
    generator, issuer, kind = (_marker(markers, k) for k in ("claim_generator", "issuer", "source_type"))
    trained = F.contains(kind, F.lit("trainedalgorithmicmedia"))
    both = F.concat(generator, F.lit("\n"), issuer)
    bytedance = (F.contains(both, F.lit("bytedance")) | F.contains(both, F.lit("byteplus"))) & trained
    return F.array_compact(F.array(F.when(F.contains(generator, F.lit("sora")), "sora"), F.when(F.contains(both, F.lit("google")) & trained, "veo"), F.when(bytedance, "seedance"), F.when(bytedance, "dola")))


def identify_videos(videos: DataFrame, stable: DataFrame) -> DataFrame:
    """Verdicts of ``videos`` (video, markers map<string,string>) from their markers and the ``stable`` frames of their marks."""
    marks = first_stable_mark(stable)
    frames = stable.groupBy("video", "mark").agg(F.count_if("accepted").alias("detected"), F.count("*").alias("frames"))
    rows = videos.join(marks, "video", "left").join(frames, ["video", "mark"], "left")
    markers = F.coalesce("markers", F.create_map().cast("map<string,string>"))
    seen = (F.size(markers) > 0) | F.col("mark").isNotNull()
    by_mark = F.lit(None).cast("string")
    for key, platform in MARK_PLATFORMS:
        by_mark = F.when(F.col("mark") == key, platform).otherwise(by_mark)
    named = first_match_folded(F.array_join(F.map_values(markers), "\n"), [(needle.lower(), platform) for needle, platform in ISSUER_PLATFORMS])
    return rows.select(
        "video", F.when(seen, True).alias("is_ai_generated"), F.when(seen, "high").otherwise("unknown").alias("confidence"), F.coalesce(by_mark, F.when(F.col("mark").isNull(), named)).alias("platform"),
        F.col("mark").alias("visible_mark"), F.coalesce("detected", F.lit(0)).alias("detected_frames"), "frames", F.array_compact(F.array(F.lit(CAVEAT), F.when(~seen, UNKNOWN))).alias("caveats"),
    )


def variable_rate(frames: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(video, variable): whether time steps between frames differ from their median by more than a share of it."""
    w = Window.partitionBy("video").orderBy("frame_index")
    steps = frames.withColumn("step", F.col("ts") - F.lag("ts").over(w)).where(F.col("step").isNotNull())
    usual = percentiles(steps.select("video", "step"), ["video"], {"usual": ("step", 0.5, "median")})
    return steps.join(usual, "video").groupBy("video").agg(F.bool_or(F.abs(F.col("step") - F.col("usual")) > tolerance * F.col("usual")).alias("variable"))


def matched_frames(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The frames of two videos side by side; a frame that only one of them has fails the job, as an average over the rest would hide it."""
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), keys, "full_outer")
    whole = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    named = F.concat(F.lit("frames do not match at "), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(named).cast("boolean"))).drop("_a", "_b")


def pooled_psnr(frames: DataFrame, key: str) -> DataFrame:
    """PSNR over all frames of a video: squared errors and counts add up, and SSIM is averaged."""
    error = F.sum("squared_error") / F.sum("n_values")
    return frames.groupBy(key).agg(F.when(error <= 0, float("inf")).otherwise(10 * F.log10(F.lit(65025.0) / F.nullif(error, F.lit(0.0)))).alias("psnr"), F.avg("ssim").alias("ssim"), F.count("*").alias("frames"))


def merge_words(words: DataFrame, keys: list[str], least_overlap: float = 0.45, floor: float = 24, factor: float = 3) -> DataFrame:
    """Word boxes (x1, y1, x2, y2) of each group merged into line boxes (keys, line, x1, y1, x2, y2).

    A box joins the line that it overlaps most in height and that is near enough, the first of equals; lines grow as they
    take boxes, so the rule is a fold: over the array of a group's boxes in reading order, with the array of lines as its state.
    """
    names = ("x1", "y1", "x2", "y2")
    box = F.struct(*names)
    order = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("middle"), F.col("x1").alias("left"), box.alias("box"))

    def share(a: Column, b: Column) -> Column:
        both = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
        return F.greatest(F.lit(0), both) / F.greatest(F.lit(1), F.least(a["y2"] - a["y1"], b["y2"] - b["y1"]))

    def near(a: Column, b: Column) -> Column:
        gap = F.greatest(a["x1"], b["x1"]) - F.least(a["x2"], b["x2"])
        return gap <= F.greatest(F.lit(floor), factor * F.least(a["y2"] - a["y1"], b["y2"] - b["y1"]))

    def take(lines: Column, word: Column) -> Column:
        fits = F.transform(lines, lambda x, i: F.when((share(x, word) >= least_overlap) & near(x, word), F.struct(share(x, word).alias("share"), (-i).alias("turn"))))
        grown = lambda x: F.struct(*((F.least if n[1] == "1" else F.greatest)(x[n], word[n]).alias(n) for n in names))
        best = F.array_max(fits)
        return F.when(best.isNull(), F.concat(lines, F.array(word))).otherwise(F.transform(lines, lambda x, i: F.when(i == -best["turn"], grown(x)).otherwise(x)))

    kind = f"array<struct<{','.join(f'{n}:{dict(words.dtypes)[n]}' for n in names)}>>"
    folded = words.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(order)), lambda o: o["box"]).alias("boxes"))
    folded = folded.select(*keys, F.aggregate("boxes", F.array().cast(kind), take).alias("lines"))
    ranked = F.array_sort(F.transform("lines", lambda x: F.struct(((x["y1"] + x["y2"]) / 2).alias("middle"), x["x1"].alias("left"), x.alias("box"))))
    return folded.select(*keys, F.posexplode(ranked).alias("line", "o")).select(*keys, "line", *(F.col(f"o.box.{n}").alias(n) for n in names))
