"""Structured Streaming forms: records and events as they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.registries import STABLE_GAP, STABLE_IOU, VIDEO_POLICIES
from ..operators.temporal import _iou
from ..operators.verdict import identify
from ..sources.media import RECORD, evidence_of, require_version


def stream_records(spark: SparkSession, path: str) -> DataFrame:
    """Portable records that arrive as Parquet files in a folder; the checkpoint of the query remembers which are done."""
    return spark.readStream.schema(RECORD).parquet(path)


def stream_verdicts(records: DataFrame) -> DataFrame:
    """Verdicts of a stream (or table) of records: a projection, so it needs no state."""
    return identify(evidence_of(require_version(records)))


def stream_events(spark: SparkSession, path: str, schema, watermark: str = "1 hour") -> DataFrame:
    """Events of a folder or pattern; an event time without a zone is taken in the session's."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)


def windowed_rates(events: DataFrame, window: str = "1 day", slide: str | None = None, fires: float = 50.0) -> DataFrame:
    """Rows and firing rows of each window and type; late rows count until the watermark passes."""
    bucket = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.groupBy(bucket.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > fires).alias("k")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "k")


def run_to_end(spark: SparkSession, path: str, schema: StructType, windowed: Callable[[DataFrame], DataFrame], folder: str, watermark: str = "1 hour", beyond: str = "400 days") -> DataFrame:
    """The rows of ``windowed`` over all events of a folder or pattern, each window closed by the stream itself.

    The stream has a second source: after all that is there has been taken, one last event comes from it, so far ahead that the watermark
    passes every window. Its own window never closes. State and output are in ``folder``, which driver and executors share, so
    the query can be started again after a failure; ``beyond`` must exceed window and watermark.
    """
    blank = spark.createDataFrame([], schema)
    blank.write.parquet(f"{folder}/last")
    # one watermark for both sources, or the one without rows would hold the other back
    events = spark.readStream.schema(schema).parquet(path).unionByName(spark.readStream.schema(schema).parquet(f"{folder}/last"))
    rows = windowed(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark))

    def take_all() -> None:
        query = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()

    take_all()
    ahead = F.lit(spark.read.schema(schema).parquet(path).agg(F.max("ts").cast("timestamp")).first()[0]) + F.expr(f"INTERVAL {beyond}")
    spark.range(1).select(*((ahead if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema)).write.mode("append").parquet(f"{folder}/last")
    take_all()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


def sessions(events: DataFrame, gap: str = "4 hours") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("user_id", F.col("s.start").alias("started"), "n", "total")


RUN_STATE = "last_frame int, length int, strongest double, anchor array<int>, box array<int>, announced boolean"
RUN_OUT = "video string, mark string, frame_index int, run_length int"


def stable_marks(detections: DataFrame) -> DataFrame:
    """(video, mark, frame_index, run_length): the frame at which a run of a mark first becomes stable.

    State is one open run a (video, mark); frames of a group are taken in order within each micro-batch.
    """
    policy = {p[0]: p for p in VIDEO_POLICIES}

    def advance(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        video, mark = key
        _, weak, _, strong, _, least, _, anchor_iou, _ = policy[mark]
        last, length, strongest, anchor, box, announced = state.get if state.exists else (None, 0, 0.0, None, None, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("frame_index")
        for r in rows.itertuples():
            if pd.isna(r.x) or r.confidence < weak:
                continue
            now = [int(r.x), int(r.y), int(r.w), int(r.h)]
            goes_on = length and r.frame_index - last <= STABLE_GAP + 1 and _iou(box, now) >= STABLE_IOU and (anchor_iou is None or _iou(anchor, now) >= anchor_iou)
            if not goes_on:
                length, strongest, anchor, announced = 0, 0.0, now, False
            last, length, strongest, box = int(r.frame_index), length + 1, max(strongest, float(r.confidence)), now
            if not announced and length >= least and strongest >= strong:
                announced = True
                out.append((video, mark, last, length))
        if length:
            state.update((last, length, strongest, anchor, box, announced))
        yield pd.DataFrame(out, columns=["video", "mark", "frame_index", "run_length"])

    known = detections.where(F.col("mark").isin(*policy))
    return known.groupBy("video", "mark").applyInPandasWithState(advance, RUN_OUT, RUN_STATE, "append", "NoTimeout")
