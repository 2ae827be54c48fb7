"""Evaluation logs and manifests: JSON lines, CSV and their sinks, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.audit import ingest

TIMING = (
    "path string, ext string, bytes long, format string, width int, height int, megapixels double, identify_ms double, scan_bytes long, "
    "has_c2pa boolean, is_ai_generated boolean, confidence string, platform string, signals array<string>, error string"
)
MANIFEST = "sha256 string, filename string, label string, source string, model string, width int, height int, format string, issuer string, added string, notes string"


def read_json_lines(spark: SparkSession, path: str, schema: str = TIMING) -> DataFrame:
    """Rows of a JSON-lines log; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def append_manifest(spark: SparkSession, path: str, batch: DataFrame, order: str = "filename") -> None:
    """Append the rows of a batch whose hash is new, once each."""
    ingest(read_manifest(spark, path), batch, "sha256", order).write.mode("append").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """CSV with a header; arrays are joined by '|'."""
    flat = [F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_reports_json(df: DataFrame, path: str, version: int = 1) -> None:
    """Versioned JSON lines, one report a row."""
    df.select(F.lit(version).alias("schema_version"), "*").write.mode("overwrite").json(path)
