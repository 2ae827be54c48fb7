"""Media scans: files to portable metadata records, records to evidence rows.

The first stage reads each file once and keeps only metadata; the second is a projection over its table, so
verdicts can be computed again without the files. A file that cannot be read is a row with an issue; of a file that is too
large to hold, windows at its head and tail and its metadata boxes are read, and the row says so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import extension
from ..functions.tokens import contains_any
from ..operators.credentials import app_evidence
from ..operators.verdict import EVIDENCE
from . import containers as C

FORMATS = (".png", ".jpg", ".jpeg", ".webp", ".heic", ".heif", ".avif")
#: Files above this many bytes are read by ranges, as binaryFile holds a whole file in memory.
MOST_BYTES = 256 << 20
RECORD = (
    "path string, schema_version int, status string, issue string, container string, metadata binary, tail binary, scan binary, "
    "pil array<struct<k:string,v:string>>, exif array<struct<k:string,v:string>>, label map<string,string>, claim_generator string"
)
SCHEMA_VERSION = 1


def list_media(spark: SparkSession, path: str, formats: tuple[str, ...] | None = FORMATS, recursive: bool = True) -> DataFrame:
    """binaryFile rows of the supported formats. Spark gives no row for an empty file."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.where(extension(F.col("path")).isin(*formats)) if formats else df


def read_media(spark: SparkSession, path: str, formats: tuple[str, ...] | None = FORMATS, recursive: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The files that fit in memory, with their content; the size filter is pushed down to the listing. ``large_records`` has the others."""
    return list_media(spark, path, formats, recursive).where(F.col("length") <= most_bytes)


def _record(path: str, data: bytes, note: str | None = None) -> dict:
    """The portable record of a file from its bytes, or from what was read of it, which ``note`` tells."""
    row = {"path": path, "schema_version": SCHEMA_VERSION, "status": "windowed" if note else "complete", "issue": note, "container": "unknown", "metadata": b"", "tail": b"", "scan": b"", "pil": [], "exif": [], "label": None, "claim_generator": None}
    try:
        scan = C.scan_buffer(data)
        kind, tail = C.sniff(data), C.trailer(data)
        label = C.find_label(scan + tail, C.label_payloads(data))
        pairs = lambda p: [{"k": k, "v": v} for k, v in p]
        row |= {"container": kind, "metadata": C.metadata_regions(data), "tail": tail, "scan": scan, "pil": pairs(C.png_texts(data) if kind == "png" else []), "exif": pairs(C.tiff_tags(C.exif_block(data)))}
        row |= {"label": None if label is None else list(label.items()), "claim_generator": C.cbor_text_after(scan, b"claim_generator")}
    except Exception as e:  # noqa: BLE001  an unreadable file is data, not a failed job
        row |= {"status": "error", "issue": f"{type(e).__name__}: {e}"[:200]}
    return row


def _in_batches(rows: Iterator[dict], kinds, size: int = 64) -> Iterator:
    import pyarrow as pa

    held: list[dict] = []
    held_bytes = 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(v) for v in row.values() if isinstance(v, bytes))
        if len(held) == size or held_bytes > 32 << 20:
            yield pa.RecordBatch.from_pylist(held, schema=kinds)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=kinds)


def collect_records(files: DataFrame) -> DataFrame:
    """One portable record a file (path, content), in Arrow batches; parsing errors become issues."""
    kinds = to_arrow_schema(StructType.fromDDL(RECORD))

    def run(batches: Iterator) -> Iterator:
        yield from _in_batches((_record(path, data or b"") for b in batches for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), kinds)

    return files.select("path", "content").mapInArrow(run, RECORD)


def read_windows(stream, size: int, head: int = C.HEAD, tail: int = C.TAIL) -> bytes:
    """What matters of a large file that can be read by ranges: of an ISO base media file the boxes without media data, in order, as a
    smaller file of that kind (its first bytes alone, if they hold no box); of others the head and the tail."""

    def at(place: int, n: int) -> bytes:
        stream.seek(place)
        return stream.read(min(n, max(0, size - place)))

    first = at(0, 16)
    if C.sniff(first) != "isobmff":
        return at(0, head) + at(max(head, size - tail), tail)
    parts, place, left = [], 0, 4 * C.BOXES
    while place + 8 <= size and left > 0:
        lead = at(place, 16)
        length, lead_size = int.from_bytes(lead[:4], "big"), 8
        if length == 1:
            length, lead_size = int.from_bytes(lead[8:16], "big"), 16
        elif length == 0:
            length = size - place
        if length < lead_size or place + length > size:
            break
        if lead[4:8] not in (b"mdat", b"free", b"skip") and length <= left:
            parts.append(at(place, length))
            left -= length
        place += length
    return b"".join(parts) or at(0, head)


def large_records(spark: SparkSession, path: str, formats: tuple[str, ...] | None = FORMATS, recursive: bool = True, most_bytes: int = MOST_BYTES, head: int = C.HEAD, tail: int = C.TAIL) -> DataFrame:
    """One record for each file above ``most_bytes``, from ranges that the workers read through Arrow's file systems.

    Its status is ``windowed``; in a store that Arrow cannot open it is ``error`` with the reason as the issue, so no file is lost.
    """
    kinds = to_arrow_schema(StructType.fromDDL(RECORD))

    def one(path: str, size: int) -> dict:
        from pyarrow import fs

        try:
            store, place = fs.FileSystem.from_uri(path)
            with store.open_input_file(place) as stream:
                data = read_windows(stream, size, head, tail)
        except Exception as e:  # noqa: BLE001
            return _record(path, b"") | {"status": "error", "issue": f"not read by ranges: {type(e).__name__}: {e}"[:200]}
        return _record(path, data, f"read {len(data)} of {size} bytes")

    def run(batches: Iterator) -> Iterator:
        yield from _in_batches((one(p, n) for b in batches for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), kinds)

    # no content is read here: only path and length are asked for; Spark names local files file:/x, Arrow reads file:///x
    listed = list_media(spark, path, formats, recursive).where(F.col("length") > most_bytes).select(F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "length")
    return listed.mapInArrow(run, RECORD)


def media_records(spark: SparkSession, path: str, formats: tuple[str, ...] | None = FORMATS, recursive: bool = True, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One record for each file, whatever its size."""
    return collect_records(read_media(spark, path, formats, recursive, most_bytes)).unionByName(large_records(spark, path, formats, recursive, most_bytes))


def require_version(records: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """The records; a row of another schema version fails the job when it is read."""
    ok = F.col("schema_version").eqNullSafe(F.lit(version))
    return records.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported schema version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("null")))).cast("boolean")))


#: Tokens of generator names in tag values.
GENERATOR_TOKENS = (
    "firefly", "dall-e", "dalle", "midjourney", "stable diffusion", "stable-diffusion", "stablediffusion", "comfyui", "automatic1111", "invokeai", "imagen",
    "gpt-image", "nightcafe", "ideogram", "leonardo", "flux", "dreamstudio", "novelai", "reve.com", "aphrodite ai", "apple photos clean up", "fal-ai",
)
_SIGNATURE = r"^Signature: [A-Za-z0-9+/=]{40,}"
_UUID = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def evidence_of(records: DataFrame) -> DataFrame:
    """Evidence rows for the verdict, from records alone. Text tags of the image come before EXIF tags."""
    text = F.decode(F.concat("scan", "tail"), "ISO-8859-1")
    last = lambda of, key: F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.transform(F.filter(of, lambda p: p["k"] == key), lambda p: p["v"])), -1)
    tags = [last("pil", k) for k in ("Software", "Source", "Title", "Description")] + [last("exif", k) for k in ("Software", "Make", "Artist", "ImageDescription", "UserComment")]
    tools = F.regexp_extract_all(text, F.lit("CreatorTool[>\"'=\\s]{1,4}([^<\"']{1,80})"), F.lit(1))
    named = F.transform(F.concat(F.array_compact(F.array(*tags)), tools), lambda v: F.coalesce(app_evidence(v)["generator"], F.when(contains_any(F.lower(v), GENERATOR_TOKENS), F.trim(v))))
    tag = F.coalesce(app_evidence(text)["generator"], F.get(F.array_compact(named), F.lit(0)))
    value = lambda key: F.get(F.transform(F.filter("exif", lambda p: p["k"] == key), lambda p: p["v"]), F.lit(0))
    system = F.regexp_extract(text, r"AISystemUsed(?:>|=\")([^<\"]{1,120})", 1)
    genai = F.expr(r"try_cast(nullif(regexp_extract(decode(concat(scan, tail), 'ISO-8859-1'), '\\\\?\"genAIType\\\\?\"\\s*:\\s*(\\d+)', 1), '') AS bigint)")
    named_cols = {
        "scan": F.col("scan"), "region": F.concat("metadata", "tail"),
        "meta_keys": F.transform("pil", lambda p: p["k"]),
        "iptc_system": F.when(F.contains(text, F.lit("AISystemUsed")), F.coalesce(F.nullif(system, F.lit("")), F.lit("fields present"))),
        "aigc_label": F.col("label"), "generator_tag": tag,
        "xai_signature": F.coalesce(F.rlike(value("ImageDescription"), F.lit(_SIGNATURE)) & F.rlike(value("Artist"), F.lit(_UUID)), F.lit(False)),
        "hf_job": F.get(F.transform(F.filter("pil", lambda p: p["k"] == "hf-job-id"), lambda p: p["v"]), F.lit(0)),
        "samsung_genai": F.nullif(genai, F.lit(0).cast("bigint")),
    }
    empty = records.sparkSession.createDataFrame([], EVIDENCE)
    c2pa = empty.schema["c2pa"].dataType
    generator = F.struct(*((F.col("claim_generator") if f.name == "claim_generator" else F.lit(None).cast(f.dataType)).alias(f.name) for f in c2pa))
    named_cols["c2pa"] = F.when(F.col("claim_generator").isNotNull() & F.contains(text, F.lit("jumb")), generator)
    return records.select("path", *(named_cols.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema if f.name != "path"))


#: Markers of the maker that gate a Live Photo's identifier.
LIVE_PHOTO = ("content.identifier", "com.apple.quicktime", "Apple iOS")


def live_photo_id(scan: Column) -> Column:
    """The content identifier that links a still to its clip, from the bytes of either; NULL without one of the maker's markers."""
    text = F.decode(scan, "ISO-8859-1")
    found = F.regexp_extract(text, "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", 0)
    return F.when(contains_any(text, LIVE_PHOTO), F.nullif(found, F.lit("")))


def live_photos(records: DataFrame) -> DataFrame:
    """(id, still, clip): stills and clips of one identifier, over records."""
    rows = records.select("path", "container", live_photo_id(F.col("scan")).alias("id")).where(F.col("id").isNotNull())
    clip = F.lower(F.col("path")).rlike(r"\.(mov|mp4)$")
    return rows.where(~clip).select("id", F.col("path").alias("still")).join(rows.where(clip).select("id", F.col("path").alias("clip")), "id")


FORENSIC = (
    "path string, sha256 string, container string, size_bytes long, parts array<struct<name:string,offset:long,length:long>>, progressive boolean, subsampling string, "
    "restart int, tables array<array<int>>, huffman array<struct<id:int,counts:array<int>>>, scans array<struct<components:int,first:int,last:int,high:int,low:int>>, comments array<string>, texts array<struct<k:string,v:string>>, tags array<struct<k:string,v:string>>, "
    "iptc array<struct<k:string,v:string>>, items array<string>, properties array<string>, auxiliary string, created long, quicktime array<struct<k:string,v:string>>, issue string"
)


def forensic_records(files: DataFrame) -> DataFrame:
    """Broad inspection records of files (path, content): never detector input. Group by ``tables`` for encoder cohorts, explode ``parts`` for chunk counts."""

    kinds = to_arrow_schema(StructType.fromDDL(FORENSIC))

    def one(path: str, data: bytes) -> dict:
        row = dict.fromkeys(kinds.names) | {"path": path, "sha256": hashlib.sha256(data).hexdigest(), "container": C.sniff(data), "size_bytes": len(data)}
        try:
            jpeg = C.jpeg_structure(data) if row["container"] == "jpeg" else {}
            pairs = lambda p: [{"k": k, "v": v} for k, v in p]
            row |= {k: jpeg.get(k) for k in ("progressive", "subsampling", "restart", "tables", "comments", "huffman", "scans")}
            if row["container"] == "isobmff":
                found = C.item_inventory(data)
                row |= found | {"quicktime": pairs(found["quicktime"])}
            row |= {"parts": [{"name": n, "offset": o, "length": k} for n, o, k in C.inventory(data)], "texts": pairs(C.png_texts(data) if row["container"] == "png" else []), "tags": pairs(C.tiff_tags(C.exif_block(data))), "iptc": pairs(C.iptc_fields(data))}
        except Exception as e:  # noqa: BLE001
            row["issue"] = f"{type(e).__name__}: {e}"[:200]
        return row

    def run(batches: Iterator) -> Iterator:
        yield from _in_batches((one(path, data or b"") for b in batches for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), kinds)

    return files.select("path", "content").mapInArrow(run, FORENSIC)
