"""Records of other tools as JSON: keys and values at any depth, and the bytes that they hold as text.

JSON of any shape has no schema, so this is a walk in Python, in Arrow batches; the results are plain columns.
"""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Keys (any case) that describe the file or a measurement; what is below them is no metadata of the asset.
DIAGNOSTIC = frozenset(
    "artifacts birthtime color content_format dct ela error extension fft file filename full gradient kind mtime name noise path pixel provenance sha256 signals size_bytes timing_ms".split()
)
CUT = "...TRUNCATED"


def _decoded(key: str | None, text: str) -> bytes:
    """The bytes of a text: base64 under a key that says so, hexadecimal after hex:, else the text itself."""
    try:
        if key is not None and (key == "base64" or key.endswith("_base64")):
            return base64.b64decode(text.partition(CUT)[0], validate=True)
    except (binascii.Error, ValueError):
        pass
    try:
        if text.startswith("hex:"):
            return bytes.fromhex(text[4:])
    except ValueError:
        pass
    return text.encode("utf-8", "replace")


def flatten(record) -> tuple[list[tuple[str, str | None]], bytes]:
    """(key, value) of each entry at any depth, in document order, and the leaves' bytes, a line each.

    A value that is no text is its JSON, None for null. Entries below a diagnostic key are left out.
    """
    pairs: list[tuple[str, str | None]] = []
    leaves: list[bytes] = []
    todo: list[tuple[str | None, object, bool]] = [(None, record, False)]
    while todo:
        key, value, is_entry = todo.pop()
        if is_entry:
            pairs.append((key, value if isinstance(value, str) or value is None else json.dumps(value, ensure_ascii=False)))
            if key.lower() in DIAGNOSTIC:
                continue
        if isinstance(value, dict):
            todo += [(str(k), v, True) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            todo += [(None, v, False) for v in reversed(value)]
        elif isinstance(value, str):
            leaves.append(_decoded(key, value))
        elif value is not None:
            leaves.append(str(value).encode())
    return pairs, b"\n".join(leaves)


def flatten_records(records: DataFrame, key: str = "path", record: str = "record") -> DataFrame:
    """(key, pairs array<struct<k, v>>, scan binary, issue) of rows (key, JSON text); a text that is no JSON is an issue."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            pairs, scans, issues = [], [], []
            for text in b.column(1).to_pylist():
                try:
                    found, scan, issue = *flatten(json.loads(text)), None
                except (ValueError, TypeError, RecursionError) as e:
                    found, scan, issue = [], b"", f"{type(e).__name__}: {e}"[:200]
                pairs.append([{"k": k, "v": v} for k, v in found])
                scans.append(scan)
                issues.append(issue)
            kind = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pairs, kind), pa.array(scans, pa.binary()), pa.array(issues, pa.string())], [key, "pairs", "scan", "issue"])

    rows = records.select(F.col(key), F.col(record))
    return rows.mapInArrow(run, f"{key} {dict(rows.dtypes)[key]}, pairs array<struct<k:string,v:string>>, scan binary, issue string")
