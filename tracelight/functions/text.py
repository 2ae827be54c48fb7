"""Text expressions: edit distance, normalisation, names and scripts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def edit_distance_normalized(a: Column, b: Column) -> Column:
    """Edit distance in code points over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / F.nullif(longest, F.lit(0)))


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def character_error_rate(seen: Column, true: Column) -> Column:
    """Edits per true character after dropping white space; 0 or 1 for an empty truth."""
    a, b = without_spaces(seen), without_spaces(true)
    return F.when(F.length(b) == 0, F.when(F.length(a) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.levenshtein(a, b) / F.nullif(F.length(b), F.lit(0)))


def normalize_ascii(text: Column) -> Column:
    """Lower case without white space; equals ``normalize_text`` for ASCII."""
    return without_spaces(F.lower(text))


@F.pandas_udf(StringType())
def normalize_text(texts: pd.Series) -> pd.Series:
    """NFC, case folding, no white space: what the built-in functions cannot express, in Arrow batches."""
    return texts.map(lambda t: None if t is None else "".join(unicodedata.normalize("NFC", t).casefold().split()))


def stem(name: Column) -> Column:
    """A file name without extension and without a _src or _clean suffix."""
    return F.regexp_replace(name, r"(_src|_clean)?(\.[^.]*)?$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def credit_code(code: Column) -> Column:
    """The 18-character credit code inside a long producer code that starts with 001; else the code itself."""
    return F.when((F.length(code) >= 22) & F.startswith(code, F.lit("001")), F.substring(code, 5, 18)).otherwise(code)


def script_language(text: Column) -> Column:
    """zh for any Han character, else ru for any Cyrillic one, else en."""
    return F.when(F.rlike(text, F.lit(r"\p{IsHan}")), F.lit("zh")).when(F.rlike(text, F.lit(r"\p{IsCyrillic}")), F.lit("ru")).otherwise(F.lit("en"))


def clipped(text: Column, most: int = 200) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def aspect_class(width: Column, height: Column) -> Column:
    ratio = width / F.nullif(height.cast("double"), F.lit(0.0))
    return F.when(ratio < 0.9, F.lit("portrait")).when(ratio > 1.1, F.lit("landscape")).otherwise(F.lit("square"))


def stable_reading(reads: Column, scores: Column, least: float = 0.85) -> Column:
    """All normalised readings agree and the worst score is high enough."""
    return (F.size(F.array_distinct(reads)) == 1) & (F.array_min(scores) >= least)


def preserves_line(expected: Column, source: Column, source_score: Column, seen: Column, seen_score: Column, least: float = 0.75, most: float = 0.25) -> Column:
    """Both readings are sure, the source reads as expected but for a quarter of it, and the candidate reads as the source."""
    near = edit_distance_normalized(normalize_ascii(expected), normalize_ascii(source)) <= most
    return (F.least(source_score, seen_score) >= least) & near & (normalize_ascii(source) == normalize_ascii(seen))
