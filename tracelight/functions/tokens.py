"""Matching a buffer (string or binary column) against ordered token registries.

Registries are small and fixed, so they fold into expressions; no join and no shuffle is made. A registry is a
sequence of (token, label) in priority order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Registry = Sequence[tuple[str, str]]


def has(buffer: Column, token: str, binary: bool = False) -> Column:
    return F.contains(buffer, F.lit(bytearray(token.encode()) if binary else token))


def contains_any(buffer: Column, tokens: Sequence[str], binary: bool = False) -> Column:
    """True if the buffer holds any of the tokens; NULL for a NULL buffer, false for no tokens."""
    return reduce(lambda a, b: a | b, (has(buffer, t, binary) for t in tokens), F.lit(False))


def first_match(buffer: Column, registry: Registry, binary: bool = False) -> Column:
    """The label of the first token, in registry order, that the buffer holds; else NULL."""
    out = F.lit(None).cast("string")
    for token, label in reversed(registry):
        out = F.when(has(buffer, token, binary), F.lit(label)).otherwise(out)
    return out


def ordered_matches(buffer: Column, registry: Registry, binary: bool = False) -> Column:
    """Labels of all tokens found, in registry order, each once."""
    if not registry:
        return F.array().cast("array<string>")
    return F.array_distinct(F.array_compact(F.array(*(F.when(has(buffer, t, binary), F.lit(label)) for t, label in registry))))


def sorted_matches(buffer: Column, registry: Registry, binary: bool = False) -> Column:
    """Labels of all tokens found, sorted, each once."""
    return F.array_sort(ordered_matches(buffer, registry, binary))


def first_match_folded(text: Column, registry: Registry) -> Column:
    """``first_match`` against lower-cased text."""
    return first_match(F.lower(text), registry)
