"""Which of the competing mark detections of an asset to accept. Pure expressions over one row.

``candidates`` is array<struct<key, strict: boolean, relaxed: boolean, flat: boolean>> in registry order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registries import MARKS, NO_WITNESS, PRODUCT_OF


def product_of(key: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in PRODUCT_OF.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def confirmed(candidates: Column, key: Column, provenance: Column, sensitivity: Column) -> Column:
    """Same-product evidence: the own vendor by metadata, or a strictly detected sibling that may bear witness."""
    sibling = F.exists(candidates, lambda c: c["strict"] & (c["key"] != key) & (product_of(c["key"]) == product_of(key)) & ~c["key"].isin(*NO_WITNESS))
    return (sensitivity != "strict") & (F.coalesce(F.array_contains(provenance, key), F.lit(False)) | sibling)


def suppressors() -> list[str]:
    pill = next(m for m in MARKS if m[0] == "jimeng_pill")
    return [m[0] for m in MARKS if m[2] == pill[2] and m[1] != pill[1]]


def keep_pill(fired: Column, provenance: Column, flat: Column) -> Column:
    """A weak mark stays with its wordmark, or with metadata on a flat ground, and never beside a rival's mark."""
    veto = F.arrays_overlap(fired, F.array(*map(F.lit, suppressors())))
    return ~veto & (F.array_contains(fired, "jimeng") | (F.coalesce(F.array_contains(provenance, "jimeng"), F.lit(False)) & flat))


def decide(candidates: Column, provenance: Column, sensitivity: Column) -> Column:
    """array<struct<key, relaxed>> of the accepted marks, in the order of the candidates."""
    provenance = F.coalesce(provenance, F.array().cast("array<string>"))
    judged = F.transform(candidates, lambda c: F.struct(c["key"].alias("key"), confirmed(candidates, c["key"], provenance, sensitivity).alias("relaxed"), c["strict"].alias("strict"), c["relaxed"].alias("loose"), c["flat"].alias("flat")))
    fired = F.filter(judged, lambda j: F.when(j["relaxed"], j["loose"]).otherwise(j["strict"]))
    keys = F.transform(fired, lambda j: j["key"])
    kept = F.filter(fired, lambda j: (j["key"] != "jimeng_pill") | keep_pill(keys, provenance, F.coalesce(j["flat"], F.lit(False))))
    return F.transform(kept, lambda j: F.struct(j["key"].alias("key"), j["relaxed"].alias("relaxed")))


def top_candidates(candidates: Column, score: str, most: int = 3) -> Column:
    """The ``most`` best of an array of structs by a field, best first; of equals the earlier. NULL scores come last."""
    ranked = F.array_sort(F.transform(candidates, lambda c, i: F.struct(F.coalesce(-c[score].cast("double"), F.lit(float("inf"))).alias("rank"), i.alias("place"), c.alias("one"))))
    return F.transform(F.slice(ranked, 1, most), lambda r: r["one"])


def selected(candidates: Column, first: str, then: str, most: int = 3) -> Column:
    """Of the ``most`` best by ``first``, the one with the highest ``then``; the better by ``first`` of equals."""
    best = top_candidates(candidates, first, most)
    return F.get(top_candidates(best, then, 1), F.lit(0))
