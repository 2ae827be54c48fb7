"""Contradictions between independent provenance claims.

A claim is struct<family, vendor>. Claims of the manifest and of SynthID come from one source; any other family is
a source of its own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registries import GENERIC_AIGC

MANIFEST = "c2pa_manifest"


def source_of(family: Column) -> Column:
    return F.when(family.isin("c2pa", "synthid"), F.lit(MANIFEST)).otherwise(family)


def relabelled(claims: Column) -> Column:
    """A generic national AI label next to ByteDance's own claim is ByteDance's label."""
    own = F.exists(claims, lambda c: (c["family"] != "aigc") & (c["vendor"] == "ByteDance"))
    return F.transform(claims, lambda c: F.struct(c["family"].alias("family"), F.when(own & (c["family"] == "aigc") & (c["vendor"] == GENERIC_AIGC), F.lit("ByteDance")).otherwise(c["vendor"]).alias("vendor")))


def conflict(claims: Column) -> Column:
    """Two claims that differ in source and in vendor exist."""
    return F.exists(claims, lambda a: F.exists(claims, lambda b: (source_of(a["family"]) != source_of(b["family"])) & (a["vendor"] != b["vendor"])))


def by_vendor(claims: Column) -> Column:
    """'vendor (via family, ...)' of each vendor, sorted, joined by ' vs '."""
    vendors = F.array_sort(F.array_distinct(F.transform(claims, lambda c: c["vendor"])))

    def part(v: Column) -> Column:
        families = F.array_sort(F.transform(F.filter(claims, lambda c: c["vendor"] == v), lambda c: c["family"]))
        return F.concat(v, F.lit(" (via "), F.array_join(families, ", "), F.lit(")"))

    return F.array_join(F.transform(vendors, part), " vs ")


def integrity_clashes(claims: Column, camera: Column) -> Column:
    """array<string>: at most one clash between vendors, then one between a camera's credentials and an AI claim from elsewhere."""
    claims = relabelled(F.coalesce(claims, F.array().cast("array<struct<family:string,vendor:string>>")))
    apart = F.exists(claims, lambda c: source_of(c["family"]) != MANIFEST)
    vendors = F.array_join(F.array_sort(F.array_distinct(F.transform(claims, lambda c: c["vendor"]))), ", ")
    first = F.when(
        conflict(claims),
        F.concat(F.lit("Conflicting AI-origin attributions from independent signals: "), by_vendor(claims), F.lit(" -- one provenance set was likely spoofed, transplanted, or laundered.")),
    )
    second = F.when(
        camera.isNotNull() & apart,
        F.concat(
            F.lit("Camera-capture C2PA credentials ("), camera, F.lit(") coexist with AI-generation markers ("), vendors,
            F.lit(") -- a genuine camera capture is not AI-generated, so the provenance is inconsistent."),
        ),
    )
    return F.array_compact(F.array(first, second))
