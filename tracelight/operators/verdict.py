"""Evidence rows to verdicts: one projection, no shuffle.

Evidence columns (see ``EVIDENCE``): what the extraction found in one asset. Stages stand in order; each may
add a signal, a watermark, a caveat and a vendor claim, and the first platform named stays. Absence of
evidence gives NULL, never false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import contains_any, first_match, first_match_folded, has, ordered_matches, sorted_matches
from . import registries as R
from .clashes import integrity_clashes

EVIDENCE = (
    "path string, scan binary, region binary, "
    "c2pa struct<present:boolean,issuer:string,claim_generator:string,ai_tool:string,source_type:string,ai_source_kind:string,identity_ai:boolean,"
    "integrity:string,signature:string,signer_trust:string,signer_validity:string,codes:array<string>>, "
    "meta_keys array<string>, synthid string, soft_binding string, iptc_system string, aigc_label map<string,string>, "
    "generator_tag string, xai_signature boolean, hf_job string, samsung_genai long, visible array<struct<key:string,label:string,platform:string,confidence:double>>"
)
# The caveats of a report.
STRIP = "Absence of metadata is not proof the image is clean: C2PA, EXIF, and PNG text chunks are stripped by re-encoding, screenshots, or social-media upload."
SYNTHID = "SynthID presence comes from supported provenance here; the pixel watermark is not locally decoded (proprietary decoder). Confirm via the Gemini app or openai.com/verify."
UNTRUSTED = "The C2PA claim signature and asset binding validate, but the signer identity is not anchored to a trusted credential here; treat the named platform as a signed claim, not a verified identity."
UNVALIDATED = "The C2PA marker was parsed without cryptographic validation; treat its origin and watermark assertions as unverified claims."
INVALID = "The embedded C2PA claim no longer validates against this asset. Its origin and watermark assertions are retained only as removal hints, not as verified provenance."
IPTC_ONLY = "The IPTC 'Made with AI' tag flags AI provenance but does not identify the specific platform."
HF_JOB = "The hf-job-id tag marks a HuggingFace-hosted job (commonly diffusion generation) but names neither the model nor the content type, so it is a medium-confidence signal, not proof the pixels are AI-generated."
SAMSUNG = "Samsung's genAIType marker shows a Galaxy AI editing tool touched the image; it is an undocumented field, so it is a medium-confidence signal of AI editing, not proof the whole image is AI-generated."
CLOUD = "The embedded C2PA manifest is absent but an XMP provenance pointer to the vendor's cloud manifest store survives, so the Content Credentials remain recoverable server-side. It marks Content Credentials, not AI origin."


def c2pa_marker(scan: Column) -> Column:
    """The manifest's UUID, or a JUMBF box and 'c2pa' in any case; a bare 'c2pa' can be chance."""
    folded = F.lower(F.decode(scan, "ISO-8859-1"))
    return F.contains(scan, F.lit(bytearray(R.C2PA_UUID))) | (has(scan, "jumb", True) & F.contains(folded, F.lit("c2pa")))


def source_kind(structured: Column, scan: Column) -> Column:
    """generated, enhanced or NULL; composite markers are taken out before full generation is looked for."""
    text = F.decode(scan, "ISO-8859-1")
    plain = reduce(lambda t, m: F.replace(t, F.lit(m), F.lit("")), R.ENHANCED_MARKERS, text)
    generated = (F.coalesce(structured, F.lit("")) == "generated") | contains_any(plain, R.GENERATED_MARKERS)
    enhanced = (F.coalesce(structured, F.lit("")) == "enhanced") | contains_any(text, R.ENHANCED_MARKERS)
    return F.when(generated, F.lit("generated")).when(enhanced, F.lit("enhanced"))


def credential_level(c2pa: Column) -> Column:
    """invalid, verified (all four checks pass) or unverified."""
    is_ = lambda f, v: F.coalesce(c2pa[f], F.lit("")) == v
    bad = is_("integrity", "invalid") | is_("signature", "invalid") | is_("signer_validity", "invalid")
    good = is_("integrity", "valid") & is_("signature", "valid") & is_("signer_trust", "trusted") & is_("signer_validity", "valid")
    return F.when(bad, F.lit("invalid")).when(good, F.lit("verified")).otherwise(F.lit("unverified"))


# Parts of codes that fail a content binding, codes that match one, and codes that fail a signature.
BINDING_FAILURES = (
    "Hash.incorrectFileCount", "Hash.malformed", "Hash.mismatch", "Hash.missingPart", "assertion.hashedURI.mismatch", "claim.hardBindings.missing", "hashedUri.mismatch", "ingredient.manifest.mismatch",
)
BINDING_MATCHES = ("assertion.dataHash.match", "assertion.bmffHash.match", "assertion.boxesHash.match", "assertion.collectionHash.match", "assertion.multiAssetHash.match")
SIGNATURE_FAILURES = ("claimSignature.mismatch", "claimSignature.missing", "claimSignature.outsideValidity")


def _any_code(codes: Column, test) -> Column:
    return F.exists(F.coalesce(codes, F.array().cast("array<string>")), test)


def binding_failed(failures: Column) -> Column:
    return _any_code(failures, lambda c: contains_any(c, BINDING_FAILURES))


def signature_failed(failures: Column) -> Column:
    return _any_code(failures, lambda c: c.isin(*SIGNATURE_FAILURES))


def validation_states(successes: Column, failures: Column) -> Column:
    """struct<integrity, signature, signer_trust, signer_validity> from lists of validation status codes."""
    among = lambda codes, *names: _any_code(codes, lambda c: c.isin(*names))
    matched = _any_code(successes, lambda c: reduce(lambda a, b: a | b, (F.endswith(c, F.lit(m)) for m in BINDING_MATCHES)))
    integrity = F.when(binding_failed(failures), "invalid").when(matched, "valid").otherwise("unknown")
    signature = F.when(signature_failed(failures), "invalid").when(among(successes, "claimSignature.validated"), "valid").otherwise("unknown")
    trust = F.when(among(successes, "signingCredential.trusted"), "trusted").when(among(failures, "signingCredential.untrusted"), "untrusted").otherwise("unknown")
    validity = (
        F.when(among(failures, "signingCredential.invalid", "signingCredential.ocsp.revoked"), "invalid")
        .when(among(failures, "signingCredential.expired"), "expired")
        .when(among(successes, "claimSignature.insideValidity"), "valid")
        .otherwise("unknown")
    )
    return F.struct(integrity.alias("integrity"), signature.alias("signature"), trust.alias("signer_trust"), validity.alias("signer_validity"))


def synthid_vendors(region: Column, action: Column | None = None) -> Column:
    """Sorted organisations whose provenance implies SynthID; some need an explicit watermark action, by default one in the bytes."""
    action = has(region, "c2pa.watermarked", True) if action is None else action
    found = [F.when(has(region, x[0], True) & (action if x[5] else F.lit(True)), F.lit(x[1])) for x in R.ISSUERS if x[4]]
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))


def attribute_platform(issuers: Column, is_ai: Column) -> Column:
    """The generator of an issuer list when the content is AI, else a neutral signer label."""
    joined = F.array_join(issuers, " ")
    neutral = F.when(F.size(issuers) > 0, F.concat(F.lit("C2PA signer: "), F.array_join(issuers, ", "), F.lit(" (no known AI generator named)")))
    return F.coalesce(F.when(is_ai, first_match(joined, R.ISSUER_PLATFORMS)), neutral)


def vendor_of(text: Column) -> Column:
    return first_match_folded(text, R.VENDORS)


def _signal(when: Column, name: str, detail: Column, confidence) -> Column:
    return F.when(when, F.struct(F.lit(name).alias("name"), detail.alias("detail"), (F.lit(confidence) if isinstance(confidence, str) else confidence).alias("confidence")))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def identify(evidence: DataFrame) -> DataFrame:
    """path, is_ai_generated, platform, confidence, ai_source_kind, ai_from_metadata, watermarks, signals, caveats, integrity_clashes."""
    c, scan, region = F.col("c2pa"), F.coalesce("scan", F.lit(bytearray())), F.coalesce("region", "scan", F.lit(bytearray()))
    strings = F.array().cast("array<string>")
    level = credential_level(c)
    base = evidence.select(
        "*",
        scan.alias("_scan"),
        region.alias("_region"),
        (F.coalesce(c["present"], F.lit(False)) | c2pa_marker(scan)).alias("_has"),
        level.alias("_level"),
        source_kind(c["ai_source_kind"], scan).alias("_kind"),
        F.when(c["issuer"].isNotNull(), F.array(c["issuer"])).otherwise(sorted_matches(region, R.ISSUER_NAMES, True)).alias("_issuers"),
        first_match(region, R.CAMERAS, True).alias("_camera"),
        first_match(region, R.SIGNERS, True).alias("_signer"),
        F.coalesce(c["claim_generator"], F.nullif(F.array_join(sorted_matches(region, R.AI_TOOLS, True), ", "), F.lit(""))).alias("_generator"),
        F.filter(F.coalesce(c["codes"], strings), lambda x: F.contains(x, F.lit("mismatch")) | F.contains(x, F.lit("invalid"))).alias("_failed"),
        F.array_sort(F.filter(F.coalesce("meta_keys", strings), lambda k: F.lower(k).isin(*R.LOCAL_KEYS))).alias("_local"),
    )
    has_c2pa, lev = F.col("_has"), F.col("_level")
    usable = lev != "invalid"
    identity = has_c2pa & (F.coalesce(c["identity_ai"], F.lit(False)) | contains_any(F.array_join("_issuers", " "), R.IDENTITY_AI))
    is_ai = usable & (F.col("_kind").isNotNull() | identity)
    trained = contains_any(F.col("_scan"), R.GENERATED_MARKERS, True)
    inferred = F.when(trained & c2pa_marker(F.col("_scan")), F.nullif(F.array_join(synthid_vendors(F.col("_region")), ", "), F.lit("")))
    base = base.withColumns(
        {
            "_ai": is_ai,
            "_synthid": F.coalesce(F.nullif(F.col("synthid"), F.lit("")), inferred),
            "_binding": F.coalesce(F.nullif(F.col("soft_binding"), F.lit("")), F.nullif(F.array_join(sorted_matches(F.col("_region"), R.SOFT_BINDINGS, True), ", "), F.lit(""))),
            "_cloud": F.when(~has_c2pa & has(F.col("_scan"), "dcterms:provenance", True), first_match(F.col("_scan"), R.CLOUD_STORES, True)),
            "_iptc": contains_any(F.col("_scan"), R.IPTC_MARKERS, True) & ~has_c2pa,
            "_iptc_ai": contains_any(F.col("_scan"), R.IPTC_FIELDS, True),
            "_named": F.nullif(F.nullif(F.col("iptc_system"), F.lit("")), F.lit("fields present")),
            "_aigc": F.col("aigc_label").isNotNull() | contains_any(F.col("_scan"), R.AIGC_MARKERS, True),
            "_producer": F.coalesce(F.element_at("aigc_label", F.lit("ContentProducer")), F.lit("")),
            "_tag": F.nullif(F.col("generator_tag"), F.lit("")),
            "_xai": F.coalesce("xai_signature", F.lit(False)),
            "_hf": F.nullif(F.col("hf_job"), F.lit("")),
            "_visible": F.coalesce("visible", F.array().cast("array<struct<key:string,label:string,platform:string,confidence:double>>")),
        }
    )
    col = F.col
    named = col("_iptc_ai") & col("_named").isNotNull()
    local = F.size("_local") > 0
    samsung = col("samsung_genai").isNotNull()
    any_visible = F.size("_visible") > 0
    issuers = F.array_join("_issuers", ", ")
    medium_or_high = F.when(lev == "verified", F.lit("high")).otherwise(F.lit("medium"))
    broken = F.concat(F.lit("C2PA manifest present, credential integrity invalid"), F.when(F.size("_failed") > 0, F.concat(F.lit("; "), F.array_join("_failed", ", "))).otherwise(""))
    detail = F.nullif(F.concat_ws(", ", F.nullif(issuers, F.lit("")), F.nullif(col("_generator"), F.lit("")), F.nullif(c["source_type"], F.lit(""))), F.lit(""))
    c2pa_detail = F.when(usable, F.coalesce(detail, F.lit("C2PA manifest present"))).otherwise(broken)
    tag = lambda v: F.transform("_visible", v)
    signals = F.concat(
        F.array_compact(
            F.array(
                _signal(has_c2pa, "c2pa", c2pa_detail, F.when(usable, medium_or_high).otherwise(F.lit("medium"))),
                _signal(col("_cloud").isNotNull(), "c2pa_cloud", _text("cloud manifest store: ", col("_cloud")), "medium"),
                _signal(col("_binding").isNotNull(), "soft_binding", _text("C2PA soft binding: ", col("_binding")), medium_or_high),
                _signal(col("_iptc"), "iptc", F.lit("digitalSourceType (Made with AI)"), "high"),
                _signal(col("_iptc_ai"), "iptc_ai_system", F.when(named, _text("IPTC AI disclosure (", col("_named"), ")")).otherwise("IPTC AI disclosure fields"), "high"),
                _signal(col("_aigc"), "aigc", _text("TC260 AIGC label", F.when(col("_producer") != "", _text(" (producer ", col("_producer"), ")")).otherwise("")), "high"),
                _signal(local, "gen_params", _text("embedded keys: ", F.array_join("_local", ", ")), "high"),
                _signal(col("_tag").isNotNull(), "exif_generator", _text("Embedded generator tag: ", col("_tag")), "high"),
                _signal(col("_xai"), "xai_signature", F.lit("EXIF Signature blob + UUID Artist"), "high"),
                _signal(col("_hf").isNotNull(), "hf_job", _text("HuggingFace job ", col("_hf")), "medium"),
                _signal(samsung, "samsung_genai", _text("Samsung genAIType=", col("samsung_genai").cast("string")), "medium"),
            )
        ),
        tag(lambda v: F.struct(F.concat(F.lit("visible_"), v["key"]).alias("name"), F.concat(F.lit("NCC confidence "), F.format_number(v["confidence"], 2)).alias("detail"), F.lit("medium").alias("confidence"))),
    )
    watermarks = F.concat(
        F.array_compact(
            F.array(
                F.when(has_c2pa, F.when(usable, _text("C2PA Content Credentials (", F.coalesce(F.nullif(issuers, F.lit("")), F.lit("unknown signer")), ")")).otherwise("C2PA Content Credentials (invalid asset binding or signature)")),
                F.when(col("_cloud").isNotNull(), _text("C2PA Durable Content Credentials (cloud manifest at ", col("_cloud"), "; embedded manifest absent)")),
                F.when(col("_synthid").isNotNull(), _text(F.when(usable, "SynthID watermark (").otherwise("SynthID watermark claimed by invalid C2PA credentials ("), col("_synthid"), ")")),
                F.when(col("_binding").isNotNull(), _text("Forensic watermark soft binding (", col("_binding"), ")")),
                F.when(col("_iptc"), "IPTC digitalSourceType (Made with AI)"),
                F.when(col("_iptc_ai"), F.when(named, _text("IPTC 2025.1 AI disclosure (", col("_named"), ")")).otherwise("IPTC 2025.1 AI disclosure fields")),
                F.when(col("_aigc"), "China AIGC label (TC260 standard)"),
                F.when(local, "Embedded generation parameters (Stable Diffusion / ComfyUI)"),
                F.when(col("_tag").isNotNull(), _text("Embedded generator tag: ", col("_tag"))),
                F.when(col("_xai"), "xAI/Grok EXIF signature"),
                F.when(col("_hf").isNotNull(), "HuggingFace-hosted job (hf-job-id)"),
                F.when(samsung, "Samsung Galaxy AI editing marker (genAIType)"),
            )
        ),
        tag(lambda v: F.concat(F.lit("Visible "), v["label"], F.lit(" (confidence "), F.format_number(v["confidence"], 2), F.lit(")"))),
    )
    trusted_but = (F.coalesce(c["integrity"], F.lit("")) == "valid") & (F.coalesce(c["signature"], F.lit("")) == "valid")
    caveats = F.array_distinct(
        F.array_compact(
            F.array(
                F.when(has_c2pa & ~usable, INVALID),
                F.when(has_c2pa & (lev == "unverified"), F.when(trusted_but, UNTRUSTED).otherwise(UNVALIDATED)),
                F.when(col("_cloud").isNotNull(), CLOUD),
                F.when(col("_synthid").isNotNull(), SYNTHID),
                F.when(col("_iptc"), IPTC_ONLY),
                F.when(col("_hf").isNotNull(), HF_JOB),
                F.when(samsung, SAMSUNG),
                F.lit(STRIP),
            )
        )
    )
    from_manifest = F.coalesce(
        col("_camera"),
        col("_signer"),
        F.when(col("_ai"), first_match_folded(col("_generator"), R.CLAIM_GENERATORS)),
        F.when(col("_ai"), first_match_folded(c["ai_tool"], R.CLAIM_GENERATORS)),
        attribute_platform(col("_issuers"), col("_ai")),
    )
    apple = F.when(has(col("_scan"), "Apple Photos Clean Up", True), "Apple Photos (Clean Up AI edit)").otherwise("Made-with-AI tag (e.g. Meta AI); platform not specified")
    platform = F.coalesce(
        F.when(has_c2pa & usable, from_manifest),
        F.when(col("_cloud").isNotNull(), _text("C2PA signer: ", col("_cloud"), " (cloud manifest)")),
        F.when(col("_iptc"), apple),
        F.when(named, _text(col("_named"), " (IPTC AISystemUsed)")),
        F.when(col("_aigc"), "China AIGC-labeled generator (TC260; e.g. Doubao)"),
        F.when(local, "Stable Diffusion / local pipeline (Automatic1111, ComfyUI, InvokeAI)"),
        F.when(col("_tag").isNotNull(), _text(col("_tag"), " (embedded generator tag)")),
        F.when(col("_xai"), "xAI (Grok / Aurora)"),
        F.when(col("_hf").isNotNull(), "HuggingFace-hosted job (model not identified)"),
        F.when(samsung, "Samsung Galaxy (Galaxy AI editing)"),
        F.get(tag(lambda v: v["platform"]), F.lit(0)),
    )
    claim = lambda when, family, vendor: F.when(when & vendor.isNotNull(), F.struct(F.lit(family).alias("family"), vendor.alias("vendor")))
    c2pa_vendor = F.coalesce(vendor_of(attribute_platform(col("_issuers"), F.lit(True))), vendor_of(col("_generator")), vendor_of(c["ai_tool"]))
    claims = F.array_compact(
        F.array(
            claim(has_c2pa & col("_ai"), "c2pa", c2pa_vendor),
            claim(usable, "synthid", vendor_of(col("_synthid"))),
            claim(named, "iptc_ai_system", vendor_of(col("_named"))),
            claim(col("_aigc"), "aigc", F.lit(R.GENERIC_AIGC)),
            claim(F.lit(True), "exif_generator", vendor_of(col("_tag"))),
            claim(col("_xai"), "xai", F.lit("xAI")),
        )
    )
    elsewhere = col("_iptc") | col("_iptc_ai") | col("_aigc") | local | col("_tag").isNotNull() | col("_xai")
    by_c2pa = has_c2pa & (col("_ai") | col("_synthid").isNotNull())
    from_metadata = (by_c2pa & usable) | elsewhere
    weak = any_visible | col("_hf").isNotNull() | samsung
    ai = F.when(from_metadata | weak, F.lit(True))
    broken_text = F.when(~usable, F.concat(F.lit("C2PA credentials failed integrity validation"), F.when(F.size("_failed") > 0, F.concat(F.lit(": "), F.array_join("_failed", ", "))).otherwise(".")))
    out = base.select("path", "_kind", "_has", "_iptc", "_level", *(x.alias(n) for x, n in ((ai, "is_ai_generated"), (platform, "platform"), (from_metadata, "ai_from_metadata"), (watermarks, "watermarks"), (signals, "signals"), (caveats, "caveats"), (claims, "claims"))),
        F.when((by_c2pa & (lev == "verified")) | elsewhere, "high").when(from_metadata | weak, "medium").otherwise("none").alias("confidence"),
        F.when(usable, col("_camera")).alias("camera"), broken_text.alias("_broken"))
    clashes = F.concat(F.array_compact(F.array("_broken")), integrity_clashes(F.col("claims"), F.when(F.size("claims") > 0, F.col("camera"))))
    kind = F.when(F.col("is_ai_generated") & ((F.col("_has") & (F.col("_level") != "invalid")) | F.col("_iptc")), F.col("_kind"))
    return out.select("path", "is_ai_generated", "platform", "confidence", kind.alias("ai_source_kind"), "ai_from_metadata", "watermarks", "signals", "caveats", clashes.alias("integrity_clashes"), "claims")


def confirmed_marks(report: DataFrame, producer: Column | None = None) -> DataFrame:
    """``report`` with ``provenance`` array<string>: the marks that its platform and signals confirm, sorted."""
    from ..functions.text import credit_code

    names = F.transform("signals", lambda s: s["name"])
    folded = F.lower(F.coalesce("platform", F.lit("")))
    found = [F.when(contains_any(folded, m[3]), F.lit(m[0])) for m in R.MARKS if m[3]]
    found += [F.when(F.array_contains(names, s), F.lit(m[0])) for m in R.MARKS for s in m[4] if s != "aigc"]
    code = credit_code(producer) if producer is not None else F.lit(None).cast("string")
    mark = F.lit(None).cast("string")
    for k, v in R.PRODUCER_MARKS.items():
        mark = F.when(code == k, F.lit(v)).otherwise(mark)
    aigc = F.when(F.array_contains(names, "aigc"), F.when(mark.isNotNull(), F.array(mark)).otherwise(F.array(*map(F.lit, R.FALLBACK_MARKS)))).otherwise(F.array().cast("array<string>"))
    return report.withColumn("provenance", F.array_sort(F.array_union(F.array_compact(F.array(*found)), aigc)))


def family_of(description: Column) -> Column:
    """The first signal family one of whose tokens the lower-cased description holds; else other."""
    out = F.lit("other")
    for name, tokens in reversed(R.FAMILIES):
        out = F.when(contains_any(F.lower(description), tokens), F.lit(name)).otherwise(out)
    return out


def is_ai_key(key: Column) -> Column:
    """A metadata key that generators write, or that names one; any case."""
    return F.lower(key).isin(*R.AI_KEYS) | contains_any(F.lower(key), R.AI_KEY_PARTS)


def manifest_chain(edges: DataFrame, roots: DataFrame, depth: int = 16) -> DataFrame:
    """(store, manifest, depth): manifests reached from each store's active one over valid ingredient edges
    (store, parent, child, valid), breadth first, each at its least depth."""
    reached = roots.select("store", F.col("active").alias("manifest"), F.lit(0).alias("depth"))
    frontier = reached
    good = edges.where("valid").select("store", F.col("parent").alias("manifest"), "child")
    for d in range(1, depth + 1):
        step = frontier.join(good, ["store", "manifest"]).select("store", F.col("child").alias("manifest")).distinct()
        frontier = step.join(reached, ["store", "manifest"], "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached


__all__ = ["EVIDENCE", "identify", "confirmed_marks", "family_of", "manifest_chain", "validation_states", "credential_level", "source_kind", "synthid_vendors", "attribute_platform", "vendor_of", "c2pa_marker", "ordered_matches"]
