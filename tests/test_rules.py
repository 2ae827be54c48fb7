"""Verdicts, clashes, trust and arbitration from hand-made evidence."""

import pytest
from pyspark.sql import functions as F

from tracelight.operators import arbiter, clashes, registries, verdict


def evidence(spark, **given):
    row = dict.fromkeys([f.split()[0] for f in ("path", "scan", "region", "c2pa", "meta_keys", "synthid", "soft_binding", "iptc_system", "aigc_label", "generator_tag", "xai_signature", "hf_job", "samsung_genai", "visible")])
    row |= {"path": "x", "scan": bytearray(b"")} | given
    if isinstance(row["scan"], bytes):
        row["scan"] = bytearray(row["scan"])
    if isinstance(row.get("c2pa"), dict):
        names = "present issuer claim_generator ai_tool source_type ai_source_kind identity_ai integrity signature signer_trust signer_validity codes".split()
        row["c2pa"] = tuple(row["c2pa"].get(n) for n in names)
    return spark.createDataFrame([tuple(row.values())], verdict.EVIDENCE)


def report(spark, **given):
    return verdict.identify(evidence(spark, **given)).first()


VERIFIED = {"present": True, "integrity": "valid", "signature": "valid", "signer_trust": "trusted", "signer_validity": "valid"}
MARKED = b"jumb C2PA "


def test_absence_is_null(spark):
    r = report(spark)
    assert r.is_ai_generated is None and r.confidence == "none" and r.platform is None and r.signals == [] and r.caveats == [verdict.STRIP] and not r.ai_from_metadata


def test_bare_c2pa_is_no_marker(spark):
    assert report(spark, scan=b"xx c2pa xx").signals == []
    assert [s.name for s in report(spark, scan=MARKED).signals] == ["c2pa"]
    assert [s.name for s in report(spark, scan=registries.C2PA_UUID).signals] == ["c2pa"]


@pytest.mark.parametrize(
    "given, ai, confidence, platform, names",
    [
        ({"scan": MARKED + b"OpenAI trainedAlgorithmicMedia"}, True, "medium", "OpenAI (ChatGPT / gpt-image / DALL-E / Sora)", ["c2pa"]),
        ({"scan": MARKED + b"OpenAI trainedAlgorithmicMedia", "c2pa": VERIFIED}, True, "high", "OpenAI (ChatGPT / gpt-image / DALL-E / Sora)", ["c2pa"]),
        ({"scan": MARKED + b"Adobe"}, None, "none", "C2PA signer: Adobe (no known AI generator named)", ["c2pa"]),
        ({"scan": MARKED + b"Dreamina"}, True, "medium", registries.BYTEDANCE, ["c2pa"]),
        ({"scan": MARKED + b"Pixel Camera Google"}, None, "none", "Google Pixel (camera, C2PA capture)", ["c2pa"]),
        ({"scan": MARKED + b"trainedAlgorithmicMedia", "c2pa": {"present": True, "integrity": "invalid"}}, None, "none", None, ["c2pa"]),
        ({"scan": b"dcterms:provenance cai-manifests.adobe.com"}, None, "none", "C2PA signer: Adobe Content Authenticity (cloud manifest)", ["c2pa_cloud"]),
        ({"scan": b"compositeWithTrainedAlgorithmicMedia Apple Photos Clean Up"}, True, "high", "Apple Photos (Clean Up AI edit)", ["iptc"]),
        ({"scan": b"AISystemUsed", "iptc_system": "Gemini"}, True, "high", "Gemini (IPTC AISystemUsed)", ["iptc_ai_system"]),
        ({"scan": b"AISystemUsed", "iptc_system": "fields present"}, True, "high", None, ["iptc_ai_system"]),
        ({"scan": b"TC260:AIGC"}, True, "high", "China AIGC-labeled generator (TC260; e.g. Doubao)", ["aigc"]),
        ({"aigc_label": {"ContentProducer": "doubao"}}, True, "high", "China AIGC-labeled generator (TC260; e.g. Doubao)", ["aigc"]),
        ({"meta_keys": ["workflow", "Prompt", "Author"]}, True, "high", "Stable Diffusion / local pipeline (Automatic1111, ComfyUI, InvokeAI)", ["gen_params"]),
        ({"generator_tag": "Ideogram AI"}, True, "high", "Ideogram AI (embedded generator tag)", ["exif_generator"]),
        ({"xai_signature": True}, True, "high", "xAI (Grok / Aurora)", ["xai_signature"]),
        ({"hf_job": "j1"}, True, "medium", "HuggingFace-hosted job (model not identified)", ["hf_job"]),
        ({"samsung_genai": 17}, True, "medium", "Samsung Galaxy (Galaxy AI editing)", ["samsung_genai"]),
        ({"visible": [("gemini", "sparkle", "Google Gemini family", 0.61)]}, True, "medium", "Google Gemini family", ["visible_gemini"]),
        ({"scan": b"com.adobe.trustmark"}, None, "none", None, ["soft_binding"]),
    ],
)
def test_stages(spark, given, ai, confidence, platform, names):
    r = report(spark, **given)
    assert (r.is_ai_generated, r.confidence, r.platform, [s.name for s in r.signals]) == (ai, confidence, platform, names)


def test_source_kind(spark):
    kind = lambda scan: spark.range(1).select(verdict.source_kind(F.lit(None).cast("string"), F.lit(bytearray(scan)))).first()[0]
    assert [kind(s) for s in (b"", b"trainedAlgorithmicMedia", b"compositeWithTrainedAlgorithmicMedia", b"compositeSynthetic TrainedAlgorithmicMedia", b"algorithmicMedia")] == [None, "generated", "enhanced", "generated", None]


def test_synthid(spark):
    text = MARKED + b"trainedAlgorithmicMedia "
    assert "SynthID watermark (Google LLC)" in report(spark, scan=text + b"Google").watermarks
    assert not any("SynthID" in w for w in report(spark, scan=text + b"OpenAI").watermarks)
    assert "SynthID watermark (OpenAI)" in report(spark, scan=text + b"OpenAI c2pa.watermarked").watermarks


def test_clash_in_a_report(spark):
    r = report(spark, scan=MARKED + b"OpenAI trainedAlgorithmicMedia", generator_tag="Ideogram AI")
    assert len(r.integrity_clashes) == 1 and "Ideogram (via exif_generator) vs OpenAI (via c2pa)" in r.integrity_clashes[0]
    r = report(spark, scan=MARKED + b"NIKON", c2pa=VERIFIED, generator_tag="Midjourney dall-e")
    assert any("Camera-capture" in c for c in r.integrity_clashes)
    r = report(spark, c2pa={"present": True, "signature": "invalid", "codes": ["claimSignature.mismatch", "x.ok"]})
    assert r.integrity_clashes == ["C2PA credentials failed integrity validation: claimSignature.mismatch"]


@pytest.mark.parametrize(
    "claims, n",
    [
        ([("c2pa", "OpenAI"), ("synthid", "Google")], 0),
        ([("c2pa", "OpenAI"), ("exif_generator", "OpenAI")], 0),
        ([("c2pa", "OpenAI"), ("exif_generator", "Google")], 1),
        ([("c2pa", "ByteDance"), ("aigc", registries.GENERIC_AIGC)], 0),
        ([("c2pa", "OpenAI"), ("aigc", registries.GENERIC_AIGC)], 1),
        ([], 0),
    ],
)
def test_clashes(spark, claims, n):
    df = spark.createDataFrame([(claims,)], "c array<struct<family:string,vendor:string>>")
    assert len(df.select(clashes.integrity_clashes(F.col("c"), F.lit(None).cast("string"))).first()[0]) == n


def test_platform_order(spark):
    r = report(spark, scan=b"TC260:AIGC", generator_tag="Midjourney", hf_job="x")
    assert r.platform.startswith("China AIGC") and [s.name for s in r.signals] == ["aigc", "exif_generator", "hf_job"]


@pytest.mark.parametrize("code, marks", [("91440101MA9Y9T4H7A", ["qwen"]), ("0011" + "91440101MA9Y9T4H7A" + "zz", ["qwen"]), ("none", ["doubao", "jimeng"])])
def test_producers(spark, code, marks):
    df = verdict.confirmed_marks(verdict.identify(evidence(spark, aigc_label={"ContentProducer": code})).withColumn("p", F.lit(code)), F.col("p"))
    assert df.first().provenance == marks


def decide(spark, candidates, provenance=(), sensitivity="auto"):
    df = spark.createDataFrame([(candidates, list(provenance), sensitivity)], "c array<struct<key:string,strict:boolean,relaxed:boolean,flat:boolean>>, p array<string>, s string")
    return [(d.key, d.relaxed) for d in df.select(arbiter.decide(F.col("c"), F.col("p"), F.col("s")).alias("d")).first().d]


@pytest.mark.parametrize(
    "candidates, provenance, sensitivity, want",
    [
        ([("qwen", False, True, False)], (), "auto", []),
        ([("qwen", False, True, False)], ("qwen",), "auto", [("qwen", True)]),
        ([("qwen", False, True, False)], ("qwen",), "strict", []),
        ([("qwen", True, True, False)], (), "auto", [("qwen", False)]),
        ([("jimeng", True, True, False), ("jimeng_pill", True, True, False)], (), "auto", [("jimeng", False), ("jimeng_pill", True)]),
        ([("jimeng", False, True, False), ("jimeng_pill", True, True, True)], (), "auto", []),
        ([("jimeng_pill", True, True, True)], ("jimeng",), "auto", [("jimeng_pill", False)]),
        ([("jimeng_pill", True, True, False)], ("jimeng",), "auto", []),
        ([("liblib", True, True, False), ("jimeng_pill", True, True, True)], ("jimeng",), "auto", [("liblib", False)]),
        ([("samsung", True, True, False), ("jimeng_pill", True, True, True)], ("jimeng",), "auto", [("samsung", False), ("jimeng_pill", False)]),
    ],
)
def test_arbiter(spark, candidates, provenance, sensitivity, want):
    assert decide(spark, candidates, provenance, sensitivity) == want


def test_manifest_chain(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    edges = spark.createDataFrame([(1, "a", "b", True), (1, "b", "c", True), (1, "a", "c", False), (1, "c", "a", True), (1, "c", "d", False), (2, "a", "z", True)], "store int, parent string, child string, valid boolean")
    roots = spark.createDataFrame([(1, "a")], "store int, active string")
    assert sorted(map(tuple, verdict.manifest_chain(edges, roots).collect())) == [(1, "a", 0), (1, "b", 1), (1, "c", 2)]


def test_validation_states(spark):
    df = spark.createDataFrame([(["assertion.dataHash.match", "claimSignature.validated", "signingCredential.trusted", "claimSignature.insideValidity"], []), ([], ["assertion.dataHash.mismatch", "signingCredential.expired"]), (None, None)], "s array<string>, f array<string>")
    got = [tuple(r[0]) for r in df.select(verdict.validation_states(F.col("s"), F.col("f"))).collect()]
    assert got == [("valid", "valid", "trusted", "valid"), ("invalid", "unknown", "unknown", "expired"), ("unknown",) * 4]
