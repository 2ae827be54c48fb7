"""Containers, records and logs from fabricated bytes."""

import json
import random

import media as m
import pytest
from pyspark.sql import functions as F

from tracelight.operators.verdict import identify
from tracelight.sources import containers as C
from tracelight.sources import logs
from tracelight.sources.media import collect_records, evidence_of, live_photo_id, read_media, require_version


@pytest.mark.parametrize("data, kind", [(m.png(), "png"), (m.jpeg(), "jpeg"), (m.mp4(), "isobmff"), (m.mkv(), "ebml"), (m.avi(), "avi"), (m.flv(), "flv"), (m.riff(b"WEBP"), "webp"), (b"", "unknown"), (b"zz", "unknown")])
def test_sniff(data, kind):
    assert C.sniff(data) == kind


@pytest.mark.parametrize("make", [m.mp4, m.mkv, m.avi, m.flv])
def test_native_labels(make):
    assert C.find_label(b"", C.label_payloads(make())) == json.loads(m.LABEL)
    assert C.label_payloads(make(b"not json")) and C.find_label(b"", C.label_payloads(make(b"not json"))) is None


def test_label_in_text():
    assert C.find_label(b'xx "AIGC": {"Label": "a}\\"b", "x": {"y": 1}} yy') == {"Label": 'a}"b', "x": '{"y": 1}'}
    assert C.find_label(b'<TC260:AIGC>{&quot;Label&quot;: &quot;1&quot;}</TC260:AIGC>') == {"Label": "1"}
    # the label's own XMP property may hold any object, with any entity, and decides
    assert C.find_label(b'x TC260:AIGC = "{&#34;other&#34;: &quot;a&amp;b&quot;}" "AIGC": {"Label": "2"}') == {"other": "a&b"}
    assert C.find_label(b'<TC260:AIGC>no json</TC260:AIGC> "AIGC": {"Label": "2"}') is None
    assert C.find_label(b'<TC260:AIGC>{&quot;Label&quot;: &quot;1&quot;}') is None
    assert C.find_label('é AIGC{"Label": "中"}'.encode()) == {"Label": "中"}
    assert C.find_label(b'"AIGC": {"other": 1}') is None and C.find_label(b'"AIGC": {"Label": ') is None


def test_regions_leave_pixels_out():
    data = m.jpeg(m.segment(0xE1, b"Exif\0\0abc"), tail=b"after")
    assert b"Bria" not in C.metadata_regions(data) and C.metadata_regions(data).endswith(b"after")
    data = m.png(before=m.text("a", "b"), tail=b"after")
    assert b"IDAT" not in C.metadata_regions(data) and C.metadata_regions(data).endswith(b"after")
    assert b"x" * 100 not in C.metadata_regions(m.mp4())
    assert C.metadata_regions(b"junk") == b"junk"


def test_late_chunk():
    data = m.png(after=m.chunk(b"zzZz", b"\0" * C.HEAD) + m.itxt("XML:com.adobe.xmp", "<TC260:AIGC>"))
    assert b"TC260:AIGC" not in data[: C.HEAD] and b"TC260:AIGC" in C.scan_buffer(data)


def test_texts_and_tags():
    data = m.png(before=m.text("parameters", "steps") + m.itxt("k", "é") + m.chunk(b"zTXt", b"z\0\0" + __import__("zlib").compress(b"packed")) + m.chunk(b"zTXt", b"bad\0\0xx"))
    assert C.png_texts(data) == [("parameters", "steps"), ("k", "é"), ("z", "packed")]
    assert C.tiff_tags(m.tiff({0x010E: b"Signature: x", 0x013B: b"me", 0x0131: b"abc"})) == [("ImageDescription", "Signature: x"), ("Software", "abc"), ("Artist", "me")]
    assert C.tiff_tags(b"junk") == [] and C.tiff_tags(b"II*\0\xff\xff\xff\xff") == []


@pytest.mark.parametrize("body, want", [(b"key\x63abc", "abc"), (b"key\x78\x03abc", "abc"), (b"key\x79\x00\x03abc", "abc"), (b"key\x63ab", None), (b"key", None), (b"no", None), (b"key\x01", None), (b"key\x61\xff", "ÿ")])
def test_cbor(body, want):
    assert C.cbor_text_after(body, b"key") == want


def test_jpeg_structure():
    data = m.jpeg(m.segment(0xE0, b"JFIF\0"), m.segment(0xDB, b"\0" + bytes(range(64))), m.segment(0xC2, b"\x08\0\x10\0\x10\x03\x01\x22\0\x02\x11\0\x03\x11\0"), m.segment(0xFE, b"hi"))
    s = C.jpeg_structure(data)
    assert s["jfif"] and s["progressive"] and s["subsampling"] == "4:2:0" and s["tables"] == [list(range(64))] and s["comments"] == ["hi"]
    assert [n for n, *_ in C.inventory(data)] == ["E0", "DB", "C2", "FE"] and [n for n, *_ in C.inventory(m.mp4())] == ["ftyp", "mdat", "moov"]


@pytest.mark.parametrize("seed", range(40))
def test_walkers_survive_damage(seed):
    rng = random.Random(seed)
    data = bytearray(rng.choice([m.png(before=m.text("a", "b")), m.jpeg(m.segment(0xE1, b"Exif\0\0" + m.tiff({0x0131: b"abcdef"}))), m.mp4(), m.mkv(), m.avi(), m.flv()]))
    for _ in range(rng.randint(1, 12)):
        data[rng.randrange(len(data))] = rng.randrange(256)
    data = bytes(data[: rng.randint(0, len(data))])
    for f in (C.sniff, C.metadata_regions, C.scan_buffer, C.trailer, C.label_payloads, C.png_texts, C.jpeg_structure, C.inventory, C.manifest_boxes):
        f(data)
    C.tiff_tags(C.exif_block(data))
    assert len(C.metadata_regions(data)) <= 2 * len(data) + 16


FILES = {
    "clean.png": m.png(before=m.text("Author", "me")),
    "sd.png": m.png(before=m.text("parameters", "a cat, Steps: 20")),
    "job.png": m.png(before=m.text("hf-job-id", "j7")),
    "grok.jpg": m.jpeg(m.segment(0xE1, b"Exif\0\0" + m.tiff({0x010E: b"Signature: " + b"A" * 80, 0x013B: b"123e4567-e89b-12d3-a456-426614174000"}))),
    "galaxy.jpg": m.jpeg(tail=b'PhotoEditor_Re_Edit_Data{"genAIType":17}'),
    "label.jpg": m.jpeg(m.segment(0xE1, b'x "AIGC": ' + m.LABEL)),
    "noise.jpg": m.jpeg(),
    "empty.png": b"",
    "tool.png": m.png(before=m.text("Software", "Midjourney v6")),
    "note.txt": b"not media",
}
WANT = {"clean.png": None, "sd.png": "gen_params", "job.png": "hf_job", "grok.jpg": "xai_signature", "galaxy.jpg": "samsung_genai", "label.jpg": "aigc", "noise.jpg": None, "tool.png": "exif_generator"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("media")
    (d / "sub").mkdir()
    for i, (name, data) in enumerate(FILES.items()):
        (d / ("sub" if i % 2 else ".") / name).write_bytes(data)
    return str(d)


def test_files_to_verdicts(spark, folder):
    files = read_media(spark, folder)
    assert files.count() == len(WANT)
    reports = identify(evidence_of(require_version(collect_records(files)))).collect()
    got = {r.path.rsplit("/", 1)[1]: [s.name for s in r.signals] for r in reports}
    assert got == {k: [v] if v else [] for k, v in WANT.items()}


def test_records_travel(spark, folder, tmp_path):
    """Verdicts from records that were written and read equal verdicts from the files."""
    records = collect_records(read_media(spark, folder))
    direct = identify(evidence_of(records)).drop("claims").collect()
    records.write.parquet(str(tmp_path / "r"))
    stored = identify(evidence_of(require_version(spark.read.parquet(str(tmp_path / "r"))))).drop("claims").collect()
    assert sorted(direct, key=str) == sorted(stored, key=str)
    from tracelight.streaming import stream_records, stream_verdicts

    q = stream_verdicts(stream_records(spark, str(tmp_path / "r"))).writeStream.format("memory").queryName("verdicts").start()
    try:
        q.processAllAvailable()
        assert spark.table("verdicts").count() == len(WANT)
    finally:
        q.stop()


def test_version_gate(spark, folder):
    records = collect_records(read_media(spark, folder)).withColumn("schema_version", F.lit(2))
    with pytest.raises(Exception, match="unsupported schema version"):
        require_version(records).collect()


def test_logs(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"path": "a", "bytes": 3}\nbroken\n{"path": "b"}\n')
    assert sorted(r.path for r in logs.read_json_lines(spark, str(tmp_path / "log.jsonl")).collect()) == ["a", "b"]
    rows = spark.createDataFrame([("h1", "b"), ("h1", "a"), ("h2", "c")], "sha256 string, filename string")
    for c in logs.MANIFEST.split(", ")[2:]:
        name, kind = c.split()
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    path = str(tmp_path / "manifest")
    rows.limit(0).write.option("header", True).csv(path)
    logs.append_manifest(spark, path, rows)
    logs.append_manifest(spark, path, rows)
    assert sorted((r.sha256, r.filename) for r in logs.read_manifest(spark, path).collect()) == [("h1", "a"), ("h2", "c")]
    logs.write_report(spark.createDataFrame([("p", ["a", "b"])], "path string, signals array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().signals == "a|b"
    logs.write_reports_json(spark.createDataFrame([("p",)], "path string"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().schema_version == 1


def test_live_photo_id(spark):
    from tracelight.sources.media import live_photos

    uid = "123E4567-E89B-12D3-a456-426614174000"
    rows = [("a.HEIC", f"Apple iOS {uid}"), ("b.mov", f"com.apple.quicktime {uid}"), ("c.jpg", uid), ("d.jpg", "Apple iOS"), ("e.jpg", f"content.identifier é {uid[:-1]}0")]
    df = spark.createDataFrame([(p, "x", t.encode("latin-1")) for p, t in rows], "path string, container string, scan binary")
    got = {r.path: r.id for r in df.select("path", live_photo_id(F.col("scan")).alias("id")).collect()}
    assert got == {"a.HEIC": uid, "b.mov": uid, "c.jpg": None, "d.jpg": None, "e.jpg": uid}
    assert {(r.still, r.clip) for r in live_photos(df).collect()} == {("a.HEIC", "b.mov"), ("e.jpg", "b.mov")}


def test_iptc():
    field = lambda r, d, v: bytes([0x1C, r, d]) + len(v).to_bytes(2, "big") + v
    body = field(2, 5, b"Title") + field(2, 80, "Zoë".encode())
    block = lambda kind, name, body: b"8BIM" + kind.to_bytes(2, "big") + name + len(body).to_bytes(4, "big") + body + b"\0" * (len(body) & 1)
    data = m.jpeg(m.segment(0xED, b"Photoshop 3.0\0" + block(0x03ED, b"\0\0", b"abc") + block(0x0404, b"\x01x", body)))
    assert C.iptc_fields(data) == [("2:5", "Title"), ("2:80", "Zoë")] and C.iptc_fields(m.png()) == []
    for k in range(len(data)):
        C.iptc_fields(data[:k])


def test_verdict_changes(spark):
    from tracelight.operators.audit import verdict_changes

    old = spark.createDataFrame([(1, True, "a"), (2, None, "b"), (3, True, "c")], "k int, ai boolean, p string")
    new = spark.createDataFrame([(1, True, "a"), (2, True, "b"), (4, None, "d")], "k int, ai boolean, p string")
    got = {r.k: (r.status, r.changed) for r in verdict_changes(old, new, "k", ["ai", "p"]).collect()}
    assert got == {1: ("same", []), 2: ("differs", ["ai"]), 3: ("only_old", []), 4: ("only_new", [])}


def test_forensic_records(spark, folder):
    from tracelight.sources.media import forensic_records

    got = {r.path.rsplit("/", 1)[1]: r for r in forensic_records(read_media(spark, folder)).collect()}
    assert [p.name for p in got["sd.png"].parts] == ["IHDR", "tEXt", "IDAT", "IEND"] and got["sd.png"].texts[0].k == "parameters"
    assert got["grok.jpg"].container == "jpeg" and got["grok.jpg"].tags[0].k == "ImageDescription" and len(got["noise.jpg"].sha256) == 64


def test_large_files_are_not_lost(spark, folder, tmp_path):
    """Above the bound, files come as windows with what they carry; a store that cannot be opened gives a row with an issue."""
    from tracelight.sources import media

    (tmp_path / "long.mp4").write_bytes(m.mp4())
    (tmp_path / "late.png").write_bytes(m.png(before=m.text("parameters", "a cat")) + b"x" * 5000)
    (tmp_path / "small.png").write_bytes(m.png(before=m.text("hf-job-id", "j")))
    small = len(m.png(before=m.text("hf-job-id", "j")))
    got = {r.path.rsplit("/", 1)[1]: r for r in media.media_records(spark, str(tmp_path), None, most_bytes=small).collect()}
    assert set(got) == {"long.mp4", "late.png", "small.png"}
    assert (got["small.png"].status, got["late.png"].status, got["long.mp4"].status) == ("complete", "windowed", "windowed")
    assert got["long.mp4"].container == "isobmff" and dict(got["long.mp4"].label) == json.loads(m.LABEL)
    assert {r.path.rsplit("/", 1)[1]: [s.name for s in r.signals] for r in identify(evidence_of(media.media_records(spark, str(tmp_path), None, most_bytes=small))).collect()}["late.png"] == ["gen_params"]


def test_windows():
    import io

    from tracelight.sources.media import read_windows

    data = m.mp4()
    kept = read_windows(io.BytesIO(data), len(data))
    assert b"mdat" not in kept and C.find_label(b"", C.label_payloads(kept)) == json.loads(m.LABEL)
    assert read_windows(io.BytesIO(b"a" * 50 + b"b" * 50), 100, 30, 20) == b"a" * 30 + b"b" * 20
    assert read_windows(io.BytesIO(b"abc"), 3, 30, 20) == b"abc"
    assert read_windows(io.BytesIO(data[:20]), 20)


def test_jpeg_tables_and_scans():
    dht = m.segment(0xC4, b"\x10" + bytes([1, 1] + [0] * 14) + b"ab")
    scan = b"\xff\xda" + (8).to_bytes(2, "big") + b"\x01\x01\x00\x00\x3f\x10" + b"\x12\xff\x00\x34"
    data = b"\xff\xd8" + dht + scan + scan + b"\xff\xd9"
    s = C.jpeg_structure(data)
    assert s["huffman"] == [{"id": 16, "counts": [1, 1] + [0] * 14}]
    assert s["scans"] == [{"components": 1, "first": 0, "last": 63, "high": 1, "low": 0}] * 2


def test_flatten(spark):
    import base64

    from tracelight.sources.external import flatten, flatten_records

    record = {"exif": {"Software": "x", "n": 3, "none": None}, "c2pa_base64": base64.b64encode(b"jumb c2pa").decode() + "...TRUNCATED 99", "name": {"deep": "left out"}, "list": ["hex:6162", {"k": "hex:zz"}], "bad_base64": "*"}
    pairs, scan = flatten(record)
    assert [k for k, _ in pairs] == ["exif", "Software", "n", "none", "c2pa_base64", "name", "list", "k", "bad_base64"]
    assert dict(pairs)["Software"] == "x" and dict(pairs)["n"] == "3" and dict(pairs)["none"] is None
    assert scan == b"x\n3\njumb c2pa\nab\nhex:zz\n*"
    rows = spark.createDataFrame([("a", json.dumps(record)), ("b", "{"), ("c", None), ("d", "[" * 100_000)], "path string, record string")
    got = {r.path: r for r in flatten_records(rows).collect()}
    assert bytes(got["a"].scan) == scan and got["a"].issue is None and all(got[k].issue and not got[k].pairs for k in "bcd")


def store(active="a", failures=(), successes=("assertion.dataHash.match", "claimSignature.validated", "claimSignature.insideValidity", "signingCredential.trusted"), **more):
    code = lambda cs: [{"code": c} for c in cs]
    made = {"claim_generator": "ChatGPT", "signature_info": {"issuer": "OpenAI OpCo", "time": "2025-01-01"}, "assertions": [{"label": "c2pa.actions.v2", "data": {"actions": [{"action": "c2pa.created", "digitalSourceType": "http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia", "softwareAgent": {"name": "GPT-4o"}}]}}]}
    return {"active_manifest": active, "manifests": {"a": made}, "validation_results": {"activeManifest": {"success": code(successes), "failure": code(failures)}}} | more


def test_credentials_from_stores(spark):
    from tracelight.operators.credentials import credentials, with_credentials

    chained = store()
    chained["manifests"] = {
        "a": {"claim_generator": "Editor 1", "ingredients": [{"active_manifest": "b"}, {"active_manifest": "bad", "validation_status": [{"code": "assertion.dataHash.mismatch"}]}, {"active_manifest": "a"}, {"title": "none"}]},
        "b": {"claim_generator_info": [{"name": "DALL-E"}], "signature_info": {"common_name": "Google"}, "ingredients": [{"active_manifest": "c"}, {"active_manifest": "a"}], "assertions": [{"label": "c2pa.soft-binding", "data": {"alg": "com.digimarc.1"}}]},
        "c": {"signature_info": {"issuer": "Adobe"}, "assertions": [{"label": "c2pa.actions", "data": {"actions": [{"action": "c2pa.watermarked.bound", "digitalSourceType": "compositeWithTrainedAlgorithmicMedia", "softwareAgent": "Photoshop"}, {"action": "other"}]}}]},
        "bad": {"claim_generator": "Firefly", "signature_info": {"issuer": "Truepic"}},
    }
    stores = {
        "verified": store(), "broken": store(failures=("claimSignature.mismatch", "x")), "old": {"active_manifest": "a", "manifests": {"a": {}}, "validation_status": [{"code": "assertion.bmffHash.mismatch"}]},
        "chain": chained, "error": {"error": "no"}, "odd": {"active_manifest": 3, "manifests": {"a": []}, "validation_results": {"activeManifest": {"failure": ["x"]}}}, "list": [1], "outside": store(failures=("claimSignature.outsideValidity",)),
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in stores.items()] + [("text", "{{"), ("null", None)], "path string, store string")
    got = {r.path: r for r in credentials(rows).collect()}
    v = got["verified"].c2pa
    assert (v.issuer, v.claim_generator, v.ai_tool, v.ai_source_kind, v.identity_ai) == ("OpenAI", "ChatGPT", "ChatGPT, GPT-4o", "generated", True)
    assert (v.integrity, v.signature, v.signer_trust, v.signer_validity) == ("valid", "valid", "trusted", "valid")
    assert got["verified"].actions == "created" and got["verified"].time == "2025-01-01" and got["verified"].synthid is None  # its vendor needs a watermark action
    assert got["broken"].c2pa.signature == "invalid" and got["broken"].c2pa.codes[-2:] == ["claimSignature.mismatch", "x"]
    assert got["outside"].c2pa.signature == "invalid"
    assert got["old"].c2pa.integrity == "invalid" and got["old"].c2pa.issuer is None
    c = got["chain"].c2pa
    assert (c.issuer, c.claim_generator, c.ai_tool, c.ai_source_kind, c.source_type) == ("Google LLC, Adobe", "Editor 1", "DALL-E", "enhanced", "compositeWithTrainedAlgorithmicMedia (AI-enhanced)")
    assert (got["chain"].actions, got["chain"].soft_binding, got["chain"].synthid, got["chain"].watermarked) == ("watermarked.bound, other", "Digimarc", "Google LLC", True)
    assert all(got[k].c2pa is None for k in ("error", "list", "text", "null"))

    # verdicts of files with such stores: verified, invalid and unverified
    empty = spark.createDataFrame([], "path string")
    from tracelight.operators.verdict import EVIDENCE

    kinds = spark.createDataFrame([], EVIDENCE).schema
    blank = spark.createDataFrame([(k,) for k in ("verified", "broken", "chain", "none")], empty.schema).select("path", *(F.lit(None).cast(f.dataType).alias(f.name) for f in kinds if f.name != "path"))
    said = {r.path: r for r in identify(with_credentials(blank, rows)).collect()}
    assert (said["verified"].is_ai_generated, said["verified"].confidence, said["verified"].platform, said["verified"].ai_source_kind) == (True, "high", "OpenAI (ChatGPT / gpt-image / DALL-E / Sora)", "generated")
    assert said["broken"].is_ai_generated is None and said["broken"].confidence == "none" and "claimSignature.mismatch" in said["broken"].integrity_clashes[0]
    assert said["chain"].is_ai_generated and "SynthID watermark (Google LLC)" in said["chain"].watermarks and said["none"].signals == []


def test_app_evidence(spark):
    from tracelight.operators.credentials import app_evidence, is_ai_value
    from tracelight.sources.media import GENERATOR_TOKENS

    cases = {
        '{"product":"doubao"}': ("ByteDance Doubao", None), r'{\"Product\": \"Dreamina\", \"exportType\":\"generation\"}': ("ByteDance Dreamina", "ByteDance Dreamina"),
        '{"product":"aweme","aigc_info":{"aigc_type":1}}': (None, "ByteDance Aweme AI"), '{"product":"aweme","aigc_info":{"aigc_type":12}}': (None, None),
        '{"aigc_info":{"aigc_label_type": 2}}': (None, "Embedded app AIGC disclosure"), '{"aigc_label_type":2}': (None, None), "plain": (None, None), None: (None, None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", app_evidence(F.col("t")).alias("e"), is_ai_value(F.col("t"), GENERATOR_TOKENS).alias("ai")).collect()
    assert {r.t: (r.e.provenance, r.e.generator) for r in rows} == cases
    assert all(r.ai == any(cases[r.t]) for r in rows)


def test_item_inventory(spark, tmp_path):
    box = lambda kind, *parts: (8 + sum(map(len, parts))).to_bytes(4, "big") + kind + b"".join(parts)
    infe = lambda version, kind: box(b"infe", bytes([version, 0, 0, 0]) + bytes(4 if version == 3 else 2) + b"\0\0" + kind)
    meta = box(b"meta", bytes(4), box(b"iinf", bytes(4) + b"\0\3", infe(2, b"hvc1"), infe(3, b"Exif"), infe(2, b"hvc1")), box(b"iprp", box(b"ipco", box(b"ispe", bytes(12)), box(b"auxC", bytes(4) + b"urn:depth\0x"))))
    mvhd = box(b"mvhd", bytes(4) + (C.EPOCH_1904 + 1000).to_bytes(4, "big") + bytes(40))
    data = box(b"ftyp", b"heic") + meta + box(b"moov", mvhd, box(b"udta", b"\xa9mak\0\x05\0\0Apple\0"))
    assert C.item_inventory(data) == {"items": ["Exif", "hvc1"], "properties": ["ispe", "auxC"], "auxiliary": "urn:depth", "created": 1000, "quicktime": [("make", "Apple")]}
    rng = random.Random(5)
    for _ in range(100):
        bad = bytearray(data)
        for _ in range(5):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        C.item_inventory(bytes(bad[: rng.randint(0, len(bad))]))
    from tracelight.sources.media import forensic_records

    (tmp_path / "a.heic").write_bytes(data)
    (row,) = forensic_records(read_media(spark, str(tmp_path))).collect()
    assert (row["items"], row.auxiliary, row.created, row.quicktime[0].v, row.issue) == (["Exif", "hvc1"], "urn:depth", 1000, "Apple", None)
