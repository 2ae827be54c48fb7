"""The verdict rules over documents: analogous tokens stand for markers, as the tables hold no media."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import contains_any, first_match
from ..operators import arbiter, registries, verdict
from ..operators.clashes import integrity_clashes
from . import query, table

_PLATFORM = (("GNU General", "FSF"), ("Apache License", "ASF"), ("MIT License", "MIT"), ("CC BY", "CC"))
_FIRST = "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN '{x}'" for t, x in _PLATFORM) + " END"
_STRONG = "(contains(text, 'MIT License') OR contains(text, 'Apache License'))"
_WEAK = "(contains(text, 'CC BY') OR contains(text, '@'))"
_VERDICT = f"""
SELECT d.doc_id, CASE WHEN {_STRONG} OR {_WEAK} OR l.toxic = 1 THEN 'flagged' END AS verdict,
       CASE WHEN {_STRONG} THEN 'high' WHEN {_WEAK} OR l.toxic = 1 THEN 'medium' ELSE 'none' END AS confidence,
       coalesce({_FIRST}, CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN l.toxic = 1 THEN 'label' END) AS platform,
       d.lang, array_to_string(list_filter([CASE WHEN {_STRONG} THEN 'license' END, CASE WHEN contains(text, 'CC BY') THEN 'cc' END,
         CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS signals
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
"""


def _verdicts(spark, sf):
    text = F.col("text")
    # what the text says is computed in the scan, so that the join carries flags and no texts
    docs = table(spark, sf, "documents").select(
        "doc_id", "lang", contains_any(text, ["MIT License", "Apache License"]).alias("strong"), F.contains(text, F.lit("@")).alias("contact"), F.contains(text, F.lit("CC BY")).alias("cc"), first_match(text, _PLATFORM).alias("named")
    )
    rows = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    strong, contact, cc = F.col("strong"), F.col("contact"), F.col("cc")
    toxic = F.coalesce(F.col("toxic") == 1, F.lit(False))
    weak = cc | contact | toxic
    return rows.select(
        "doc_id",
        F.when(strong | weak, "flagged").alias("verdict"),  # or NULL, never a denial
        F.when(strong, "high").when(weak, "medium").otherwise("none").alias("confidence"),
        F.coalesce("named", F.when(contact, "contact"), F.when(toxic, "label")).alias("platform"),
        "lang",
        F.array_join(F.array_compact(F.array(F.when(strong, F.lit("license")), F.when(cc, F.lit("cc")), F.when(contact, F.lit("contact")), F.when(toxic, F.lit("toxic")))), ",").alias("signals"),
    )


@query(_VERDICT)
def verdict_engine(spark, sf):
    return _verdicts(spark, sf)


@query(f"SELECT platform, lang, confidence, count(*) AS n, count(verdict) AS n_flagged FROM ({_VERDICT}) v GROUP BY ALL ORDER BY n DESC")
def verdict_summary(spark, sf):
    """The flagship: verdict of each document, counted by platform, language and confidence."""
    return _verdicts(spark, sf).groupBy("platform", "lang", "confidence").agg(F.count("*").alias("n"), F.count("verdict").alias("n_flagged"))


# what a reader of the rules expects of each kind of evidence: AI, platform, confidence, signals, caveats
_EXPECTED = (
    (0, None, None, "none", 0, 1),
    (1, True, "Made-with-AI tag (e.g. Meta AI); platform not specified", "high", 1, 2),
    (2, True, "HuggingFace-hosted job (model not identified)", "medium", 1, 2),
    (3, True, "Samsung Galaxy (Galaxy AI editing)", "medium", 1, 2),
    (4, True, "xAI (Grok / Aurora)", "high", 1, 1),
    (5, True, "Midjourney v6 (embedded generator tag)", "high", 1, 1),
    (6, True, "Stable Diffusion / local pipeline (Automatic1111, ComfyUI, InvokeAI)", "high", 1, 1),
    (7, None, "C2PA signer: Adobe Content Authenticity (cloud manifest)", "none", 1, 2),
)


@query(f"""
SELECT doc_id, is_ai_generated, platform, confidence, n_signals, n_caveats FROM documents JOIN (VALUES {", ".join(f"({k}, {'NULL::BOOLEAN' if ai is None else ai}, {'NULL' if p is None else repr(p)}, '{c}', {n}, {m})" for k, ai, p, c, n, m in _EXPECTED)})
  e(kind, is_ai_generated, platform, confidence, n_signals, n_caveats) ON doc_id % 8 = kind
""")
def provenance_reports(spark, sf):
    """The rule engine over documents as evidence: their text is the scan buffer, to which a mark is added for each kind of evidence."""
    k = F.col("doc_id") % 8
    only = lambda n, v: F.when(k == n, v)
    mark = F.coalesce(only(1, F.lit(" trainedAlgorithmicMedia")), only(7, F.lit(" dcterms:provenance https://cai-manifests.adobe.com/m")), F.lit(""))
    found = {
        "path": F.col("doc_id").cast("string"), "scan": F.concat("text", mark).cast("binary"), "hf_job": only(2, F.lit("j1")), "samsung_genai": only(3, F.lit(17)),
        "xai_signature": k == 4, "generator_tag": only(5, F.lit("Midjourney v6")), "meta_keys": only(6, F.array(F.lit("parameters"), F.lit("Title"))),
    }
    empty = spark.createDataFrame([], verdict.EVIDENCE)
    evidence = table(spark, sf, "documents").select(*(found.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema))
    report = verdict.identify(evidence)
    return report.select(F.col("path").cast("long").alias("doc_id"), "is_ai_generated", "platform", "confidence", F.size("signals").alias("n_signals"), F.size("caveats").alias("n_caveats"))


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 3 = 0 THEN 'OpenAI, Adobe' ELSE 'OpenAI' END AS issuer, CASE WHEN p_partkey % 5 <> 4 THEN p_brand END AS claim_generator,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 3 = 0 THEN 'GPT-4o, Firefly' ELSE 'GPT-4o' END AS ai_tool,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 2 = 0 THEN 'generated' WHEN p_partkey % 3 = 0 THEN 'enhanced' END AS ai_source_kind,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 7 = 0 THEN 'invalid' ELSE 'valid' END AS integrity, CASE WHEN p_partkey % 5 <> 4 THEN 1 END AS n_codes,
  CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN p_partkey % 3 = 0 THEN 'created, edited' ELSE 'created' END AS actions
FROM part
""")
def manifest_stores(spark, sf):
    """Manifest stores as JSON, with an ingredient whose credential holds or fails, to credential fields."""
    from ..operators.credentials import credentials

    k = F.col("p_partkey")
    media = "http://cv.iptc.org/newscodes/digitalsourcetype/"
    one = lambda name, tool, kind: F.struct(F.lit("c2pa.actions").alias("label"), F.struct(F.array(F.struct(F.lit(name).alias("action"), kind.alias("digitalSourceType"), F.struct(F.lit(tool).alias("name")).alias("softwareAgent"))).alias("actions")).alias("data"))
    code = lambda c: F.array(F.struct(c.alias("code")))
    failed = F.when(k % 3 == 0, F.lit("signingCredential.untrusted")).otherwise("claimSignature.mismatch")
    manifests = F.create_map(
        F.lit("main"),
        F.struct(
            F.col("p_brand").alias("claim_generator"), F.struct(F.lit("OpenAI").alias("issuer")).alias("signature_info"),
            F.array(one("c2pa.created", "GPT-4o", F.when(k % 2 == 0, media + "trainedAlgorithmicMedia"))).alias("assertions"),
            F.array(F.struct(F.lit("part").alias("active_manifest"), code(failed).alias("validation_status"))).alias("ingredients"),
        ),
        F.lit("part"),
        F.struct(
            F.lit("Editor").alias("claim_generator"), F.struct(F.lit("Adobe").alias("issuer")).alias("signature_info"),
            F.array(one("c2pa.edited", "Firefly", F.lit(media + "compositeWithTrainedAlgorithmicMedia"))).alias("assertions"), F.array().cast("array<struct<active_manifest:string,validation_status:array<struct<code:string>>>>").alias("ingredients"),
        ),
    )
    bad = k % 7 == 0
    status = F.struct(F.struct(F.when(~bad, code(F.lit("assertion.dataHash.match"))).alias("success"), F.when(bad, code(F.lit("assertion.dataHash.mismatch"))).alias("failure")).alias("activeManifest"))
    made = F.to_json(F.struct(F.lit("main").alias("active_manifest"), manifests.alias("manifests"), status.alias("validation_results")))
    stores = table(spark, sf, "part").select("p_partkey", F.when(k % 5 == 4, F.lit('{"error": "no manifest"}')).otherwise(made).alias("store"))
    of = lambda f: F.col(f"c2pa.{f}")
    return credentials(stores, "p_partkey").select("p_partkey", *(of(f).alias(f) for f in ("issuer", "claim_generator", "ai_tool", "ai_source_kind", "integrity")), F.size(of("codes")).alias("n_codes"), "actions")


@query("""
SELECT event_id, CASE k % 6 WHEN 0 THEN 'ByteDance Doubao' WHEN 1 THEN 'ByteDance Dreamina' END AS provenance,
  CASE k % 6 WHEN 1 THEN 'ByteDance Dreamina' WHEN 2 THEN 'ByteDance Aweme AI' WHEN 3 THEN 'Embedded app AIGC disclosure' END AS generator
FROM (SELECT event_id, event_id AS k FROM events)
""")
def app_disclosures(spark, sf):
    """What apps write beside other marks: product, export and disclosure, around the events' own properties."""
    from ..operators.credentials import app_evidence

    texts = ('{"product":"doubao"}', '{\\"product\\":\\"DREAMINA\\",\\"exportType\\":\\"generation\\"}', '{"product":"aweme","aigc_info":{"aigc_type":1}}', '{"aigc_info":{"aigc_label_type":2}}', '{"product":"aweme","aigc_info":{"aigc_type":12}}', "")
    text = F.concat(F.coalesce("props", F.lit("")), F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 6 + 1).cast("int")))
    return table(spark, sf, "events").select("event_id", app_evidence(text).alias("e")).select("event_id", "e.provenance", "e.generator")


@query("""
WITH c AS (
  SELECT doc_id, 'lang' AS family, CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'B' ELSE 'C' END AS vendor FROM documents
  UNION ALL SELECT doc_id, 'source', CASE WHEN source IN ('src0', 'src1', 'src2') THEN 'A' ELSE 'B' END FROM documents
  UNION ALL SELECT doc_id, 'license', 'A' FROM documents WHERE contains(text, 'License')
)
SELECT a.doc_id, count(*) AS n_pairs FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.family < b.family AND a.vendor <> b.vendor GROUP BY a.doc_id
""")
def integrity_clash(spark, sf):
    """Pairs of claims that differ in family and vendor, over arrays instead of a self-join."""
    claim = lambda f, v: F.struct(F.lit(f).alias("family"), v.alias("vendor"))
    docs = table(spark, sf, "documents")
    claims = F.array_compact(
        F.array(
            claim("lang", F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "B").otherwise("C")),
            claim("source", F.when(F.col("source").isin("src0", "src1", "src2"), "A").otherwise("B")),
            F.when(F.contains("text", F.lit("License")), claim("license", F.lit("A"))),
        )
    )
    one = docs.select("doc_id", F.explode(F.transform(claims, lambda a: F.size(F.filter(claims, lambda b: (a["family"] < b["family"]) & (a["vendor"] != b["vendor"]))))).alias("n"))
    return one.groupBy("doc_id").agg(F.sum("n").alias("n_pairs")).where("n_pairs > 0")


@query("""
SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 AND s_suppkey % 2 = 0 THEN
  'Conflicting AI-origin attributions from independent signals: Google (via exif_generator) vs OpenAI (via c2pa, synthid) -- one provenance set was likely spoofed, transplanted, or laundered.'
  ELSE '' END AS clash FROM supplier
""")
def clash_messages(spark, sf):
    claim = lambda f, v: F.struct(F.lit(f).alias("family"), F.lit(v).alias("vendor"))
    odd = (F.col("s_nationkey") % 5 == 0) & (F.col("s_suppkey") % 2 == 0)
    claims = F.array_compact(F.array(claim("synthid", "OpenAI"), claim("c2pa", "OpenAI"), F.when(odd, claim("exif_generator", "Google"))))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(integrity_clashes(claims, F.lit(None).cast("string")), "; ").alias("clash"))


_VENDOR = "CASE " + " ".join(f"WHEN contains(lower(n), '{t}') THEN '{v}'" for t, v in registries.VENDORS) + " END"


@query(f"SELECT p_partkey, {_VENDOR} AS vendor FROM (SELECT p_partkey, p_name || CASE p_partkey % 4 WHEN 0 THEN ' DALL-E' WHEN 1 THEN ' Imagen 3' WHEN 2 THEN ' Stable Diffusion XL' ELSE '' END AS n FROM part)")
def vendor_normalize(spark, sf):
    suffix = F.when(F.col("p_partkey") % 4 == 0, " DALL-E").when(F.col("p_partkey") % 4 == 1, " Imagen 3").when(F.col("p_partkey") % 4 == 2, " Stable Diffusion XL").otherwise("")
    return table(spark, sf, "part").select("p_partkey", verdict.vendor_of(F.concat("p_name", suffix)).alias("vendor"))


@query("""
SELECT doc_id, CASE WHEN contains(replace(replace(t, 'compositeWithTrainedAlgorithmicMedia', ''), 'compositeSynthetic', ''), 'rainedAlgorithmicMedia') THEN 'generated'
  WHEN contains(t, 'composite') THEN 'enhanced' END AS kind
FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN 'trainedAlgorithmicMedia' WHEN 1 THEN 'compositeWithTrainedAlgorithmicMedia' WHEN 2 THEN 'compositeSynthetic' ELSE '' END AS t FROM documents)
""")
def source_kinds(spark, sf):
    k = F.col("doc_id") % 4
    mark = F.when(k == 0, "trainedAlgorithmicMedia").when(k == 1, "compositeWithTrainedAlgorithmicMedia").when(k == 2, "compositeSynthetic").otherwise("")
    docs = table(spark, sf, "documents").select("doc_id", F.concat("text", mark).cast("binary").alias("scan"))
    return docs.select("doc_id", verdict.source_kind(F.lit(None).cast("string"), F.col("scan")).alias("kind"))


@query("""
SELECT event_id, CASE WHEN k % 5 = 0 THEN 'invalid' WHEN k % 2 = 0 THEN 'valid' ELSE 'unknown' END AS integrity,
  CASE WHEN k % 7 = 0 THEN 'invalid' WHEN k % 3 = 0 THEN 'valid' ELSE 'unknown' END AS signature,
  CASE WHEN k % 4 = 0 THEN 'trusted' WHEN k % 11 = 0 THEN 'untrusted' ELSE 'unknown' END AS signer_trust
FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
""")
def validation_state_codes(spark, sf):
    k = F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")
    events = table(spark, sf, "events").select("event_id", k.alias("k"))
    code = lambda n, name: F.when(F.col("k") % n == 0, F.lit(name))
    good = F.array_compact(F.array(code(2, "assertion.dataHash.match"), code(3, "claimSignature.validated"), code(4, "signingCredential.trusted")))
    bad = F.array_compact(F.array(code(5, "assertion.dataHash.mismatch"), code(7, "claimSignature.mismatch"), code(11, "signingCredential.untrusted")))
    return events.select("event_id", verdict.validation_states(good, bad).alias("s")).select("event_id", "s.integrity", "s.signature", "s.signer_trust")


@query("""
WITH RECURSIVE e AS (SELECT p_partkey AS parent, p_partkey * 7 % 997 AS child, p_partkey % 11 <> 0 AS valid FROM part),
r AS (SELECT 5::BIGINT AS manifest, 0 AS depth UNION SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.manifest AND e.valid WHERE r.depth < 16)
SELECT 1 AS store, manifest, min(depth)::INT AS depth FROM r GROUP BY manifest
""")
def manifest_chain(spark, sf):
    """Breadth-first walk over valid ingredient edges."""
    edges = table(spark, sf, "part").select(F.lit(1).alias("store"), F.col("p_partkey").alias("parent"), (F.col("p_partkey") * 7 % 997).alias("child"), (F.col("p_partkey") % 11 != 0).alias("valid"))
    roots = spark.createDataFrame([(1, 5)], "store int, active long")
    from ..sources.shared import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return verdict.manifest_chain(edges, roots)


@query("SELECT s_suppkey, coalesce(n_name, 'fallback') AS mark FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def producer_join(spark, sf):
    known = table(spark, sf, "nation").where("n_regionkey < 3").select("n_nationkey", "n_name")
    return table(spark, sf, "supplier").join(known, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("fallback")).alias("mark"))


_CAND = """
c AS (SELECT user_id, bool_or(event_type = 'click' AND value > 30) AS jimeng_s, bool_or(event_type = 'click') AS jimeng_r,
        bool_or(event_type = 'view' AND value > 60) AS pill, bool_or(event_type = 'purchase' AND value > 80) AS doubao_s, bool_or(event_type = 'purchase') AS doubao_r,
        max(value) > 99 AS prov FROM events GROUP BY user_id)
"""


def _candidates(spark, sf):
    t, v = F.col("event_type"), F.col("value")
    e = table(spark, sf, "events").groupBy("user_id")
    return e.agg(
        F.bool_or((t == "click") & (v > 30)).alias("jimeng_s"), F.bool_or(t == "click").alias("jimeng_r"), F.bool_or((t == "view") & (v > 60)).alias("pill"),
        F.bool_or((t == "purchase") & (v > 80)).alias("doubao_s"), F.bool_or(t == "purchase").alias("doubao_r"), (F.max("value") > 99).alias("prov"),
    )


def _array(df):
    one = lambda key, s, r: F.struct(F.lit(key).alias("key"), F.col(s).alias("strict"), F.col(r).alias("relaxed"), (F.col("user_id") % 2 == 0).alias("flat"))
    return df.select("user_id", F.array(one("doubao", "doubao_s", "doubao_r"), one("jimeng", "jimeng_s", "jimeng_r"), one("jimeng_pill", "pill", "pill")).alias("c"), F.when(F.col("prov"), F.array(F.lit("jimeng"))).otherwise(F.array().cast("array<string>")).alias("p"))


@query(f"WITH {_CAND} SELECT user_id, prov AS jimeng_confirmed, prov OR jimeng_s AS pill_confirmed FROM c")
def trust_resolve(spark, sf):
    """The wordmark is confirmed by metadata only (the pill bears no witness), the pill by metadata of its own key or by a strict wordmark."""
    df = _array(_candidates(spark, sf))
    ok = lambda key, p: arbiter.confirmed(F.col("c"), F.lit(key), p, F.lit("auto"))
    pill = F.transform("p", lambda _: F.lit("jimeng_pill"))
    return df.select("user_id", ok("jimeng", F.col("p")).alias("jimeng_confirmed"), ok("jimeng_pill", pill).alias("pill_confirmed"))


@query(f"""
WITH {_CAND}, f AS (SELECT *, CASE WHEN prov THEN jimeng_r ELSE jimeng_s END AS jimeng FROM c)
SELECT user_id, array_to_string(list_filter([CASE WHEN doubao_s THEN 'doubao' END, CASE WHEN jimeng THEN 'jimeng' END,
  CASE WHEN pill AND NOT doubao_s AND (jimeng OR (prov AND user_id % 2 = 0)) THEN 'jimeng_pill' END], lambda x: x IS NOT NULL), ',') AS accepted FROM f
""")
def arbiter_decide(spark, sf):
    df = _array(_candidates(spark, sf))
    out = arbiter.decide(F.col("c"), F.col("p"), F.lit("auto"))
    return df.select("user_id", F.array_join(F.transform(out, lambda d: d["key"]), ",").alias("accepted"))


@query(f"WITH {_CAND} SELECT user_id, pill AND NOT doubao_s AND (jimeng_s OR (prov AND user_id % 2 = 0)) AS kept FROM c")
def pill_gate(spark, sf):
    df = _array(_candidates(spark, sf))
    fired = F.transform(F.filter("c", lambda x: x["strict"]), lambda x: x["key"])
    return df.select("user_id", (F.array_contains(fired, "jimeng_pill") & arbiter.keep_pill(fired, F.col("p"), F.col("user_id") % 2 == 0)).alias("kept"))


_FAM = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(t), '{x}')" for x in xs) + f" THEN '{n}'" for n, xs in registries.FAMILIES) + " ELSE 'other' END"


@query(f"SELECT p_partkey, {_FAM} AS family FROM (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Made with AI' WHEN 1 THEN ' C2PA Content Credentials' WHEN 2 THEN ' Visible Gemini sparkle' WHEN 3 THEN ' TC260 label' ELSE '' END AS t FROM part)")
def signal_family(spark, sf):
    k = F.col("p_partkey") % 5
    t = F.concat("p_name", F.when(k == 0, " Made with AI").when(k == 1, " C2PA Content Credentials").when(k == 2, " Visible Gemini sparkle").when(k == 3, " TC260 label").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", verdict.family_of(t).alias("family"))


@query("""
WITH t AS (SELECT user_id, event_id, round(value, 4) AS ncc, event_id * 37 % 101 AS fused FROM events WHERE event_type = 'click' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(value, 4) DESC, event_id) <= 3)
SELECT user_id, arg_max(event_id, (fused, ncc, -event_id)) AS event_id, count(*) AS considered FROM t GROUP BY user_id
""")
def sparkle_selection(spark, sf):
    """Of the three candidates that match best, the one whose fused score is highest."""
    one = F.struct("event_id", F.round("value", 4).alias("ncc"), (F.col("event_id") * 37 % 101).alias("fused"))
    found = table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    return found.select("user_id", arbiter.selected(F.col("c"), "ncc", "fused")["event_id"].alias("event_id"), F.least(F.lit(3), F.size("c")).cast("long").alias("considered"))
