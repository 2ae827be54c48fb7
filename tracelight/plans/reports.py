"""Joins and rollups of evaluation runs over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from . import query, table


@query("""
WITH labels AS (SELECT doc_id % 2 AS round, doc_id // 2 AS idx, (['doubao', 'jimeng', 'pill', 'sparkle', 'nothing', 'uncertain'])[length(text) % 6 + 1] AS seen FROM documents),
manifest AS (SELECT doc_id % 2 AS round, doc_id // 2 AS idx, doc_id % 100 AS uid, source AS path, (['doubao', 'jimeng_pill', 'gemini', 'other'])[doc_id % 4 + 1] AS key FROM documents),
j AS (SELECT uid, path, m.round::VARCHAR AS round, seen, CASE seen WHEN 'pill' THEN 'jimeng_pill' WHEN 'sparkle' THEN 'gemini' WHEN 'nothing' THEN NULL ELSE seen END AS mark,
  CASE WHEN key IN ('doubao', 'jimeng') THEN ['doubao', 'jimeng'] ELSE [key] END AS ruled FROM manifest m JOIN labels l ON l.round = m.round AND l.idx = m.idx WHERE seen <> 'uncertain')
SELECT uid, min(path) AS path, coalesce(array_to_string(list_sort(list(DISTINCT mark) FILTER (mark IS NOT NULL)), ','), '') AS present, array_to_string(list_sort(list(DISTINCT seen)), ',') AS seen,
  array_to_string(list_sort(list(DISTINCT round)), ',') AS rounds, array_to_string(list_sort(list_distinct(flatten(list(ruled)))), ',') AS adjudicated
FROM j GROUP BY uid
""")
def groundtruth_rounds(spark, sf):
    """Labels of two rounds met with their manifests on round and index."""
    d = table(spark, sf, "documents")
    place = [(F.col("doc_id") % 2).cast("string").alias("round"), F.floor(F.col("doc_id") / 2).alias("idx")]
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    labels = d.select(*place, pick(("doubao", "jimeng", "pill", "sparkle", "nothing", "uncertain"), F.length("text")).alias("seen"), F.lit(0).alias("line"))
    manifest = d.select(*place, (F.col("doc_id") % 100).alias("uid"), F.col("source").alias("path"), pick(("doubao", "jimeng_pill", "gemini", "other"), F.col("doc_id")).alias("key"))
    out = reports.ground_truth(labels, manifest)
    return out.select("uid", "path", *(F.array_join(c, ",").alias(c) for c in ("present", "seen", "rounds", "adjudicated")))


_OLD_NEW = """
o AS (SELECT doc_id AS uid, doc_id % 13 <> 0 AS readable, contains(text, 'License') AS ai, list_filter([CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(text, '#') THEN 'mark' END], lambda x: x IS NOT NULL) AS fam, lang AS platform, length(text) % 3 AS confidence FROM documents),
n AS (SELECT doc_id AS uid, CASE WHEN doc_id % 7 = 0 THEN 'ValueError' END AS error, contains(lower(text), 'license') AS ai, list_filter([CASE WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' END, CASE WHEN contains(text, '##') THEN 'mark' END], lambda x: x IS NOT NULL) AS fam, CASE WHEN lang = 'fr' THEN 'x' ELSE lang END AS platform, length(text) % 4 AS confidence FROM documents WHERE doc_id % 17 <> 0)
"""


@query(f"""
WITH {_OLD_NEW},
j AS (SELECT o.uid, CASE WHEN NOT readable THEN 'sidecar_unreadable' WHEN n.uid IS NULL THEN 'image_missing' WHEN error IS NOT NULL THEN 'identify_raised' ELSE 'ok' END AS status,
  list_filter([CASE WHEN o.ai AND NOT n.ai THEN 'lost_ai' END, CASE WHEN NOT o.ai AND n.ai THEN 'new_ai' END, CASE WHEN len(list_filter(o.fam, lambda x: NOT list_contains(n.fam, x))) > 0 THEN 'lost_signal' END,
    CASE WHEN len(list_filter(n.fam, lambda x: NOT list_contains(o.fam, x))) > 0 THEN 'new_signal' END, CASE WHEN o.platform IS DISTINCT FROM n.platform THEN 'platform' END, CASE WHEN o.confidence IS DISTINCT FROM n.confidence THEN 'confidence' END], lambda x: x IS NOT NULL) AS c
  FROM o LEFT JOIN n ON n.uid = o.uid)
SELECT uid, status, CASE WHEN status = 'ok' THEN CASE WHEN len(c) = 0 THEN 'unchanged' ELSE array_to_string(c, ',') END END AS classes FROM j
""")
def sidecar_regression(spark, sf):
    """Recorded verdicts against fresh ones; what cannot be compared keeps a row and a status."""
    d, t = table(spark, sf, "documents"), F.col("text")
    has = lambda mark: F.contains(t, F.lit(mark))
    some = lambda **flags: F.array_compact(F.array(*(F.when(f, F.lit(n)) for n, f in flags.items())))
    k = F.col("doc_id")
    old = d.select(k.alias("uid"), (k % 13 != 0).alias("readable"), has("License").alias("ai"), some(contact=has("@"), mark=has("#")).alias("families"), F.col("lang").alias("platform"), (F.length(t) % 3).alias("confidence"))
    new = d.where(k % 17 != 0).select(
        k.alias("uid"), F.when(k % 7 == 0, "ValueError").alias("error"), F.contains(F.lower(t), F.lit("license")).alias("ai"), some(contact=has("@") | has("http"), mark=has("##")).alias("families"),
        F.when(F.col("lang") == "fr", "x").otherwise(F.col("lang")).alias("platform"), (F.length(t) % 4).alias("confidence"),
    )
    return reports.sidecar_status(old, new).select("uid", "status", F.array_join("classes", ",").alias("classes"))


@query("""
WITH b AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, arg_max(floor(value / 50), (ts, event_id)) AS level FROM events WHERE event_type <> 'logout' GROUP BY user_id),
n AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS kind, arg_min(floor(value / 50), (ts, event_id)) AS level FROM events GROUP BY user_id)
SELECT n.user_id, CASE WHEN b.kind IS DISTINCT FROM n.kind THEN b.kind || '>' || n.kind END AS kind, b.level IS DISTINCT FROM n.level AS level_changed
FROM n JOIN b ON b.user_id = n.user_id WHERE b.kind IS DISTINCT FROM n.kind OR b.level IS DISTINCT FROM n.level
""")
def baseline_changes(spark, sf):
    """Against a log, of which the last row of a key counts, and rows with an error do not."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("kind"), F.floor(F.col("value") / 50).alias("level"))
    new = e.groupBy("user_id").agg(F.min_by(F.struct("kind", "level"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.*")
    log = e.withColumn("error", F.when(F.col("kind") == "logout", "x"))
    out = reports.against_baseline(new, log, "user_id", ["ts", "event_id"], ["kind", "level"], "error")
    return out.select("user_id", F.concat("kind.before", F.lit(">"), "kind.after").alias("kind"), F.col("level").isNotNull().alias("level_changed"))


@query("""
SELECT coalesce(a.k, b.k) AS k, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right, CASE WHEN b.n IS NULL THEN 'only_left' WHEN a.n IS NULL THEN 'only_right' WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' ELSE 'paired' END AS status
FROM (SELECT 'f' || o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL OUTER JOIN (SELECT 'f' || o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.k = b.k
""")
def paired_stems(spark, sf):
    """Originals and cleaned files met by stem, with the files of each side."""
    from ..functions.text import stem

    o = table(spark, sf, "orders")
    side = lambda status, suffix: o.where(F.col("o_orderstatus") == status).select(stem(F.concat(F.lit("f"), F.col("o_custkey").cast("string"), F.lit(suffix))).alias("k"))
    return reports.paired_sides(side("F", "_src.png"), side("O", "_clean.jpg"), "k")


@query("""
WITH v AS (SELECT o_orderpriority AS variant, round(avg(o_totalprice), 4) AS psnr FROM orders GROUP BY 1),
f AS (SELECT o_orderpriority AS variant, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice / 1e6 END AS identity, o_totalprice / 2e6 AS lpips, o_custkey / 1e3 AS ratio FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')
SELECT v.variant, count(f.variant) AS n_faces, round(avg(identity), 9) AS identity, round(avg(lpips), 9) AS face_lpips, round(avg(ratio), 9) AS lapvar_ratio, any_value(psnr) AS psnr FROM v LEFT JOIN f ON f.variant = v.variant GROUP BY v.variant
""")
def fidelity_report(spark, sf):
    o = table(spark, sf, "orders")
    none = F.lit(None).cast("double")
    variants = o.groupBy(F.col("o_orderpriority").alias("variant")).agg(F.round(F.avg("o_totalprice"), 4).alias("psnr")).select("variant", none.alias("cer"), none.alias("lpips"), none.alias("ssim"), "psnr")
    faces = o.where("o_orderstatus = 'P' AND o_orderpriority <> '5-LOW'").select(
        F.col("o_orderpriority").alias("variant"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice") / 1e6).alias("identity"), (F.col("o_totalprice") / 2e6).alias("lpips"), (F.col("o_custkey") / 1e3).alias("lapvar_ratio")
    )
    return reports.fidelity_table(variants, faces).select("variant", "n_faces", *(F.round(c, 9).alias(c) for c in ("identity", "face_lpips", "lapvar_ratio")), "psnr")


@query("""
SELECT count(*) FILTER (event_type <> 'error' AND value < 90) AS processed, count(*) FILTER (event_type = 'error' OR value >= 90) AS failed, count(*) FILTER (event_type = 'view' AND value < 90) AS unavailable,
  arg_min(event_type || ' ' || user_id, event_id) FILTER (event_type = 'error' OR value >= 90) AS first_error FROM events
""")
def batch_tallies(spark, sf):
    e = table(spark, sf, "events")
    failed = (F.col("event_type") == "error") | (F.col("value") >= 90)
    return reports.batch_summary(e.select(F.col("event_id").alias("path"), F.when(F.col("event_type") == "view", "unavailable").alias("outcome"), F.when(failed, F.concat("event_type", F.lit(" "), F.col("user_id").cast("string"))).alias("error")))


@query("""
WITH f AS (SELECT doc_id, unnest(list_filter([CASE WHEN contains(text, '@') THEN 'contact' END, CASE WHEN contains(text, 'icense') THEN 'license' END, CASE WHEN contains(text, 'http') THEN 'link' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '#') THEN 'hash' END], lambda x: x IS NOT NULL)) AS detector FROM documents),
k AS (SELECT * FROM (SELECT source, detector, count(*) AS k FROM documents JOIN f USING (doc_id) GROUP BY source, detector) QUALIFY row_number() OVER (PARTITION BY source ORDER BY k DESC, detector) <= 4),
s AS (SELECT source, string_agg(detector || ':' || k, ', ' ORDER BY k DESC, detector) AS detectors FROM k GROUP BY source),
b AS (SELECT source, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM f)) AS hits, count(DISTINCT lang) AS products FROM documents GROUP BY source)
SELECT b.source, n, round(hits / n, 9) AS share, coalesce(detectors, '') AS detectors, products, n >= 40 AS shown FROM b LEFT JOIN s ON s.source = b.source
""")
def vendor_cohorts(spark, sf):
    d, t = table(spark, sf, "documents"), F.col("text")
    marks = (("contact", "@"), ("license", "icense"), ("link", "http"), ("table", " | "), ("hash", "#"))
    fired = d.select(F.col("doc_id").alias("path"), F.explode(F.array_compact(F.array(*(F.when(F.contains(t, F.lit(m)), F.lit(n)) for n, m in marks)))).alias("detector"))
    return reports.cohort_report(d.select(F.col("doc_id").alias("path"), "source", "lang"), fired, "source", "lang", 40).withColumn("share", F.round("share", 9))


@query("""
WITH v AS (SELECT p_brand AS k, p_size / 50.0::DOUBLE AS v FROM part), e AS (SELECT k, min(v) * 0.9 AS s, max(v) * 1.1 AS t, count(*) AS n FROM v GROUP BY k),
g AS (SELECT k, n, s + i * 0.002 AS f, i FROM (SELECT *, unnest(range(0, ceil((t - s) / 0.002)::BIGINT)) AS i FROM e)),
c AS (SELECT g.k, g.i, any_value(f) AS f, any_value(n) AS n, count(*) FILTER (v.v >= f * 0.8013 AND v.v <= f * 1.2507) AS c FROM g JOIN v ON v.k = g.k GROUP BY ALL)
SELECT k, round(arg_max(f, (c, -i)), 6) AS fraction, round(max(c) / any_value(n), 9) AS coverage FROM c GROUP BY k
""")
def coverage_grid(spark, sf):
    """The one fraction of a grid whose window covers the most values."""
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("k"), (F.col("p_size") / 50.0).alias("v"))
    return reports.coverage_fit(rows, "k", "v", 0.8013, 1.2507).select("k", F.round("fraction", 6).alias("fraction"), F.round("coverage", 9).alias("coverage"))


_ARMS = "SELECT CASE WHEN event_type = 'click' THEN 'covered' WHEN event_type = 'view' THEN 'uncovered' ELSE 'clean' END AS arm, value AS score FROM events"


def _arms(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").select(F.when(kind == "click", "covered").when(kind == "view", "uncovered").otherwise("clean").alias("arm"), F.col("value").alias("score"))


@query(f"SELECT arm, count(*) AS n, {', '.join(f'round(quantile_cont(score, {q / 100}), 6) AS p{q}' for q in (50, 75, 90, 95, 99))}, max(score) AS top FROM ({_ARMS}) GROUP BY arm")
def probe_arms(spark, sf):
    out = reports.arms(_arms(spark, sf))
    return out.select("arm", "n", *(F.round(f"p{q}", 6).alias(f"p{q}") for q in (50, 75, 90, 95, 99)), "top")


@query(f"""
WITH a AS ({_ARMS}), g AS (SELECT unnest([0.95, 0.975, 0.99, 0.995, 0.999]) AS quantile, unnest((SELECT quantile_cont(score, [0.95, 0.975, 0.99, 0.995, 0.999]) FROM a WHERE arm = 'clean')) AS threshold)
SELECT quantile::DOUBLE AS quantile, round(threshold, 6) AS threshold, round(avg(CASE WHEN arm = 'clean' THEN (score >= threshold)::INT END), 9) AS clean_rate, round(avg(CASE WHEN arm = 'uncovered' THEN (score >= threshold)::INT END), 9) AS probed_rate,
  count(*) FILTER (arm = 'uncovered' AND score >= threshold) AS candidates FROM a, g WHERE arm IN ('clean', 'uncovered') GROUP BY ALL
""")
def probe_operating_points(spark, sf):
    out = reports.probe_points(_arms(spark, sf))
    return out.select("quantile", *(F.round(c, n).alias(c) for c, n in (("threshold", 6), ("clean_rate", 9), ("probed_rate", 9))), "candidates")


@query("""
WITH c AS (SELECT lang, count(*) FILTER (f AND b) AS tp, count(*) FILTER (f AND NOT b) AS fp, count(*) FILTER (NOT f AND b) AS fn FROM (SELECT lang, contains(text, '!!') OR contains(text, '***') AS f, quality = 0 AS b FROM documents JOIN labels USING (doc_id)) GROUP BY lang),
u AS (SELECT lang, tp, fp, fn, unnest(['precision', 'recall']) AS what, tp AS k, unnest([tp + fp, tp + fn]) AS n FROM c),
w AS (SELECT *, k / n AS p, 1.96 * 1.96 AS z FROM u),
r AS (SELECT lang, tp, fp, fn, what, round(CASE WHEN n > 0 THEN p END, 9) AS p, round(CASE WHEN n = 0 THEN 0 ELSE greatest(0, (p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4.0 * n * n))) / (1 + z / n)) END, 9) AS low,
  round(CASE WHEN n = 0 THEN 0 ELSE least(1, (p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4.0 * n * n))) / (1 + z / n)) END, 9) AS high FROM w)
SELECT lang, tp, fp, fn, max(p) FILTER (what = 'precision') AS precision, max(low) FILTER (what = 'precision') AS precision_low, max(high) FILTER (what = 'precision') AS precision_high,
  max(p) FILTER (what = 'recall') AS recall, max(low) FILTER (what = 'recall') AS recall_low, max(high) FILTER (what = 'recall') AS recall_high FROM r GROUP BY lang, tp, fp, fn
""")
def gate_intervals(spark, sf):
    """Precision and recall of a gate with the intervals of both."""
    from ..functions.tokens import contains_any

    rows = table(spark, sf, "documents").select("doc_id", "lang", contains_any(F.col("text"), ["!!", "***"]).alias("f")).join(table(spark, sf, "labels").select("doc_id", (F.col("quality") == 0).alias("b")), "doc_id")
    out = reports.gate_quality(rows, ["lang"], F.col("f"), F.col("b"))
    return out.select("lang", "tp", "fp", "fn", *(F.round(f"{m}{e}", 9).alias(f"{m}{e}") for m in ("precision", "recall") for e in ("", "_low", "_high")))


@query("""
WITH s AS (SELECT doc_id AS uid, list_filter([CASE WHEN contains(text, 'icense') THEN 'China AIGC label (TC260 standard)' END, CASE WHEN contains(text, '@') THEN 'C2PA Content Credentials (Google LLC)' END, CASE WHEN contains(text, '#') THEN 'other' END], lambda x: x IS NOT NULL) AS w FROM documents WHERE doc_id % 3 > 0)
SELECT l.doc_id AS uid, coalesce(array_to_string(list_filter([CASE WHEN list_contains(w, 'China AIGC label (TC260 standard)') THEN 'doubao,jimeng' END, CASE WHEN list_contains(w, 'C2PA Content Credentials (Google LLC)') THEN 'gemini' END], lambda x: x IS NOT NULL), ','), '') AS provenance
FROM (SELECT DISTINCT doc_id FROM labels) l LEFT JOIN s ON s.uid = l.doc_id
""")
def sidecar_provenance(spark, sf):
    d, t = table(spark, sf, "documents"), F.col("text")
    say = lambda mark, text: F.when(F.contains(t, F.lit(mark)), F.lit(text))
    sidecars = d.where("doc_id % 3 > 0").select(F.col("doc_id").alias("uid"), F.array_compact(F.array(say("icense", "China AIGC label (TC260 standard)"), say("@", "C2PA Content Credentials (Google LLC)"), say("#", "other"))).alias("watermarks"))
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("uid")).distinct()
    return reports.sidecar_provenance(truth, sidecars).select("uid", F.array_join("provenance", ",").alias("provenance"))


@query("""
WITH RECURSIVE b AS (SELECT p_brand AS k, p_partkey AS id, p_partkey * 7 % 500 AS x, p_partkey * 11 % 400 AS y, p_partkey % 30 + 5 AS w, p_partkey % 20 + 5 AS h FROM part),
p AS (SELECT a.k, a.id AS a, c.id AS b, sqrt(pow(a.x + a.w / 2 - c.x - c.w / 2, 2) + pow(a.y + a.h / 2 - c.y - c.h / 2, 2)) AS d FROM b a JOIN b c ON a.k = c.k AND a.id % 2 = 0 AND c.id % 2 = 1 WHERE sqrt(pow(a.x + a.w / 2 - c.x - c.w / 2, 2) + pow(a.y + a.h / 2 - c.y - c.h / 2, 2)) <= 0.6 * sqrt(a.w * a.w + a.h * a.h)),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY d, a, b) AS i FROM p),
r AS (SELECT k, 0::BIGINT AS i, []::BIGINT[] AS s, []::BIGINT[] AS c, false AS taken FROM (SELECT DISTINCT k FROM p)
  UNION ALL SELECT k, i, CASE WHEN free THEN list_append(s, a) ELSE s END, CASE WHEN free THEN list_append(c, b) ELSE c END, free
  FROM (SELECT o.*, s, c, NOT list_contains(s, o.a) AND NOT list_contains(c, o.b) AS free FROM r JOIN o ON o.k = r.k AND o.i = r.i + 1) o)
SELECT o.k, o.a, o.b, round(o.d, 6) AS distance FROM o JOIN r ON r.k = o.k AND r.i = o.i WHERE r.taken
""")
def face_matches(spark, sf):
    k = F.col("p_partkey")
    b = table(spark, sf, "part").select(F.col("p_brand").alias("k"), k.alias("id"), (k * 7 % 500).alias("x"), (k * 11 % 400).alias("y"), (k % 30 + 5).alias("w"), (k % 20 + 5).alias("h"))
    return reports.match_faces(b.where("id % 2 = 0"), b.where("id % 2 = 1"), "k").withColumn("distance", F.round("distance", 6))
