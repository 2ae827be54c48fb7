"""Corpus audits: diffs between two verdict tables, manifests, cohorts, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.audit import count_tokens_of, diff_classes, first_per_key, keyed_sample, resume
from . import query, table

_OLD = "CASE WHEN contains(text, 'License') THEN 'license' WHEN contains(text, '@') THEN 'contact' END"
_NEW = "CASE WHEN contains(lower(text), 'license') AND NOT contains(text, 'CC') THEN 'license' WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' END"


def _old(text):
    return F.when(F.contains(text, F.lit("License")), "license").when(F.contains(text, F.lit("@")), "contact")


def _new(text):
    return F.when(F.contains(F.lower(text), F.lit("license")) & ~F.contains(text, F.lit("CC")), "license").when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact")


@query(f"SELECT doc_id, o AS old_family, n AS new_family, CASE WHEN o IS NOT NULL AND n IS NULL THEN 'lost' WHEN o IS NULL AND n IS NOT NULL THEN 'new' ELSE 'changed' END AS class FROM (SELECT doc_id, {_OLD} AS o, {_NEW} AS n FROM documents) WHERE o IS DISTINCT FROM n")
def verdict_diff(spark, sf):
    text = F.col("text")
    rows = table(spark, sf, "documents").select("doc_id", _old(text).alias("old_family"), _new(text).alias("new_family"))
    kind = F.when(F.col("old_family").isNotNull() & F.col("new_family").isNull(), "lost").when(F.col("old_family").isNull() & F.col("new_family").isNotNull(), "new").otherwise("changed")
    return rows.where(~F.col("old_family").eqNullSafe(F.col("new_family"))).withColumn("class", kind)


@query(f"""
WITH v AS (SELECT doc_id, list_filter([CASE WHEN contains(text, 'License') THEN 'license' END, CASE WHEN contains(text, '@') THEN 'contact' END], lambda x: x IS NOT NULL) AS o,
  list_filter([CASE WHEN contains(text, 'Apache') THEN 'license' END, CASE WHEN contains(text, '@') OR contains(text, 'http') THEN 'contact' END], lambda x: x IS NOT NULL) AS n FROM documents),
c AS (SELECT unnest(list_concat(list_transform(list_filter(o, lambda x: NOT list_contains(n, x)), lambda x: 'lost_' || x), list_transform(list_filter(n, lambda x: NOT list_contains(o, x)), lambda x: 'new_' || x))) AS class FROM v)
SELECT class, count(*) AS n FROM c GROUP BY class
""")
def verdict_diff_classes(spark, sf):
    text = F.col("text")
    flag = lambda when, name: F.when(when, F.lit(name))
    at = F.contains(text, F.lit("@"))
    rows = table(spark, sf, "documents").select(
        F.array_compact(F.array(flag(F.contains(text, F.lit("License")), "license"), flag(at, "contact"))).alias("o"),
        F.array_compact(F.array(flag(F.contains(text, F.lit("Apache")), "license"), flag(at | F.contains(text, F.lit("http")), "contact"))).alias("n"),
    )
    return rows.select(F.explode(diff_classes(F.col("o"), F.col("n"))).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) AS n, count(*) FILTER (a IS NOT DISTINCT FROM b) AS agree, count(*) FILTER (a IS DISTINCT FROM b) AS differ
FROM (SELECT contains(text, 'License') AS a, contains(lower(text), 'license') AS b FROM documents)
""")
def parity_audit(spark, sf):
    """Two extractors over the same rows, compared null-safely."""
    rows = table(spark, sf, "documents").select(F.contains("text", F.lit("License")).alias("a"), F.contains(F.lower("text"), F.lit("license")).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    return rows.agg(F.count("*").alias("n"), F.count_if(same).alias("agree"), F.count_if(~same).alias("differ"))


@query("""
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'only_new' WHEN b.k IS NULL THEN 'only_old' WHEN a.n IS DISTINCT FROM b.n THEN 'differs' ELSE 'same' END AS status
FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k
""")
def full_outer_parity(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("na"))
    b = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("nb"))
    both = a.join(b, "k", "full_outer")
    return both.select("k", F.when(F.col("na").isNull(), "only_new").when(F.col("nb").isNull(), "only_old").when(~F.col("na").eqNullSafe(F.col("nb")), "differs").otherwise("same").alias("status"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def resume_antijoin(spark, sf):
    done = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return resume(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("SELECT sha256(text) AS sha, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY 1")
def manifest_dedup(spark, sf):
    """The first row of each content hash, by an aggregate rather than a sort."""
    docs = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    return first_per_key(docs, ["sha"], "doc_id", ["source"]).select("sha", "doc_id", "source")


@query("""
SELECT lang, doc_id FROM documents WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) <= 20
""")
def stratified_sample(spark, sf):
    """20 documents of each language, by a keyed hash: the same rows on every run."""
    docs = table(spark, sf, "documents").select("doc_id", "lang").where(F.col("lang").isNotNull())
    return keyed_sample(docs, ["lang"], "doc_id", 20, 7).select("lang", "doc_id")


@query("""
SELECT doc_id, list_sort(list(DISTINCT label)) AS present, count(*) AS rounds FROM (
  SELECT doc_id, 'toxic' AS label FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'poor' FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'license' FROM documents WHERE contains(text, 'License')) GROUP BY doc_id
""")
def label_union_groundtruth(spark, sf):
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    mark = lambda df, name: df.select("doc_id", F.lit(name).alias("label"))
    rounds = mark(labels.where("toxic = 1"), "toxic").unionByName(mark(labels.where("quality = 0"), "poor")).unionByName(mark(docs.where(F.contains("text", F.lit("License"))), "license"))
    return rounds.groupBy("doc_id").agg(F.array_sort(F.collect_set("label")).alias("present"), F.count("*").alias("rounds"))


@query("""
WITH c AS (SELECT c_mktsegment, c_custkey, count(o_orderkey) AS fired FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000 GROUP BY ALL)
SELECT c_mktsegment, count(*) AS n, round(avg((fired > 0)::INT), 9) AS share, sum(fired)::BIGINT AS fired FROM c GROUP BY c_mktsegment HAVING count(*) >= 5
""")
def cohort_rollup(spark, sf):
    dear = table(spark, sf, "orders").where("o_totalprice > 250000").groupBy("o_custkey").agg(F.count("*").alias("fired"))
    rows = table(spark, sf, "customer").join(dear, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("fired", F.coalesce("fired", F.lit(0)))
    out = rows.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg((F.col("fired") > 0).cast("int")), 9).alias("share"), F.sum("fired").alias("fired"))
    return out.where("n >= 5")


@query("SELECT lang, source, n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) <= 4")
def top_k_per_group(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "source")
    return counts.withColumn("r", F.row_number().over(w)).where("r <= 4").drop("r")


@query("SELECT l_orderkey, l_linenumber, l_discount FROM lineitem ORDER BY l_discount DESC, l_extendedprice, l_orderkey, l_linenumber LIMIT 50")
def worst_n(spark, sf):
    """The worst 50 rows: a top-k report, so the limit is the feature."""
    return table(spark, sf, "lineitem").orderBy(F.desc("l_discount"), "l_extendedprice", "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_discount")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS token FROM part) WHERE token <> '' GROUP BY token")
def exploded_token_count(spark, sf):
    return count_tokens_of(table(spark, sf, "part"), F.split("p_type", " "))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def key_intersection(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))


@query("SELECT kind, count(*) AS n FROM (SELECT 'carrier' AS kind FROM documents WHERE contains(text, 'License') UNION ALL SELECT 'control' FROM documents WHERE NOT contains(text, 'License')) GROUP BY kind")
def carrier_control_union(spark, sf):
    docs = table(spark, sf, "documents")
    lic = F.contains("text", F.lit("License"))
    return docs.where(lic).select(F.lit("carrier").alias("kind")).unionByName(docs.where(~lic).select(F.lit("control").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def adjudication_semijoin(spark, sf):
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(urgent, "c_custkey", "left_semi")


@query("""
WITH p AS (SELECT contains(text, 'License') AS a1, lang = 'en' AS a2, length(text) > 500 AS a3, contains(lower(text), 'license') AS b1, lang IN ('en', 'de') AS b2, length(text) > 400 AS b3 FROM documents)
SELECT unnest(['license', 'lang', 'length']) AS field, unnest([count(*) FILTER (a1 IS DISTINCT FROM b1), count(*) FILTER (a2 IS DISTINCT FROM b2), count(*) FILTER (a3 IS DISTINCT FROM b3)]) AS mismatches FROM p
""")
def field_mismatch_counts(spark, sf):
    """Mismatches of each compared field, in one pass."""
    n = F.length("text")
    fields = {
        "license": (F.contains("text", F.lit("License")), F.contains(F.lower("text"), F.lit("license"))),
        "lang": (F.col("lang") == "en", F.col("lang").isin("en", "de")),
        "length": (n > 500, n > 400),
    }
    one = table(spark, sf, "documents").agg(*(F.count_if(~a.eqNullSafe(b)).alias(k) for k, (a, b) in fields.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("mismatches")) for k in fields))).alias("f")).select("f.*")


@query("SELECT c_custkey, round_even(c_acctbal / 20, 0)::BIGINT AS band FROM customer")
def reading_order(spark, sf):
    """Rows banded by height as a reader takes them; exact halves round to even."""
    return table(spark, sf, "customer").select("c_custkey", F.bround(F.col("c_acctbal") / 20).cast("long").alias("band"))


@query("""
SELECT user_id, max(abs(step - usual)) > 0.5 * any_value(usual) AS variable FROM (
  SELECT user_id, step, median(step) OVER (PARTITION BY user_id) AS usual FROM (
    SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) WHERE step IS NOT NULL) GROUP BY user_id
""")
def variable_frame_rate(spark, sf):
    from ..operators.video import variable_rate

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frames = table(spark, sf, "events").select(F.col("user_id").alias("video"), F.row_number().over(w).alias("frame_index"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return variable_rate(frames, 0.5).withColumnRenamed("video", "user_id")


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY ALL")
def streamed_rates(spark, sf):
    """The windowed stream run to its end over the events: the same rows as the batch."""
    from ..sources.shared import shared_folder
    from ..streaming import run_to_end, windowed_rates

    schema = table(spark, sf, "events").schema
    # a file source takes folders, so the one file of small scales is named by a pattern
    return run_to_end(spark, f"{sf}/events.parquet*", schema, windowed_rates, shared_folder(spark)).select("start", "event_type", "n", "k")


@query("""
WITH e AS (SELECT user_id, ts, event_id, value, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(ts) - epoch_us(prev) >= 14400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e)
SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session
""")
def streamed_sessions(spark, sf):
    """Sessions as the stream closes them."""
    from ..sources.shared import shared_folder
    from ..streaming import run_to_end, sessions

    out = run_to_end(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema, sessions, shared_folder(spark))
    return out.where("user_id IS NOT NULL").select("user_id", "started", "n", F.round("total", 4).alias("total"))
