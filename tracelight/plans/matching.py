"""Token, text and source queries over documents, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import bucketize
from ..functions.text import edit_distance_normalized, normalize_ascii, normalize_text, script_language, stem
from ..functions.tokens import contains_any, first_match, ordered_matches, sorted_matches
from . import query, table

#: Tokens that occur in the tables, in priority order.
TOKENS = (("GNU General", "gpl"), ("Apache License", "apache"), ("MIT License", "mit"), ("CC BY", "cc"), ("@", "contact"), (" | ", "table"), ("!!", "shouting"))
_CASE = "CASE " + " ".join(f"WHEN contains(text, '{t}') THEN '{x}'" for t, x in TOKENS) + " END"
_LIST = "list_filter([" + ", ".join(f"CASE WHEN contains(text, '{t}') THEN '{x}' END" for t, x in TOKENS) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id, {' OR '.join(f'''contains(text, '{t}')''' for t, _ in TOKENS)} AS flagged FROM documents")
def token_flags(spark, sf):
    return table(spark, sf, "documents").select("doc_id", contains_any(F.col("text"), [t for t, _ in TOKENS]).alias("flagged"))


@query(f"SELECT doc_id, {_CASE} AS platform FROM documents")
def first_token_platform(spark, sf):
    return table(spark, sf, "documents").select("doc_id", first_match(F.col("text"), TOKENS).alias("platform"))


@query(f"SELECT doc_id, array_to_string({_LIST}, ',') AS labels FROM documents")
def ordered_match_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(ordered_matches(F.col("text"), TOKENS), ",").alias("labels"))


@query(f"SELECT doc_id, array_to_string(list_sort({_LIST}), ',') AS labels FROM documents")
def sorted_match_labels(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(sorted_matches(F.col("text"), TOKENS), ",").alias("labels"))


@query("""
SELECT page_id, contains(split_part(html, '<body', 1), 'title') AS in_head, contains(html, 'License') AS in_page,
       contains(html, 'License') AND NOT contains(split_part(html, '<body', 1), 'License') AS body_only FROM pages
""")
def region_scoped_match(spark, sf):
    """Short tokens count in the head only, long ones anywhere."""
    head = F.substring_index("html", "<body", 1)
    page = table(spark, sf, "pages")
    lic = F.contains("html", F.lit("License"))
    return page.select("page_id", F.contains(head, F.lit("title")).alias("in_head"), lic.alias("in_page"), (lic & ~F.contains(head, F.lit("License"))).alias("body_only"))


_FAMILY = "CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), '@') OR contains(lower(text), 'http') THEN 'contact' WHEN contains(text, ' | ') THEN 'table' ELSE 'other' END"


@query(f"SELECT {_FAMILY} AS family, lang, count(*) AS n FROM documents GROUP BY ALL")
def family_counts(spark, sf):
    families = (("license", ("license",)), ("contact", ("@", "http")), ("table", (" | ",)))
    out = F.lit("other")
    for name, tokens in reversed(families):
        out = F.when(contains_any(F.lower("text"), tokens), name).otherwise(out)
    return table(spark, sf, "documents").groupBy(out.alias("family"), "lang").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'unknown' WHEN o_totalprice < 50000 THEN 'small' WHEN o_totalprice < 150000 THEN 'medium' WHEN o_totalprice < 300000 THEN 'large' ELSE 'huge' END AS size FROM orders")
def bucketize_orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", bucketize(F.col("o_totalprice"), (50_000, 150_000, 300_000), ("small", "medium", "large", "huge")).alias("size"))


@query("""
SELECT n_name, r_name, round(CASE WHEN greatest(length(n_name), length(r_name)) = 0 THEN 0 ELSE levenshtein(n_name, r_name) / greatest(length(n_name), length(r_name)) END, 9) AS distance
FROM nation JOIN region ON n_regionkey = r_regionkey
""")
def edit_distance(spark, sf):
    pairs = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("n_name", "r_name", F.round(edit_distance_normalized(F.col("n_name"), F.col("r_name")), 9).alias("distance"))


@query("SELECT c_custkey, regexp_replace(lower(c_name), '\\s+', '', 'g') AS folded, regexp_replace(c_name || '_src.png', '(_src|_clean)?(\\.[^.]*)?$', '') AS stem FROM customer")
def text_normalize(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", normalize_ascii(F.col("c_name")).alias("folded"), stem(F.concat("c_name", F.lit("_src.png"))).alias("stem"))


@query("SELECT doc_id, sha256(regexp_replace(replace(lower(nfc_normalize(text)), 'ß', 'ss'), '\\s+', '', 'g')) AS folded_sha256 FROM documents")
def text_normalize_unicode(spark, sf):
    """NFC and case folding of whole texts. In the languages of the table, folding is lower case and one letter; tests/test_functions.py has others."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(normalize_text("text").cast("binary"), 256).alias("folded_sha256"))


@query("SELECT CASE WHEN regexp_matches(text, '\\p{Han}') THEN 'zh' WHEN regexp_matches(text, '\\p{Cyrillic}') THEN 'ru' ELSE 'en' END AS script, count(*) AS n FROM conversations GROUP BY ALL")
def script_choice(spark, sf):
    return table(spark, sf, "conversations").groupBy(script_language(F.col("text")).alias("script")).agg(F.count("*").alias("n"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.k') IS NOT NULL AS labelled FROM events")
def json_label_parse(spark, sf):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)").alias("k"), k.isNotNull().alias("labelled"))


@query("SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY ALL")
def content_hashes(spark, sf):
    return table(spark, sf, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
