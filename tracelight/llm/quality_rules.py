"""Quality rules whose thresholds adapt to each language and source. Native: DataFrame functions only.

One pass over the texts makes a row of counts per document. Each metric of each (language, source) then gets a
mergeable quantile sketch: a histogram with buckets of a bounded relative width (1/64 of the value), which adds up
exactly in any order, so thresholds do not depend on how the rows were dealt. Limits are made of the sketch's quantiles
alone. Small groups take the merged sketch of their language, or of everything. Documents meet their limits by a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, Store, let, small, text_or_empty, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 8


@dataclass(frozen=True)
class Metric:
    """An integer metric of a document, from 0 for most to ``scale`` in the worst case or around a typical value.

    With ``fences`` None, a document fails above q99 + (q99 - q90) of its group: few have a value at all, so the tail's own
    spread says what lies beyond it. With ``fences``, it fails beyond q90 + fences * spread or q10 - fences *
    spread, where the spread is q90 - q10, or an eighth of the median where copies leave less than that.
    """

    name: str
    over: str
    under: str
    scale: int
    fences: int | None = None

    def value(self) -> Column:
        return F.floor(F.col(self.over) * F.lit(self.scale) / F.greatest(F.col(self.under), F.lit(1))).cast("long")

    def outside(self, low: Column, high: Column) -> Column:
        value = bucket(self.value())
        return (value > high) | (value < low)


METRICS = (
    Metric("symbols", "n_symbols", "word_chars", 10_000),
    Metric("dup_lines", "n_dup_lines", "n_lines", 10_000),
    Metric("repeats", "n_repeat_words", "n_words", 10_000),
    Metric("word_length", "word_chars", "n_words", 100, 1),
)
#: Binary digits of a value that its sketch bucket keeps.
DIGITS = 7
#: Documents that a group needs for a sketch of its own.
LEAST_GROUP = 100
#: Groups (a language and source each, about 200 bytes) whose limits are broadcast; more are joined by shuffles.
BROADCAST_GROUPS = 50_000


def _repeat_words(words: Column) -> Column:
    """Words in windows of 8 words that the text has twice or more. Hashes find the candidates, words confirm them."""
    n = F.size(words)

    def exact(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))

        def same(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (F.slice(words, a["p"] + 1, WINDOW) == F.slice(words, b["p"] + 1, WINDOW))

        def covered(e: Column) -> Column:
            hit = F.filter(e, lambda x, i: F.coalesce(same(x, F.get(e, i - 1)), F.lit(False)) | F.coalesce(same(x, F.get(e, i + 1)), F.lit(False)))
            return let(
                F.array_sort(F.transform(hit, lambda x: x["p"])),
                lambda at: F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x),
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, covered))

    windows = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW))),
    )
    return F.when(n < WINDOW, F.lit(0)).otherwise(let(windows, exact))


def base_counts(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep`` and the counts of each row's text; a null text has none."""
    text = F.col("__text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPACES + "+", "")) > 0)
    of_words = let(words_of(text), lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("n_distinct")))
    rows = docs.select(*keep, text_or_empty(text_col).alias("__text"))
    rows = rows.select(
        *(c for c in rows.columns if c != "__text"),
        of_words.alias("w"),
        of_lines.alias("l"),
        F.length(F.regexp_replace(text, SPACES + "+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
    )
    return rows.select(
        *(c for c in rows.columns if c not in ("w", "l")),
        F.col("w.n_words").cast("long").alias("n_words"),
        F.col("w.n_repeat_words").cast("long").alias("n_repeat_words"),
        F.col("l.n_lines").cast("long").alias("n_lines"),
        (F.col("l.n_lines") - F.col("l.n_distinct")).cast("long").alias("n_dup_lines"),
    ).withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bucket(value: Column) -> Column:
    """The lower edge of the sketch bucket: the value's leading binary digits."""
    shift = F.greatest(F.length(F.bin(value)) - DIGITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketch(counts: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n): the quantile sketches of all groups; sketches merge by adding n.

    They describe the documents that pass the base rules: what the base removes anyway must not widen the limits of the rest.
    """
    metric = F.explode(F.array(*(F.struct(F.lit(m.name).alias("metric"), bucket(m.value()).alias("bucket")) for m in METRICS)))
    return counts.where(~F.col("base_failed")).select("lang", "source", metric.alias("m")).groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n"))


def limits(sketches: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """(lang, source, limits map<metric, (low, high)>) of every group, from its own, its language's or the whole sketch."""
    merged = sketches.select("metric", "bucket", "n", F.explode(F.array(F.struct("lang", "source"), F.struct("lang", F.lit(None).cast("string").alias("source")), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")))).alias("g"))
    merged = merged.groupBy("g", "metric", "bucket").agg(F.sum("n").alias("n"))
    each = Window.partitionBy("g", "metric")
    ranked = merged.select("*", F.sum("n").over(each).alias("total"), F.sum("n").over(each.orderBy("bucket")).alias("upto"))
    quantile = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("total"), F.col("bucket"))).alias(f"q{q}")
    of = ranked.groupBy("g", "metric").agg(F.max("total").alias("total"), *map(quantile, (10, 50, 90, 99)))
    spread = F.greatest(F.col("q90") - F.col("q10"), F.floor(F.col("q50") / 8))
    low, high = F.lit(0).cast("long"), 2 * F.col("q99") - F.col("q90")
    for m in METRICS:
        if m.fences is not None:
            low = F.when(F.col("metric") == m.name, F.col("q10") - m.fences * spread).otherwise(low)
            high = F.when(F.col("metric") == m.name, F.col("q90") + m.fences * spread).otherwise(high)
    limit = F.struct(low.alias("low"), high.alias("high"))
    of = of.groupBy("g").agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("metric", limit.alias("limit")))).alias("limits")).select("g.lang", "g.source", "total", "limits")
    own = of.where(F.col("source").isNotNull())
    lang = of.where(F.col("source").isNull() & F.col("lang").isNotNull()).select("lang", F.col("total").alias("lang_total"), F.col("limits").alias("lang_limits"))
    whole = of.where(F.col("lang").isNull()).select(F.col("limits").alias("all_limits"))
    chosen = F.when(F.col("total") >= least_group, F.col("limits")).when(F.col("lang_total") >= least_group, F.col("lang_limits")).otherwise(F.col("all_limits"))
    # a group none of whose documents passes the base has no limits and needs none
    return own.join(lang, "lang").join(F.broadcast(whole), F.lit(True)).select("lang", "source", chosen.alias("limits"))


def judge(counts: DataFrame, limit: DataFrame) -> DataFrame:
    """Each row of counts with ``failed`` (the metrics outside their limits, sorted) and ``kept``.

    The limits have one row a (language, source), are counted and broadcast up to a bound; beyond it they join by
    shuffle, where Spark splits a hot source's rows.
    """
    limit = small(limit, limit.count(), BROADCAST_GROUPS)
    of = lambda m: F.col("limits").getItem(m.name)
    outside = F.array_compact(F.array(*(F.when(m.outside(of(m)["low"], of(m)["high"]), F.lit(m.name)) for m in sorted(METRICS, key=lambda m: m.name))))
    out = counts.join(limit, ["lang", "source"], "left").withColumn("failed", outside).drop("limits")
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """One row per row of ``docs``: id, lang, source, the counts, base_failed, failed, kept.

    A null text has no words and fails the base; null languages and sources form a group named ''. Null ids and
    repeated rows stay, other columns are not read, and an empty table gives an empty result.
    Only the counts (no text) are written between the two passes and joined.
    """
    keep = [F.col(id_col).alias(id_col), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")]
    store = Store(docs.sparkSession)
    counts = store.put(base_counts(docs, keep, text_col))
    return judge(counts, store.put(limits(sketch(counts), least_group)))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep. Rows are written with their counts once, and only
    the limits (a row a language and source) are joined to them."""
    keep = [F.struct(*docs.columns).alias("__doc"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")]
    store = Store(docs.sparkSession)
    counts = store.put(base_counts(docs, keep, text_col))
    kept = judge(counts, store.put(limits(sketch(counts.drop("__doc")), least_group))).where("kept")
    return kept.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def sql(documents: str = "documents", least_group: int = LEAST_GROUP) -> str:
    """DuckDB SQL for the same result over a table of documents."""
    metrics = "\nUNION ALL ".join(
        f"SELECT doc_id, lang, source, '{m.name}' AS metric, ({m.over} * {m.scale} // greatest({m.under}, 1))::BIGINT AS v, {'NULL' if m.fences is None else m.fences}::BIGINT AS fences FROM c WHERE NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
        for m in METRICS
    )
    return f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {documents}),
w AS (SELECT *, regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM t),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS v FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, v) > 1),
rep AS (SELECT doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(rep.n, 0) AS n_repeat_words, len(ls)::BIGINT AS n_lines,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
),
m AS ({metrics}),
b AS (SELECT *, (v >> greatest(length(bin(v)) - {DIGITS}, 0)) << greatest(length(bin(v)) - {DIGITS}, 0) AS bucket FROM m),
g AS (
  SELECT 2 AS level, lang, source, metric, fences, bucket FROM b
  UNION ALL SELECT 1, lang, NULL, metric, fences, bucket FROM b UNION ALL SELECT 0, NULL, NULL, metric, fences, bucket FROM b
),
h AS (
  SELECT *, row_number() OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, count(*) OVER (PARTITION BY level, lang, source, metric) AS total FROM g
),
q AS (
  SELECT level, lang, source, metric, any_value(fences) AS fences, any_value(total) AS total, min(bucket) FILTER (100 * upto >= 10 * total) AS q10,
         min(bucket) FILTER (100 * upto >= 50 * total) AS q50, min(bucket) FILTER (100 * upto >= 90 * total) AS q90, min(bucket) FILTER (100 * upto >= 99 * total) AS q99
  FROM h GROUP BY level, lang, source, metric
),
lim AS (
  SELECT *, CASE WHEN fences IS NULL THEN 0 ELSE q10 - fences * greatest(q90 - q10, q50 // 8) END AS low,
         CASE WHEN fences IS NULL THEN 2 * q99 - q90 ELSE q90 + fences * greatest(q90 - q10, q50 // 8) END AS high FROM q
),
failed AS (
  SELECT DISTINCT b.doc_id FROM b JOIN lim o ON o.level = 2 AND o.lang = b.lang AND o.source = b.source AND o.metric = b.metric
  JOIN lim l ON l.level = 1 AND l.lang = b.lang AND l.metric = b.metric JOIN lim a ON a.level = 0 AND a.metric = b.metric
  WHERE b.bucket > CASE WHEN o.total >= {least_group} THEN o.high WHEN l.total >= {least_group} THEN l.high ELSE a.high END
     OR b.bucket < CASE WHEN o.total >= {least_group} THEN o.low WHEN l.total >= {least_group} THEN l.low ELSE a.low END
)
SELECT c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND failed.doc_id IS NULL AS kept
FROM c LEFT JOIN failed ON c.doc_id = failed.doc_id
"""
