"""URL filters by host-suffix and path-prefix rules.

Each URL is expanded into (host suffix, path prefix) expressions, each expression is hashed, and the hashes
meet the rules' in an equi-join on the first 32 bits of the digest. The full digest then confirms a match and
the longest rule wins. Native: DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: A rule table of so many rows at most (about 100 bytes each) is broadcast; a larger one is joined by shuffles.
BROADCAST_RULES = 20_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for a null or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES,
    salts: int = 16,
) -> DataFrame:
    """One row (id, host, path, rule, verdict) for each row of ``pages``; other columns are not read.

    A rule fits its host and all subdomains when the path starts with the rule's path. The longest rule
    (characters of host and path together, then of the host, then the text) wins; without one, ``rule`` is null
    and ``verdict`` is ``default``. Null and malformed URLs have empty host and path and fit no rule (a rule
    with an empty host fits every URL). Repeated rows stay repeated, null ids stay null, an empty table gives an empty result; without
    rules every verdict is ``default``. Of equal rules with different verdicts, block wins.

    The one shuffle carries (id, url): equal rows are counted first and the expressions are aggregated where
    they were made. With more than ``broadcast_rules`` rules, expressions are salted, so that a hot host is spread.
    """
    spark = pages.sparkSession
    best: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        key = (host.lower(), path)
        best[key] = "block" if "block" in (verdict, best.get(key)) else verdict
    host, path = url_parts(F.col("__url"))
    base = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url")).groupBy("__id", "__url").agg(F.count("*").alias("copies"))
    base = base.select("*", host.alias("host"), path.alias("path"))
    out = [F.col("__id").alias(id_col), "host", "path", "rule", "verdict"]
    if not best:
        best[("\n", "\n")] = default  # fits no host
    lengths = sorted({len(p) for _, p in best})  # only lengths that some rule has can match
    listed = spark.createDataFrame([(h, p, v) for (h, p), v in sorted(best.items())], "h string, p string, rule_verdict string")
    full = F.sha2(F.concat_ws("\n", "h", "p").cast("binary"), 256)
    rule = listed.select(
        full.alias("rule_digest"),
        F.concat("h", "p").alias("rule"),
        "rule_verdict",
        (F.length("h") + F.length("p")).alias("len"),
        F.length("h").alias("host_len"),
    ).withColumn("short", F.conv(F.substring("rule_digest", 1, 8), 16, 10).cast("long"))
    labels = F.split("host", "\\.")
    suffixes = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr("path", F.lit(1), n))
    pairs = F.flatten(F.transform(F.array_distinct(suffixes), lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat_ws("\n", s, p).cast("binary"), 256))))
    exprs = base.select("*", F.explode_outer(pairs).alias("digest"))
    exprs = exprs.withColumn("short", F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"))
    if len(best) <= broadcast_rules:
        joined = exprs.join(F.broadcast(rule), "short", "left")
    else:
        exprs = exprs.withColumn("salt", F.pmod(F.xxhash64("__url", "__id"), F.lit(salts)))
        rule = rule.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        joined = exprs.join(rule, ["short", "salt"], "left")
    sure = F.when(F.col("rule_digest") == F.col("digest"), F.struct("len", "host_len", "rule", "rule_verdict"))
    judged = joined.groupBy("__id", "__url", "host", "path", "copies").agg(F.max(sure).alias("best"))
    return judged.select(
        *out[:3],
        F.col("best.rule").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
        F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    ).drop("copy")


SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM parts
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), rules(verdict, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits AS (
  SELECT split.page_id, max_by(struct_pack(r := h || p, v := verdict), length(h) + length(p)) AS best
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL
)
SELECT split.page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict
FROM split LEFT JOIN fits USING (page_id)
"""
