"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic). Raking scales the cells until the expected tokens of a sample meet
the target shares of sources, languages and topics; a document is then sampled with its cell's probability, by a hash of
its id. Probabilities end at 1, and the fit knows it:

- The rate (sampled share of all tokens) goes down from ``RATE`` until the corpus can fill every given share, at most to
  ``LEAST_RATE``.
- A key that has fewer tokens than its share asks for is taken whole, and the other keys of its margin share what is
  missing in proportion to their targets. ``report`` lists such keys.
- The rest is raked with probabilities cut at 1 inside the fit, so that other cells make up for it, until every margin is met
  to one in a million.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Store, let, small, text_or_empty

MARGINS = ("source", "lang", "topic")
#: Production targets: a mapping gives shares (what it does not name shares the rest as observed; if no rest is left, it
#: keeps its observed share and the given shares are scaled to what that leaves); a number a flattens the observed shares to their power a.
TARGETS = {"source": 0.5, "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}, "topic": 0.5}
#: Rounds of raking at most; share of the tokens to sample, and what it is lowered to at most where given shares need it.
ROUNDS, RATE, LEAST_RATE = 40, 0.6, 0.25
#: A margin within this of its goal is met: its cells are not scaled any more.
MET = 1e-6
#: Cells that the driver rakes itself and that are broadcast (some 60 bytes each); more are raked and joined as a table.
DRIVER_CELLS = 100_000
#: (topic, mark, words a mark stands for): the topic of a text is the one whose marks cover most of it, if they cover all
#: of its words; the first of equals; else prose. A license is mentioned once in a paragraph, a table row has some cells.
TOPICS = (("licensed", "icense", 100), ("contact", "@", 100), ("table", " | ", 20))


def topic_of(text: Column, n_words: Column) -> Column:
    """The topic by the density of its marks."""
    count = lambda mark: (F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))) / len(mark)
    return let(
        F.array(*(F.floor(count(mark)).cast("long") * words for _, mark, words in TOPICS)),
        lambda covered: F.when(F.array_max(covered) < F.greatest(n_words, F.lit(1)), F.lit("prose")).otherwise(
            F.element_at(F.array(*(F.lit(name) for name, *_ in TOPICS)), F.array_position(covered, F.array_max(covered)).cast("int"))
        ),
    )


def cells_of(docs: DataFrame, keep: list[Column], text_col: str = "text") -> DataFrame:
    """``keep``, the cell (source, lang, topic) and ``n_tokens`` of each row. No part of a cell can be null, so joins on it add no filter
    that would compute it twice."""
    text = text_or_empty(text_col)
    rows = docs.select(*keep, F.coalesce(F.col("source"), F.lit("")).alias("source"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"), let(F.regexp_count(text, F.lit(WORD)).cast("long"), lambda n: F.struct(n.alias("n"), topic_of(text, n).alias("t"))).alias("__cell"))
    return rows.select(*(c for c in rows.columns if c != "__cell"), F.coalesce("__cell.t", F.lit("prose")).alias("topic"), F.col("__cell.n").alias("n_tokens"))


def shares(observed: Mapping, target) -> dict:
    """The target share of each key of ``observed`` (key -> tokens); they sum to 1."""
    total = sum(observed.values())
    if not isinstance(target, Mapping):
        raw = {k: (v / total) ** target if v else 0.0 for k, v in observed.items()}
    else:
        free = sum(v for k, v in observed.items() if k not in target)
        rest, scale = split(target, free / total, sum(target[k] for k, v in observed.items() if v and k in target))
        raw = {k: (scale * target[k] if k in target else rest * v / free) if v else 0.0 for k, v in observed.items()}
    whole = sum(raw.values())
    return {k: v / whole for k, v in raw.items()} if whole else {k: v / total for k, v in observed.items()}


def split(target: Mapping, free: float, given: float) -> tuple[float, float]:
    """What keys that are not named share, and the factor of the given shares, for the observed share ``free`` of the former
    and the sum ``given`` of the shares of keys that have tokens."""
    rest = 1 - sum(target.values())
    if rest > 1e-9 or not free:
        return max(0.0, rest), 1.0
    return free, (1 - free) / given if given else 0.0


def fill(seen: list[float], share: list[float]) -> float:
    """The factor f with sum(min(seen, f * share)) = 1, for what is there and what is asked, both as shares of the sample."""
    order = sorted((a / s, a, s) for a, s in zip(seen, share, strict=True) if s > 0)
    best, whole, rest = 0.0, 1.0, sum(s for *_, s in order)
    for ratio, a, s in order:
        if rest > 1e-12:
            best = max(best, whole / rest)
        if ratio >= best:
            break
        whole, rest = whole - a, rest - s
    return best


def rake(cells: list[tuple[tuple[str, str, str], int]], targets: Mapping = TARGETS, rounds: int = ROUNDS, rate: float = RATE, least_rate: float = LEAST_RATE) -> tuple[list[float], float]:
    """The probability of each cell (key, tokens), and the rate."""
    import numpy as np

    tokens = np.array([n for _, n in cells], float)
    total = tokens.sum()
    if not total:
        return [rate] * len(cells), rate
    margins = []
    for d, name in enumerate(MARGINS):
        keys = sorted({k[d] for k, _ in cells})
        place = {k: i for i, k in enumerate(keys)}
        at = np.array([place[k[d]] for k, _ in cells])
        seen = np.bincount(at, tokens, len(keys))
        goal = shares(dict(zip(keys, seen.tolist(), strict=True)), targets[name])
        margins.append((at, seen / total, np.array([goal[k] for k in keys]), isinstance(targets[name], Mapping)))
    enough = [(a / g) for _, seen, goal, given in margins if given for a, g in zip(seen, goal, strict=True) if g > 0]
    rate = min(rate, max(least_rate, min(enough, default=rate)))
    whole = np.zeros(len(cells), bool)
    goals = []
    for at, seen, goal, _ in margins:
        asked = fill((seen / rate).tolist(), goal.tolist()) * goal * rate
        short = (asked >= seen * (1 - 1e-12)) & (seen > 0)
        whole |= short[at]
        goals.append(np.minimum(asked, seen) * total)
    free = np.where(whole, 0.0, tokens)
    goals = [np.maximum(0.0, goal - np.bincount(at, np.where(whole, tokens, 0.0), len(goal))) for (at, *_), goal in zip(margins, goals, strict=True)]
    weight = np.full(len(cells), rate)
    for _ in range(rounds):
        met = True
        for (at, *_), goal in zip(margins, goals, strict=True):
            now = np.bincount(at, free * np.minimum(1.0, weight), len(goal))
            factor = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
            factor = np.where(np.abs(factor - 1) < MET, 1.0, factor)
            met = met and bool((factor == 1).all())
            weight = weight * factor[at]
        if met:
            break
    return np.where(whole, 1.0, np.minimum(1.0, weight)).tolist(), rate


def rake_table(store: Store, cells: DataFrame, targets: Mapping = TARGETS, rounds: int = ROUNDS, rate: float = RATE, least_rate: float = LEAST_RATE) -> tuple[DataFrame, float]:
    """The same for a table of cells (source, lang, topic, tokens) of any size; only totals reach the driver."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.withColumn("probability", F.lit(rate)), rate
    wanted, enough = {}, []
    for name in MARGINS:
        seen = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("seen"))
        target = targets[name]
        if isinstance(target, Mapping):
            given = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items()], f"{name} string, given double")
            seen = seen.join(given, name, "left")
            free = seen.where(F.col("given").isNull()).agg(F.sum("seen")).first()[0] or 0.0
            present = seen.where("seen > 0").agg(F.sum("given")).first()[0] or 0.0
            rest, scale = split(target, free / float(total), present)
            raw = F.coalesce(F.lit(scale) * F.col("given"), F.lit(rest) * F.col("seen") / F.lit(free or 1.0))
        else:
            raw = F.pow(F.col("seen") / total, F.lit(float(target)))
        seen = store.put(seen.select(name, (F.col("seen") / total).alias("seen"), F.when(F.col("seen") > 0, raw).otherwise(0.0).alias("raw")))
        norm = seen.agg(F.sum("raw")).first()[0]
        wanted[name] = seen.select(name, "seen", (F.col("raw") / F.lit(norm) if norm else F.col("seen")).alias("share"))
        if isinstance(target, Mapping):
            enough.append(wanted[name].where("share > 0").agg(F.min(F.col("seen") / F.col("share"))).first()[0])
    rate = min(rate, max(least_rate, min(enough, default=rate)))
    goals = {}
    for name, of in wanted.items():
        factor = 1.0
        while True:  # each step takes more keys whole, until none is added
            short = F.lit(factor) * F.col("share") * rate >= F.col("seen")
            a, s = of.where("share > 0").agg(F.sum(F.when(short, F.col("seen"))), F.sum(F.when(~short, F.col("share")))).first()
            new = (1 - (a or 0.0) / rate) / s if s and s > 1e-12 else factor
            if new <= factor * (1 + 1e-13):
                break
            factor = new
        asked = F.lit(factor * rate) * F.col("share")
        goals[name] = store.put(of.select(name, (F.least(asked, "seen") * total).alias("goal"), ((asked >= F.col("seen") * (1 - 1e-12)) & (F.col("seen") > 0)).alias("short")))
    for name in MARGINS:
        cells = cells.join(goals[name].select(name, F.col("short").alias(f"short_{name}")), name)
    whole = F.greatest(*(F.col(f"short_{m}") for m in MARGINS))
    cells = store.put(cells.select(*MARGINS, "tokens", whole.alias("whole"), F.lit(rate).alias("weight")))
    for name in MARGINS:
        taken = cells.where("whole").groupBy(name).agg(F.sum("tokens").alias("taken"))
        goals[name] = store.put(goals[name].join(taken, name, "left").select(name, F.greatest(F.lit(0.0), F.col("goal") - F.coalesce("taken", F.lit(0))).alias("goal")))
    for _ in range(rounds):
        moved = []
        for name in MARGINS:
            now = cells.where("NOT whole").groupBy(name).agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), "weight")).alias("now")).join(goals[name], name)
            factor = F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(1.0)
            scaled = store.put(now.select(name, F.when(F.abs(factor - 1) < MET, 1.0).otherwise(factor).alias("factor")))
            moved.append(scaled.where("factor <> 1"))
            cells = cells.join(scaled, name, "left").select(*MARGINS, "tokens", "whole", (F.col("weight") * F.coalesce("factor", F.lit(1.0))).alias("weight"))
        cells = store.put(cells)
        if not any(m.count() for m in moved):
            break
    return cells.withColumn("probability", F.when(F.col("whole"), 1.0).otherwise(F.least(F.lit(1.0), "weight"))), rate


def calibrate(store: Store, counted: DataFrame, targets: Mapping = TARGETS, rounds: int = ROUNDS, rate: float = RATE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(source, lang, topic, tokens, weight, probability) of each cell of ``counted`` (source, lang, topic, n_tokens)."""
    cells = store.put(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    n = cells.count()
    if n <= driver_cells:
        rows = sorted(((r.source, r.lang, r.topic), r.tokens) for r in cells.collect())
        chances, rate = rake(rows, targets, rounds, rate, min(rate, LEAST_RATE))
        made = [(*k, t, p) for (k, t), p in zip(rows, chances, strict=True)]
        out = cells.sparkSession.createDataFrame(made, "source string, lang string, topic string, tokens long, probability double")
    else:
        out, rate = rake_table(store, cells, targets, rounds, rate, min(rate, LEAST_RATE))
    return small(out.select(*MARGINS, "tokens", (F.col("probability") / F.lit(rate)).alias("weight"), "probability"), n, driver_cells)


def report(docs: DataFrame, text_col: str = "text", targets: Mapping = TARGETS, rounds: int = ROUNDS, rate: float = RATE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(margin, key, tokens, observed, expected, whole) of each key: its share of all tokens and of the expected sample, and
    whether all of its tokens are in the sample, so that a larger share cannot be had at this rate."""
    store = Store(docs.sparkSession)
    cells = calibrate(store, cells_of(docs, [], text_col), targets, rounds, rate, driver_cells)
    key = F.explode(F.array(*(F.struct(F.lit(m).alias("margin"), F.col(m).alias("key")) for m in MARGINS)))
    of = cells.select(key.alias("k"), "tokens", (F.col("tokens") * F.col("probability")).alias("drawn")).groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("drawn").alias("drawn"))
    sums = of.groupBy(F.col("k.margin").alias("margin")).agg(F.sum("tokens").alias("all"), F.sum("drawn").alias("all_drawn"))
    of = of.select("k.margin", "k.key", "tokens", "drawn").join(F.broadcast(sums), "margin")  # three rows
    return of.select("margin", "key", "tokens", (F.col("tokens") / F.col("all")).alias("observed"), (F.col("drawn") / F.col("all_drawn")).alias("expected"), (F.col("drawn") >= F.col("tokens") * (1 - 1e-9)).alias("whole"))


def draw(doc_id: Column) -> Column:
    """A uniform number in [0, 1) that depends on the id alone."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Mapping = TARGETS, rounds: int = ROUNDS, rate: float = RATE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """(id, source, lang, topic, n_tokens, weight, probability, sampled) for each row.

    The expected token shares of the sample meet the targets wherever the corpus has the tokens, see the module's text; the
    weight is the probability over the rate. Null sources and languages are the key ''; a null text has no tokens and topic prose;
    cells without tokens have no part in the fit and take its factors; without any tokens every probability is the rate.
    Rows with one id are sampled alike; null ids draw as the empty text. An empty table gives an empty result.
    """
    store = Store(docs.sparkSession)
    rows = store.put(cells_of(docs, [F.col(id_col).alias(id_col)], text_col))
    cells = calibrate(store, rows, targets, rounds, rate, driver_cells).drop("tokens")
    return rows.join(cells, list(MARGINS), "left").select(
        id_col, *MARGINS, "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), (draw(F.col(id_col)) < F.col("probability")).alias("sampled")
    )


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", targets: Mapping = TARGETS, rounds: int = ROUNDS, rate: float = RATE, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns; texts are read twice and not shuffled for a small table of cells."""
    store = Store(docs.sparkSession)
    cells = calibrate(store, cells_of(docs, [], text_col), targets, rounds, rate, driver_cells).drop("tokens")
    rows = cells_of(docs, [F.struct(*docs.columns).alias("__doc"), draw(F.col(id_col)).alias("__u")], text_col)
    kept = rows.join(cells, list(MARGINS)).where(F.col("__u") < F.col("probability"))
    return kept.select(*(F.col("__doc").getField(c).alias(c) for c in docs.columns))


def sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL for ``mix`` over documents with the production targets, whose given shares sum to 1."""
    lang = TARGETS["lang"]
    named = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in lang.items())
    covered = ", ".join(f"((length(t) - length(replace(t, '{mark}', ''))) // {len(mark)}) * {words}" for _, mark, words in TOPICS)
    cases = " ".join(f"WHEN cov[{i + 1}] = list_max(cov) THEN '{name}'" for i, (name, *_) in enumerate(TOPICS))
    goals, steps, at = [], [], "c0"
    for d in MARGINS:
        goals.append(f"""
fill_{d} AS MATERIALIZED (
  SELECT max((1 - before_a) / (1 - before_s)) AS factor FROM (
    SELECT coalesce(sum(seen / rate) OVER w, 0) AS before_a, coalesce(sum(share) OVER w, 0) AS before_s FROM want_{d}, rate WHERE share > 0
    WINDOW w AS (ORDER BY seen / share, {d} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ) WHERE before_s < 1 - 1e-12
),
ask_{d} AS MATERIALIZED (SELECT {d}, least(factor * share * rate, seen) * total AS goal, factor * share * rate >= seen * (1 - 1e-12) AND seen > 0 AS short FROM want_{d}, rate, fill_{d}, tot)""")
    for i in range(rounds):
        for d in MARGINS:
            new = f"c{i}_{d}"
            steps.append(
                f"{new} AS MATERIALIZED (SELECT {', '.join(f'{at}.{m}' for m in MARGINS)}, free, weight * CASE WHEN now > 0 AND abs(goal / now - 1) >= {MET} THEN goal / now ELSE 1 END AS weight "
                f"FROM {at} JOIN (SELECT {d}, sum(free * least(1.0::DOUBLE, weight)) AS now FROM {at} GROUP BY {d}) n ON n.{d} = {at}.{d} JOIN goal_{d} g ON g.{d} = {at}.{d})"
            )
            at = new
    on = lambda a, b: " AND ".join(f"{a}.{m} = {b}.{m}" for m in MARGINS)
    return f"""
WITH r AS MATERIALIZED (
  SELECT doc_id, source, lang, n_tokens, CASE WHEN list_max(cov) < greatest(n_tokens, 1) THEN 'prose' {cases} END AS topic
  FROM (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, [{covered}] AS cov, len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+'))::BIGINT AS n_tokens
        FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents))
),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM r GROUP BY ALL),
tot AS MATERIALIZED (SELECT sum(tokens) AS total FROM cells),
want_source AS MATERIALIZED (SELECT source, seen, s / sum(s) OVER () AS share FROM (SELECT source, sum(tokens) / any_value(total) AS seen, pow(sum(tokens) / any_value(total), {TARGETS['source']}) AS s FROM cells, tot GROUP BY source)),
want_topic AS MATERIALIZED (SELECT topic, seen, s / sum(s) OVER () AS share FROM (SELECT topic, sum(tokens) / any_value(total) AS seen, pow(sum(tokens) / any_value(total), {TARGETS['topic']}) AS s FROM cells, tot GROUP BY topic)),
named(lang, given) AS (VALUES {named}),
langs AS MATERIALIZED (SELECT lang, given, sum(tokens) / any_value(total) AS seen FROM cells LEFT JOIN named USING (lang), tot GROUP BY lang, given),
unnamed AS MATERIALIZED (SELECT coalesce(sum(seen) FILTER (given IS NULL), 0) AS free, sum(given) FILTER (seen > 0) AS present FROM langs),
want_lang AS MATERIALIZED (
  SELECT lang, seen, s / sum(s) OVER () AS share
  FROM (SELECT lang, seen, CASE WHEN seen = 0 THEN 0 WHEN given IS NULL THEN seen WHEN free > 0 THEN given * (1 - free) / present ELSE given END::DOUBLE AS s FROM langs, unnamed)
),
rate AS MATERIALIZED (SELECT least({RATE}::DOUBLE, greatest({LEAST_RATE}::DOUBLE, min(seen / share))) AS rate FROM want_lang WHERE share > 0),
{','.join(goals)},
whole AS MATERIALIZED (
  SELECT cells.*, a.short OR b.short OR c.short AS whole FROM cells JOIN ask_source a USING (source) JOIN ask_lang b USING (lang) JOIN ask_topic c USING (topic)
),
{', '.join(f"goal_{d} AS MATERIALIZED (SELECT {d}, greatest(0, any_value(goal) - coalesce(sum(tokens) FILTER (whole), 0)) AS goal FROM whole JOIN ask_{d} USING ({d}) GROUP BY {d})" for d in MARGINS)},
c0 AS MATERIALIZED (SELECT source, lang, topic, CASE WHEN whole THEN 0 ELSE tokens END AS free, rate AS weight FROM whole, rate),
{', '.join(steps)},
done AS (SELECT whole.source, whole.lang, whole.topic, rate, CASE WHEN whole THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, weight) END AS p FROM whole JOIN {at} w ON {on('whole', 'w')}, rate)
SELECT doc_id, r.source, r.lang, r.topic, n_tokens, round(p / rate, 9) AS weight, round(p, 9) AS probability,
       ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < p AS sampled
FROM r JOIN done d ON {on('r', 'd')}
"""
