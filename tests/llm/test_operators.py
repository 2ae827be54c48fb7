"""Each operator against a brute-force version, and on the awkward rows that the docstrings define."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

from tracelight.llm import byte_bpe, jaccard_join, license_scan, lm_scoring, mixing, quality_classifier, quality_rules, token_counts, url_rules, vector_graph
from tracelight.llm import queries as registered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: With columns whose names the operators use inside, and with an id of None.
CLASHING = SCHEMA + ", n_words long, topic long, weight string, fold int, hits string, bucket int, batch int, score string, row int, `__text` string"
BPE, MULTI = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def awkward():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("aeioultnrs") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = text(60)
    near = base.split()
    near[30] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", " \t\n ", "one", "one", "one two three four", "One TWO three four",
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.", "mit\x00license MIT-license; license mit",
        "license " * 500, "a" * 30_000, text(9000), "é ß ñ 中文 😀 " * 30, "<|endoftext|> x <|endoftext|>" * 40, "### $$$ %%% " + text(25),
        "same line here\n" * 40, "\r\n\x0b\x0c x \x0b y", text(25) + "\n" + text(25), "'s 't  123 4567\u00a0\u3000end", "*", "word",
    ]
    rows = [(i, t, ("en", "de", None)[i % 3], ("a", "b", None, "")[i % 4], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[0], rows[4], (None, base, "en", "a", 1), (None, None, None, None, None)]
    rows += [(100 + i, text(40 + i), "en", "a", 1) for i in range(30)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "w", 3, "h", 4, 5, "s", 6, "t") for r in rows], CLASHING).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, keep_null=True):
    return sorted((tuple(r) for r in df.collect() if keep_null or r[0] is not None), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


# 1 and 4: tokenizers


def test_token_counts(docs, rows, empty):
    t = token_counts.load(BPE)[0]
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in rows]
    for chunk, overlap in ((32_768, 1024), (200, 50)):
        got = by_id(token_counts.count_tokens(docs, BPE, chunk=chunk, overlap=overlap))
        assert [r[:3] for r in got] == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
        assert all(r[3] == (r[2] > 1024) for r in got)
    assert token_counts.count_tokens(empty, BPE).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_splices_are_exact(seed):
    rng = random.Random(seed)
    parts = ["<|endoftext|>", " ", "\n\n", "a", "  b", "'ll", "é", "中", "12", "!!", "\t"]
    text = "".join(rng.choice(parts) * rng.choice((1, 1, 1, 40)) for _ in range(1500))
    want = token_counts.load(BPE)[0].encode(text, add_special_tokens=False).ids
    for chunk, overlap in ((150, 40), (64, 32), (1000, 8)):
        ids, splices = token_counts.encode_long(text, BPE, chunk, overlap)
        assert ids == want and splices > 1


def test_splices_of_texts_without_boundaries():
    """Overlaps widen, in the end to the whole text, where no pre-token ends; a marker may stand at every chunk's end."""
    t = token_counts.load(BPE)[0]
    for text in ("a" * 5000, " " * 5000, "a" * 700 + "<|endoftext|>" * 100 + "b" * 700, ("x" * 70 + " ") * 60, "<|endoftext|>" * 300, "é中😀" * 900, "\n" * 999 + "a", "<|endoftext" * 200):
        for chunk, overlap in ((64, 32), (100, 33), (257, 64)):
            assert token_counts.encode_long(text, BPE, chunk, overlap)[0] == t.encode(text, add_special_tokens=False).ids


def test_chunks_are_encoded_once(monkeypatch):
    """The spliced ids are those of the overlapping chunks: nothing but the chunks is encoded."""
    seen = []
    scan = token_counts._scan
    monkeypatch.setattr(token_counts, "_scan", lambda path, text: seen.append(text) or scan(path, text))
    text = " ".join(f"word{i % 97}" for i in range(3000))
    ids, splices = token_counts.encode_long(text, BPE, 500, 50)
    assert ids == token_counts.load(BPE)[0].encode(text, add_special_tokens=False).ids
    assert len(seen) == splices + 1 == len(range(0, len(text) - 50, 450)) and all(len(x) == 500 for x in seen[:-1])


def test_byte_bpe(docs, rows, empty):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.encode_and_decode(docs, MULTI, public_tokenizers.PATTERN, outputs=("ids", "decoded")))
    want = []
    for i, text, *_ in rows:
        ids = own.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids, (text or "").encode()))
    assert got == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert byte_bpe.encode_and_decode(empty, MULTI, public_tokenizers.PATTERN).count() == 0


# 2: URL rules


def verdict(url, rules=url_rules.RULES, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = lower(host)
    fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, default)


URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?x#y", "https://example.com/en/71", "x://b.example.net/de/8", "x://net/de/", "x://net/de", "x://knet/de/1",
    "x://a.b.c.org/es/\n/z", "x://org?/es/", "x://user@h.com:80/en/1", "x://..com/en/", "x://com/EN/", "a://b://c.com/en/2", "x://ÄB.com/en/",
]


def test_url_rules(spark):
    table = [(i, u, "c", 1) for i, u in enumerate(URLS)] + [(3, "x://net/de/", "c", 1)] * 3 + [(None, "x://net/de/", "c", 1)]
    pages = spark.createDataFrame(table, "page_id long, url string, host string, copies int")
    want = sorted(((i, *verdict(u)) for i, u, *_ in table), key=str)
    assert sorted(map(tuple, url_rules.filter_urls(pages).collect()), key=str) == want
    assert sorted(map(tuple, url_rules.filter_urls(pages, broadcast_rules=0).collect()), key=str) == want
    assert {(r.rule, r.verdict) for r in url_rules.filter_urls(pages, []).collect()} == {(None, "allow")}
    assert url_rules.filter_urls(pages.limit(0)).count() == 0


def test_url_rules_native(spark, sf):
    plan = registered.op2_url_rules(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "html" not in plan and "Python" not in plan and "Arrow" not in plan


# 3: language model


def reference_scores(rows):
    """Base columns and, by exact counts, the interpolated score up to the weights."""
    tokens = [(i, words(lower(t)) + [None]) for i, t, *_ in rows]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    c = Counter(w for i, t in tokens if fold(i) != 1 for w in t)
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in tokens:
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        out.append((i, fold(i) == 1, len(t), sum(c[w] > 0 for w in t), n, base))
    return out


def test_lm_base(docs, rows, empty):
    got = by_id(lm_scoring.score_texts(docs, batch=3000))
    want = sorted(reference_scores(rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    got.sort(key=lambda r: (str(r[0]), r[2]))
    want.sort(key=lambda r: (str(r[0]), r[2]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
        assert a[6] <= 0
    assert lm_scoring.score_texts(empty).count() == 0


def interpolated(rows):
    """The scores by exact counts: EM on the deleted fold against the kept ones, then the mixture with all training counts."""
    tokens = [(i, words(lower(t)) + [None]) for i, t in rows]
    fold = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, _ in rows}
    pairs = lambda t: list(zip(["<s>", *t], t, strict=False))
    bucket = lambda c: c.bit_length()

    def counts(folds):
        own = [t for i, t in tokens if fold[i] in folds]
        one = Counter(w for t in own for w in t)
        return one, Counter(p for t in own for p in pairs(t)), Counter(one) + Counter({"<s>": len(own)})

    one, two, context = counts({0, 3, 4})
    distinct = len(counts({0, 2, 3, 4})[0])
    seen = [(bucket(context[a]), two[a, b] / context[a] if context[a] else 0, one[b] / max(1, sum(one.values()))) for i, t in tokens if fold[i] == 2 for a, b in pairs(t)]
    weights = {}
    for k in {x[0] for x in seen}:
        own, w = [(x[1], x[2], 1 / (distinct + 1)) for x in seen if x[0] == k], [1 / 3] * 3
        for _ in range(lm_scoring.EM_ROUNDS):
            parts = [[a * b for a, b in zip(w, p, strict=True)] for p in own]
            share = [sum(x[j] / sum(x) for x in parts) + lm_scoring.EM_LEAST for j in range(3)]
            w = [x / sum(share) for x in share]
        weights[k] = w
    one, two, context = counts({0, 2, 3, 4})
    n, out = sum(one.values()), []
    for i, t in tokens:
        score = 0
        for a, b in pairs(t):
            k = bucket(context[a])
            w = weights[max((x for x in weights if x <= k), default=min(weights))] if weights and sum(one.values()) else [0, 0, 1]
            w = [0, w[1] / (w[1] + w[2]), w[2] / (w[1] + w[2])] if k == 0 else w
            score += math.log10(w[0] * (two[a, b] / context[a] if context[a] else 0) + w[1] * one[b] / max(1, n) + w[2] / (len(one) + 1))
        out.append((i, score))
    return out


@pytest.mark.parametrize("driver_rows", [500_000, 0])
@pytest.mark.parametrize("buckets", ["few", "many"])
def test_lm_scores_by_brute_force(spark, monkeypatch, driver_rows, buckets):
    """Weights and scores against counts and EM made by hand, with EM on the driver and as a table, over few and many buckets."""
    monkeypatch.setattr(lm_scoring, "EM_STOP", 0.0)
    learn = lm_scoring.learn_weights
    monkeypatch.setattr(lm_scoring, "learn_weights", lambda *a: learn(*a, driver_rows=driver_rows))
    monkeypatch.setattr(lm_scoring, "EM_ROUNDS", 12)
    learn.__defaults__ = (12, 0)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the of cat dog sat on mat in a an".split()) for _ in range(rng.randint(0, 30)))) for i in range(200)]
    rows += [(300, None), (301, "a new word"), (None, "the cat"), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = lm_scoring.score_texts(df, batch=500, bucket_bytes=1 << 30 if buckets == "few" else 40).collect()
    want = sorted(interpolated(rows), key=str)
    got = sorted(((r.doc_id, r.score) for r in got), key=str)
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], rel=1e-8)


def test_lm_beats_the_base_on_held_out(spark):
    rng = random.Random(2)
    follow = {w: rng.sample("abcdefghijkl", 2) for w in "abcdefghijkl"}

    def text():
        out = [rng.choice("abcdefghijkl")]
        for _ in range(50):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    got = lm_scoring.score_texts(spark.createDataFrame([(i, text()) for i in range(300)], "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in got) > 0.6 * sum(r.base_score for r in got)


# 5: mixing


def test_mixing(spark, docs, rows, empty):
    got = by_id(mixing.mix(docs))
    assert len(got) == len(rows)
    for r, (i, t, lang, source, _) in zip(sorted(got, key=lambda r: (str(r[0]), r[4], str(r))), sorted(rows, key=lambda r: (str(r[0]), len(words(r[1])), str(r))), strict=True):
        assert r[0] == i and r[4] == len(words(t)) and 0 <= r[6] <= 1
    assert mixing.mix(empty).count() == 0
    assert sorted(mixing.sample(docs).columns) == sorted(docs.columns)
    kept = Counter(r[0] for r in got if r[7])
    assert Counter(r.doc_id for r in mixing.sample(docs).collect()) == kept


def test_raking_meets_the_targets():
    rng = random.Random(4)
    cells = [((s, lang, t), rng.randint(500, 1000)) for s in "abcd" for lang in ("en", "de") for t in "xy"]
    targets = {"source": {"a": 0.3, "b": 0.3, "c": 0.2, "d": 0.2}, "lang": {"en": 0.55, "de": 0.45}, "topic": 0.5}
    chance, rate = mixing.rake(cells, targets, 200)
    total = sum(n for _, n in cells)
    for d, name in ((0, "source"), (1, "lang")):
        for k, share in targets[name].items():
            assert sum(n * p for ((key), n), p in zip(cells, chance, strict=True) if key[d] == k) == pytest.approx(share * rate * total, rel=2e-6)
    assert mixing.rake([((s, "en", "x"), 0) for s in "ab"]) == ([0.6, 0.6], 0.6)


@pytest.mark.parametrize("seed", range(20))
def test_filled_targets(seed):
    """What a short key lacks goes to the others in proportion: against bisection."""
    rng = random.Random(seed)
    seen = [rng.random() ** 3 for _ in range(rng.randint(1, 9))]
    seen = [x / sum(seen) / rng.uniform(0.3, 1) for x in seen]
    seen = [x / min(1, sum(seen)) for x in seen]
    share = [rng.random() for _ in seen]
    share = [x / sum(share) for x in share]
    low, high = 0.0, 1e9
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(a, mid * s) for a, s in zip(seen, share, strict=True)) < 1 else (low, mid)
    got = mixing.fill(seen, share)
    assert [min(a, got * s) for a, s in zip(seen, share, strict=True)] == pytest.approx([min(a, high * s) for a, s in zip(seen, share, strict=True)], abs=1e-9)


MARKS = {"prose": "x y", "licensed": "License y", "contact": "a@b y", "table": "x | y"}


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_the_sample_meets_the_targets(spark, driver_cells):
    """Expected and drawn token shares, where languages lower the rate."""
    rng = random.Random(6)
    rows = [(i, f"{MARKS[rng.choices([*MARKS], (70, 10, 10, 10))[0]]} {'w ' * 10}", rng.choices(("en", "de"), (8, 2))[0], "a", 0) for i in range(6000)]
    targets = {"source": 1.0, "lang": {"en": 0.6, "de": 0.4}, "topic": {"prose": 0.7, "licensed": 0.1, "contact": 0.1, "table": 0.1}}
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df, targets=targets, driver_cells=driver_cells).collect()
    for name in ("lang", "topic"):
        for k, share in targets[name].items():
            part = lambda of, name=name, k=k: sum(of(r) for r in got if r[name] == k) / sum(map(of, got))
            assert part(lambda r: r.n_tokens * r.probability) == pytest.approx(share, abs=1e-3)
            assert part(lambda r: r.n_tokens * r.sampled) == pytest.approx(share, abs=0.05)
    assert max(r.probability for r in got) <= 1
    told = {(r.margin, r.key): r for r in mixing.report(df, targets=targets, driver_cells=driver_cells).collect()}
    assert told["lang", "de"].expected == pytest.approx(0.4, abs=1e-3) and told["lang", "de"].whole and not told["lang", "en"].whole


def test_a_short_topic_is_taken_whole(spark):
    """A topic with a tenth of what its share asks for: all of it is sampled, the other margins and the rate hold."""
    rng = random.Random(7)
    rows = [(i, f"{MARKS['table' if rng.random() < 0.02 else 'prose']} {'w ' * 10}", rng.choice(("en", "de")), rng.choice("ab"), 0) for i in range(4000)]
    targets = {"source": 1.0, "lang": {"en": 0.6, "de": 0.4}, "topic": 0.01}
    df = spark.createDataFrame(rows, SCHEMA)
    told = {(r.margin, r.key): r for r in mixing.report(df, targets=targets, rate=0.5).collect()}
    assert told["topic", "table"].whole and not told["topic", "prose"].whole
    assert told["lang", "en"].expected == pytest.approx(0.6, abs=1e-4)
    got = mixing.mix(df, targets=targets, rate=0.5).collect()
    assert all(r.sampled for r in got if r.topic == "table")
    assert sum(r.n_tokens * r.probability for r in got) == pytest.approx(0.5 * sum(r.n_tokens for r in got), rel=1e-3)


def test_topics(spark):
    texts = {"prose": ["", "a b c", "see the License " + "w " * 200, None], "licensed": ["the license", "License " + "w " * 98], "contact": ["mail a@b now"], "table": ["a | b | c d"]}
    rows = [(0, t, topic, "a", 0) for topic, ts in texts.items() for t in ts]
    assert all(r.topic == r.name for r in mixing.cells_of(spark.createDataFrame(rows, SCHEMA).withColumnRenamed("lang", "name").selectExpr("*", "'en' AS lang"), ["name"]).collect())


@pytest.mark.parametrize("driver_cells", [1000, 0])
def test_mixing_is_the_sql(spark, docs, rows, driver_cells):
    con = duckdb.connect()
    plain = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    frame = plain.toPandas()
    con.register("documents", frame)
    want = sorted(con.sql(mixing.sql(6)).fetchall())
    got = sorted(map(tuple, mixing.mix(plain, rounds=6, driver_cells=driver_cells).collect()))
    for a, b in zip(got, want, strict=True):
        assert (a[:5], a[7]) == (b[:5], b[7]) and a[5:7] == pytest.approx(b[5:7], rel=1e-7, abs=1e-8)


def test_languages_without_a_target_keep_their_share(spark):
    assert mixing.shares({"en": 60, "de": 20, "it": 15, "": 5}, mixing.TARGETS["lang"]) == pytest.approx({"en": 0.8 * 2 / 3, "de": 0.8 / 3, "it": 0.15, "": 0.05})
    assert mixing.shares({"it": 30, "": 10}, mixing.TARGETS["lang"]) == {"it": 0.75, "": 0.25}
    for langs in (("it", None), ("en", "it", None)):
        df = spark.createDataFrame([(i, f"a b {i}", langs[i % len(langs)], "s", 0) for i in range(30)], SCHEMA)
        for n in (1000, 0):
            got = mixing.mix(df, rounds=2, driver_cells=n).collect()
            assert [r.weight for r in got] == pytest.approx([1] * 30, rel=1e-5)


def test_raking_as_a_table_is_the_same(docs):
    few = lambda n: sorted(map(tuple, mixing.mix(docs, rounds=3, driver_cells=n).collect()), key=str)
    assert few(0) == few(1000)


# 6: quality rules


def test_quality_rules(docs, rows, empty, spark):
    plain = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, quality_rules.apply_rules(plain, least_group=5).select(*quality_rules.COLUMNS).collect()))
    con = duckdb.connect()
    frame = plain.toPandas()
    con.register("documents", frame)
    assert got == sorted(con.sql(quality_rules.sql(least_group=5)).fetchall())
    for r in got:
        w = words(rows[r[0]][1])
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = Counter(wins)
        covered = {i + k for i, x in enumerate(wins) if often[x] > 1 for k in range(8)}
        assert (r[1], r[2], r[5]) == (len(w), sum(map(len, w)), len(covered))
        assert r[3] == sum((rows[r[0]][1] or "").count(x) for x in "#*$%&|<>")
    assert quality_rules.apply_rules(docs).count() == len(rows)
    assert quality_rules.apply_rules(empty).count() == 0
    assert sorted(quality_rules.keep_good(docs).columns) == sorted(docs.columns)


def test_limits_adapt_to_each_source(spark):
    """More symbols and longer words in one source move that source's limits and no other's; outliers fail, the shifted rest stays."""
    rng = random.Random(8)

    def text(source, outlier):
        words_ = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8) + (6 if source == "c" else 0))) for _ in range(rng.randint(30, 60))]
        for k in range((3 if source == "c" else 0) + rng.randint(0, 2)):
            words_[k * 3] += "#"
        return " ".join(w + "#" * 5 if outlier else w for w in words_)

    rows = [(i, text("abc"[i % 3], i % 300 < 3), "en", "abc"[i % 3], 0) for i in range(1800)]
    plain = [(i, t if s != "c" else rows[i - 1][1], lang, s, n) for i, t, lang, s, n in rows]
    of = lambda r: {x.source: x.limits for x in quality_rules.limits(quality_rules.sketch(quality_rules.base_counts(spark.createDataFrame(r, SCHEMA), ["doc_id", "lang", "source"]))).collect()}
    before, after = of(plain), of(rows)
    assert before["a"] == after["a"] and before["b"] == after["b"]
    assert after["c"]["symbols"].high > before["c"]["symbols"].high and after["c"]["word_length"].low > before["c"]["word_length"].high > before["c"]["word_length"].low
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[i] for i in got if i % 300 < 3)
    assert sum(got[i] for i in got if i % 300 >= 3) >= 0.98 * 1782


def test_limits_survive_copies(spark):
    """A source of which most is one copied text leaves its other, ordinary texts alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6)))
    text = " ".join("abcde" for _ in range(3)) + " " + " ".join(f"{word()}" for _ in range(40))
    rows = [(i, text if i % 10 else " ".join(word() for _ in range(45)), "en", "a", 0) for i in range(400)]
    assert all(r.kept for r in quality_rules.apply_rules(spark.createDataFrame(rows, SCHEMA)).collect())


def test_quality_rules_of_a_long_text(spark):
    """A text of 60,000 words, where only two windows repeat."""
    w = [f"w{i}" for i in range(60_000)]
    w[50_000:50_010] = w[10:20]
    r = quality_rules.apply_rules(spark.createDataFrame([(1, " ".join(w), "en", "a", 0)], SCHEMA)).first()
    assert (r.n_words, r.n_repeat_words, r.base_failed) == (60_000, 20, False)


def test_quality_sketches_merge(docs):
    one = quality_rules.sketch(quality_rules.base_counts(docs.repartition(1), [docs.doc_id, docs.lang, docs.source]))
    many = quality_rules.sketch(quality_rules.base_counts(docs.repartition(7), [docs.doc_id, docs.lang, docs.source]))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


# 7: Jaccard join


def components(rows, percent=80):
    sets = {}
    for i, t, *_ in rows:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def test_jaccard_join(docs, rows, empty):
    known = [r for r in rows if r[0] is not None]
    for batch, bucket_bytes in ((2000, jaccard_join.BUCKET_BYTES), (300, 1 << 30), (300, 200)):
        got = jaccard_join.join_near_duplicates(docs, batch=batch, bucket_bytes=bucket_bytes).select(*jaccard_join.COLUMNS)
        assert got.count() == len(rows)
        assert sorted(map(tuple, got.where("doc_id IS NOT NULL").distinct().collect())) == components(known)
        assert sorted(map(tuple, got.where("doc_id IS NULL").collect())) == [(None, 0, None), (None, 56, None)]
    assert jaccard_join.join_near_duplicates(empty).count() == 0
    kept = jaccard_join.keep_one_of_each(docs)
    assert sorted(kept.columns) == sorted(docs.columns)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for *_, c in components(known)})
    assert kept.where("doc_id IS NULL").count() == 2


def test_rows_that_share_an_id(spark):
    """Each text is judged on its own, whatever id it has; columns may have any name."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(3, text(1), 0), (7, text(1), 1), (7, text(2), 2), (7, text(2), 3), (9, text(2), 4), (5, text(3), 5), (5, text(4), 6), (6, text(3) + " end", 7), (8, "", 8), (8, None, 9), (None, text(1), 10), (2, text(5), 11)]
    df = spark.createDataFrame([(i, t, k, 1) for i, t, k in rows], "doc_id long, text string, `__id` long, `a b` int")
    kept = jaccard_join.keep_one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    # of ids 7 the copy of 3 goes, and one of two equal rows; of ids 5 both texts stay
    assert got == sorted([(3, text(1)), (7, text(2)), (5, text(3)), (5, text(4)), (8, ""), (None, text(1)), (2, text(5))], key=str) or [x for x in got if x != (8, None)] == sorted(
        [(3, text(1)), (7, text(2)), (5, text(3)), (5, text(4)), (None, text(1)), (2, text(5))], key=str
    )


def test_each_order_removes_candidates(spark):
    """Documents of the same passages in other choices share much but no link: later orders filter what earlier ones let pass."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passages = [[word() for _ in range(rng.randint(10, 30))] for _ in range(40)]
    rows = []
    for i in range(200):
        chosen = sorted(rng.sample(range(40), 12), key=lambda k: k * rng.random())
        rows.append((i, " ".join(w for k in chosen for w in passages[k]), "en", "s", 0))
        if i % 10 == 0:
            rows.append((1000 + i, rows[-1][1] + " " + word(), "en", "s", 0))
    counts = jaccard_join.candidate_counts(spark.createDataFrame(rows, SCHEMA))
    assert counts[0] > counts[1] > counts[2] >= 20


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_join_of_edited_copies(spark, seed):
    """Groups of edited copies, chains of edits, and a passage that all documents share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(8):
        text = [word() for _ in range(rng.randint(15, 80))]
        if rng.random() < 0.5:
            text += passage
        chain = rng.random() < 0.5
        for _ in range(rng.randint(1, 25)):
            copy = list(text)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy), "en", "s", 0))
            if chain:
                text = copy
    got = jaccard_join.join_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), batch=1500).select(*jaccard_join.COLUMNS)
    assert sorted(map(tuple, got.collect())) == components(rows)


def test_large_groups_are_dealt_whole(spark, monkeypatch):
    """A group of edited copies over many parts links like one over a single part; joins by shuffle keep the same rows."""
    monkeypatch.setattr(jaccard_join, "PART", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_IDS", 0)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(70)]
    rows = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(len(copy))] = rng.choice(["common", word()])
        rows.append((i, " ".join(copy), "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert sorted(map(tuple, jaccard_join.join_near_duplicates(df).select(*jaccard_join.COLUMNS).collect())) == components(rows)
    assert sorted(r.doc_id for r in jaccard_join.keep_one_of_each(df).collect()) == sorted({c for *_, c in components(rows)})


# 8: vectors


def vector_rows(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(40):
        base = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 12))):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.06).tolist(), g % 3))
    rows += [(len(rows) + k, rows[0][1], rows[0][2]) for k in range(5)]
    rows.append((len(rows), [2 * x for x in rows[0][1]], rows[0][2]))
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[1.0] * 15], [None, *[1.0] * 15], [1.0, 2.0]]
    rows += [(len(rows) + k, v, 0) for k, v in enumerate(bad)]
    rows += [(len(rows), rows[0][1], None), (None, rows[0][1], rows[0][2])]
    return rows


def brute_links(rows, threshold=0.98):
    ok = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {i: set() for i, *_ in rows if i is not None}
    for i, a, c in ok:
        for j, b, d in ok:
            if i != j and c == d and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
    out = {}
    for i in sorted(links):
        if i not in out:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in out:
                    out[k] = i
                    todo += links[k]
    return links, out


def test_vector_graph(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    got = {r.vec_id: r for r in vector_graph.link_vectors(df, shard=40).collect()}
    links, root = brute_links(rows)
    assert len(got) == len(rows)
    found = sum(min(got[i].n_links, len(x)) for i, x in links.items())
    assert all(got[i].n_links <= len(x) for i, x in links.items())
    assert found >= 0.98 * sum(map(len, links.values()))
    if found == sum(map(len, links.values())):
        assert all(got[i].component_id == root[i] and got[i].kept == (i == root[i]) for i in root)
    assert got[None].n_links == 0 and got[None].component_id is None and got[None].kept
    assert vector_graph.link_vectors(df.limit(0)).count() == 0


def test_vector_graph_recall(spark):
    df = spark.createDataFrame(vector_rows(7), "vec_id long, embedding array<double>, label int").where("vec_id IS NOT NULL")
    found, true = vector_graph.audit_recall(df, df.where("vec_id % 20 = 0"), shard=40)
    rows = [r for r in vector_rows(7) if r[0] is not None]
    links, _ = brute_links(rows)
    assert true == sum(len(x) for i, x in links.items() if i % 20 == 0) and 0.95 * true <= found <= true


def test_links_lead_across_shards(spark):
    """A label that is one dense group of distinct vectors, 15 times the shard."""
    rng = np.random.default_rng(12)
    x = rng.normal(size=64) + rng.normal(size=(600, 64)) * 0.13
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.98).sum(1) - 1
    assert true.sum() > 30_000
    got = {r.vec_id: r.n_links for r in vector_graph.link_vectors(df, shard=40).collect()}
    assert all(got[i] <= true[i] for i in got)
    assert sum(got.values()) >= 0.995 * true.sum()


def test_repeated_ids_are_different_vectors(spark):
    """Orthogonal vectors that share ids, over two labels and within one."""
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    for labels in ((0, 1, 0, 1), (0, 0, 0, 0)):
        rows = list(zip((1, 1, 2, 3), (a, b, near(a), near(b)), labels, strict=True))
        got = vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
        assert sorted(map(tuple, got)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]
    rows = [(5, a, 0), (5, b, 0), (6, near(a), 0), (2, near(b), 0)]
    got = vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(tuple, got)) == [(2, 1, 2, True), (5, 1, 2, False), (5, 1, 5, True), (6, 1, 5, False)]


def test_vectors_of_one_direction(spark):
    """Multiples of one vector fill many shards, though no centre tells them apart; labels whose names look like cells stay apart."""
    rows = [(i, [(i + 1) * x for x in (1.0, 2.0, 3.0)], "b") for i in range(130)] + [(1000 + i, [1.0, 2.0, 3.0 + i / 1e6], c) for i, c in enumerate(("0.b", "3/b", "0.3/b", "/"))]
    got = {r.vec_id: r for r in vector_graph.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string"), shard=10).collect()}
    assert all((got[i].n_links, got[i].component_id) == (129, 0) for i in range(130))
    assert all((got[1000 + i].n_links, got[1000 + i].component_id) == (0, 1000 + i) for i in range(4))


def test_roots():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = rng.integers(0, n, (2, int(rng.integers(0, 40))))
        links = {i: set() for i in range(n)}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            links[x].add(y)
            links[y].add(x)
        want = {}
        for i in range(n):
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in want:
                    want[k] = i
                    todo += links[k]
        assert vector_graph._roots(n, a, b).tolist() == [want[i] for i in range(n)]


def test_robust_graph_prunes():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vector_graph.robust_graph(x, degree=8)
    assert g.shape == (200, 8) and (g != np.arange(200)[:, None]).all()
    for i in range(0, 200, 20):
        kept = [k for k in g[i] if k >= 0]
        assert len(set(kept)) == len(kept)
        for a, k in enumerate(kept):  # no kept neighbour is shadowed by a nearer one
            for near in kept[:a]:
                assert 1.44 * (2 - 2 * x[near] @ x[k]) > (2 - 2 * x[i] @ x[k]) - 1e-9


# 9: classifier


def test_classifier(spark, docs, rows, empty):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioultnrs") for _ in range(rng.randint(2, 8)))
    good = lambda: " ".join(word() for _ in range(rng.randint(20, 90))).capitalize() + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(rng.randint(20, 90)))
    own = [(1000 + i, good() if i % 4 else bad(), "en", "s", 0) for i in range(600)]
    labels = spark.createDataFrame([(1000 + i, int(bool(i % 4)), 0) for i in range(600)] + [(None, 1, 0), (1, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(own, SCHEMA)
    got = [r for r in quality_classifier.score_documents(df, labels).collect()]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == bool((r.doc_id - 1000) % 4) for r in held) >= 0.97 * len(held)
    all_of = by_id(quality_classifier.score_documents(docs, labels))
    assert len(all_of) == len(rows) and all(0 <= r[2] <= 1 for r in all_of)
    assert quality_classifier.score_documents(empty, labels).count() == 0
    assert {r[2] for r in by_id(quality_classifier.score_documents(docs, labels.limit(0)))} == {0.5}
    kept = quality_classifier.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.predicted}


def plain_statistics(text):
    """The statistics, character by character."""
    b, w = (text or "").encode(), re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    if not w:
        return [0.0] * 17
    lines = [x for x in b.split(b"\n") if re.search(rb"[^\x20\x09-\x0D]", x)]
    share = lambda test: sum(map(test, b)) / len(b)
    return [
        math.log(1 + len(b)), math.log(1 + len(w)), sum(map(len, w)) / len(w),
        share(lambda c: 65 <= c <= 90), share(lambda c: 48 <= c <= 57), share(lambda c: c in b"#*$%&<>"), *(share(lambda c, x=x: c == ord(x)) for x in "|!.,\n"), share(lambda c: c > 127),
        len(set(w)) / len(w), sum(x == y for x, y in zip(w, w[1:], strict=False)) / len(w), sum(x == y for x, y in zip(w, w[2:], strict=False)) / len(w),
        1 - len(set(lines)) / len(lines), math.log(1 + len(w) / len(lines)),
    ]


def monotone(y, w):
    """Isotonic regression by its min-max formula."""
    return [max(min(sum(a * b for a, b in zip(y[i : j + 1], w[i : j + 1], strict=True)) / sum(w[i : j + 1]) for j in range(k, len(y))) for i in range(k + 1)) for k in range(len(y))]


def brute_scores(rows, quality):
    """The score of each row (id, text) from whole matrices: features, weighted ridge by least squares, isotonic steps by their formula."""
    x = np.array([plain_statistics(t) for _, t in rows]).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(("" if i is None else str(i)).encode()) % 5 for i, _ in rows])
    known = np.array([i in quality for i, _ in rows])
    y = np.array([float(quality.get(i, 0)) for i, _ in rows])
    own, held = known & (fold > 1), known & (fold == 1)
    z = np.clip((x - x[own].mean(0)) / np.maximum(x[own].std(0), 1e-3), -6, 6)
    draws = np.random.default_rng(quality_classifier.SEED)
    w = draws.normal(0, 1 / (quality_classifier.WIDTH * math.sqrt(17)), (17, 256))
    phase = draws.uniform(0, 2 * np.pi, 256)
    f = np.hstack([np.sqrt(2 / 256) * np.cos(z @ w + phase), np.ones((len(z), 1))])
    weight = np.where(y[own] > 0, 0.5 / y[own].mean(), 0.5 / (1 - y[own].mean()))
    root = np.sqrt(weight)[:, None]
    beta = np.linalg.lstsq(np.vstack([f[own] * root, np.eye(257)]), np.concatenate([y[own] * root[:, 0], np.zeros(257)]), rcond=None)[0]
    raw = f @ beta
    spot = np.clip(np.round(raw[held] * 1000), -2000, 2000) / 1000
    bins = sorted(set(spot.tolist()))
    n, p = [int((spot == s).sum()) for s in bins], [y[held][spot == s].sum() for s in bins]
    steps = [round(v, 9) for v in monotone([a / b for a, b in zip(p, n, strict=True)], n)]
    knots = [np.average([s for s, v in zip(bins, steps, strict=True) if v == u], weights=[k for k, v in zip(n, steps, strict=True) if v == u]) for u in sorted(set(steps))]
    return np.interp(raw, knots, sorted(set(steps)))


def test_classifier_by_brute_force(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("aeioultnrsé1") for _ in range(rng.randint(1, 9)))
    rows = [(i, rng.choice((" ", "\n")).join(rng.choice((word(), word().upper() + "!", "|")) if i % 3 else word() for _ in range(rng.randint(0, 40)))) for i in range(400)]
    rows += [(7, rows[7][1]), (400, None), (401, ""), (402, "long " * 20_000)]
    quality = {i: int(rng.random() < (0.85 if i % 3 == 0 else 0.25)) for i in range(0, 400, 2)}
    labels = [(i, q, 0) for i, q in quality.items()] + [(8, 1 - quality[8], 0)]
    quality[8] = 0
    got = quality_classifier.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = brute_scores(rows, quality)
    assert len(got) == len(rows) and len(set(want.round(6))) > 50
    assert sorted((r.doc_id, round(r.score, 5)) for r in got) == sorted((i, round(float(s), 5)) for (i, _), s in zip(rows, want, strict=True))
    assert all(r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_isotonic():
    knots, values = quality_classifier.isotonic([(0.1, 2, 0), (0.2, 1, 1), (0.3, 2, 1), (0.9, 4, 4)])
    assert values == sorted(values) and values[0] == 0 and values[-1] == 1


# 10: licences


def test_license_scan(spark, docs, rows, empty):
    plain = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], SCHEMA)
    got = sorted(map(tuple, license_scan.scan_licenses(plain).select(*license_scan.COLUMNS).collect()))
    con = duckdb.connect()
    frame = plain.toPandas()
    con.register("documents", frame)
    assert got == sorted(con.sql(license_scan.sql()).fetchall())
    for r in got:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(rows[r[0]][1]))
        at = [(i, x) for p, x in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert r[1:5] == (len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None)
        assert r[5] == ",".join(sorted({x for _, x in at})) and set(r[5].split(",")) <= set(r[6].split(",")) | {""}
    assert license_scan.scan_licenses(docs).count() == len(rows)
    assert license_scan.scan_licenses(empty).count() == 0


def alignments(text, least=license_scan.LEAST_SHARE):
    """(template, start, matched) by comparing every template at every place."""
    w, out = license_scan.split(text or ""), []
    for t, (_, notice, key) in enumerate(license_scan.TEMPLATES):
        words_, wanted = license_scan.split(notice), license_scan.split(key)
        at = next(i for i in range(len(words_)) if words_[i : i + len(wanted)] == wanted)
        counted = [i for i, x in enumerate(words_) if at <= i < at + len(wanted) or x not in license_scan.STOP_WORDS]
        for start in range(-len(words_), len(w)):
            matched = sum(0 <= start + i < len(w) and w[start + i] == words_[i] for i in counted)
            if start + at >= 0 and w[start + at : start + at + len(wanted)] == wanted and matched >= least * len(counted):
                out.append((t, start, matched))
    return sorted(out)


def test_every_notice_is_found(spark):
    """Each notice alone, all in one file, with edits and with their words in disorder, against every template at every place."""
    rng = random.Random(10)
    notices = [n for _, n, _ in license_scan.TEMPLATES]
    rows = [(i, n) for i, n in enumerate(notices)] + [(100, "\n\n".join(notices)), (101, " and ".join(reversed(notices)) * 3)]
    for i in range(40):
        w = " ".join(rng.sample(notices, 3)).split()
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = rng.choice(["x", "license", "public", "the"])
        rows.append((200 + i, " ".join(w)))
    rows += [(300, " ".join(rng.sample(" ".join(notices).split(), 300))), (301, "license " * 2000), (302, None), (303, "MIT License " * 500)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, text in rows:
        assert [tuple(a) for a in got[i].alignments or []] == alignments(text), i
    assert set(got[100].labels.split(",")) == {label for label, *_ in license_scan.TEMPLATES}
    for i, (label, *_) in enumerate(license_scan.TEMPLATES):
        assert label in got[i].labels.split(",") and got[i].score == 1


def test_texts_of_many_words(spark):
    """Texts of 40,000 words through 3, 7 and 10: counts, links and a notice at the very end."""
    rng = random.Random(30)
    words_ = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(40_000)]
    near = list(words_)
    for _ in range(600):
        near[rng.randrange(len(near))] = "changed"
    notice = license_scan.TEMPLATES[1][1]
    rows = [(0, " ".join(words_), "en", "a", 0), (1, " ".join(near), "en", "a", 0), (2, " ".join(words_[:36_000]) + " " + notice, "en", "a", 0), (3, "short", "en", "a", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, jaccard_join.join_near_duplicates(df, batch=50_000).select(*jaccard_join.COLUMNS).collect())) == components(rows)
    got = {r.doc_id: r for r in lm_scoring.score_texts(df, batch=50_000).collect()}
    for i, held, n, known, train, base in reference_scores(rows):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train) and r.base_score == pytest.approx(base, rel=1e-9)
    found = {r.doc_id: r for r in license_scan.scan_licenses(df).collect()}
    assert found[2].labels == "mit" and found[2].score == 1 and (1, 36_000, found[2].alignments[0].matched) in [tuple(a) for a in found[2].alignments]
    assert found[0].labels == "" and found[0].n_words == 40_000


# native operators run no Python


@pytest.mark.parametrize("name", ["op2_url_rules", "op6_quality_rules", "op10_license_scan"])
def test_native(spark, sf, name):
    plan = getattr(registered, name)(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
