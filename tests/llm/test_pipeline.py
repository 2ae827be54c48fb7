"""The pipeline's stages, each against brute force or SQL on the stage's own input, and runs over awkward tables."""

import base64
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from test_operators import brute_scores, components

import corpus_pipeline
from tracelight.llm import mixing, quality_rules
from tracelight.llm.common import Store

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def stages(spark, sf):
    store, docs, out = Store(spark), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        made = store.put(f(spark, docs, sf))
        out.append((name, docs, made))
        docs = made
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def by_sql(docs, sql):
    con = duckdb.connect()
    frame = docs.toPandas()
    con.register("documents", frame)
    return con.sql(sql).df()


def test_names_and_columns(stages):
    assert [n for n, *_ in stages] == ["quality_classifier", "quality_rules", "ngram_jaccard_join", "mixing", "byte_bpe"]
    assert all(made.columns == docs.columns for _, docs, made in stages[:-1])
    assert all(made.count() for *_, made in stages)


def test_classifier_stage(spark, sf, stages):
    _, docs, made = stages[0]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    quality = {}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        quality[r.doc_id] = min(r.quality, quality.get(r.doc_id, 1))
    scores = brute_scores(rows, {i: q for i, q in quality.items() if zlib.crc32(str(i).encode()) % 5})
    assert min(abs(scores - 0.3)) > 1e-9
    assert ids(made) == sorted(i for (i, _), s in zip(rows, scores, strict=True) if s >= 0.3)


def test_rules_stage(stages):
    _, docs, made = stages[1]
    want = by_sql(docs, quality_rules.sql())
    assert ids(made) == sorted(want[want.kept].doc_id.tolist())


def test_join_stage(stages):
    _, docs, made = stages[2]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ids(made) == sorted({c for *_, c in components(rows)})


def test_mixing_stage(stages):
    _, docs, made = stages[3]
    want = by_sql(docs, mixing.sql())
    assert ids(made) == sorted(want[want.sampled].doc_id.tolist())


def check_encoding(docs, made):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(corpus_pipeline.public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in docs.collect():
        tokens = own.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(tokens), hashlib.sha256(np.array(tokens, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest(), tokens))
    assert sorted((tuple(r) for r in made.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids").collect()), key=str) == sorted(want, key=str)


def test_encoding_stage(stages):
    check_encoding(*stages[4][1:])


def test_run(spark, sf, stages):
    assert ids(corpus_pipeline.run(spark, sf)) == ids(stages[-1][2])


def written(spark, folder, docs, labels=()):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_run_over_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [])).collect() == []


def test_run_over_nulls_and_repeated_rows(spark, tmp_path):
    """Without labels every document scores 0.5 and stays; null and short texts fail the base rules; of equal rows one stays."""
    rng = random.Random(5)
    text = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 6))) for _ in range(60))
    docs = [(i, text(i), ("en", None)[i % 2], ("s", None)[i % 3 > 0], 0) for i in range(40)]
    docs += [docs[3], docs[3], (100, None, "en", "s", None), (101, "", None, None, 0), (102, "too short", "en", "s", 9), (None, text(50), "en", "s", 0), (None, None, None, None, None), (200, docs[5][1], "en", "s", 0)]
    folder = written(spark, tmp_path, docs, [(None, None, None)])
    got = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) <= {*range(40), None}
    kept, store = spark.read.parquet(f"{folder}/documents.parquet"), Store(spark)
    for _, f in corpus_pipeline.STAGES[:3]:
        kept = store.put(f(spark, kept, folder))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([*range(40), None], key=str)
    check_encoding(kept, corpus_pipeline.byte_bpe_stage(spark, kept, folder))
