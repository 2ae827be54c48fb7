"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, jaccard_join, license_scan, lm_scoring, mixing, quality_classifier, quality_rules, token_counts, url_rules, vector_graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.filter_urls(table(spark, sf_dir, "pages"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents")).select(*lm_scoring.COLUMNS)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    return byte_bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, outputs=())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents")).select(*quality_rules.COLUMNS)


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_near_duplicates(table(spark, sf_dir, "documents")).select(*jaccard_join.COLUMNS)


def op8_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.link_vectors(table(spark, sf_dir, "embeddings"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select(*license_scan.COLUMNS)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_token_counts,
            op2_url_rules,
            op3_lm_scoring,
            op4_byte_bpe,
            op5_mixing,
            op6_quality_rules,
            op7_jaccard_join,
            op8_vector_graph,
            op9_quality_classifier,
            op10_license_scan,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": url_rules.SQL, "op5_mixing": mixing.sql(), "op6_quality_rules": quality_rules.sql(), "op7_jaccard_join": jaccard_join.sql(), "op10_license_scan": license_scan.sql()}
