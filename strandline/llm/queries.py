"""Registered queries of this subpackage (problems 4 to 9) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.bitext import align
from strandline.llm.mixing import mix, replicate
from strandline.llm.normalize import normalize_columns, unusual_fields
from strandline.llm.subjects import assign, composition, train
from strandline.llm.tokenize import token_ids
from strandline.llm.variants import attach_variants
from strandline.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unusual_fields(table(spark, sf_dir, "mentions"), "mention_id", {"name": "name", "quote": "evidence.quote"})


def p4_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions").selectExpr("mention_id", "name", "evidence.quote as quote").distinct()
    return normalize_columns(mentions, ["name", "quote"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "releases"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attach_variants(table(spark, sf_dir, "mentions"), table(spark, sf_dir, "entity_register"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(table(spark, sf_dir, "documents"))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p8_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(_mixed(spark, sf_dir)[0])


def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return assign(docs, train(docs, table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subject_areas")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assigned(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return composition(table(spark, sf_dir, "documents"), _assigned(spark, sf_dir))


def queries() -> dict:
    return {"p4_found": p4_found, "p4_normalized": p4_normalized, "p5_found": p5_found, "p6_found": p6_found, "p7_ids": p7_ids, "p8_mix": p8_mix, "p8_shares": p8_shares, "p8_stream": p8_stream, "p9_found": p9_found, "p9_composition": p9_composition}


def oracle_sql() -> dict[str, str]:
    return {}
