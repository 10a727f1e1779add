"""Registered queries of the record operators (problems 1 to 3) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.current import current_rows
from strandline.operators.orphans import find_orphans, orphan_counts
from strandline.operators.shred import entities, entity_table, shred
from strandline.operators.widen import long_cells, widen
from strandline.session import table

KEYS = ("source_ref", "language")
ENTITY_TABLES = {
    "mentions": ("mentions", ("id", "type", "name", "relevance", "description"), ("aliases", "involvement"), ("evidence.quote",)),
    "matters": ("matters", ("id", "kind", "description"), ("authority_ids", "subject_ids"), ("evidence.quote",)),
    "relationships": ("relationships", ("id", "subject_id", "object_id", "kind", "predicate", "status", "negated"), (), ("period.text", "period.start", "period.end", "period.evidence.quote", "evidence.quote")),
    "risks": ("risks", ("id", "matter_id", "type", "label", "description", "status", "negated"), ("authority_ids", "subject_ids", "affected_ids"), ("period.text", "period.start", "period.end", "period.evidence.quote", "evidence.quote")),
    "actions": ("actions", ("id", "matter_id", "type", "label", "description", "status", "duration"), ("actor_ids", "target_ids", "affected_ids"), ("amount.text", "amount.currency", "amount.amount", "amount.qualifier", "period.text", "period.start", "period.end", "period.evidence.quote", "evidence.quote")),
    "mention_attributes": ("mentions.attributes", ("name", "value"), (), ("evidence.quote",)),
    "mention_geographies": ("mentions.geographies", ("name", "role"), (), ("evidence.quote",)),
    "matter_case_numbers": ("matters.case_numbers", ("value",), (), ("evidence.quote",)),
    "matter_legal_provisions": ("matters.legal_provisions", ("value",), (), ("evidence.quote",)),
}


def current_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "extractions"), KEYS, ("extracted_at",), ("extraction_json",))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shred(current_extractions(spark, sf_dir), KEYS, "extraction_json")
    return entities(nodes, KEYS).select("source_ref", "language", "path", "item_pos", "child_pos")


def p1_table(spec: str):
    path, fields, lists, embedded = ENTITY_TABLES[spec]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = shred(current_extractions(spark, sf_dir), KEYS, "extraction_json")
        flat = entity_table(nodes, KEYS, path, fields, lists, embedded)
        # A flat table has no arrays: lists of ids and names are written as JSON.
        return flat.withColumns({c: F.to_json(c) for c in lists})

    return run


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_orphans(table(spark, sf_dir, "release_links"), table(spark, sf_dir, "releases"), table(spark, sf_dir, "release_removals"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(p2_found(spark, sf_dir))


def p3_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widen(table(spark, sf_dir, "mention_attributes"), table(spark, sf_dir, "attribute_types"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return long_cells(p3_wide(spark, sf_dir), table(spark, sf_dir, "attribute_types"))


def queries() -> dict:
    out = {"p1_found": p1_found}
    out |= {f"p1_{name}": p1_table(name) for name in ENTITY_TABLES}
    return out | {"p2_found": p2_found, "p2_counts": p2_counts, "p3_found": p3_found, "p3_wide": p3_wide}
