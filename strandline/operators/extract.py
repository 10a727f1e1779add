"""Running an extractor over pending releases, and the tables of its successes and failures.

The extractor is a parameter: a function of one source document that makes one
request and returns a record, with the run's id and usage if it has them. It
runs in the executors, one document at a time in each of ``workers`` tasks.
Records are grounded and checked by expressions; successes and failures are
both rows, so nothing that succeeded is lost to what failed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import plain_text
from strandline.operators.evidence import first_missing_quote, ground, read_record, unknown_fields, violations
from strandline.operators.ingest import EXTRACTION
from strandline.session import cut
from strandline.sources.graph_io import compact

#: Extractor: document -> (record, run id, usage); anything it raises is a failure of that document.
Extractor = Callable[[dict[str, str]], tuple[dict[str, Any], str | None, dict[str, Any] | None]]

EXTRACTED = ("source_ref", "language", "source_modification_time", "schema_version", "model", "extraction_json", "extracted_at", "run_id", "usage_json")
FAILED = ("source_ref", "language", "source_modification_time", "schema_version", "model", "failed_at", "error_type", "error_message", "usage_json")
REQUIRED = ("newsRefNo", "title", "html", "issueDate")


class ExtractionError(RuntimeError):
    """Releases whose extraction failed; ``run`` has the tables of the whole run."""

    def __init__(self, message: str, run: ExtractionRun | None = None, usage: dict[str, Any] | None = None):
        super().__init__(message)
        self.run, self.usage = run, usage


def diagnostic(error: BaseException) -> str:
    """The error and what it came from, one cause a line, each once."""
    told: dict[int, str] = {}

    def tell(what: BaseException | None) -> None:
        if what is not None and told.setdefault(id(what), "") == "":
            told[id(what)] = f"{type(what).__name__}: {what}"
            tell(what.__cause__ or what.__context__)

    tell(error)
    return "\nCaused by: ".join(told.values())


def document(raw_json: str) -> dict[str, str]:
    """What an extractor is given: reference, title, issue_date and source_text."""
    raw = json.loads(raw_json)
    missing = [f for f in REQUIRED if not isinstance(raw, dict) or not isinstance(raw.get(f), str) or not raw[f]]
    if missing:
        raise ExtractionError("the release has no text in " + ", ".join(missing))
    return {"reference": raw["newsRefNo"], "title": raw["title"].strip(), "issue_date": raw["issueDate"], "source_text": plain_text(raw["html"])}


@dataclass(frozen=True)
class ExtractionRun:
    """Tables of what was extracted and of what failed."""

    extractions: DataFrame
    failures: DataFrame

    def counts(self) -> tuple[int, int]:
        return self.extractions.count(), self.failures.count()

    def check(self) -> None:
        """Raise if anything failed, naming the first; to be called when the tables are saved."""
        n = self.failures.count()
        if n:
            first = self.failures.orderBy("source_ref", "language").first()
            raise ExtractionError(f"{n} extractions failed; the first is {first['source_ref']}: {first['error_message']}", self)


def extract(pending: DataFrame, extractor: Extractor, version: int, model: str, workers: int = 1) -> ExtractionRun:
    """Extract ``pending`` (source_ref, language, modification_time, raw_json), once each.

    A release without its required texts, an extractor that raises, a record
    with unknown fields or that breaks a rule, and a record with a quote that
    its source does not have are failures, each with type, message and usage.
    Repeated rows are extracted once. An empty table gives empty tables.
    """

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for raw in part["raw_json"]:
                try:
                    doc = document(raw)
                    record, run_id, usage = extractor(doc)
                    out = (compact(record), f"{doc['title']}\n{doc['source_text']}", run_id, usage, None, None)
                except Exception as error:
                    out = (None, None, None, getattr(error, "usage", None), type(error).__name__, diagnostic(error))
                rows.append((*out[:3], None if out[3] is None else compact(out[3]), *out[4:]))
            found = pd.DataFrame(rows, columns=["_record", "_source", "run_id", "usage_json", "error_type", "error_message"])
            yield pd.concat([part[["source_ref", "language", "source_modification_time"]].reset_index(drop=True), found], axis=1)

    rows = pending.select("source_ref", F.upper("language").alias("language"), F.col("modification_time").alias("source_modification_time"), "raw_json").distinct()
    called = rows.repartition(workers, "source_ref", "language").mapInPandas(run, "source_ref string, language string, source_modification_time string, _record string, _source string, run_id string, usage_json string, error_type string, error_message string")
    # One request each: what came back is written before anything reads it twice.
    called = cut(called.withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
    # Rules hold for the record as sent and as grounded, whose periods may be gone.
    judged = called.withColumn("_x", read_record(F.col("_record"))).withColumn("_odd", unknown_fields(F.col("_record"))).withColumn("_rules", violations(F.col("_x")))
    judged = judged.withColumn("_x", ground(F.col("_x"), F.col("_source"))).withColumn("_missing", first_missing_quote(F.col("_x"), F.col("_source")))
    wrong = (
        F.when(F.col("_x").isNull(), F.lit("the record can't be read"))
        .when(F.size("_odd") > 0, F.concat(F.lit("unknown fields: "), F.array_join("_odd", ", ")))
        .when(F.size("_rules") > 0, F.concat(F.lit("rules broken: "), F.array_join("_rules", ", ")))
        .when(F.col("_missing").isNotNull(), F.concat(F.lit("the source does not have the quote: "), "_missing"))
    )
    kind = F.when(F.col("_missing").isNotNull() & (F.size("_rules") == 0) & (F.size("_odd") == 0), "EvidenceError").otherwise("InvalidRecord")
    refused = F.col("error_type").isNull() & F.col("_wrong").isNotNull()
    judged = judged.withColumn("_wrong", wrong).withColumn("error_message", F.when(refused, F.concat(kind, F.lit(": "), "_wrong")).otherwise(F.col("error_message"))).withColumn("error_type", F.when(refused, kind).otherwise(F.col("error_type")))
    judged = cut(judged.select("source_ref", "language", "source_modification_time", F.lit(version).alias("schema_version"), F.lit(model).alias("model"), F.to_json("_x").alias("extraction_json"), "run_id", "usage_json", "error_type", "error_message", "at"))
    good = judged.where("error_type is null").withColumn("extracted_at", F.col("at")).select(*EXTRACTED)
    bad = judged.where("error_type is not null").withColumn("failed_at", F.col("at")).select(*FAILED)
    return ExtractionRun(good, bad)


def saved(extractions: DataFrame, failures: DataFrame, run: ExtractionRun) -> tuple[DataFrame, DataFrame]:
    """Both tables with a run's rows in place of those of equal keys; an extraction clears the failure of its key."""
    key = list(EXTRACTION)
    done, failed = run.extractions, run.failures
    kept = extractions.select(*EXTRACTED).join(done.select(*key), key, "left_anti").unionByName(done)
    touched = done.select(*key).unionByName(failed.select(*key))
    return kept, failures.select(*FAILED).join(touched, key, "left_anti").unionByName(failed)
