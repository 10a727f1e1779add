"""Registered queries of ingest, evidence, projection and budgets, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.text import entity_id, html_text, normalize_name, source_text
from strandline.operators import ingest as I
from strandline.operators import metrics as M
from strandline.operators import query as Q
from strandline.operators.current import current_rows
from strandline.operators.evidence import check_quotes, first_missing_quote, ground, quotes, read_record, unknown_fields, unwrapped, violations
from strandline.operators.extract import extract
from strandline.operators.project import merge, projection
from strandline.session import cut, table
from strandline.streaming.budget import apply_budget

VERSION, MODEL = 10, "extractor-large"
CUT_OFF = "2021-01-01"
KEYS = ("source_ref", "language")


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current_rows(table(spark, sf_dir, "releases"), KEYS, ("modification_time", "fetched_at"), ("issue_date", "raw_json"))


def _oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "releases")
    first = rows.groupBy(*KEYS).agg(F.min(F.struct("modification_time", "fetched_at")).alias("f"))
    return rows.join(first, list(KEYS)).where((F.col("modification_time") == F.col("f.modification_time")) & (F.col("fetched_at") == F.col("f.fetched_at"))).drop("f").distinct()


def releases_scan(spark, sf_dir):
    return I.scan(_current(spark, sf_dir), "ZH").select("source_ref", "issue_date")


def release_versions(spark, sf_dir):
    return I.versions(_current(spark, sf_dir), "EN")


def links_scan(spark, sf_dir):
    known = I.versions(_current(spark, sf_dir), "EN")
    return I.links_of(table(spark, sf_dir, "release_links"), known, "EN")


def _batch(spark, sf_dir):
    """The releases modified since the cut-off: the batch that comes upon what was stored before."""
    return _current(spark, sf_dir).where(F.col("modification_time") >= CUT_OFF)


def upsert_releases(spark, sf_dir):
    cols = ("source_ref", "language", "issue_date", "modification_time", "fetched_at")
    return I.save_releases(_oldest(spark, sf_dir).select(*cols), _batch(spark, sf_dir).select(*cols))


def html_links(spark, sf_dir):
    return I.derived_links(_current(spark, sf_dir))


def links_replaced(spark, sf_dir):
    old = table(spark, sf_dir, "release_links").select("source_ref", "language", "target_ref").distinct()
    return I.replace_links(old, _batch(spark, sf_dir))


def classify_changes(spark, sf_dir):
    known = _oldest(spark, sf_dir).where((F.col("language") == "EN") & (F.col("modification_time") < CUT_OFF))
    return I.classify_changes(_current(spark, sf_dir).where("language = 'EN'"), known)


def loose_extractions(spark, sf_dir):
    """Extractions of releases that are not stored."""
    return I.without_release(table(spark, sf_dir, "extractions"), table(spark, sf_dir, "releases")).select("source_ref", "language", "extracted_at").distinct()


def _failed(spark, sf_dir):
    return I.invalid_json(table(spark, sf_dir, "extractions"), "extraction_json")


def worklist(spark, sf_dir):
    done = table(spark, sf_dir, "extractions").where(F.try_parse_json("extraction_json").isNotNull())
    return I.pending(_current(spark, sf_dir), done, _failed(spark, sf_dir), VERSION, MODEL)


def worklist_all(spark, sf_dir):
    """All work with failures retried and done work forced."""
    done = table(spark, sf_dir, "extractions")
    return I.pending(_current(spark, sf_dir), done, _failed(spark, sf_dir), VERSION, MODEL, force=True, retry_failures=True)


def worklist_skipped(spark, sf_dir):
    now = cut(_current(spark, sf_dir).select("source_ref", "language", "issue_date"))
    return I.skipped(now, cut(worklist(spark, sf_dir)), 40)


def current_extractions(spark, sf_dir):
    rows = I.valid_extractions(_current(spark, sf_dir), table(spark, sf_dir, "extractions"), VERSION, MODEL, "EN")
    return rows.select("source_ref", "issue_date", F.length("extraction_json").alias("n")).distinct()


def invalid_json(spark, sf_dir):
    return _failed(spark, sf_dir).select("source_ref", "language", "extracted_at").distinct()


def release_text(spark, sf_dir):
    rows = _current(spark, sf_dir)
    return rows.select(*KEYS, source_text(F.get_json_object("raw_json", "$.title"), html_text(F.get_json_object("raw_json", "$.html"))).alias("text"))


def evidence_repair(spark, sf_dir):
    rows = table(spark, sf_dir, "mentions").select("mention_id", F.lower("evidence.quote").alias("quote"), F.concat("evidence.quote", F.lit(" / "), "name", F.lit(" / "), "description").alias("source")).distinct()
    return check_quotes(rows).select("mention_id", "repaired", "grounded")


def evidence_check(spark, sf_dir):
    rows = table(spark, sf_dir, "mentions").select("mention_id", *KEYS, F.col("evidence.quote").alias("quote")).distinct()
    return check_quotes(rows.join(release_text(spark, sf_dir).withColumnRenamed("text", "source"), list(KEYS))).select("mention_id", "repaired", "grounded")


def _records(spark, sf_dir):
    return current_rows(table(spark, sf_dir, "extractions"), KEYS, ("extracted_at",), ("source_modification_time", "extraction_json"))


def _typed(spark, sf_dir):
    """Current extractions with their typed record, however it is wrapped."""
    return _records(spark, sf_dir).select(*KEYS, "extraction_json", read_record(F.col("extraction_json")).alias("x"))


def validate_rules(spark, sf_dir):
    rows = _typed(spark, sf_dir).withColumn("rules", F.when(F.col("x").isNotNull(), violations(F.col("x"))))
    return rows.select(*KEYS, F.explode("rules").alias("rule"))


def unknown_record_fields(spark, sf_dir):
    return _records(spark, sf_dir).select(*KEYS, F.explode(unknown_fields(unwrapped(F.col("extraction_json")))).alias("field"))


def _grounded(spark, sf_dir):
    joined = _typed(spark, sf_dir).where("x is not null").join(release_text(spark, sf_dir), list(KEYS))
    return joined.select(*KEYS, "text", "x", ground(F.col("x"), F.col("text")).alias("g"))


def ground_records(spark, sf_dir):
    """Per record: quotes, quotes changed to the source's spelling, periods dropped, and the first quote the source does not have."""
    period = lambda r: F.size(F.filter(F.concat(*[F.transform(F.coalesce(r[n], F.array()), lambda x: x["period"]) for n in ("relationships", "risks", "actions")]), lambda p: p.isNotNull()))
    x, g = F.col("x"), F.col("g")
    return _grounded(spark, sf_dir).select(
        *KEYS, F.size(quotes(x)).cast("long").alias("n_quotes"), (period(x) - period(g)).cast("long").alias("dropped_periods"),
        F.size(F.array_except(quotes(g), quotes(x))).cast("long").alias("repaired"), first_missing_quote(g, F.col("text")).alias("missing"),
    )


def missing_quotes(spark, sf_dir):
    return ground_records(spark, sf_dir).where("missing is not null").select(*KEYS, F.col("missing").alias("quote"))


def _stub(doc: dict) -> tuple[dict, str, dict]:
    """An extractor without a model: one organisation, quoted from the title; documents whose title has an odd length are refused."""
    if len(doc["title"]) % 2:
        raise ValueError("an odd title")
    quote = {"quote": doc["title"]}
    mention = {"id": "mention_1", "type": "organization", "name": doc["title"][:40], "relevance": "primary", "involvement": ["authority"], "description": "Named in the title.", "evidence": quote}
    return {"mentions": [mention]}, "run-" + doc["reference"], {"requests": 1}


def extraction_run(spark, sf_dir):
    """Work list to extractions and failures with a stub extractor: status and error type of every EN release."""
    done = extract(_current(spark, sf_dir).where("language = 'EN'"), _stub, VERSION, MODEL, workers=8)
    good = done.extractions.select("source_ref", F.lit("extracted").alias("status"), F.lit(None).cast("string").alias("error_type"))
    return good.unionByName(done.failures.select("source_ref", F.lit("failed").alias("status"), "error_type"))


def entity_ids_all(spark, sf_dir):
    rows = table(spark, sf_dir, "entity_register")
    return rows.select("entity_id", entity_id(F.col("type"), F.col("name"), F.lit("16PR1"), F.lit("mention_1"), normalize_name(F.col("name"))).alias("id"))


def entity_ids(spark, sf_dir):
    """The ids of plain ASCII names, the part of ``entity_ids_all`` that SQL can follow."""
    plain = table(spark, sf_dir, "entity_register").where(F.col("name").rlike(r"^[\x20-\x7E]+$")).select("entity_id")
    return entity_ids_all(spark, sf_dir).join(plain.distinct(), "entity_id", "left_semi")


def _projected(spark, sf_dir, newest=None):
    now = _current(spark, sf_dir).where("language = 'EN'").select("source_ref", "issue_date", "raw_json")
    return projection(_records(spark, sf_dir).where("language = 'EN'").select("source_ref", "extraction_json").join(now, "source_ref"), table(spark, sf_dir, "release_links"), newest=newest)


def project_nodes(spark, sf_dir):
    return _projected(spark, sf_dir).nodes().select("node_ord", "id", "label", "kind", F.size("releaseRefs").alias("n_refs"), F.size("facts").alias("n_facts"))


def project_links(spark, sf_dir):
    return _projected(spark, sf_dir).links("source", "target", "kind", "family")


def projected_metrics(spark, sf_dir):
    """Degree, component, core number and PageRank of the graph projected from the extractions."""
    return M.structure(cut(_projected(spark, sf_dir).topology())).withColumn("pagerank", F.round("pagerank", 7))


def projected_overview(spark, sf_dir):
    """The newest releases of the projected graph and what they mainly name. Labels and places of these nodes are those of the newest releases' own records."""
    p = _projected(spark, sf_dir, Q.OVERVIEW_RELEASES)
    named = cut(p.claimed.where(F.col("kind").isin("primary_mention", "reports", "asserts")).select(F.col("target").alias("id")).unionByName(p.releases.select(F.concat(F.lit("release:"), "ref").alias("id"))).distinct())
    return p.labels().join(named, "id", "left_semi").select("node_ord", "id", "label", "kind")


def ordered_merge(spark, sf_dir):
    """Nodes named once per order line: the first label counts, refs are appended in order."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.min("l_partkey").alias("p"))
    at = F.struct(F.col("l_orderkey").alias("r"), F.lit(0).alias("section"), F.lit(0).alias("item"), F.lit(0).alias("step"), F.lit(0).alias("sub"))
    nil = F.from_json(F.lit("{}"), "map<string,array<string>>")
    candidates = rows.select(at.alias("at"), F.concat(F.lit("s"), "l_suppkey").alias("id"), F.col("p").cast("string").alias("label"), F.lit("organization").alias("kind"), F.lit("").alias("summary"), F.col("l_orderkey").cast("string").alias("ref"), nil.alias("facets"), F.array().cast("array<struct<name:string,value:string,evidence:string,releaseRef:string>>").alias("facts"))
    return merge(candidates).select("id", "label", F.array_join("releaseRefs", ",").alias("refs"))


def request_budget(spark, sf_dir):
    return apply_budget(table(spark, sf_dir, "events"), limit=2, window_ms=6 * 3_600_000)


def queries() -> dict:
    own = (releases_scan, release_versions, links_scan, upsert_releases, html_links, links_replaced, classify_changes, loose_extractions, worklist, worklist_all, worklist_skipped, current_extractions, invalid_json, release_text, evidence_repair, evidence_check, validate_rules, unknown_record_fields, ground_records, missing_quotes, extraction_run, entity_ids, entity_ids_all, project_nodes, project_links, projected_metrics, projected_overview, ordered_merge, request_budget)
    return {f.__name__: f for f in own}


_NOW = """WITH RECURSIVE ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_ref, language ORDER BY modification_time DESC, fetched_at DESC) AS rn,
    row_number() OVER (PARTITION BY source_ref, language ORDER BY modification_time, fetched_at) AS first FROM releases
), now AS (SELECT * FROM ranked WHERE rn = 1), old AS (SELECT * FROM ranked WHERE first = 1), linked AS (
  SELECT source_ref, language, unnest(list_distinct(list_transform(regexp_extract_all(raw_json ->> '$.html', '[?&](?:refNo|refno|REFNO|RefNo)=([0-9]{2}[Pp][Rr][0-9]+)', 1), lambda x: upper(x)))) AS target_ref FROM now
)"""
_DONE = "e.schema_version = 10 AND e.model = 'extractor-large' AND e.source_ref = n.source_ref AND e.language = n.language AND e.source_modification_time = n.modification_time"
_TODO = f", todo AS (SELECT source_ref, language, issue_date, modification_time FROM now n WHERE NOT EXISTS (SELECT 1 FROM extractions e WHERE {_DONE}))"


def oracle_sql() -> dict[str, str]:
    return {
        "releases_scan": _NOW + " SELECT source_ref, issue_date FROM now WHERE language = 'ZH'",
        "release_versions": _NOW + " SELECT source_ref, issue_date, modification_time FROM now WHERE language = 'EN'",
        "links_scan": "SELECT DISTINCT source_ref, target_ref FROM release_links l WHERE language = 'EN' AND EXISTS (SELECT 1 FROM releases r WHERE r.source_ref = l.source_ref AND r.language = l.language)",
        "upsert_releases": _NOW + " SELECT source_ref, language, issue_date, modification_time, fetched_at FROM now WHERE modification_time >= '2021-01-01' UNION ALL SELECT source_ref, language, issue_date, modification_time, fetched_at FROM old o WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.modification_time >= '2021-01-01' AND n.source_ref = o.source_ref AND n.language = o.language)",
        "html_links": _NOW + " SELECT source_ref, language, target_ref FROM linked WHERE target_ref <> source_ref",
        "links_replaced": _NOW + " SELECT source_ref, language, target_ref FROM linked l WHERE target_ref <> source_ref AND EXISTS (SELECT 1 FROM now n WHERE n.modification_time >= '2021-01-01' AND n.source_ref = l.source_ref AND n.language = l.language) UNION ALL (SELECT DISTINCT source_ref, language, target_ref FROM release_links l WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.modification_time >= '2021-01-01' AND n.source_ref = l.source_ref AND n.language = l.language))",
        "classify_changes": _NOW + " SELECT n.source_ref, n.issue_date, n.modification_time, CASE WHEN o.source_ref IS NULL THEN 'added' WHEN o.issue_date = n.issue_date AND o.modification_time = n.modification_time THEN 'unchanged' ELSE 'updated' END AS status FROM now n LEFT JOIN old o ON o.source_ref = n.source_ref AND o.language = 'EN' AND o.modification_time < '2021-01-01' WHERE n.language = 'EN'",
        "worklist": _NOW + _TODO + " SELECT * FROM todo",
        "worklist_all": _NOW + " SELECT source_ref, language, issue_date, modification_time FROM now",
        "loose_extractions": "SELECT DISTINCT source_ref, language, extracted_at FROM extractions e WHERE NOT EXISTS (SELECT 1 FROM releases r WHERE r.source_ref = e.source_ref AND r.language = e.language)",
        "extraction_run": _NOW + " SELECT source_ref, CASE WHEN length(trim(raw_json ->> '$.title')) % 2 = 0 THEN 'extracted' ELSE 'failed' END AS status, CASE WHEN length(trim(raw_json ->> '$.title')) % 2 = 1 THEN 'ValueError' END AS error_type FROM now WHERE language = 'EN'",
        "worklist_skipped": _NOW + _TODO + ", stop AS (SELECT issue_date, source_ref FROM todo ORDER BY issue_date DESC, source_ref DESC LIMIT 1 OFFSET 40) SELECT source_ref, language, issue_date FROM now n WHERE NOT EXISTS (SELECT 1 FROM todo t WHERE t.source_ref = n.source_ref AND t.language = n.language) AND (n.issue_date, n.source_ref) > (SELECT (issue_date, source_ref) FROM stop)",
        "current_extractions": _NOW + f" SELECT DISTINCT n.source_ref, n.issue_date, CAST(length(e.extraction_json) AS INT) AS n FROM now n JOIN extractions e ON {_DONE} WHERE n.language = 'EN'",
        "invalid_json": "SELECT DISTINCT source_ref, language, extracted_at FROM extractions WHERE NOT json_valid(extraction_json)",
        "evidence_repair": """WITH q AS (SELECT DISTINCT mention_id, lower(evidence.quote) AS quote, evidence.quote || ' / ' || name || ' / ' || description AS source FROM mentions), r AS (
  SELECT *, CASE WHEN length(quote) > 0 AND (length(source) - length(replace(lower(source), quote, ''))) / length(quote) = 1 THEN substr(source, position(quote IN lower(source)), length(quote)) ELSE quote END AS repaired FROM q)
SELECT mention_id, repaired, contains(source, repaired) AS grounded FROM r""",
        "entity_ids": "SELECT entity_id, 'entity:' || type || ':' || substr(sha256(type || chr(0) || lower(name)), 1, 16) AS id FROM entity_register WHERE regexp_full_match(name, '[ -~]+')",
        "ordered_merge": "WITH c AS (SELECT l_orderkey AS o, l_suppkey AS s, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT 's' || s AS id, CAST(arg_min(p, o) AS VARCHAR) AS label, string_agg(CAST(o AS VARCHAR), ',' ORDER BY o) AS refs FROM c GROUP BY s",
        "request_budget": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), fold AS (
  SELECT user_id, event_id, ms, i, CASE WHEN ms >= 21600000 THEN ms ELSE 0 END AS start, 1 AS n, true AS allowed, CAST(0 AS BIGINT) AS retry_after FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.ms, e.i, CASE WHEN e.ms - f.start >= 21600000 THEN e.ms ELSE f.start END,
    CASE WHEN e.ms - f.start >= 21600000 THEN 1 WHEN f.n >= 2 THEN f.n ELSE f.n + 1 END,
    e.ms - f.start >= 21600000 OR f.n < 2, CASE WHEN e.ms - f.start >= 21600000 OR f.n < 2 THEN 0 ELSE CAST(ceil((f.start + 21600000 - e.ms) / 1000.0) AS BIGINT) END
  FROM fold f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, allowed, retry_after FROM fold""",
    }
