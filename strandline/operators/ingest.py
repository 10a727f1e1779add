"""Versioned release storage: upsert, change classification, work lists and current records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.text import release_links
from strandline.operators.current import current_rows

RELEASE = ("source_ref", "language")
EXTRACTION = ("source_ref", "language", "source_modification_time", "schema_version", "model")


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with equal keys. Of equal keys in one batch the one greatest by ``order`` (columns of ``new``), then the greatest row, wins.

    Keys and rows are combined on the map side; nothing is sorted per key.
    """
    cols = old.columns
    rest = [c for c in cols if c not in keys]
    rank = new.select(*cols, F.struct(*order).alias("_o") if order else F.lit(0).alias("_o"), F.struct(*rest).alias("_t"))
    fresh = current_rows(rank, keys, ("_o", "_t"), ()).select(*keys, *[F.col(f"_t.{c}").alias(c) for c in rest])
    return old.join(fresh.select(*keys), list(keys), "left_anti").unionByName(fresh)


def save_releases(old: DataFrame, new: DataFrame, order: tuple[str, ...] = ()) -> DataFrame:
    """Releases with a batch saved: languages are kept in upper case."""
    return upsert(old, new.withColumn("language", F.upper("language")), RELEASE, order)


def derived_links(releases: DataFrame) -> DataFrame:
    """source_ref, language, target_ref of the releases linked in the markup of each release."""
    rows = releases.select(*RELEASE, F.get_json_object("raw_json", "$.html").alias("html"))
    return rows.select(*RELEASE, F.explode(release_links(F.col("html"), F.col("source_ref"))).alias("target_ref"))


def replace_links(links: DataFrame, upserted: DataFrame) -> DataFrame:
    """Links with those of the upserted releases rebuilt from their markup."""
    kept = links.select(*RELEASE, "target_ref").join(upserted.select(*RELEASE).distinct(), list(RELEASE), "left_anti")
    return kept.unionByName(derived_links(upserted))


def classify_changes(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Every listed ref with its status: added, updated or unchanged, by issue date and modification time. ``known`` has one language; of a ref given twice the greatest version counts."""
    version = F.struct(F.col("modification_time").alias("m"), F.col("issue_date").alias("i"))
    seen = known.groupBy("source_ref").agg(F.max(version).alias("_v"))
    same = (F.col("_v.i") == F.col("issue_date")) & (F.col("_v.m") == F.col("modification_time"))
    status = F.when(F.col("_v").isNull(), "added").when(same, "unchanged").otherwise("updated")
    return listing.join(seen, "source_ref", "left").select("source_ref", "issue_date", "modification_time", status.alias("status"))


def scan(releases: DataFrame, language: str, refs: tuple[str, ...] = ()) -> DataFrame:
    """Releases of a language, newest first; only those of ``refs`` if there are any."""
    rows = releases.where(F.col("language") == language.upper())
    rows = rows.where(F.col("source_ref").isin(*refs)) if refs else rows
    return rows.orderBy(F.desc("issue_date"), F.desc("source_ref"))


def versions(releases: DataFrame, language: str) -> DataFrame:
    """source_ref, issue_date, modification_time of a language's releases."""
    return releases.where(F.col("language") == language.upper()).select("source_ref", "issue_date", "modification_time")


def links_of(links: DataFrame, known: DataFrame, language: str) -> DataFrame:
    """Links of the known releases (source_ref), in order of source and target."""
    rows = links.where(F.col("language") == language.upper()).select("source_ref", "target_ref").distinct()
    return rows.join(known.select("source_ref").distinct(), "source_ref", "left_semi").orderBy("source_ref", "target_ref")


def pending(releases: DataFrame, extractions: DataFrame, failures: DataFrame, version: int, model: str, force: bool = False, retry_failures: bool = False, limit: int | None = None) -> DataFrame:
    """Releases that still need an extraction, newest first. ``force`` redoes current ones, but does not lift the skipping of failures."""
    key = list(EXTRACTION)
    rows = releases.withColumn("source_modification_time", F.col("modification_time")).withColumn("schema_version", F.lit(version)).withColumn("model", F.lit(model))
    if not force:
        rows = rows.join(extractions.select(*key).distinct(), key, "left_anti")
    if not retry_failures:
        rows = rows.join(failures.select(*key).distinct(), key, "left_anti")
    rows = rows.select("source_ref", "language", "issue_date", "modification_time").orderBy(F.desc("issue_date"), F.desc("source_ref"))
    return rows if limit is None else rows.limit(limit)


def skipped(releases: DataFrame, todo: DataFrame, limit: int | None = None) -> DataFrame:
    """Releases passed over before the limit was reached, newest first; all others without one. ``todo`` is the unlimited work list."""
    passed = releases.join(todo, ["source_ref", "language"], "left_anti").select("source_ref", "language", "issue_date")
    if limit is None:
        return passed
    last = todo.orderBy(F.desc("issue_date"), F.desc("source_ref")).limit(limit + 1).collect()
    if len(last) <= limit:
        return passed
    stop = last[-1]
    return passed.where((F.col("issue_date") > stop["issue_date"]) | ((F.col("issue_date") == stop["issue_date"]) & (F.col("source_ref") > stop["source_ref"])))


def valid_extractions(releases: DataFrame, extractions: DataFrame, version: int, model: str, language: str) -> DataFrame:
    """Extractions made by this version and model from the release as it now stands."""
    now = releases.where(F.col("language") == language).select("source_ref", "language", "issue_date", F.col("modification_time").alias("source_modification_time"), "raw_json")
    own = extractions.where((F.col("schema_version") == version) & (F.col("model") == model) & (F.col("language") == language))
    return own.join(now, ["source_ref", "language", "source_modification_time"])


def invalid_json(df: DataFrame, column: str) -> DataFrame:
    """Rows whose JSON can't be read."""
    return df.where(F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def without_release(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """Rows of a table whose release (source_ref, language) does not exist."""
    return rows.join(releases.select(*RELEASE).distinct(), list(RELEASE), "left_anti")
