"""Incremental ingest of release batches into a versioned store of Parquet files.

The store keeps releases and their links in buckets by a hash of the key. A
batch rewrites only the buckets it touches, as a new version beside the old
files; a manifest, written last and put in place by one rename, says which
version of each bucket of both tables counts. A run that stops anywhere leaves
the old manifest in force, and the same batch run again writes the same files.
All file operations go through the file system of the store's address.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.ingest import RELEASE, derived_links, replace_links, save_releases

BUCKETS = 64
SCHEMAS = {
    "releases": "source_ref string, language string, issue_date string, modification_time string, raw_json string, fetched_at string",
    "release_links": "source_ref string, language string, target_ref string",
}


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def _manifest(spark: SparkSession, store: str) -> tuple[int, dict]:
    """Number and content of the manifest in force; -1 and an empty one for a new store."""
    fs, folder = _files(spark, store)
    if not fs.exists(folder):
        return -1, {"buckets": BUCKETS, **{t: {} for t in SCHEMAS}}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    numbers = [int(n.removeprefix("manifest-").removesuffix(".json")) for n in names if n.startswith("manifest-") and n.endswith(".json")]
    if not numbers:
        return -1, {"buckets": BUCKETS, **{t: {} for t in SCHEMAS}}
    text = spark.read.text(f"{store}/manifest-{max(numbers):010}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _put_manifest(spark: SparkSession, store: str, number: int, content: dict) -> None:
    path = f"{store}/manifest-{number:010}.json"
    fs, started = _files(spark, path + ".tmp")
    out = fs.create(started, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    if not fs.rename(started, _files(spark, path)[1]):
        raise RuntimeError(f"{path} is there already: another run has written it")


def _bucket(n: int) -> Column:
    return F.pmod(F.xxhash64(*RELEASE), F.lit(n)).cast("int")


def _read(spark: SparkSession, store: str, manifest: dict, name: str, buckets: set[int] | None = None) -> DataFrame:
    paths = [f"{store}/{name}/v{v:010}/bucket={b}" for b, v in manifest[name].items() if v is not None and (buckets is None or int(b) in buckets)]
    return spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[name])


def read_store(spark: SparkSession, store: str, name: str) -> DataFrame:
    """One table (releases or release_links) as the manifest in force has it."""
    return _read(spark, store, _manifest(spark, store)[1], name)


def merge_batch(batch: DataFrame, store: str, number: int | None = None) -> None:
    """Upsert a batch of releases and rebuild the links of those it touches.

    ``number`` is the batch's own, so that a repeated batch changes nothing.
    An empty batch writes a manifest only.
    """
    spark = batch.sparkSession
    last, manifest = _manifest(spark, store)
    number = last + 1 if number is None else number
    if number <= last:
        return
    n = manifest["buckets"]
    fresh = batch.withColumn("language", F.upper("language")).persist()
    touched = {r["b"] for r in fresh.select(_bucket(n).alias("b")).distinct().collect()}  # at most as many as there are buckets
    releases = save_releases(_read(spark, store, manifest, "releases", touched), fresh)
    # Links follow from the rows that stand after the upsert.
    standing = releases.join(fresh.select(*RELEASE).distinct(), list(RELEASE), "left_semi")
    links = replace_links(_read(spark, store, manifest, "release_links", touched), standing)
    new = {t: dict(manifest[t]) for t in SCHEMAS}
    for name, rows in (("releases", releases), ("release_links", links)):
        target = f"{store}/{name}/v{number:010}"
        rows.withColumn("bucket", _bucket(n)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        fs, folder = _files(spark, target)
        written = {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(folder) if s.getPath().getName().startswith("bucket=")}
        for b in touched:
            new[name][str(b)] = number if b in written else None
    _put_manifest(spark, store, number, {"buckets": n, **new})
    fresh.unpersist()
    _sweep(spark, store, manifest, new)


def _sweep(spark: SparkSession, store: str, before: dict, now: dict) -> None:
    """Delete files that neither the manifest in force nor the one before, which readers may still use, has."""
    for name in SCHEMAS:
        kept = {(v, int(b)) for m in (before, now) for b, v in m[name].items() if v is not None}
        fs, folder = _files(spark, f"{store}/{name}")
        for version in fs.listStatus(folder):
            v = int(version.getPath().getName().removeprefix("v"))
            for part in fs.listStatus(version.getPath()):
                b = part.getPath().getName()
                if b.startswith("bucket=") and (v, int(b.removeprefix("bucket="))) not in kept:
                    fs.delete(part.getPath(), True)


def ingest_stream(stream: DataFrame, store: str, checkpoint: str):
    """Start a query that merges every micro-batch of a release stream into the store."""
    return stream.writeStream.foreachBatch(lambda batch, number: merge_batch(batch, store, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
