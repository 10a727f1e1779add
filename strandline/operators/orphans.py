"""References to records that do not exist, per side, reason and month.

A Bloom filter of the parent keys is built in the executors, gathered as a bit
map of bounded size and broadcast; where the keys are too many for one, the
range of their hash is cut into slices with a filter each, taken in turn. A reference the filter denies is a definite
orphan and never meets the parent table; only the references it lets through
are verified by an exact join. Each distinct reference is settled once and its
finding is handed to its links, so a target named by a third of all links
costs one row on the verifying side.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators.skew import lookup_join
from strandline.session import cut

#: Upper bound of the broadcast bit map: 2^27 bits are 16 MiB.
MAX_BITS = 1 << 27
BITS_PER_KEY = 12
HASHES = 6


def slices(n: int, max_bits: int = MAX_BITS) -> int:
    """Filters of at most ``max_bits`` that ``n`` keys take at ``BITS_PER_KEY`` each."""
    return max(1, -(-n * BITS_PER_KEY // max_bits))


def slice_of(on: Sequence[str], count: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), *on), F.lit(count)).cast("int")


def bloom_bits(keys: DataFrame, on: Sequence[str], n: int, max_bits: int = MAX_BITS) -> np.ndarray:
    """Bit map (as 64-bit words) of a Bloom filter of the rows of ``keys``, about ``n``.

    Word values are or-ed on the map side; the driver gets at most
    ``max_bits / 64`` words.
    """
    bits = min(max_bits, 1 << max(10, math.ceil(math.log2(max(n, 1) * BITS_PER_KEY))))
    h = F.xxhash64(*on)
    places = F.array(*[_place(h, i, bits) for i in range(HASHES)])
    words = (
        keys.select(F.explode(places).alias("p"))
        .groupBy(F.shiftright("p", 6).alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
        .toPandas()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["w"].to_numpy(dtype=np.int64)] = words["v"].to_numpy(dtype=np.int64)
    return out


def probed(refs: DataFrame, keys: DataFrame, on: Sequence[str], max_bits: int = MAX_BITS) -> DataFrame:
    """``refs`` with ``maybe``: false only for those that no row of ``keys`` has."""
    context = refs.sparkSession.sparkContext
    n = keys.count()
    count = slices(n, max_bits)
    if count == 1:
        return refs.withColumn("maybe", maybe_present(on, context.broadcast(bloom_bits(keys, on, n, max_bits))))
    refs, keys = cut(refs.withColumn("_slice", slice_of(on, count))), cut(keys.select(*on).withColumn("_slice", slice_of(on, count)))
    out = None
    for i in range(count):
        words = context.broadcast(bloom_bits(keys.where(F.col("_slice") == i), on, -(-n // count), max_bits))
        part = cut(refs.where(F.col("_slice") == i).drop("_slice").withColumn("maybe", maybe_present(on, words)))
        words.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def _place(h: Column, i: int, bits: int) -> Column:
    """The i-th place of a hash by double hashing, bits being a power of two."""
    low = h.bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned(h, 32)
    return (low + F.lit(i) * (high.bitwiseOR(F.lit(1)))).bitwiseAND(F.lit(bits - 1))


def maybe_present(on: Sequence[str], words) -> Column:
    """True where the broadcast filter can't rule the key out. No false negatives."""
    h = F.xxhash64(*on)

    @F.pandas_udf("boolean")
    def probe(hashes: pd.Series) -> pd.Series:
        bits = len(words.value) * 64
        v = hashes.to_numpy(dtype=np.int64)
        low, high = v & 0xFFFFFFFF, (v.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
        hit = np.ones(len(v), dtype=bool)
        for i in range(HASHES):
            p = (low + i * high) & (bits - 1)
            hit &= (words.value[p >> 6] >> (p & 63)) & 1 == 1
        return pd.Series(hit)

    return probe(h)


def canonical_ref(c: Column | str) -> Column:
    """A ref without outer white space, in upper case; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.upper(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def find_orphans(links: DataFrame, releases: DataFrame, removals: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """side, source_ref, language, target_ref, reason, period of every orphan reference.

    A link is a distinct (source_ref, language, target_ref) in canonical form
    and counts at its earliest recorded_at. Reasons: ``missing`` (no release
    and no removal), ``deleted`` (no release, a removal), ``late`` (the
    earliest fetched_at is after the link was recorded). A null ref or
    language refers to nothing and is no orphan; a link without any
    recorded_at is never late and has a null period; a release without a
    readable fetched_at exists from the start. Empty tables give no rows, or
    with no releases at all every reference as missing or deleted.
    """
    link = links.select(canonical_ref("source_ref").alias("source_ref"), canonical_ref("language").alias("language"), canonical_ref("target_ref").alias("target_ref"), "recorded_at")
    link = cut(link.groupBy("source_ref", "language", "target_ref").agg(F.min("recorded_at").alias("at")))
    parents = cut(
        releases.select(canonical_ref("source_ref").alias("ref"), canonical_ref("language").alias("language"), F.try_to_timestamp("fetched_at").alias("f"))
        .where("ref is not null and language is not null")
        .groupBy("ref", "language")
        .agg(F.min("f").alias("first_seen"))
    )
    gone = removals.select(canonical_ref("source_ref").alias("ref"), canonical_ref("language").alias("language")).where("ref is not null and language is not null").distinct()
    sides = link.select("*", F.explode(F.array(F.lit("source"), F.lit("target"))).alias("side"))
    sides = sides.withColumn("ref", F.when(F.col("side") == "source", F.col("source_ref")).otherwise(F.col("target_ref"))).where("ref is not null and language is not null")
    refs = sides.select("ref", "language").distinct()
    refs = probed(refs, parents.select("ref", "language"), ("ref", "language"), max_bits)
    verified = refs.where("maybe").join(parents.withColumn("exists", F.lit(True)), ["ref", "language"], "left")
    denied = refs.where("not maybe").select("ref", "language", "maybe", F.lit(None).cast("timestamp").alias("first_seen"), F.lit(None).cast("boolean").alias("exists"))
    settled = verified.unionByName(denied).join(gone.withColumn("gone", F.lit(True)), ["ref", "language"], "left")
    settled = settled.select("ref", "language", F.coalesce("exists", F.lit(False)).alias("exists"), "first_seen", F.coalesce("gone", F.lit(False)).alias("gone"))
    found = lookup_join(sides, settled, ["ref", "language"])
    reason = F.when(~F.col("exists") & F.col("gone"), "deleted").when(~F.col("exists"), "missing").when(F.col("first_seen") > F.col("at"), "late")
    return (
        found.withColumn("reason", reason)
        .where("reason is not null")
        .select("side", "source_ref", "language", "target_ref", "reason", F.date_format("at", "yyyy-MM").alias("period"))
    )


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphan references per side, language, reason and month."""
    return orphans.groupBy("side", "language", "reason", "period").agg(F.count(F.lit(1)).alias("n_links"), F.countDistinct(F.when(F.col("side") == "source", F.col("source_ref")).otherwise(F.col("target_ref"))).alias("n_refs"))
