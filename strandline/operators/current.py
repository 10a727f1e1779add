"""The current row of each key: greatest ordering columns, copies collapsed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the one whose ``order`` columns are greatest, compared in turn.

    Only a narrow (keys, order, payload hash) projection is aggregated to find
    the winner, so the wide payload crosses the network once, already collapsed
    on the map side, and hashed on keys *and* order: a key that holds a third
    of the rows spreads over its versions.

    Nulls: a null in ``order`` sorts below every value; rows whose key has a
    null form a group of their own, as in GROUP BY. Ties with different
    payloads are broken by the greatest payload hash, so the result is stable.
    Empty input gives empty output; columns not named are dropped.
    """
    cols = [*keys, *order, *payload]
    base = df.select(*cols).withColumn("_h", F.xxhash64(*payload) if payload else F.lit(0))
    rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("s"), F.col(c).alias("v")).alias(c) for c in order], F.col("_h").alias("_h"))
    best = base.groupBy(*keys).agg(F.max(rank).alias("_b"))
    best = best.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        *[F.col(f"_b.{c}.v").alias(f"_o{i}") for i, c in enumerate(order)],
        F.col("_b._h").alias("_bh"),
    )
    versions = base.groupBy(*keys, *order, "_h")
    single = versions.agg(*[F.first(c).alias(c) for c in payload]) if payload else base.distinct()
    on = F.col("_h") == F.col("_bh")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    for i, c in enumerate(order):
        on = on & F.col(c).eqNullSafe(F.col(f"_o{i}"))
    return single.join(best, on, "inner").select(*cols)
