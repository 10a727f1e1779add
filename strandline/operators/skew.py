"""Joins that survive a key holding a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so there are at most 1 / share of them.
HOT_SHARE = 1 / 64
#: Below this many rows a key is never hot.
HOT_ROWS = 100_000


def hot_keys(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE, floor: int = HOT_ROWS) -> list[tuple]:
    """Keys with more than ``share`` of the rows and more than ``floor`` rows: at most 1/share.

    Counts are combined on the map side; only the few hot keys reach the driver.
    """
    counts = df.groupBy(*on).count()
    large = counts.where(F.col("count") > floor).orderBy(F.desc("count")).limit(int(1 / share) + 1).collect()
    if not large:
        return []
    total = df.count()
    return [tuple(r)[:-1] for r in large if r["count"] > share * total]


def lookup_join(df: DataFrame, right: DataFrame, on: Sequence[str], share: float = HOT_SHARE, floor: int = HOT_ROWS, hot: list[tuple] | None = None) -> DataFrame:
    """``df`` left-joined with ``right``, which has one row per ``on``.

    Rows of hot keys meet their (at most 1/share) partner rows in a broadcast
    join; all other rows meet in a plain shuffle join. Null keys match nothing.
    Where ``df`` is joined again and again, its ``hot`` keys can be given.
    """
    hot = hot_keys(df, on, share, floor) if hot is None else hot
    if not hot:
        return df.join(right, list(on), "left")
    spark = df.sparkSession
    few = spark.createDataFrame(hot, df.select(*on).schema)
    flag = few.withColumn("_hot", F.lit(True))
    hot_right = right.join(F.broadcast(few), list(on), "left_semi")
    marked = df.join(F.broadcast(flag), list(on), "left")
    warm = marked.where(F.col("_hot").isNull()).drop("_hot").join(right, list(on), "left")
    cold = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_right), list(on), "left")
    return warm.unionByName(cold)
