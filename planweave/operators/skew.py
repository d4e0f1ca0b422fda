"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys can be hot.
HOT_SHARE = 0.001
#: Below this many rows a key is never worth separate treatment.
HOT_ROWS = 100_000


def hot_threshold(total_rows: int, share: float = HOT_SHARE, least: int = HOT_ROWS) -> int:
    return max(least, int(total_rows * share))


def lookup(rows: DataFrame, values: DataFrame, key: str, count: str, total_rows: int, most: int, share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``values`` (one row per ``key``) that no hot key can unbalance.

    ``count`` is the column of ``values`` with the number of rows of a key, ``total_rows`` the number of all
    rows and ``most`` the largest count. Keys above the threshold, at most ``1 / share`` of them whatever the
    size of the data, are looked up in a broadcast of just those keys; all others take the shuffled join.
    """
    limit = hot_threshold(total_rows, share, least)
    values_only = values.drop(count)
    if most <= limit:
        return rows.join(values_only, key)
    hot = values.where(F.col(count) > limit).drop(count)
    through_broadcast = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return through_broadcast.unionByName(rest.join(values.where(F.col(count) <= limit).drop(count), key))


def lookup_counted(rows: DataFrame, values: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = HOT_ROWS) -> DataFrame:
    """Inner join of ``rows`` with ``values``, a bounded number of rows per key, when nobody has counted the rows of a key yet.

    The count is an aggregate with a partial step before its shuffle. At most ``1 / share`` keys are hot, and only
    their values are broadcast.
    """
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"))
    total, most = counts.agg(F.sum("n_"), F.max("n_")).first()
    limit = hot_threshold(total or 0, share, least)
    if (most or 0) <= limit:
        return rows.join(values, keys)
    hot = F.broadcast(counts.where(F.col("n_") > limit).select(*keys))
    return rows.join(F.broadcast(values.join(hot, keys, "left_semi")), keys).unionByName(rows.join(hot, keys, "left_anti").join(values, keys))
