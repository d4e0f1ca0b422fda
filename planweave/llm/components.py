"""Problem 1: consolidating pairwise matches into groups by hash-to-min.

Every vertex keeps a cluster of vertices, at first itself and its neighbours. In each round it sends the whole
cluster to the cluster's smallest member and that member to all others; the clusters received are united. The
rounds end when nothing changes: then the smallest vertex of a component holds the whole component and every
other vertex holds just the smallest one. A cluster is stored as rows ``(v, u)``, never as an array, so a
component of any size stays distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from planweave.operators.skew import lookup
from planweave.session import cut, cut_measured


def _signature() -> list:
    """Aggregates that tell one set of clusters from another."""
    hashed = F.xxhash64("v", "u")
    return [F.count(F.lit(1)).alias("n"), F.sum(F.shiftrightunsigned(hashed, 33)).alias("high"), F.sum(hashed.bitwiseAND(F.lit(0x7FFFFFFF))).alias("low")]


def connected_groups(pairs: DataFrame, left: str, right: str, max_rounds: int = 200) -> DataFrame:
    """``(id, group_id)``: one row for each id that occurs in a pair, ``group_id`` the smallest id of its group.

    Pairs with a null on either side say nothing and are left out; repeated and reversed pairs count once; an
    id matched only with itself is a group of its own; an empty input gives an empty result. Other columns of
    ``pairs``, whatever their names, are ignored.
    """
    known = pairs.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b")).where("a is not null and b is not null")
    edges = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = cut(edges)
    alone = edges.where("a = b").select(F.col("a").alias("v"), F.col("a").alias("u"))
    linked = edges.where("a < b")
    clusters, before = cut_measured(linked.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(linked.select(F.col("b").alias("v"), F.col("a").alias("u"))), *_signature())
    for _ in range(max_rounds):
        least = clusters.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        most = least.agg(F.max("n")).first()[0] or 0
        sent = lookup(clusters, least, "v", "n", before["n"] or 0, most)
        members = sent.where("u <> m").select("m", F.col("u").alias("w"))
        selves = least.where("v <> m").select("m", F.col("v").alias("w"))
        stars = members.unionByName(selves).distinct()
        # m is less than w in every row, so the rows and their reverses are all different
        both = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("w").alias("u")), F.struct(F.col("w").alias("v"), F.col("m").alias("u"))))
        clusters, after = cut_measured(stars.select(both.alias("s")).select("s.*"), *_signature())
        least.unpersist()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    to_least = clusters.where("u < v").select(F.col("v").alias("id"), F.col("u").alias("group_id"))
    roots = to_least.select(F.col("group_id").alias("id"), "group_id")
    lone = alone.select(F.col("v").alias("id"), F.col("u").alias("group_id"))
    return to_least.unionByName(roots).unionByName(lone).groupBy("id").agg(F.min("group_id").alias("group_id"))
