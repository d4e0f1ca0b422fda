"""Vector search: the k nearest rows of a query, and the choice between rules and chunks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planweave.config import DEFAULT
from planweave.functions.vectors import cosine, norm, normalized
from planweave.operators.alias import TILE
from planweave.session import cut


def top_k(rows: DataFrame, vector: str, query: list[float], key: str, k: int) -> DataFrame:
    """The ``k`` rows nearest to ``query`` by cosine, ties to the smaller key, with ``similarity``; the query travels as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("similarity", cosine(F.col(vector), q)).orderBy(F.desc("similarity"), key).limit(k)


def tiered(rules: DataFrame, chunks: DataFrame, vector: str, query: list[float], key: str, k: int, threshold: float = DEFAULT.search_threshold) -> DataFrame:
    """The best rules, or the best chunks if there is no rule at all; ``tier`` says rule (the best is at least ``threshold``), weak_rule or chunk."""
    best = cut(top_k(rules, vector, query, key, k))
    most = best.agg(F.max("similarity")).first()[0]
    if most is None:
        return top_k(chunks, vector, query, key, k).withColumn("tier", F.lit("chunk"))
    return best.withColumn("tier", F.lit("rule" if most >= threshold else "weak_rule"))


def top_k_set(rows: DataFrame, queries: DataFrame, vector: str, key: str, k: int, block: str | None = None, tile: int = TILE) -> DataFrame:
    """``(query, key, similarity)``: for each row of ``queries`` the ``k`` rows nearest by cosine, among all rows or those of its ``block``.

    Exact. Both sides are cut into tiles by hash; each pair of tiles is one bounded matrix product, and only the
    ``k`` best of a query in each tile leave it. Ties, similarities equal to 12 digits, go to the smaller key.
    """
    v = F.col(vector)
    unit = F.when(norm(v) > 0, normalized(v)).otherwise(F.array().cast("array<double>"))
    parted = lambda df: df.where(F.col(key).isNotNull()).select((F.lit(0) if block is None else F.col(block)).alias("block"), F.col(key).alias("key"), unit.alias("v"))
    right, left = parted(rows), parted(queries)
    tiles = lambda df, n: df.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(n))
    counts = tiles(left, "nx").join(tiles(right, "ny"), "block")
    counts = cut(counts) if block is not None else F.broadcast(counts)
    at = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = left.join(counts, "block").select("block", at("nx").alias("x"), every("ny").alias("y"), F.lit(0).alias("side"), "key", "v")
    right = right.join(counts, "block").select("block", every("nx").alias("x"), at("ny").alias("y"), F.lit(1).alias("side"), "key", "v")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0].sort_values("key"), pdf[pdf["side"] == 1].sort_values("key")
        if a.empty or b.empty:
            return pd.DataFrame({"query": [], "key": [], "similarity": []})
        n = max(map(len, pdf["v"]))
        pad = lambda part: np.array([list(v) + [0.0] * (n - len(v)) for v in part["v"]])
        length = lambda part: part["v"].map(len).to_numpy()
        sims = np.where(length(a)[:, None] == length(b), np.round(pad(a) @ pad(b).T, 12), 0.0)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        of = np.repeat(np.arange(len(a)), best.shape[1])
        to = best.ravel()
        return pd.DataFrame({"query": a["key"].to_numpy()[of], "key": b["key"].to_numpy()[to], "similarity": sims[of, to]})

    schema = f"query {dict(left.dtypes)['key']}, key {dict(right.dtypes)['key']}, similarity double"
    near = left.unionByName(right).groupBy("block", "x", "y").applyInPandas(product, schema)
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "key")
    return near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def tiered_set(rules: DataFrame, chunks: DataFrame, queries: DataFrame, vector: str, key: str, k: int, threshold: float = DEFAULT.search_threshold, block: str | None = None) -> DataFrame:
    """``(query, key, similarity, tier)``: ``tiered`` for a set of queries; each gets chunks only if there is no rule at all for it, in its ``block`` if given."""
    best = cut(top_k_set(rules, queries, vector, key, k, block))
    most = F.max("similarity").over(Window.partitionBy("query"))
    found = best.withColumn("tier", F.when(most >= threshold, "rule").otherwise("weak_rule"))
    rest = queries.join(best.select(F.col("query").alias(key)).distinct(), key, "left_anti")
    return found.unionByName(top_k_set(chunks, rest, vector, key, k, block).withColumn("tier", F.lit("chunk")))
