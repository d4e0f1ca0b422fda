"""Alias maps from vectors: neighbours within a block, components, and clusters around an anchor."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from planweave.config import DEFAULT
from planweave.functions.vectors import as_double, dot, norm, normalized
from planweave.operators.skew import hot_threshold, lookup
from planweave.session import cut, cut_measured, measured

#: Rows of a block that meet in one task; a larger block is cut into tiles and pairs of tiles.
TILE = 2048


def neighbours(vectors: DataFrame, block: str, key: str, vector: str, threshold: float = DEFAULT.alias_similarity, k: int = DEFAULT.neighbours, tile: int = TILE) -> DataFrame:
    """``(block, a, b, sim)``: for each row its at most ``k`` nearest rows of the block, itself among those counted, that are nearer than ``threshold``.

    Exact inner products of unit vectors. A block of any size is cut into tiles by hash; each pair of tiles is one
    bounded matrix product, and only the ``k`` best of a row in each tile leave it. Ties go to the smaller key.
    """
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(block).alias("block"), F.col(key).alias("key"), normalized(F.col(vector)).alias("v"))
    counts = rows.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiled = cut(rows.join(counts, "block").withColumn("tile", F.pmod(F.xxhash64("key"), F.col("tiles"))))
    left = tiled.select("block", F.col("tile").alias("x"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("y"), F.lit(0).alias("side"), "key", "v")
    right = tiled.select("block", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("x"), F.col("tile").alias("y"), F.lit(1).alias("side"), "key", "v")

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf["side"] == 0].sort_values("key"), pdf[pdf["side"] == 1].sort_values("key")
        if a.empty or b.empty:
            return pd.DataFrame({"block": [], "a": [], "b": [], "sim": []})
        n = max(map(len, pdf["v"]))
        pad = lambda part: np.array([list(v) + [0.0] * (n - len(v)) for v in part["v"]])
        sims = pad(a) @ pad(b).T
        best = np.argsort(-sims, axis=1, kind="stable")[:, :k]
        at = np.repeat(np.arange(len(a)), best.shape[1])
        to = best.ravel()
        return pd.DataFrame({"block": pdf["block"].iloc[0], "a": a["key"].to_numpy()[at], "b": b["key"].to_numpy()[to], "sim": sims[at, to]})

    schema = f"block {dict(rows.dtypes)['block']}, a {dict(rows.dtypes)['key']}, b {dict(rows.dtypes)['key']}, sim double"
    near = left.unionByName(right).groupBy("block", "x", "y").applyInPandas(product, schema)
    order = Window.partitionBy("block", "a").orderBy(F.desc("sim"), "b")
    top = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    return top.where((F.col("a") != F.col("b")) & (F.col("sim") > threshold)).select("block", "a", "b", "sim")


def edges(near: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """``(block, a, b, sim)`` in both directions, once each; pairs of equal names, by ``names`` (key, name), are left out."""
    both = near.unionByName(near.select("block", F.col("b").alias("a"), F.col("a").alias("b"), "sim")).groupBy("block", "a", "b").agg(F.max("sim").alias("sim"))
    if names is None:
        return both
    with_names = both.join(names.select(F.col("key").alias("a"), F.col("name").alias("na")), "a").join(names.select(F.col("key").alias("b"), F.col("name").alias("nb")), "b")
    return with_names.where("na <> nb").select("block", "a", "b", "sim")


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """``(key, component)``, the component being its smallest key, by alternating large-star and small-star.

    (Kiveris et al., Connected Components in MapReduce and Beyond.) Every round is written to the checkpoint folder,
    and a vertex with a large share of all links is looked up apart.
    """
    marks = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    now, before = cut_measured(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), *marks)
    ends = now.select(F.explode(F.array("u", "v")).alias("u")).groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    most = {True: ends.agg(F.max("n")).first()[0] or 0, False: 0}
    kept: list[DataFrame] = []

    def star(pairs: DataFrame, large: bool, counted: Observation) -> DataFrame:
        """One half of a round. The largest vertex of the round before tells whether there are hot ones; if so they are counted anew and looked up apart."""
        seen = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
        least = seen.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        if (most[large] or 0) > hot_threshold(2 * (before["n"] or 0)):
            least = least.persist(StorageLevel.MEMORY_AND_DISK)
            kept.append(least)
            total, most[large] = least.agg(F.sum("n"), F.max("n")).first()
            joined = lookup(seen, least, "u", "n", total or 0, most[large] or 0)
        else:
            joined = seen.join(least.observe(counted, F.max("n").alias("most")).drop("n"), "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    for _ in range(max_rounds):
        counted = {large: Observation() for large in (True, False)}
        now, after = cut_measured(star(star(now, True, counted[True]), False, counted[False]), *marks)
        if kept:
            while kept:
                kept.pop().unpersist()
        elif before["n"]:
            # without word from the job the next round counts for itself
            most = {large: (measured(counted[large]) or {"most": sys.maxsize})["most"] or 0 for large in (True, False)}
        if after == before:
            leaves = now.select(F.col("u").alias("key"), F.col("v").alias("component"))
            roots = now.select(F.col("v").alias("key"), F.col("v").alias("component")).distinct()
            return leaves.unionByName(roots)
        before = after
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def alias_map(vectors: DataFrame, block: str, key: str, name: str, vector: str, threshold: float = DEFAULT.alias_similarity, k: int = DEFAULT.neighbours) -> DataFrame:
    """``(block, alias, canonical)``: names near the anchor of their component.

    The anchor is the member with most neighbours, of those the shortest name, of those the last in order. Members
    no nearer to it than ``threshold`` are left out, and a component of which only the anchor is left says nothing.
    """
    rows = vectors.where(F.length(F.trim(name)) > 0).select(F.col(block).alias("block"), F.col(key).alias("key"), F.col(name).alias("name"), normalized(F.col(vector)).alias("v"))
    linked = cut(edges(neighbours(rows, "block", "key", "v", threshold, k), rows.select("key", "name")))
    degree = linked.groupBy(F.col("a").alias("key")).agg(F.count_distinct("b").alias("degree"))
    members = components(linked).join(degree, "key").join(rows, "key")
    rank = F.struct("degree", -F.length("name"), "name", "key")
    anchors = members.groupBy("component").agg(F.max_by(F.struct("key", "name", "v"), rank).alias("anchor"))
    joined = members.join(anchors, "component").where(F.col("key") != F.col("anchor.key"))
    kept = joined.where((dot(F.col("v"), F.col("anchor.v")) > threshold) & (F.col("name") != F.col("anchor.name")))
    return kept.groupBy("block", F.col("name").alias("alias")).agg(F.max_by("anchor.name", "component").alias("canonical"))


def embedding_stats(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(key, dim, norm_l2)``; a null vector has no dimension and a length of 0."""
    v = F.coalesce(as_double(F.col(vector)), F.array().cast("array<double>"))
    return vectors.select(key, F.size(v).alias("dim"), F.round(norm(v), 6).alias("norm_l2"))


def embed(rows: DataFrame, text: str, provider, batch: int = DEFAULT.embedding_batch) -> DataFrame:
    """Adds ``embedding`` and ``norm_l2`` from a provider's ``embed(list) -> list of vectors``, ``batch`` texts a call; blank texts are left out."""
    some = rows.where(F.length(F.trim(text)) > 0)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = []
            for k in range(0, len(pdf), batch):
                part = list(pdf[text].iloc[k : k + batch])
                got = list(provider.embed(part))
                out += got + [[]] * (len(part) - len(got))
            yield pdf.assign(embedding=[[float(x) for x in v] for v in out])

    return some.mapInPandas(run, fields + ", embedding array<double>").withColumn("norm_l2", norm(F.col("embedding")))


def records_of(embedded: DataFrame, key: str, text: str, model: str, source: list[str]) -> DataFrame:
    """``(id, text, embedding, model, dim, norm_l2, source)`` of rows that have their ``embedding`` already."""
    return embedded.select(F.col(key).alias("id"), F.col(text).alias("text"), "embedding", F.lit(model).alias("model"), F.size("embedding").alias("dim"), "norm_l2", F.struct(*source).alias("source"))


def embedding_records(rows: DataFrame, key: str, text: str, provider, model: str, source: list[str], batch: int = DEFAULT.embedding_batch) -> DataFrame:
    """``(id, text, embedding, model, dim, norm_l2, source)`` ready to be written as parquet or JSON lines; ``source`` names the columns of the nested struct."""
    done = embed(rows.select(F.col(key).alias("id"), F.col(text).alias("text"), F.struct(*source).alias("source")), "text", provider, batch)
    return done.select("id", "text", "embedding", F.lit(model).alias("model"), F.size("embedding").alias("dim"), "norm_l2", "source")
