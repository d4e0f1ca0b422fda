"""The plan hierarchy: depth and specificity, and the anchoring of sources to plans."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions import packs
from planweave.session import cut

#: Plan names and sources meet on so many signs.
GRAM = 6


def plan_nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(packs.PLANS, "name string, level string")


def plan_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(packs.PLAN_EDGES, "child string, parent string")


def depths(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(name, depth)``: edges from each node up to the nearest root, 0 for a root, null for a node without a way.

    Level by level from the roots, each level one join; nodes reached are left out of further levels, so cycles end.
    """
    reached = roots.select("name").distinct().withColumn("depth", F.lit(0))
    front = reached
    for d in count(1):
        below = edges.join(front.select(F.col("name").alias("parent")), "parent").select(F.col("child").alias("name")).distinct()
        front = cut(below.join(reached.select("name"), "name", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
        if d % 16 == 0:  # else the plan grows with the depth
            reached = cut(reached)
    return nodes.select("name").distinct().join(reached, "name", "left")


def specificity(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``(name, depth, specificity)``, the specificity being the depth over the largest, most specific first; null where there is no way to a root."""
    known = cut(depths(nodes, edges, roots))
    most = known.agg(F.max("depth")).first()[0]
    return known.select("name", "depth", F.round(F.try_divide(F.col("depth"), F.lit(most)), 6).alias("specificity")).orderBy(F.desc_nulls_last("specificity"), "name")


def anchor(sources: DataFrame, plans: DataFrame, name: str = "source_name") -> DataFrame:
    """``(source_name, plan)`` for each distinct source whose name contains a plan's name.

    Both sides meet on the first GRAM signs of the plan's name, or all of a shorter one, at every place of the
    source's name, and only those that meet are tested.
    """
    distinct = sources.select(F.col(name).alias("source_name")).where("source_name is not null").distinct()
    known = plans.select(F.col("name").alias("plan")).where("plan <> ''").distinct()
    grams = distinct.where("source_name <> ''").select("source_name", F.explode(F.transform(F.sequence(F.lit(1), F.length("source_name")), lambda i: F.substring("source_name", i, F.lit(GRAM)))).alias("g"))
    starts = known.withColumn("g", F.substring("plan", 1, GRAM)).withColumn("n", F.length("g"))
    lengths = F.sequence(F.lit(1), F.least(F.length("g"), F.lit(GRAM)))
    heads = grams.select("source_name", F.explode(F.transform(lengths, lambda k: F.substring("g", F.lit(1), k))).alias("g")).distinct()
    return heads.join(starts, "g").where(F.col("source_name").contains(F.col("plan"))).select("source_name", "plan").distinct()


def anchor_edges(nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """Edges from every entity node to each plan whose name its source contains; sources are matched once each."""
    some = nodes.where(~F.col("label").isin(packs.PLAN_LABEL, packs.TYPE_LABEL) & F.col("source_name").isNotNull())
    found = anchor(some, plans)
    return some.join(found, "source_name").select(
        F.col("label").alias("src_label"), F.col("name").alias("src_name"), F.col("source_name").alias("src_source"), F.lit(packs.OF_SOURCE).alias("type"), F.lit(packs.PLAN_LABEL).alias("dst_label"), F.col("plan").alias("dst_name"), F.lit("").alias("dst_source")
    )


def plan_graph(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """The hierarchy as nodes and edges of the property graph."""
    nodes = plan_nodes(spark).select(F.lit(packs.PLAN_LABEL).alias("label"), "name", F.lit("").alias("source_name"), F.col("level").alias("description"))
    side = lambda end, c: [F.lit(packs.PLAN_LABEL).alias(f"{end}_label"), F.col(c).alias(f"{end}_name"), F.lit("").alias(f"{end}_source")]
    return nodes, plan_edges(spark).select(*side("src", "child"), F.lit(packs.SUB_PLAN).alias("type"), *side("dst", "parent"))
