"""Resolution of names inside a document: alias maps, canonical records, remapped relations, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.config import DEFAULT
from planweave.functions import packs
from planweave.functions.text import ustrip
from planweave.operators.chunking import first_wins


def no_strings() -> Column:
    return F.array().cast("array<string>")


def alias_pairs(alias_map: DataFrame) -> DataFrame:
    """``(document_id, alias, canonical)``: one target per alias of a document, the last by ``pair_id``; nulls and self matches are left out."""
    some = alias_map.where("document_id is not null and alias is not null and canonical is not null and alias <> canonical")
    return some.groupBy("document_id", "alias").agg(F.max_by("canonical", "pair_id").alias("canonical"))


def merge_maps(low: DataFrame, high: DataFrame) -> DataFrame:
    """Two alias maps as one; where both have an alias the second decides."""
    both = low.join(high.withColumnRenamed("canonical", "high_"), ["document_id", "alias"], "full_outer")
    return both.select("document_id", "alias", F.coalesce("high_", "canonical").alias("canonical"))


def apply_aliases(entities: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(document_id, name, entity_type, aliases, description, members)``: entities under their canonical name.

    One hop only. Every former name becomes an alias of the canonical entity of its type, and all aliases of
    the rows that meet there are united; the description is the first non-empty one by id, own name before former.
    """
    joined = entities.where("name is not null").join(pairs, (entities["document_id"] == pairs["document_id"]) & (entities["name"] == pairs["alias"]), "left").select(
        entities["document_id"], F.coalesce("canonical", "name").alias("to_name"), "name", "entity_type", "entity_id", "description", "aliases"
    )
    own = F.concat(F.coalesce("aliases", no_strings()), F.when(F.col("name") != F.col("to_name"), F.array("name")).otherwise(no_strings()))
    grouped = joined.groupBy("document_id", F.col("to_name").alias("name"), "entity_type").agg(
        F.array_sort(F.array_distinct(F.array_compact(F.flatten(F.collect_set(own))))).alias("aliases"),
        F.min_by(F.nullif("description", F.lit("")), F.when(F.col("description") != "", F.struct(F.col("name") != F.col("to_name"), F.col("entity_id")))).alias("description"),
        F.count_distinct("entity_id").alias("members"),
    )
    return grouped


def remap_relations(relations: DataFrame, pairs: DataFrame, document: str = "document_id") -> DataFrame:
    """Relations with both ends under their canonical names, one hop; of triples that fall together the first by id stays."""
    out = relations.where("subject is not null and predicate is not null and object is not null")
    for end in ("subject", "object"):
        side = pairs.select(F.col("document_id").alias(document), F.col("alias").alias(end), F.col("canonical").alias("to_"))
        out = out.join(side, [document, end], "left").withColumn(end, F.coalesce("to_", end)).drop("to_")
    return first_wins(out, [document, "subject", "predicate", "object"], [F.col("relation_id")])


def merge_canonical(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(document_id, name, entity_type, aliases, description, source_name, confidence, origin)``: entities with canonical records upserted.

    On name and type aliases are united and an empty description or source filled; a record without its entity
    becomes one of confidence 0.8. A missing type is 未知; records with a blank name are left out.
    """
    left = entities.where("name is not null and document_id is not null").groupBy("document_id", "name", F.coalesce("entity_type", F.lit(packs.UNKNOWN)).alias("entity_type")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", no_strings())))).alias("aliases"),
        F.min_by("description", "entity_id").alias("description"),
        F.min_by("source_name", "entity_id").alias("source_name"),
        F.max("confidence").alias("confidence"),
    )
    right = canonical.where((F.length(ustrip(F.col("name"))) > 0) & F.col("document_id").isNotNull()).groupBy("document_id", ustrip(F.col("name")).alias("name"), F.coalesce(F.nullif(ustrip(F.col("entity_type")), F.lit("")), F.lit(packs.UNKNOWN)).alias("entity_type")).agg(
        F.array_distinct(F.flatten(F.collect_set(F.coalesce("aliases", no_strings())))).alias("c_aliases"),
        F.min_by("description", "canon_id").alias("c_description"),
        F.min_by("source_name", "canon_id").alias("c_source"),
    )
    both = left.join(right, ["document_id", "name", "entity_type"], "full_outer")
    filled = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))
    return both.select(
        "document_id",
        "name",
        "entity_type",
        F.array_sort(F.array_distinct(F.array_compact(F.concat(F.coalesce("aliases", no_strings()), F.coalesce("c_aliases", no_strings()))))).alias("aliases"),
        filled("description", "c_description").alias("description"),
        filled("source_name", "c_source").alias("source_name"),
        F.when(F.col("aliases").isNull(), 0.8).otherwise(F.col("confidence")).alias("confidence"),
        F.when(F.col("aliases").isNull(), "canonical").when(F.col("c_aliases").isNull(), "entity").otherwise("both").alias("origin"),
    )


def isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(document_id, name)``: names of a document that no relation of it has as an end."""
    ends = relations.select("document_id", F.explode(F.array("subject", "object")).alias("name")).where("name <> ''").distinct()
    return entities.where("name is not null").select("document_id", "name").distinct().join(ends, ["document_id", "name"], "left_anti")


def hypothesis(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("根据上述文本，"), s, p, o, F.lit("。"))


def bridges(relations: DataFrame, entail=None, evidence: str = "source_text", confidence: float = DEFAULT.bridge_confidence, entailment: float = DEFAULT.entailment) -> DataFrame:
    """Relations sure enough to bridge: non-empty ends and evidence, confidence, and a predicate of the schema or an entailed statement.

    ``entail(evidence, hypothesis)`` gives a column of scores. Rows of the schema never reach it: the frame is split, only
    open predicates are scored, and both parts are united. A missing confidence counts as 0.7, so it fails.
    """
    ends = {c: ustrip(F.coalesce(F.col(c), F.lit(""))) for c in ("subject", "predicate", "object")}
    proof = ustrip(F.coalesce(F.col(evidence), F.lit("")))
    kept = relations.withColumns(ends).withColumn("s_evidence", proof).withColumn("confidence", F.coalesce("confidence", F.lit(0.7)))
    kept = kept.where((F.col("subject") != "") & (F.col("predicate") != "") & (F.col("object") != "") & (F.col("confidence") >= confidence) & (F.col("s_evidence") != ""))
    kept = kept.withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(packs.UNKNOWN)) for c in ("subject_type", "object_type")})
    schema = F.col("predicate").isin(packs.BRIDGE_PREDICATES)
    sure = kept.where(schema).withColumns({"predicate_is_schema": F.lit(True), "entailment_score": F.lit(None).cast("double")})
    if entail is None:
        return sure
    open_ = kept.where(~schema).withColumn("predicate_is_schema", F.lit(False))
    scored = open_.withColumn("entailment_score", entail(F.col("s_evidence"), hypothesis(F.col("subject"), F.col("predicate"), F.col("object")))).where(F.col("entailment_score") >= entailment)
    return sure.unionByName(scored)
