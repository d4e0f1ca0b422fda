"""The pN_ queries over the whole tables of a data directory, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm import components, copies, encode, lookalikes, moderation, names, packing, pieces
from planweave.session import table


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.connected_groups(table(spark, sf_dir, "alias_map"), "alias_id", "canonical_id")


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, group_id)`` of every canonical record, and of ids that only alias_map has; a record without a usable match is a group of its own."""
    groups = _matched(spark, sf_dir)
    records = table(spark, sf_dir, "canonical_entities").select(F.col("canon_id").cast("long").alias("id")).where("id is not null").distinct()
    return groups.unionByName(records.join(groups, "id", "left_anti").withColumn("group_id", F.col("id")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).where("id <> group_id").select("group_id", F.col("id").alias("canon_id"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.groups(table(spark, sf_dir, "entities"), table(spark, sf_dir, "canonical_entities"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.found(table(spark, sf_dir, "entities"), table(spark, sf_dir, "canonical_entities"))


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.pieces(pieces.items(table(spark, sf_dir, "sections"), table(spark, sf_dir, "chunk_texts")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.found(pieces.items(table(spark, sf_dir, "sections"), table(spark, sf_dir, "chunk_texts")))


def _rule_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.records(table(spark, sf_dir, "rules"), table(spark, sf_dir, "rule_json"))


def p4_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.collapsed(_rule_records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.found(_rule_records(spark, sf_dir))


def p5_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.field_forms(table(spark, sf_dir, "entities"), table(spark, sf_dir, "relations"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.found(table(spark, sf_dir, "entities"), table(spark, sf_dir, "relations"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.encode(table(spark, sf_dir, "documents"))


def p6_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids put back into texts, which must be the texts of the documents, '' for null."""
    return encode.decode(p6_ids(spark, sf_dir))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.containers(encode.sizes(table(spark, sf_dir, "documents")))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "moderation_labels"))


def p8_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.rates(p8_scores(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moderation.found(p8_scores(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_groups, p1_found, p2_groups, p2_found, p3_pieces, p3_found, p4_collapsed, p4_found, p5_forms, p5_found, p6_ids, p6_texts, p7_containers, p8_scores, p8_rates, p8_found)
}

_GROUPS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT alias_id AS a, canonical_id AS b FROM alias_map WHERE alias_id IS NOT NULL AND canonical_id IS NOT NULL
), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
r(a, b) AS (SELECT a, b FROM s UNION SELECT r.a, s.b FROM r JOIN s ON r.b = s.a),
g AS (SELECT a AS id, min(b) AS group_id FROM r GROUP BY a)
"""

_ITEMS = """
SELECT 'section' AS item_kind, section_id AS item_id, text FROM sections UNION ALL SELECT 'chunk', chunk_id, chunk_text FROM chunk_texts
"""


def _canonical_sql(column: str) -> str:
    """Marks between two digits are taken out of reach first, twice since neighbours share a digit, and put back."""
    kept = f"regexp_replace(regexp_replace(coalesce({column}, ''), '(\\p{{Nd}})(\\p{{P}})(\\p{{Nd}})', '\\1\ue000\\2\ue001\\3', 'g'), '(\\p{{Nd}})(\\p{{P}})(\\p{{Nd}})', '\\1\ue000\\2\ue001\\3', 'g')"
    marked = f"regexp_replace({kept}, '(^|[^\ue000])[\\s\\p{{Z}}\\x{{85}}\\x{{b}}\\x{{1c}}-\\x{{1f}}\\p{{P}}]+', '\\1', 'g')"
    return f"lower(upper(replace(replace({marked}, '\ue000', ''), '\ue001', '')))"


_COPIES = f"""
WITH r AS (
  SELECT record_id, rule_name, rule_text FROM rules
  UNION ALL SELECT record_id, body::JSON->>'rule_name', body::JSON->>'rule_text' FROM rule_json
), k AS (SELECT record_id, {_canonical_sql("rule_name")} AS n, {_canonical_sql("rule_text")} AS t FROM r),
g AS (SELECT n, t, min(record_id) AS keep_id, count(DISTINCT record_id) AS copies FROM k WHERE t <> '' GROUP BY n, t)
"""

ORACLE: dict[str, str] = {
    "p1_groups": _GROUPS + "SELECT id, group_id FROM g UNION SELECT canon_id, canon_id FROM canonical_entities WHERE canon_id IS NOT NULL AND canon_id NOT IN (SELECT id FROM g)",
    "p1_found": _GROUPS + "SELECT group_id, id AS canon_id FROM g WHERE id <> group_id",
    "p3_found": f"SELECT DISTINCT item_kind, item_id FROM ({_ITEMS}) WHERE length(text) > 1000",
    "p6_texts": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p4_collapsed": _COPIES + "SELECT keep_id, copies, rule_name, rule_text FROM g JOIN r ON r.record_id = g.keep_id",
    "p4_found": _COPIES + "SELECT DISTINCT keep_id, record_id FROM k JOIN g USING (n, t) WHERE record_id > keep_id",
}
