"""Problem 4: duplicates hidden by formatting differences.

Records are brought to a canonical form inside the JVM, hashed to 128 bits and aggregated with partial
aggregation before the shuffle, so a set of copies of any size reaches its reducer as one row per task. A second,
independent hash of the same form is carried as minimum and maximum; where they differ two forms have collided and
those groups, and only those, are grouped again by the form itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.operators.skew import lookup
from planweave.session import cut

#: White space, and punctuation unless it stands directly between two decimal digits.
IGNORED = r"(?U)[\s\x1c-\x1f]|(?<!\p{Nd})\p{P}|\p{P}(?!\p{Nd})"

RULE = T.StructType(
    [
        T.StructField("rule_id", T.StringType()),
        T.StructField("rule_name", T.StringType()),
        T.StructField("rule_text", T.StringType()),
        T.StructField("elements", T.ArrayType(T.StringType())),
        T.StructField("rule_tags", T.ArrayType(T.StringType())),
        T.StructField("rule_source", T.StringType()),
    ]
)


def canonical(text: Column) -> Column:
    """The text without what formatting changes: white space, letter case and punctuation. Null becomes ''."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), IGNORED, "")
    return F.lower(F.upper(bare))


def records(rules: DataFrame, rule_json: DataFrame) -> DataFrame:
    """Both tables as ``(record_id, rule_name, rule_text)``; fields are taken by key, so their order in the JSON is nothing."""
    flat = rules.select("record_id", "rule_name", "rule_text")
    parsed = rule_json.select("record_id", F.from_json("body", RULE).alias("r")).select("record_id", "r.rule_name", "r.rule_text")
    return flat.unionByName(parsed)


def keyed(rows: DataFrame) -> DataFrame:
    """``(record_id, h128, check)`` of the records that have a text left once formatting is ignored."""
    form = F.concat(F.col("name_form"), F.lit("\u0001"), F.col("text_form"))
    forms = rows.select("record_id", canonical(F.col("rule_name")).alias("name_form"), canonical(F.col("rule_text")).alias("text_form")).where("text_form <> ''")
    return forms.select("record_id", F.md5(form).alias("h128"), F.xxhash64(form).alias("check"), form.alias("form"))


def copy_sets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records with their set key, and one row ``(key, keep_id, copies)`` per set.

    Records with a null id are no records. A set of one has ``copies`` 1. Rows repeated under one id count
    once for ``copies``. Nulls and blanks in the name are equal; a text of which nothing is left makes no set.
    """
    known = keyed(rows.where("record_id is not null"))
    with_keys = cut(known.select("record_id", "h128", "check").distinct())
    groups = with_keys.groupBy("h128").agg(F.min("record_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"), F.min("check").alias("low"), F.max("check").alias("high"))
    groups = cut(groups)
    clash = groups.where("low <> high").select("h128")
    if clash.isEmpty():
        return with_keys.select("record_id", F.col("h128").alias("key")), groups.select(F.col("h128").alias("key"), "keep_id", "copies")
    apart = known.join(clash, "h128", "left_semi").select("record_id", F.col("form").alias("key")).distinct()
    apart_groups = apart.groupBy("key").agg(F.min("record_id").alias("keep_id"), F.count(F.lit(1)).alias("copies"))
    rest = with_keys.join(clash, "h128", "left_anti").select("record_id", F.col("h128").alias("key"))
    rest_groups = groups.where("low = high").select(F.col("h128").alias("key"), "keep_id", "copies")
    return rest.unionByName(apart), rest_groups.unionByName(apart_groups)


def collapsed(rows: DataFrame) -> DataFrame:
    """``(keep_id, copies, rule_name, rule_text)``: one record for each set of copies, with the number of its copies.

    The record is the one of the smallest id, as it stands; should that id come with several contents, the least of them.
    """
    kept = copy_sets(rows)[1].select("keep_id", "copies").join(rows.select(F.col("record_id").alias("keep_id"), F.struct("rule_name", "rule_text").alias("r")), "keep_id")
    return kept.groupBy("keep_id", "copies").agg(F.min("r").alias("r")).select("keep_id", "copies", "r.rule_name", "r.rule_text")


def found(rows: DataFrame) -> DataFrame:
    """``(keep_id, record_id)``: every record that is a copy of one with a smaller id."""
    members, groups = copy_sets(rows)
    several = groups.where("copies > 1")
    total, most = several.agg(F.sum("copies"), F.max("copies")).first()
    joined = lookup(members, several, "key", "copies", total or 0, most or 0)
    return joined.where("record_id > keep_id").select("keep_id", "record_id").distinct()
