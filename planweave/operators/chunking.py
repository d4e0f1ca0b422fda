"""Loading order, groups, batches and chunks of rules and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.config import DEFAULT
from planweave.functions import packs
from planweave.functions.text import SPACE, token_estimate, ustrip


def group_rules(rules: DataFrame, group_size: int = DEFAULT.group_size) -> DataFrame:
    """``(group_id, source_name, members, group_text)``: the rules of a source in order, ``group_size`` to a group.

    Rules are numbered by one ordered aggregation per group; blank texts are left out, a missing source is
    未知 and a missing rule id the number of the rule in the load. Two numberings are used so that a source with a
    large share of all rules is never sorted by one task: ranges of ``ord`` are counted first, and the offset of a
    range is added to the rank inside it.
    """
    rows = rules.where(F.length(ustrip(F.col("rule_text"))) > 0).select(
        F.coalesce(F.nullif(ustrip(F.col("source_name")), F.lit("")), F.lit(packs.UNKNOWN)).alias("source_name"),
        F.coalesce(F.nullif(ustrip(F.col("rule_id")), F.lit("")), F.concat(F.lit("doc_"), F.col("ord"))).alias("rule_id"),
        "rule_text",
        "ord",
    )
    numbered = rank_within(rows, "source_name", "ord")
    grouped = numbered.withColumn("bucket", F.floor((F.col("rn") - 1) / group_size)).groupBy("source_name", "bucket")
    line = F.concat(F.lit("【"), F.col("rule_id"), F.lit("】"), F.col("rule_text"))
    packed = grouped.agg(F.array_sort(F.collect_list(F.struct("rn", "rule_id", line.alias("line")))).alias("rows"))
    first = F.col("bucket") * group_size
    return packed.select(
        F.concat_ws("_", F.lit("group"), "source_name", (first + 1).cast("string"), (first + F.size("rows")).cast("string")).alias("group_id"),
        "source_name",
        F.col("rows.rule_id").alias("members"),
        F.array_join(F.col("rows.line"), "\n").alias("group_text"),
    )


def rank_within(rows: DataFrame, key: str, order: str, slice_rows: int = 1_000_000) -> DataFrame:
    """Adds ``rn``, the number of a row from 1 within its ``key`` by the unique bigint column ``order``.

    A key may hold any share of the rows: they are ranked within slices of ``order``, and the rows of the
    slices before are added from one count per key and slice.
    """
    sliced = rows.withColumn("slice_", F.floor(F.col(order) / slice_rows))
    counts = sliced.groupBy(key, "slice_").agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(key).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(key, "slice_", F.coalesce(before, F.lit(0)).alias("before_"))
    inside = sliced.withColumn("in_", F.row_number().over(Window.partitionBy(key, "slice_").orderBy(order)))
    return inside.join(offsets, [key, "slice_"]).withColumn("rn", F.col("in_") + F.col("before_")).drop("slice_", "in_", "before_")


def batches(rows: DataFrame, key: str, order: str, size: int = DEFAULT.embedding_batch) -> DataFrame:
    """Adds ``batch``: the rows of a key cut into runs of ``size`` in order."""
    return rank_within(rows, key, order).withColumn("batch", F.floor((F.col("rn") - 1) / size)).drop("rn")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per ``keys``: the first by ``order``. Done as a minimum over a struct, so copies shrink before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(*[o.alias(f"o{k}_") for k, o in enumerate(order)], F.struct(*rest).alias("row_")))
    return rows.groupBy(*keys).agg(best.alias("best_")).select(*keys, "best_.row_.*").select(*rows.columns)


def paragraph_chunks(sections: DataFrame, budget: int = DEFAULT.paragraph_tokens, chars_per_token: int = 4) -> DataFrame:
    """``(document, chunk_index, chunk_text)``: sections in order, joined until the budget would be passed.

    A chunk over the budget is closed and the next begins with the last section of the one before. Blank sections are
    left out; a section over the budget makes a chunk of its own with its forerunner. One document is one row here.
    """
    rows = sections.where((F.length(ustrip(F.col("text"))) > 0) & F.col("document").isNotNull()).groupBy("document", "section_index").agg(F.max("text").alias("text"))
    ordered = rows.groupBy("document").agg(F.array_sort(F.collect_list(F.struct("section_index", ustrip(F.col("text")).alias("text")))).alias("rows"))
    kind = "struct<done:array<string>,now:string,tokens:int,last:string>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("tokens"), F.lit("").alias("last")).cast(kind)

    def step(acc: Column, row: Column) -> Column:
        n = token_estimate(row["text"], chars_per_token)
        full = (acc["tokens"] + n > budget) & (acc["now"] != "")
        return F.when(
            full,
            F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.concat(acc["last"], row["text"]).alias("now"), (token_estimate(acc["last"], chars_per_token) + n).alias("tokens"), row["text"].alias("last")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], row["text"]).alias("now"), (acc["tokens"] + n).alias("tokens"), row["text"].alias("last")))

    folded = ordered.select("document", F.aggregate("rows", start, step, lambda acc: F.array_compact(F.concat(acc["done"], F.array(F.nullif(acc["now"], F.lit("")))))).alias("chunks"))
    return folded.select("document", F.posexplode("chunks").alias("chunk_index", "chunk_text"))


SENTENCE = rf"[。！？；]{SPACE}*"


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE), ustrip), lambda s: s != "")


def overlap_tail(text: Column, overlap: int, chars_per_token: int) -> Column:
    """The last sentences of a text whose tokens together stay within ``overlap``, joined and closed by 。; '' for none."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        n = token_estimate(s, chars_per_token)
        fits = acc["open"] & (acc["n"] + n <= overlap)
        return F.when(fits, F.struct(F.when(acc["text"] == "", s).otherwise(F.concat(s, F.lit("。"), acc["text"])).alias("text"), (acc["n"] + n).alias("n"), F.lit(True).alias("open"))).otherwise(
            F.struct(acc["text"].alias("text"), acc["n"].alias("n"), F.lit(False).alias("open"))
        )

    return F.aggregate(F.reverse(_sentences(text)), start, step, lambda acc: F.when(acc["text"] == "", F.lit("")).otherwise(F.concat(acc["text"], F.lit("。"))))


def sentence_chunks(text: Column, size: int = DEFAULT.chunk_tokens, overlap: int = DEFAULT.overlap_tokens, chars_per_token: int = 2) -> Column:
    """Array of chunks of a text: whole if it is within ``size`` tokens, else sentences joined by 。 up to it, each chunk after the first begun with the tail of the one before."""
    kind = "struct<done:array<string>,now:string,n:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        n = token_estimate(s, chars_per_token)
        closed = F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        led = F.when(F.size(closed) > 0, F.concat(overlap_tail(F.coalesce(F.try_element_at(closed, F.lit(-1)), F.lit("")), overlap, chars_per_token), s)).otherwise(s)
        return F.when(acc["n"] + n > size, F.struct(closed.alias("done"), led.alias("now"), token_estimate(led, chars_per_token).alias("n"))).otherwise(
            F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", s).otherwise(F.concat(acc["now"], F.lit("。"), s)).alias("now"), (acc["n"] + n).alias("n"))
        )

    cut = F.aggregate(_sentences(text), start, step, lambda acc: F.when(acc["now"] != "", F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).when(token_estimate(text, chars_per_token) <= size, F.array(text)).otherwise(cut)
