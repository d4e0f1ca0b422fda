"""Rules as a stream: a folder of JSON files, repeats dropped within a watermark, entities and relations merged into the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions.text import ustrip
from planweave.operators import extract, graph
from planweave.sources.readers import RULE, with_source


def rule_stream(spark: SparkSession, folder: str, watermark: str = "1 day", per_trigger: int = 1000) -> DataFrame:
    """New rules of a folder of JSON-lines files, each with ``loaded_at``; a text of a source that comes again within the watermark is dropped."""
    raw = spark.readStream.schema(RULE + ", loaded_at timestamp").option("maxFilesPerTrigger", per_trigger).json(folder)
    sourced = with_source(raw.withColumn("file", F.input_file_name()), F.col("file")).drop("file").where(F.length(ustrip(F.col("rule_text"))) > 0)
    stamped = sourced.withColumn("loaded_at", F.coalesce("loaded_at", F.current_timestamp())).withWatermark("loaded_at", watermark)
    return stamped.withColumn("text_hash", F.md5(ustrip(F.col("rule_text")))).dropDuplicatesWithinWatermark(["source_name", "text_hash"])


def counts_by_window(rules: DataFrame, window: str = "1 hour") -> DataFrame:
    """Rules per source and tumbling window of load time."""
    return rules.groupBy(F.window("loaded_at", window).alias("w"), "source_name").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "source_name", "n")


def merge_into(store: graph.GraphStore):
    """A ``foreachBatch`` function: pattern extraction of the batch, then the keyed upsert, which a repeated batch does not change."""

    def run(batch: DataFrame, batch_id: int) -> None:
        rules = batch.select(F.concat_ws("/", "source_name", "text_hash").alias("document_id"), "source_name", "rule_text")
        spans = extract.entity_spans(rules, "document_id", "rule_text").withColumn("entity_id", F.col("ord"))
        sources = rules.select("document_id", "source_name").distinct()
        entities = spans.join(sources, "document_id").select("document_id", "name", "entity_type", "source_name", "entity_id", F.lit(0).alias("chunk_index"), F.lit("").alias("description"), F.array().cast("array<string>").alias("aliases"))
        relations = extract.pattern_relations(rules, "document_id", "rule_text").join(sources, "document_id").select("document_id", "subject", "predicate", "object", "source_name", "confidence", F.lit(0).alias("chunk_index"), F.xxhash64("subject", "predicate", "object").alias("relation_id"))
        nodes, edges = graph.graph_of(entities, relations)
        store.merge(nodes.withColumn("seq", F.lit(batch_id)), edges.withColumn("seq", F.lit(batch_id)))

    return run
