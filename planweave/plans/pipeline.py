"""End to end: rules to groups, extraction, consolidation, graph, repair, anchoring and report, as one set-oriented plan."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.config import DEFAULT, EngineConfig
from planweave.functions import packs, payload, prompts
from planweave.functions.text import admissible, semantic_elements
from planweave.operators import alias, chunking, extract, graph, ontology, resolve
from planweave.session import cut
from planweave.sources import sinks
from planweave.sources.providers import Offline, Provider, ask, entailment, trace
from planweave.sources.readers import read_docx, shape_rules


def run_counters(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: documents, those with entities and relations (succeeded), the others, the rate, and totals; the rate of no documents is null."""
    e = entities.groupBy("document_id").agg(F.count_distinct("entity_id").alias("entities"))
    r = relations.groupBy("document_id").agg(F.count_distinct("relation_id").alias("relations"))
    both = e.join(r, "document_id", "full_outer").na.fill(0, ["entities", "relations"])
    ok = F.count_if((F.col("entities") > 0) & (F.col("relations") > 0))
    n = F.count(F.lit(1))
    return both.agg(n.alias("documents"), ok.alias("succeeded"), (n - ok).alias("failed"), F.round(F.try_divide(ok, n), 6).alias("success_rate"), F.coalesce(F.sum("entities"), F.lit(0)).alias("entities"), F.coalesce(F.sum("relations"), F.lit(0)).alias("relations"))


def extract_rules(chunks: DataFrame, provider: Provider) -> DataFrame:
    """``(document, rule_id, RULE columns, source_name)``: rules a model finds in ``(document, chunk_index, chunk_text)``.

    Admissible ones only, numbered per document in order before copies are dropped, the first of each text kept.
    """
    asked = cut(ask(chunks.where(F.length(F.trim("chunk_text")) > 0).withColumn("prompt", prompts.rules(F.col("chunk_text"))), provider))
    rows = asked.select("document", "chunk_index", F.posexplode(payload.parsed_rules("answer")).alias("k", "r"))
    flat = rows.select("document", "chunk_index", "k", "r.rule_name", "r.rule_text", semantic_elements(F.col("r.rule_text"), F.col("r.elements")).alias("elements"), "r.rule_tags", F.col("document").alias("source_name"), F.col("document").alias("rule_source"))
    kept = shape_rules(flat.where(admissible(F.col("elements")))).withColumn("place", F.col("chunk_index").cast("long") * 1_000_000 + F.col("k"))
    numbered = chunking.rank_within(kept, "document", "place").withColumn("rule_id", F.col("rn").cast("string"))
    return chunking.first_wins(numbered.drop("rn", "k"), ["document", "rule_text"], [F.col("place")]).drop("chunk_index", "place")


def rules_from_documents(spark: SparkSession, folder: str, out: str, provider: Provider | None = None, config: EngineConfig = DEFAULT) -> DataFrame:
    """From .docx files to rules: sections, chunks, rules, and both embedded; tables ``chunks``, ``rules`` under ``out``, and the rules as JSON lines under ``rules_json``. Gives the rules."""
    provider = provider or Offline(config.embedding_dim)
    chunks = cut(chunking.paragraph_chunks(read_docx(spark, folder).where("error is null"), config.paragraph_tokens))
    rules = cut(extract_rules(chunks, provider))
    model = type(provider).__name__
    sinks.write_json(rules, f"{out.rstrip('/')}/rules_json")
    alias.embedding_records(chunks.withColumn("id", F.concat_ws("#", "document", "chunk_index")), "id", "chunk_text", provider, model, ["document", "chunk_index"], config.embedding_batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/chunks")
    alias.embedding_records(rules.withColumn("id", F.concat_ws("#", "document", "rule_id")), "id", "rule_text", provider, model, ["document", "rule_name"], config.embedding_batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/rules")
    return rules


@dataclass
class Consolidated:
    alias_pairs: DataFrame
    canonical: DataFrame
    bridges: DataFrame


def consolidate(entities: DataFrame, relations: DataFrame, provider: Provider) -> Consolidated:
    """What a model says of the names and triples of each document: aliases, canonical records and bridges.

    One call a document, written once. A failing or senseless answer leaves its document as it is.
    """
    listed = prompts.consolidation_inputs(entities, relations, resolve.isolated(entities, relations))
    asked = cut(ask(listed.select("document_id", prompts.consolidation(F.col("entities"), F.col("relations"), F.col("lonely")).alias("prompt")), provider))
    answers = cut(asked.select("document_id", payload.parsed("answer").alias("p")))
    pairs = answers.select("document_id", F.explode("p.alias_map").alias("alias", "canonical")).where("canonical is not null and alias <> canonical")
    value = lambda m, k: F.try_element_at(m, F.lit(k))
    records = answers.select("document_id", F.posexplode("p.canonical_entities").alias("k", "c")).select(
        "document_id", F.col("k").cast("long").alias("canon_id"), value("c", "name").alias("name"), value("c", "type").alias("entity_type"), F.from_json(value("c", "aliases"), "array<string>").alias("aliases"), value("c", "description").alias("description")
    )
    found = answers.select("document_id", F.posexplode("p.bridge_relations").alias("k", "r")).select(
        "document_id",
        *[value("r", c).alias(c) for c in ("subject", "predicate", "object", "subject_type", "object_type")],
        F.coalesce(F.expr("try_cast(try_element_at(r, 'confidence') as double)"), F.lit(0.7)).alias("confidence"),
        F.coalesce(F.nullif(value("r", "s_evidence"), F.lit("")), value("r", "source_text")).alias("source_text"),
        F.lit(0).alias("chan"),
        F.col("k").cast("long").alias("relation_id"),
        F.lit(-1).alias("chunk_index"),
    )
    return Consolidated(pairs, records, found)


@dataclass
class Built:
    groups: DataFrame
    entities: DataFrame
    relations: DataFrame
    nodes: DataFrame
    edges: DataFrame
    before: DataFrame
    after: DataFrame
    traces: DataFrame
    embeddings: DataFrame
    results: DataFrame
    report: str


def extraction(groups: DataFrame, provider: Provider, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations of ``(document_id, source_name, group_text)``, by the model's channel and the patterns', and the model calls themselves."""
    spans = extract.entity_spans(groups, "document_id", "group_text")
    wanted = groups.select("document_id", "source_name", prompts.extraction(F.col("group_text"), F.array().cast("array<string>")).alias("prompt"), "group_text")
    asked = cut(ask(wanted, provider))
    answers = asked.select("document_id", "group_text", payload.parsed("answer").alias("p"))
    found = answers.select("document_id", "group_text", F.posexplode("p.entities").alias("k", "e")).where("length(e['name']) > 0")
    at = F.position(F.element_at("e", "name"), "group_text") - 1
    modelled = found.select(
        "document_id", F.element_at("e", "name").alias("name"), F.coalesce(F.try_element_at("e", F.lit("type")), F.lit(packs.UNKNOWN)).alias("entity_type"), F.coalesce(F.expr("try_cast(try_element_at(e, 'confidence') as double)"), F.lit(0.8)).alias("confidence"),
        at.alias("start_pos"), F.when(at < 0, -1).otherwise(at + F.length(F.element_at("e", "name"))).alias("end_pos"), F.col("k").alias("ord"), F.lit(0).alias("chan"),
    )
    merged = extract.combine_channels(modelled.unionByName(spans.select("document_id", "name", "entity_type", "confidence", "start_pos", "end_pos", "ord", F.lit(1).alias("chan"))), "document_id")
    sources = groups.select("document_id", "source_name")
    entities = extract.dedupe_entities(merged.withColumn("entity_id", F.col("place").cast("long")).withColumn("chunk_index", F.lit(0))).join(sources, "document_id")
    entities = cut(entities.withColumns({"description": F.lit(""), "aliases": F.array().cast("array<string>")}))
    by_pattern = extract.pattern_relations(groups, "document_id", "group_text").withColumn("chan", F.lit(1))
    by_model = answers.select("document_id", F.posexplode("p.relations").alias("k", "r")).select(
        "document_id", *[F.try_element_at("r", F.lit(c)).alias(c) for c in ("subject", "predicate", "object", "subject_type", "object_type")], F.coalesce(F.expr("try_cast(try_element_at(r, 'confidence') as double)"), F.lit(0.8)).alias("confidence"), F.try_element_at("r", F.lit("source_text")).alias("source_text"), F.lit(0).alias("chan")
    )
    both = by_model.unionByName(by_pattern).withColumn("relation_id", F.col("chan").cast("long") * (1 << 40) + F.shiftrightunsigned(F.xxhash64("subject", "predicate", "object"), 25)).withColumn("chunk_index", F.lit(0))
    relations = extract.dedupe_relations(both, config.relation_confidence).join(sources, "document_id")
    return entities, relations, asked


def build(spark: SparkSession, rules: DataFrame, provider: Provider | None = None, config: EngineConfig = DEFAULT) -> Built:
    """The graph of rules with columns RULE, ``source_name`` and ``ord``.

    Model answers are written once to the checkpoint folder and read from there, since they are dear and may
    differ between calls. A failing call leaves its document with what the patterns find.
    """
    began = time.time()
    provider = provider or Offline(config.embedding_dim)
    groups = cut(chunking.group_rules(shape_rules(rules), config.group_size).select(F.col("group_id").alias("document_id"), "source_name", "members", "group_text"))
    entities, relations, asked = extraction(groups, provider, config)
    sources = groups.select("document_id", "source_name")
    embedded = alias.embed(entities.select("document_id", "entity_type", "name", "entity_id").withColumn("block", F.concat_ws("\u0001", "document_id", "entity_type")).withColumn("key", F.xxhash64("block", "name")), "name", provider, config.embedding_batch)
    embedded = cut(embedded)
    pairs = cut(alias.alias_map(embedded, "block", "key", "name", "embedding", config.alias_similarity, config.neighbours)).select(F.substring_index("block", "\u0001", 1).alias("document_id"), "alias", "canonical")
    pairs = pairs.groupBy("document_id", "alias").agg(F.max("canonical").alias("canonical"))
    consolidated = consolidate(entities, relations, provider)
    pairs = resolve.merge_maps(consolidated.alias_pairs, pairs).where("alias <> canonical")
    resolved = resolve.apply_aliases(entities, pairs).join(sources, "document_id").withColumns({"entity_id": F.lit(0).cast("long"), "confidence": F.lit(None).cast("double")})
    resolved = resolve.merge_canonical(resolved, consolidated.canonical.join(sources, "document_id"))
    remapped = resolve.remap_relations(relations, pairs)
    judge = entailment(provider)
    proposed = consolidated.bridges.join(sources, "document_id").select(*remapped.columns)
    candidates = remapped.withColumn("rank", F.lit(0)).unionByName(proposed.withColumn("rank", F.lit(1)))
    bridged = resolve.bridges(candidates, judge, confidence=config.bridge_confidence, entailment=config.entailment).select("document_id", "subject", "predicate", "object", F.lit(True).alias("is_bridge")).distinct()
    kept = candidates.join(bridged, ["document_id", "subject", "predicate", "object"], "left").where("rank = 0 or is_bridge")
    all_relations = chunking.first_wins(kept, ["document_id", "subject", "predicate", "object"], [F.col("rank"), F.col("relation_id")]).drop("rank")
    nodes, edges = graph.graph_of(resolved.withColumns({"entity_id": F.lit(0).cast("long"), "chunk_index": F.lit(0)}), all_relations)
    meta = graph.meta_nodes(groups)
    every_node = cut(nodes.unionByName(meta, allowMissingColumns=True))
    with_links = edges.unionByName(graph.type_links(nodes), allowMissingColumns=True).unionByName(graph.meta_edges(groups), allowMissingColumns=True)
    repaired, before, after = graph.repair(every_node, cut(with_links))
    kept_nodes, kept_edges = graph.prune(every_node, cut(repaired))
    plan_nodes, plan_edges = ontology.plan_graph(spark)
    anchors = ontology.anchor_edges(kept_nodes, ontology.plan_nodes(spark))
    kept_nodes = cut(kept_nodes.unionByName(plan_nodes, allowMissingColumns=True))
    final_edges = cut(kept_edges.unionByName(anchors, allowMissingColumns=True).unionByName(plan_edges, allowMissingColumns=True))
    traces = trace(asked, type(provider).__name__)
    results = cut(document_results(groups, entities, all_relations, asked))
    records = alias.records_of(embedded.join(sources, "document_id"), "key", "name", type(provider).__name__, ["document_id", "entity_type", "source_name"])
    counters = run_counters(entities, relations.withColumn("relation_id", F.xxhash64("subject", "predicate", "object")))
    report = report_text(counters, kept_nodes, final_edges, after, time.time() - began, results)
    return Built(groups, entities, all_relations, kept_nodes, final_edges, before, after, traces, records, results, report)


def document_results(groups: DataFrame, entities: DataFrame, relations: DataFrame, asked: DataFrame) -> DataFrame:
    """``(document_id, source_name, entities, relations, status, seconds)`` of every document; ``status`` and ``seconds`` are those of its model call, null where it had none."""
    count = F.count(F.lit(1))
    e = entities.groupBy("document_id").agg(count.alias("entities"))
    r = relations.groupBy("document_id").agg(count.alias("relations"))
    calls = asked.groupBy("document_id").agg(F.max("status").alias("status"), F.sum("seconds").alias("seconds"))
    joined = groups.select("document_id", "source_name").join(e, "document_id", "left").join(r, "document_id", "left").join(calls, "document_id", "left")
    return joined.na.fill(0, ["entities", "relations"]).select("document_id", "source_name", "entities", "relations", "status", "seconds")


def write_outputs(built: Built, folder: str) -> None:
    """What a run leaves besides the graph: results, entities and relations by document, entity embeddings, the trace of calls and the report."""
    root = folder.rstrip("/")
    sinks.write_per_document(built.results, built.entities, built.relations, root)
    built.embeddings.write.mode("overwrite").parquet(f"{root}/entity_embeddings")
    sinks.write_trace(built.traces, f"{root}/trace")
    sinks.write_text(built.report, f"{root}/report.md")


def report_text(counters: DataFrame, nodes: DataFrame, edges: DataFrame, links: DataFrame, seconds: float, results: DataFrame | None = None) -> str:
    """The report in Markdown: counters, seconds a document, all counts by label and type, type edges, and how many documents ended how."""
    c = counters.first().asDict()
    n = c["documents"]
    lines = ["# Build report", "", f"- documents: {n}, succeeded {c['succeeded']}, failed {c['failed']}, rate {c['success_rate']}", f"- entities: {c['entities']}, relations: {c['relations']}"]
    lines += [f"- seconds: {seconds:.1f}, documents a second: {n / seconds if seconds else 0:.2f}, seconds a document: {seconds / n if n else 0:.3f}"]
    if results is not None:
        calls = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.avg("seconds").alias("mean"), F.max("seconds").alias("most")).orderBy("status").collect()
        lines += ["", "## Model calls", ""] + [f"- {r['status']}: {r['n']} documents, {r['mean'] or 0:.3f} seconds on average, {r['most'] or 0:.3f} at most" for r in calls]
    lines += ["", "## Graph", ""]
    lines += [f"- {r['kind']} {r['name']}: {r['n']}" for r in graph.statistics(nodes, edges).orderBy("kind", F.desc("n"), "name").toLocalIterator()]
    lines += ["", "## Type edges", ""] + [f"- {r['label']}: {r['linked']} of {r['total']}, missing {r['missing']}" for r in links.orderBy("label").collect()]
    return "\n".join(lines) + "\n"
