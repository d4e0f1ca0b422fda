"""Entities and relations from text by pattern packs, and the ordered merges that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planweave.config import DEFAULT
from planweave.functions import packs
from planweave.functions.text import canonical_type, ustrip, window
from planweave.operators.chunking import first_wins
from planweave.session import spread

SPAN = "struct<start_pos:int,end_pos:int,ord:int,confidence:double,name:string,entity_type:string>"


def offsets(text: Column, found: Column) -> Column:
    """``array<struct<name, start_pos, end_pos>>`` of matches in order; exact as long as patterns have no anchors or look-around.

    Each match is looked for from the end of the one before: an earlier place of the same string would itself
    have matched first.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<name:string,start_pos:int,end_pos:int>>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        p = (F.position(m, text, acc["at"] + 1) - 1).cast("int")
        end = p + F.length(m)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(m.alias("name"), p.alias("start_pos"), end.alias("end_pos")))).alias("out"))

    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _as_span(k: int, label: str, confidence: float):
    def one(s: Column, i: Column) -> Column:
        place = (F.lit(k * 100_000) + i).cast("int").alias("ord")
        return F.struct(s["start_pos"].alias("start_pos"), s["end_pos"].alias("end_pos"), place, F.lit(float(confidence)).alias("confidence"), s["name"].alias("name"), F.lit(label).alias("entity_type"))

    return one


def entity_matches(text: Column, patterns: list[tuple[str, str]] | None = None, confidence: float = DEFAULT.pattern_confidence) -> Column:
    """All matches of all patterns as an array of SPAN, ``ord`` being the order in which patterns and matches come."""
    parts = []
    for k, (kind, pattern) in enumerate(patterns or packs.ENTITY_PATTERNS):
        label = packs.TYPE_MAP.get(kind, kind)
        spans = offsets(text, F.regexp_extract_all(text, F.lit(packs.anchored(pattern)), 0))
        parts.append(F.transform(spans, _as_span(k, label, confidence)))
    return F.when(F.length(text) > 0, F.flatten(F.array(*parts))).otherwise(F.array().cast(f"array<{SPAN}>"))


def merge_overlaps(spans: Column) -> Column:
    """Spans without overlaps, surest first: taken by start and end, a span that overlaps the last kept one replaces it only if it is surer.

    Kept spans never overlap and candidates come by start, so only the last kept span can overlap the next.
    Spans at (-1, -1) overlap nothing.
    """
    none = F.array().cast(f"array<{SPAN}>")

    def step(kept: Column, s: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        overlaps = F.coalesce((s["start_pos"] < last["end_pos"]) & (s["end_pos"] > last["start_pos"]), F.lit(False))
        surer = s["confidence"] > last["confidence"]
        return F.when(~overlaps, F.concat(kept, F.array(s))).when(surer, F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))).otherwise(kept)

    merged = F.aggregate(F.array_sort(spans), none, step)
    by_confidence = F.array_sort(F.transform(merged, lambda s, i: F.struct((-s["confidence"]).alias("c"), i.alias("i"), s.alias("s"))))
    return F.transform(by_confidence, lambda x: x["s"])


def entity_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, name, entity_type, start_pos, end_pos, confidence, source_text, ord)``: pattern matches of each text after the merge.

    Null and empty texts have none. Matching, offsets and merge all happen in the row of the text, without a shuffle.
    """
    t = F.col(text)
    merged = spread(documents.select(key, text)).select(key, text, F.posexplode(merge_overlaps(entity_matches(t))).alias("ord", "s"))
    return merged.select(key, "s.name", "s.entity_type", "s.start_pos", "s.end_pos", "s.confidence", window(t, F.col("s.start_pos"), F.col("s.end_pos")).alias("source_text"), "ord")


def combine_channels(spans: DataFrame, key: str, run: int = 1_000) -> DataFrame:
    """Spans of several channels merged per ``key``; ``chan`` orders the channels, the model's before the patterns'.

    A span that begins where all before it have ended cannot overlap a kept one, so the merge starts afresh there: a key is
    merged in runs of about ``run`` spans that begin at such places, and only a chain of overlaps makes a run longer.
    Spans are numbered in order, so ``chan`` and ``ord`` may be of any size; nulls among them come last.
    """
    order = ["start_pos", "end_pos", F.col("chan").asc_nulls_last(), F.col("ord").asc_nulls_last(), "confidence", "name", "entity_type"]
    inside = Window.partitionBy(key).orderBy(*order)
    ended = F.max("end_pos").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumns({"n_": F.row_number().over(inside), "afresh_": F.coalesce(F.col("start_pos") >= ended, F.lit(True))})
    since = F.max(F.when(F.col("afresh_"), F.col("n_"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    span = F.struct("start_pos", "end_pos", F.col("n_").alias("ord"), "confidence", "name", "entity_type")
    packed = numbered.withColumn("run_", F.floor(since / run)).groupBy(key, "run_").agg(F.collect_list(span).alias("spans"))
    kept = packed.select(key, F.explode(merge_overlaps(F.col("spans").cast(f"array<{SPAN}>"))).alias("s")).select(key, "s.*")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("confidence").desc_nulls_first(), "ord")) - 1
    return kept.select(key, place.alias("place"), "name", "entity_type", "start_pos", "end_pos", "confidence")


def dedupe_entities(entities: DataFrame, document: str = "document_id") -> DataFrame:
    """The first entity of each name and canonical type of a document: by chunk, then surest, then place, then id; null names are left out."""
    typed = entities.where("name is not null").withColumn("entity_type", canonical_type(F.col("entity_type"), F.col("name")))
    order = [F.coalesce(F.col("chunk_index"), F.lit(0)), -F.coalesce(F.col("confidence"), F.lit(0.0)), F.coalesce(F.col("start_pos"), F.lit(-1)), F.coalesce(F.col("end_pos"), F.lit(-1)), F.col("entity_id")]
    return first_wins(typed, [document, "name", "entity_type"], order)


def dedupe_by_position(entities: DataFrame, document: str = "document_id") -> DataFrame:
    """The first entity at each ``(start_pos, end_pos)`` of a document's chunk, by id."""
    return first_wins(entities, [document, "chunk_index", "start_pos", "end_pos"], [F.col("entity_id")])


def _as_triple(k: int, predicate: str, subject_type: str, object_type: str, pattern: str):
    def one(s: Column, i: Column) -> Column:
        # the groups are read from the match alone, so a text is searched once for each pattern
        end = lambda g: ustrip(F.regexp_extract(s["name"], pattern, g))
        return F.struct((F.lit(k * 100_000) + i).alias("ord"), end(1).alias("subject"), F.lit(predicate).alias("predicate"), end(2).alias("object"), F.lit(subject_type).alias("subject_type"), F.lit(object_type).alias("object_type"), s["start_pos"].alias("s"), s["end_pos"].alias("e"))

    return one


def pattern_relations(documents: DataFrame, key: str = "doc_id", text: str = "text", confidence: float = DEFAULT.pattern_confidence) -> DataFrame:
    """``(key, subject, predicate, object, subject_type, object_type, confidence, source_text)``: the first of each triple in order of patterns."""
    t = F.col(text)
    parts = []
    for k, (predicate, subject_type, object_type, pattern) in enumerate(packs.RELATION_PATTERNS):
        matches = F.regexp_extract_all(t, F.lit(packs.anchored(pattern)), 0)
        parts.append(F.transform(offsets(t, matches), _as_triple(k, predicate, subject_type, object_type, pattern)))
    rows = spread(documents.select(key, text)).where(F.length(text) > 0).select(key, text, F.explode(F.flatten(F.array(*parts))).alias("r")).where("r.subject <> '' and r.object <> ''")
    flat = rows.select(key, "r.ord", "r.subject", "r.predicate", "r.object", "r.subject_type", "r.object_type", F.lit(float(confidence)).alias("confidence"), window(t, F.col("r.s"), F.col("r.e")).alias("source_text"))
    return first_wins(flat, [key, "subject", "predicate", "object"], [F.col("ord")]).drop("ord")


def dedupe_relations(relations: DataFrame, least: float = DEFAULT.relation_confidence, document: str = "document_id") -> DataFrame:
    """The first of each triple of a document by chunk and id, types made canonical, if its confidence is at least ``least``.

    The first decides even when a later copy is surer; a null confidence is not sure. Rows with a null end or predicate are left out.
    """
    some = relations.where("subject is not null and predicate is not null and object is not null")
    typed = some.withColumns({c: canonical_type(F.col(c)) for c in ("subject_type", "object_type")})
    return first_wins(typed, [document, "subject", "predicate", "object"], [F.coalesce(F.col("chunk_index"), F.lit(0)), F.col("relation_id")]).where(F.col("confidence") >= least)


def type_hints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the types of their ends as the entities of the same document know them; the last entity of a name decides, 未知 for none."""
    known = entities.where("name is not null").groupBy("document_id", "name").agg(F.max_by("entity_type", "entity_id").alias("t"))
    out = relations
    for end in ("subject", "object"):
        side = known.select("document_id", F.col("name").alias(end), F.col("t").alias(f"{end}_hint"))
        out = out.join(side, ["document_id", end], "left").withColumn(f"{end}_hint", F.coalesce(f"{end}_hint", F.lit(packs.UNKNOWN)))
    return out


def chunk_hints(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """``(document_id, chunk_index, hints)``: sorted names of the entities first seen in each chunk, [] for none."""
    names = entities.groupBy("document_id", "chunk_index").agg(F.array_sort(F.collect_set("name")).alias("hints"))
    return chunks.join(names, ["document_id", "chunk_index"], "left").withColumn("hints", F.coalesce("hints", F.array().cast("array<string>")))


def distributions(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(kind, name, n)``: entities by type and relations by predicate."""
    count = F.count(F.lit(1)).alias("n")
    return entities.groupBy(F.lit("entity").alias("kind"), F.col("entity_type").alias("name")).agg(count).unionByName(relations.groupBy(F.lit("relation").alias("kind"), F.col("predicate").alias("name")).agg(count))
