"""The queries for the engine's own operators over the tables of a data directory, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.config import DEFAULT
from planweave.functions import packs, payload, prompts, text, vectors
from planweave.operators import alias, chunking, extract, graph, ontology, resolve, search
from planweave.sources import readers
from planweave.streaming import rules as streaming
from planweave.sources.providers import Offline, ask, entailment, trace
from planweave.plans import pipeline
from planweave.session import cut, shared_folder, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Similarity of the vector queries: the test vectors are random, so near ones are rarer than in real embeddings.
NEAR = 0.3
PROBE = 7


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# SQL pieces ------------------------------------------------------------------------------------------------

_SP = r"[\s\p{Z}\x{b}\x{1c}-\x{1f}\x{85}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_SP}+|{_SP}+$', '', 'g')"


def _or_null(c: str) -> str:
    return f"nullif({_strip(c)}, '')"


def _in(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _canonical(kind: str, name: str | None = None) -> str:
    t = _strip(f"coalesce({kind}, '')")
    cases = f"WHEN {t} IN ({_in(packs.LABELS)}) THEN {t} " + " ".join(f"WHEN {t} = '{a}' THEN '{b}'" for a, b in packs.TYPE_MAP.items())
    if name:
        cases += " " + " ".join(f"WHEN {' OR '.join(f"contains({name}, '{p}')" for p in parts)} THEN '{label}'" for label, parts in packs.NAME_HINTS)
    return f"CASE {cases} ELSE {t} END"


def _mangled(c: str) -> str:
    return f"replace(replace({c}, ' ', '_'), '...', '_')"


_LABEL_ROWS = ", ".join(f"('{v}')" for v in packs.LABELS)

_RULES = rf"""
rules_all AS (
  SELECT record_id, rule_id, rule_name, rule_text, elements, rule_tags, rule_source, coalesce({_or_null("rule_source")}, {_or_null("source_name")}) AS source_name FROM rules
  UNION ALL
  SELECT record_id, body->>'rule_id', body->>'rule_name', body->>'rule_text', CAST(body->'elements' AS VARCHAR[]), CAST(body->'rule_tags' AS VARCHAR[]), body->>'rule_source',
    coalesce({_or_null("body->>'rule_source'")}, regexp_extract(file_name, '([^/]+?)(\.[^./]*)?$', 1)) FROM (SELECT record_id, body::JSON AS body, file_name FROM rule_json)
), shaped AS (
  SELECT record_id, rule_id, coalesce({_or_null("rule_name")}, '{packs.DEFAULT_RULE_NAME}') AS rule_name, {_strip("rule_text")} AS rule_text, elements,
    CASE WHEN len(rule_tags) > 0 THEN rule_tags ELSE ['{packs.DEFAULT_RULE_TAG}'] END AS rule_tags, coalesce({_or_null("source_name")}, '{packs.UNKNOWN}') AS source_name
  FROM rules_all WHERE length({_strip("rule_text")}) > 0
)
"""

_ENTITIES = f"""
typed AS (SELECT * REPLACE ({_canonical("entity_type", "name")} AS entity_type) FROM entities WHERE name IS NOT NULL),
first_entities AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, name, entity_type ORDER BY coalesce(chunk_index, 0), -coalesce(confidence, 0), coalesce(start_pos, -1), coalesce(end_pos, -1), entity_id) AS rn FROM typed) WHERE rn = 1
)
"""

_GRAPH = f"""
node_rows AS (SELECT {_canonical("entity_type", "name")} AS label, name, source_name, description, aliases, document_id, chunk_index, entity_id AS seq FROM entities WHERE name IS NOT NULL AND source_name IS NOT NULL),
nodes AS (
  SELECT label, name, source_name, arg_max(description, seq) FILTER (description IS NOT NULL) AS description, arg_max(aliases, seq) FILTER (aliases IS NOT NULL) AS aliases,
    arg_max(document_id, seq) FILTER (document_id IS NOT NULL) AS document_id, arg_max(chunk_index, seq) FILTER (chunk_index IS NOT NULL) AS chunk_index
  FROM node_rows WHERE label <> '' GROUP BY ALL
), resolved AS (
  SELECT s.label AS src_label, s.name AS src_name, s.source_name AS src_source, {_mangled("r.predicate")} AS type, o.label AS dst_label, o.name AS dst_name, o.source_name AS dst_source, r.source_name, r.document_id, r.chunk_index, r.confidence, r.relation_id AS seq
  FROM relations r JOIN nodes s ON r.subject = s.name AND (r.source_name IS NULL OR r.source_name = s.source_name) JOIN nodes o ON r.object = o.name AND (r.source_name IS NULL OR r.source_name = o.source_name)
  WHERE r.predicate IS NOT NULL
), edges AS (
  SELECT src_label, src_name, src_source, type, dst_label, dst_name, dst_source, arg_max(source_name, seq) FILTER (source_name IS NOT NULL) AS source_name, arg_max(document_id, seq) FILTER (document_id IS NOT NULL) AS document_id,
    arg_max(chunk_index, seq) FILTER (chunk_index IS NOT NULL) AS chunk_index, arg_max(confidence, seq) FILTER (confidence IS NOT NULL) AS confidence
  FROM resolved GROUP BY src_label, src_name, src_source, type, dst_label, dst_name, dst_source
), flagged AS (
  SELECT *, confidence >= 0.85 AS is_bridge, CAST(NULL AS BOOLEAN) AS is_meta, CAST(NULL AS BOOLEAN) AS stat_edge, chunk_index % 2 = 0 AS is_llm_generated FROM edges
)
"""

_LINKED = f"""
type_nodes AS (SELECT DISTINCT '{packs.TYPE_LABEL}' AS label, unnest([{_in(packs.LABELS)}]) AS name, source_name FROM nodes),
links AS (SELECT label AS src_label, name AS src_name, source_name AS src_source, '{packs.OF_TYPE}' AS type, '{packs.TYPE_LABEL}' AS dst_label, label AS dst_name, source_name AS dst_source FROM nodes WHERE label IN ({_in(packs.LABELS)}) AND length(name) % 3 <> 0),
faulty AS (
  SELECT * FROM links
  UNION ALL SELECT src_label, src_name, src_source, type, src_label, src_name, src_source FROM links WHERE length(src_name) % 5 = 0
  UNION ALL SELECT dst_label, dst_name, dst_source, type, dst_label, dst_name, dst_source || '_' FROM links WHERE length(src_name) % 7 = 0
  UNION ALL SELECT src_label, src_name, src_source, type, '{packs.SOURCE_LABEL}', src_source, src_source FROM links WHERE length(src_name) % 11 = 0
  UNION ALL SELECT src_label, src_name, src_source, type, dst_label, dst_name, dst_source FROM edges
), marked AS (
  SELECT *, CASE WHEN type <> '{packs.OF_TYPE}' THEN NULL WHEN src_label = dst_label AND src_name = dst_name AND src_source = dst_source THEN 'self_loop' WHEN src_label = '{packs.TYPE_LABEL}' THEN 'from_type' WHEN dst_label <> '{packs.TYPE_LABEL}' THEN 'to_other' END AS fault FROM faulty
), clean AS (SELECT * EXCLUDE (fault) FROM marked WHERE fault IS NULL)
"""


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return readers.shape_rules(readers.table_rules(table(spark, d, "rules"), table(spark, d, "rule_json")))


def _ordered_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d).withColumn("ord", F.col("record_id"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return graph.graph_of(table(spark, d, "entities"), table(spark, d, "relations"))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    flags = {"is_bridge": F.col("confidence") >= 0.85, "is_meta": F.lit(None).cast("boolean"), "stat_edge": F.lit(None).cast("boolean"), "is_llm_generated": F.col("chunk_index") % 2 == 0}
    return _graph(spark, d)[1].withColumns(flags)


def _faulty(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges with type edges of which some are missing and some are wrong in each of the three ways."""
    nodes, edges = _graph(spark, d)
    nodes = cut(nodes)
    links = graph.type_links(nodes).where(F.length("src_name") % 3 != 0)
    n = F.length("src_name")
    loops = links.where(n % 5 == 0).withColumns({"dst_label": F.col("src_label"), "dst_name": F.col("src_name"), "dst_source": F.col("src_source")})
    from_type = links.where(n % 7 == 0).withColumns({"src_label": F.col("dst_label"), "src_name": F.col("dst_name"), "src_source": F.col("dst_source"), "dst_source": F.concat("dst_source", F.lit("_"))})
    other = links.where(n % 11 == 0).withColumns({"dst_label": F.lit(packs.SOURCE_LABEL), "dst_name": F.col("src_source"), "dst_source": F.col("src_source")})
    out = links
    for part in (loops, from_type, other, edges.select(*graph.EDGE_KEY)):
        out = out.unionByName(part)
    return nodes, cut(out)


# loading, groups, chunks -----------------------------------------------------------------------------------


@query(f"WITH {_RULES} SELECT record_id, rule_id, rule_name, rule_text, array_to_string(elements, '|') AS elements, array_to_string(rule_tags, '|') AS rule_tags, source_name FROM shaped")
def load_rules(spark, d):
    return _rules(spark, d).select("record_id", "rule_id", "rule_name", "rule_text", F.array_join("elements", "|").alias("elements"), F.array_join("rule_tags", "|").alias("rule_tags"), "source_name")


@query(
    f"""WITH {_RULES}, n AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY record_id) AS rn, coalesce({_or_null("rule_id")}, 'doc_' || record_id) AS rid FROM shaped),
g AS (SELECT source_name, (rn - 1) // 12 AS b, count(*) AS n, string_agg(rid, '|' ORDER BY rn) AS members, md5(string_agg('【' || rid || '】' || rule_text, chr(10) ORDER BY rn)) AS text_md5 FROM n GROUP BY ALL)
SELECT 'group_' || source_name || '_' || (b * 12 + 1) || '_' || (b * 12 + n) AS group_id, source_name, members, text_md5 FROM g"""
)
def group_rules(spark, d):
    return chunking.group_rules(_ordered_rules(spark, d)).select("group_id", "source_name", F.array_join("members", "|").alias("members"), F.md5("group_text").alias("text_md5"))


@query(f"WITH {_RULES} SELECT source_name, rule_text, min(record_id) AS record_id FROM shaped GROUP BY ALL")
def dedupe_rules(spark, d):
    return chunking.first_wins(_rules(spark, d).select("source_name", "rule_text", "record_id"), ["source_name", "rule_text"], [F.col("record_id")])


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def batch_ids(spark, d):
    return chunking.batches(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "batch")


@query(
    f"""WITH RECURSIVE s AS (SELECT document, section_index, {_strip("max(text)")} AS t FROM sections WHERE length({_strip("text")}) > 0 AND document IS NOT NULL GROUP BY document, section_index),
n AS (SELECT document, t, length(t) // 4 AS k, row_number() OVER (PARTITION BY document ORDER BY section_index) AS i FROM s),
r(document, i, chunk, k, last, no) AS (
  SELECT document, i, t, k, t, 0 FROM n WHERE i = 1
  UNION ALL
  SELECT n.document, n.i, CASE WHEN r.k + n.k > 1024 THEN r.last || n.t ELSE r.chunk || n.t END, CASE WHEN r.k + n.k > 1024 THEN length(r.last) // 4 + n.k ELSE r.k + n.k END, n.t, CASE WHEN r.k + n.k > 1024 THEN r.no + 1 ELSE r.no END
  FROM r JOIN n ON n.document = r.document AND n.i = r.i + 1
)
SELECT document, CAST(no AS INTEGER) AS chunk_index, md5(arg_max(chunk, i)) AS text_md5 FROM r GROUP BY document, no"""
)
def chunk_paragraphs(spark, d):
    return chunking.paragraph_chunks(table(spark, d, "sections")).select("document", "chunk_index", F.md5("chunk_text").alias("text_md5"))


def _sentences(c: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({c}, '[。！？；]{_SP}*'), lambda x: {_strip('x')}), lambda x: x <> '')"


#: The longest run of last sentences of ``now`` whose tokens together are within the overlap.
_TAIL = f"""(WITH l AS (SELECT {_sentences("r.now")} AS v), j AS (SELECT v, min(k) AS k FROM l, unnest(generate_series(1, len(v))) AS g(k) WHERE list_sum(list_transform(v[k:], lambda x: length(x) // 2)) <= {DEFAULT.overlap_tokens} GROUP BY v)
  SELECT coalesce((SELECT array_to_string(v[k:], '。') || '。' FROM j), ''))"""


@query(
    f"""WITH RECURSIVE long AS (SELECT doc_id, unnest({_sentences("text")}) AS s, generate_subscripts({_sentences("text")}, 1) AS i FROM documents WHERE length(text) // 2 > {DEFAULT.chunk_tokens}),
r(doc_id, i, now, n, no) AS (
  SELECT doc_id, 1, s, length(s) // 2, 0 FROM long WHERE i = 1
  UNION ALL
  SELECT doc_id, i, CASE WHEN is_full THEN tail || s ELSE now || '。' || s END, CASE WHEN is_full THEN length(tail || s) // 2 ELSE n + length(s) // 2 END, no + CASE WHEN is_full THEN 1 ELSE 0 END
  FROM (SELECT r.doc_id, l.i, l.s, r.now, r.n, r.no, r.n + length(l.s) // 2 > {DEFAULT.chunk_tokens} AS is_full, CASE WHEN r.n + length(l.s) // 2 > {DEFAULT.chunk_tokens} THEN {_TAIL} END AS tail FROM r JOIN long l ON l.doc_id = r.doc_id AND l.i = r.i + 1)
)
SELECT doc_id, CAST(no AS INTEGER) AS chunk_index, arg_max(now, i) AS chunk_text FROM r GROUP BY doc_id, no
UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) > 0 AND length(text) // 2 <= {DEFAULT.chunk_tokens}"""
)
def chunk_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"))).alias("chunk_index", "chunk_text"))


@query(
    f"""WITH l AS (SELECT doc_id, {_sentences("text")} AS v FROM documents WHERE text IS NOT NULL),
j AS (SELECT doc_id, min(k) AS k FROM (SELECT doc_id, v, unnest(generate_series(1, len(v))) AS k FROM l) WHERE list_sum(list_transform(v[k:], lambda x: length(x) // 2)) <= {DEFAULT.overlap_tokens} GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(array_to_string(l.v[j.k:], '。') || '。', '') END AS tail FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN j ON j.doc_id = d.doc_id"""
)
def overlap_tails(spark, d):
    """What the next chunk would begin with, were each text a chunk."""
    return table(spark, d, "documents").select("doc_id", chunking.overlap_tail(F.col("text"), DEFAULT.overlap_tokens, 2).alias("tail"))


# extraction ------------------------------------------------------------------------------------------------

_MATCHES = " UNION ALL ".join(f"SELECT '{packs.TYPE_MAP.get(k, k)}' AS entity_type, unnest(regexp_extract_all(text, '{p}')) AS name FROM documents" for k, p in packs.ENTITY_PATTERNS)


@query(f"SELECT entity_type, name, count(*) AS n FROM ({_MATCHES}) GROUP BY ALL")
def entity_matches(spark, d):
    docs = spread(table(spark, d, "documents").select("text")).select(F.explode(extract.entity_matches(F.col("text"))).alias("s"))
    return docs.groupBy("s.entity_type", "s.name").agg(F.count(F.lit(1)).alias("n"))


#: Places of the matches: what a pattern leaves between its matches tells where they lie. All are equally sure, so of two that overlap the first by place stays.
_SPANS = f"""
found AS ({" UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{packs.TYPE_MAP.get(kind, kind)}' AS entity_type, regexp_extract_all(text, '{x}') AS m, regexp_split_to_array(text, '{x}') AS apart FROM documents" for k, (kind, x) in enumerate(packs.ENTITY_PATTERNS))}),
each_match AS (SELECT doc_id, k, entity_type, unnest(m) AS name, unnest(apart[1:len(m)]) AS ahead, generate_subscripts(m, 1) AS i FROM found WHERE len(m) > 0),
placed AS (SELECT doc_id, k, i, entity_type, name, sum(length(ahead) + length(name)) OVER (PARTITION BY doc_id, k ORDER BY i) AS end_pos FROM each_match),
ordered AS (SELECT doc_id, entity_type, name, end_pos - length(name) AS start_pos, end_pos, row_number() OVER (PARTITION BY doc_id ORDER BY end_pos - length(name), end_pos, k, i) AS n FROM placed),
kept(doc_id, n, last_end, taken) AS (
  SELECT doc_id, n, end_pos, true FROM ordered WHERE n = 1
  UNION ALL
  SELECT o.doc_id, o.n, CASE WHEN o.start_pos >= q.last_end THEN o.end_pos ELSE q.last_end END, o.start_pos >= q.last_end FROM kept q JOIN ordered o ON o.doc_id = q.doc_id AND o.n = q.n + 1
),
spans AS (SELECT o.*, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.n) - 1 AS ord FROM ordered o JOIN kept q ON q.doc_id = o.doc_id AND q.n = o.n WHERE q.taken)
"""


@query(
    f"""WITH RECURSIVE {_SPANS}
SELECT doc_id, s.name, s.entity_type, CAST(s.start_pos AS INTEGER) AS start_pos, CAST(s.end_pos AS INTEGER) AS end_pos, CAST({DEFAULT.pattern_confidence} AS DOUBLE) AS confidence,
  substring(d.text, CAST(greatest(s.start_pos - 10, 0) + 1 AS BIGINT), CAST(s.end_pos + 10 - greatest(s.start_pos - 10, 0) AS BIGINT)) AS source_text, CAST(s.ord AS INTEGER) AS ord
FROM spans s JOIN documents d USING (doc_id)"""
)
def entity_spans_merged(spark, d):
    return extract.entity_spans(table(spark, d, "documents"))


@query(f"WITH RECURSIVE {_SPANS} SELECT entity_type, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT DISTINCT doc_id, name, entity_type FROM spans) GROUP BY entity_type")
def entity_type_counts(spark, d):
    """The flagship: documents to spans, overlap merge, the first of each name and type of a document, counts by type."""
    spans = extract.entity_spans(table(spark, d, "documents"))
    first = chunking.first_wins(spans.select("doc_id", "name", "entity_type", "ord"), ["doc_id", "name", "entity_type"], [F.col("ord")])
    return first.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents")).orderBy(F.desc("n"), "entity_type")


@query(f"WITH {_ENTITIES} SELECT document_id, name, entity_type, entity_id, chunk_index, start_pos, confidence FROM first_entities")
def entities_first_wins(spark, d):
    return extract.dedupe_entities(table(spark, d, "entities")).select("document_id", "name", "entity_type", "entity_id", "chunk_index", "start_pos", "confidence")


@query("SELECT document_id, chunk_index, start_pos, end_pos, min(entity_id) AS entity_id FROM entities GROUP BY ALL")
def entities_by_position(spark, d):
    return extract.dedupe_by_position(table(spark, d, "entities")).select("document_id", "chunk_index", "start_pos", "end_pos", "entity_id")


_TRIPLES = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS k, '{p}' AS predicate, '{st}' AS subject_type, '{ot}' AS object_type, unnest(regexp_extract_all(text, '{x}', 1)) AS s, unnest(regexp_extract_all(text, '{x}', 2)) AS o FROM documents"
    for k, (p, st, ot, x) in enumerate(packs.RELATION_PATTERNS)
)


@query(
    f"""WITH m AS (SELECT doc_id, k, predicate, subject_type, object_type, {_strip("s")} AS subject, {_strip("o")} AS object FROM ({_TRIPLES}))
SELECT doc_id, subject, predicate, object, arg_min(subject_type, k) AS subject_type, arg_min(object_type, k) AS object_type FROM m WHERE subject <> '' AND object <> '' GROUP BY doc_id, subject, predicate, object"""
)
def relations_pattern(spark, d):
    return extract.pattern_relations(table(spark, d, "documents")).select("doc_id", "subject", "predicate", "object", "subject_type", "object_type")


_REL_FIRST = f"""
SELECT * FROM (SELECT document_id, subject, predicate, object, {_canonical("subject_type")} AS subject_type, {_canonical("object_type")} AS object_type, confidence, relation_id,
  row_number() OVER (PARTITION BY document_id, subject, predicate, object ORDER BY coalesce(chunk_index, 0), relation_id) AS rn FROM relations WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)
WHERE rn = 1 AND confidence >= 0.5
"""


@query(f"SELECT * EXCLUDE (rn) FROM ({_REL_FIRST})")
def relations_first_wins(spark, d):
    return extract.dedupe_relations(table(spark, d, "relations")).select("document_id", "subject", "predicate", "object", "subject_type", "object_type", "confidence", "relation_id")


@query(
    f"""WITH k AS (SELECT document_id, name, arg_max_null(entity_type, entity_id) AS t FROM entities WHERE name IS NOT NULL GROUP BY ALL)
SELECT DISTINCT r.relation_id, coalesce(a.t, '{packs.UNKNOWN}') AS subject_hint, coalesce(b.t, '{packs.UNKNOWN}') AS object_hint FROM relations r LEFT JOIN k a ON a.document_id = r.document_id AND a.name = r.subject LEFT JOIN k b ON b.document_id = r.document_id AND b.name = r.object"""
)
def relation_type_hints(spark, d):
    return extract.type_hints(table(spark, d, "relations"), table(spark, d, "entities")).select("relation_id", "subject_hint", "object_hint").distinct()


@query(
    f"""WITH {_ENTITIES}, h AS (SELECT document_id, chunk_index, string_agg(DISTINCT name, '|' ORDER BY name) AS hints FROM first_entities GROUP BY ALL), c AS (SELECT DISTINCT document_id, chunk_index FROM relations)
SELECT document_id, chunk_index, coalesce(hints, '') AS hints FROM c LEFT JOIN h USING (document_id, chunk_index)"""
)
def chunk_entity_hints(spark, d):
    chunks = table(spark, d, "relations").select("document_id", "chunk_index").distinct()
    return extract.chunk_hints(chunks, extract.dedupe_entities(table(spark, d, "entities"))).select("document_id", "chunk_index", F.array_join("hints", "|").alias("hints"))


def _elements_sql() -> str:
    keys = " ".join(f"WHEN lower({_strip('x')}) IN ({_in(v)}) THEN '{k}'" for k, v in packs.ELEMENT_KEYS.items())
    t = "rule_text"
    shown = f"""CASE WHEN {" OR ".join(f"contains({t}, '{m}')" for m in packs.ACTION_MARKERS)} THEN 'Action' END, CASE WHEN regexp_matches({t}, '{packs.CONDITION}') THEN 'Condition' END,
      CASE WHEN regexp_matches({t}, '{packs.TIME_LIMIT}') THEN 'Time' END, CASE WHEN strpos({t}, nullif(regexp_extract({t}, '{packs.NORM_VERB}', 1), '')) >= 3 THEN 'Subject' END, CASE WHEN regexp_matches({t}, '{packs.OBJECT_MARK}') THEN 'Object' END"""
    return f"SELECT record_id, list_sort(list_distinct(list_filter(list_concat(list_transform(coalesce(elements, []), lambda x: CASE {keys} END), [{shown}]), lambda x: x IS NOT NULL))) AS e FROM shaped"


@query(f"WITH {_RULES}, e AS ({_elements_sql()}) SELECT record_id, array_to_string(e, '|') AS elements FROM e")
def semantic_elements(spark, d):
    return _rules(spark, d).select("record_id", F.array_join(text.semantic_elements(F.col("rule_text"), F.col("elements")), "|").alias("elements"))


@query(f"WITH {_RULES}, e AS ({_elements_sql()}) SELECT record_id FROM e WHERE len(e) >= 2 AND (list_contains(e, 'Action') OR list_contains(e, 'Condition'))")
def rule_filter(spark, d):
    return _rules(spark, d).where(text.admissible(text.semantic_elements(F.col("rule_text"), F.col("elements")))).select("record_id")


# scalars ---------------------------------------------------------------------------------------------------


@query(
    rf"""WITH t AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length({_strip("text")}) > 0 THEN len(regexp_split_to_array({_strip("text")}, '{_SP}+')) ELSE 0 END AS w,
  len(regexp_extract_all(text, '[一-龥]')) AS h, len(regexp_extract_all(text, '\p{{Nd}}+')) AS d, len(regexp_extract_all(text, '[，。！？；："（）()【】\[\]<>《》]')) AS p FROM documents WHERE length(text) > 0)
SELECT doc_id, n AS char_count, w AS word_count, len(regexp_split_to_array(text, '[。！？；]')) AS sentence_count, h AS chinese_chars, round(h / n, 6) AS chinese_ratio, d AS numbers, CASE WHEN w > 0 THEN round(d / w, 6) ELSE 0.0 END AS number_ratio, p AS punctuations, round(p / n, 6) AS punctuation_ratio FROM t"""
)
def text_features(spark, d):
    return table(spark, d, "documents").where(F.length("text") > 0).select("doc_id", *[(v if "ratio" in k else v.cast("long")).alias(k) for k, v in text.features(F.col("text")).items()])


_ONE_BLANK = f"regexp_replace(coalesce(text, ''), '{_SP}+', ' ', 'g')"
_KEPT = r"""'[^一-龥a-zA-Z0-9\s。，！？；："（）()【】\[\]<>《》]'"""
_CLEAN = f"regexp_replace(regexp_replace({_ONE_BLANK}, {_KEPT}, '', 'g'), '[。，！？；：]{{2,}}', '。', 'g')"


@query(f"SELECT doc_id, {_strip(_CLEAN)} AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


_WIDE, _NARROW = "　" + "".join(chr(o) for o in range(0xFF01, 0xFF5F)), " " + "".join(chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F)).replace("'", "''")


@query(f"""SELECT doc_id, {_strip(f"regexp_replace(translate(translate(coalesce(text, ''), '{_WIDE}', '{_NARROW}'), '（）—–', '()--'), '{_SP}+', ' ', 'g')")} AS normal FROM documents""")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_text(F.col("text")).alias("normal"))


@query("SELECT doc_id, md5(text) AS md5, sha256(coalesce(text, '')) AS sha256, coalesce(length(text), 0) // 2 AS tokens2, coalesce(length(text), 0) // 4 AS tokens4, strftime(to_timestamp(doc_id * 1000)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS stamp FROM documents")
def text_hashes(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.text_hash(c).alias("md5"), text.prompt_hash(c).alias("sha256"), text.token_estimate(c, 2).cast("long").alias("tokens2"), text.token_estimate(c, 4).cast("long").alias("tokens4"), text.format_epoch(F.col("doc_id") * 1000).alias("stamp"))


@query(
    rf"SELECT DISTINCT entity_id, coalesce(length({_strip('name')}) >= 2 AND NOT regexp_full_match(name, '\p{{Nd}}+') AND len(regexp_extract_all(name, '[^一-龥a-zA-Z0-9]')) <= length(name) * 0.3, false) AS valid FROM entities"
)
def entity_valid(spark, d):
    return table(spark, d, "entities").select("entity_id", text.valid_entity(F.col("name")).alias("valid")).distinct()


@query(
    f"SELECT DISTINCT relation_id, coalesce(length({_strip('subject')}) >= 2 AND length({_strip('predicate')}) >= 2 AND length({_strip('object')}) >= 2 AND {_strip('subject')} <> {_strip('object')}, false) AS valid, {_mangled('predicate')} AS type FROM relations"
)
def relation_valid(spark, d):
    return table(spark, d, "relations").select("relation_id", text.valid_relation(F.col("subject"), F.col("predicate"), F.col("object")).alias("valid"), text.relation_type(F.col("predicate")).alias("type")).distinct()


@query("SELECT DISTINCT entity_id, strpos(source_text, name) - 1 AS at, substring(source_text, greatest(strpos(source_text, name) - 1 - 10, 0) + 1, strpos(source_text, name) - 1 + length(name) + 10 - greatest(strpos(source_text, name) - 1 - 10, 0)) AS around FROM entities WHERE strpos(source_text, name) > 0")
def entity_evidence(spark, d):
    at = text.find(F.col("source_text"), F.col("name"))
    rows = table(spark, d, "entities").withColumn("at", at).where("at >= 0")
    return rows.select("entity_id", F.col("at").cast("long").alias("at"), text.window(F.col("source_text"), F.col("at"), F.col("at") + F.length("name")).alias("around")).distinct()


@query("SELECT event_id, coalesce(json_extract_string(props, '$.device'), json_extract_string(props, '$.page'), 'none') AS picked FROM events")
def safe_get(spark, d):
    props = F.from_json("props", "map<string,string>")
    return table(spark, d, "events").select("event_id", text.safe_get(props, "device", text.safe_get(props, "page", F.lit("none"))).alias("picked"))


# vectors ---------------------------------------------------------------------------------------------------

_V = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_PROBE = f"p AS (SELECT e AS q FROM v WHERE vec_id = (SELECT min(vec_id) + {PROBE} FROM v))"


def _probe(spark, d) -> list[float]:
    rows = table(spark, d, "embeddings")
    least = rows.agg(F.min("vec_id")).first()[0]
    return list(rows.where(F.col("vec_id") == least + PROBE).first()["embedding"])


@query(f"WITH {_V} SELECT vec_id, len(e) AS dim, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm_l2 FROM v")
def embedding_stats(spark, d):
    return alias.embedding_stats(table(spark, d, "embeddings"), "vec_id", "embedding").withColumn("dim", F.col("dim").cast("long"))


@query(f"WITH {_V}, n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM v) SELECT vec_id, round(list_sum(list_transform(e, lambda x: x / l)), 6) AS total, round(e[1] / l, 6) AS first FROM n")
def embedding_normalized(spark, d):
    v = vectors.normalized(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", v.alias("v")).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.get("v", F.lit(0)), 6).alias("first"))


@query(f"WITH {_V}, {_PROBE} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS similarity FROM v, p ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return search.top_k(table(spark, d, "embeddings"), "embedding", _probe(spark, d), "vec_id", 20).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH {_V}, {_PROBE}, r AS (SELECT vec_id, list_cosine_similarity(e, q) AS s FROM v, p WHERE label % 2 = 0 ORDER BY s DESC, vec_id LIMIT 10)
SELECT vec_id, round(s, 6) AS similarity, CASE WHEN (SELECT max(s) FROM r) >= 0.6 THEN 'rule' ELSE 'weak_rule' END AS tier FROM r"""
)
def tiered_search(spark, d):
    rows = table(spark, d, "embeddings")
    out = search.tiered(rows.where("label % 2 = 0"), rows.where("label % 2 = 1"), "embedding", _probe(spark, d), "vec_id", 10)
    return out.select("vec_id", F.round("similarity", 6).alias("similarity"), "tier")


#: The query set of the searches: every row whose id this divides, against all rows.
EVERY = 50
_EVERY = f"s AS (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(v.e, q.e), 12) AS s FROM v, v q WHERE q.vec_id % {EVERY} = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) AS n FROM s)"


@query(f"WITH {_V}, {_EVERY} SELECT query, vec_id, round(s, 6) AS similarity FROM r WHERE n <= 20")
def cosine_topk_set(spark, d):
    rows = table(spark, d, "embeddings")
    return search.top_k_set(rows, rows.where(F.col("vec_id") % EVERY == 0), "embedding", "vec_id", 20).select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_V}, {_EVERY} SELECT query, vec_id, round(s, 6) AS similarity, CASE WHEN max(s) OVER (PARTITION BY query) >= 0.6 THEN 'rule' ELSE 'weak_rule' END AS tier FROM r WHERE n <= 10")
def tiered_search_set(spark, d):
    """The table does not tell rules from chunks, so every row stands in both tiers and none goes unsearched."""
    rows = table(spark, d, "embeddings")
    out = search.tiered_set(rows, rows, rows.where(F.col("vec_id") % EVERY == 0), "embedding", "vec_id", 10)
    return out.select("query", F.col("key").alias("vec_id"), F.round("similarity", 6).alias("similarity"), "tier")


_NEAR = f"""{_V}, u AS (SELECT vec_id, label, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
pairs AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, list_dot_product(a.e, b.e) AS sim FROM u a JOIN u b USING (label)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY sim DESC, b) AS r FROM pairs),
near AS (SELECT label, a, b, sim FROM ranked WHERE r <= 64 AND a <> b AND sim > {NEAR}),
linked AS (SELECT label, a, b, max(sim) AS sim FROM (SELECT * FROM near UNION ALL SELECT label, b, a, sim FROM near) GROUP BY ALL)"""


def _near(spark, d):
    return alias.edges(alias.neighbours(table(spark, d, "embeddings"), "label", "vec_id", "embedding", NEAR))


@query(f"WITH {_NEAR} SELECT label, a, b, round(sim, 5) AS sim FROM linked")
def knn_edges(spark, d):
    return _near(spark, d).select(F.col("block").alias("label"), "a", "b", F.round("sim", 5).alias("sim"))


_COMPONENTS = "reach(a, b) AS (SELECT a, b FROM linked UNION SELECT a, a FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a), comp AS (SELECT a AS key, min(b) AS component FROM reach GROUP BY a)"


@query(f"WITH RECURSIVE {_NEAR}, {_COMPONENTS} SELECT key, component FROM comp")
def similar_components(spark, d):
    return alias.components(_near(spark, d))


@query(
    f"""WITH RECURSIVE {_NEAR}, {_COMPONENTS}, deg AS (SELECT a AS key, count(DISTINCT b) AS degree FROM linked GROUP BY a),
m AS (SELECT key, component, degree, 'v' || key AS name, e, label FROM comp JOIN deg USING (key) JOIN u ON u.vec_id = key),
anchors AS (SELECT component, arg_max({{'key': key, 'name': name, 'e': e}}, (degree, -length(name), name, key)) AS x FROM m GROUP BY component)
SELECT label, name AS alias, x.name AS canonical FROM m JOIN anchors USING (component) WHERE key <> x.key AND list_dot_product(m.e, x.e) > {NEAR}"""
)
def alias_map_build(spark, d):
    rows = table(spark, d, "embeddings").withColumn("name", F.concat(F.lit("v"), F.col("vec_id")))
    return alias.alias_map(rows, "label", "vec_id", "name", "embedding", NEAR).withColumnRenamed("block", "label")


# resolution ------------------------------------------------------------------------------------------------

_PAIRS = "pairs AS (SELECT document_id, alias, arg_max(canonical, pair_id) AS canonical FROM alias_map WHERE document_id IS NOT NULL AND alias IS NOT NULL AND canonical IS NOT NULL AND alias <> canonical GROUP BY ALL)"


@query(
    f"""WITH {_PAIRS}, j AS (SELECT e.document_id, coalesce(p.canonical, e.name) AS to_name, e.name, e.entity_type, e.entity_id, e.description, list_concat(coalesce(e.aliases, []), CASE WHEN p.canonical IS NULL THEN [] ELSE [e.name] END) AS own
  FROM entities e LEFT JOIN pairs p ON p.document_id = e.document_id AND p.alias = e.name WHERE e.name IS NOT NULL)
SELECT document_id, to_name AS name, entity_type, array_to_string(list_sort(list_distinct(flatten(list(own)))), '|') AS aliases, arg_min(nullif(description, ''), (name <> to_name, entity_id)) FILTER (description <> '') AS description, count(DISTINCT entity_id) AS members FROM j GROUP BY document_id, to_name, entity_type"""
)
def alias_apply(spark, d):
    out = resolve.apply_aliases(table(spark, d, "entities"), resolve.alias_pairs(table(spark, d, "alias_map")))
    return out.select("document_id", "name", "entity_type", F.array_join("aliases", "|").alias("aliases"), "description", "members")


@query(
    f"""WITH {_PAIRS}, low AS (SELECT document_id, name AS alias, min(upper(name)) AS canonical FROM canonical_entities WHERE name IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(p.document_id, l.document_id) AS document_id, coalesce(p.alias, l.alias) AS alias, coalesce(p.canonical, l.canonical) AS canonical FROM low l FULL JOIN pairs p ON p.document_id = l.document_id AND p.alias = l.alias"""
)
def alias_map_union(spark, d):
    low = table(spark, d, "canonical_entities").where("name is not null and document_id is not null").groupBy("document_id", F.col("name").alias("alias")).agg(F.min(F.upper("name")).alias("canonical"))
    return resolve.merge_maps(low, resolve.alias_pairs(table(spark, d, "alias_map")))


@query(
    f"""WITH {_PAIRS}, j AS (SELECT r.document_id, coalesce(a.canonical, r.subject) AS subject, r.predicate, coalesce(b.canonical, r.object) AS object, r.relation_id, r.confidence FROM relations r LEFT JOIN pairs a ON a.document_id = r.document_id AND a.alias = r.subject
  LEFT JOIN pairs b ON b.document_id = r.document_id AND b.alias = r.object WHERE r.subject IS NOT NULL AND r.predicate IS NOT NULL AND r.object IS NOT NULL)
SELECT document_id, subject, predicate, object, min(relation_id) AS relation_id FROM j GROUP BY ALL"""
    .replace("relation_id, r.confidence", "relation_id")
)
def relation_remap(spark, d):
    return resolve.remap_relations(table(spark, d, "relations"), resolve.alias_pairs(table(spark, d, "alias_map"))).select("document_id", "subject", "predicate", "object", "relation_id")


@query(
    f"""WITH l AS (SELECT document_id, name, coalesce(entity_type, '{packs.UNKNOWN}') AS entity_type, flatten(list(coalesce(aliases, []))) AS aliases, arg_min_null(description, entity_id) AS description, arg_min_null(source_name, entity_id) AS source_name, max(confidence) AS confidence
  FROM entities WHERE name IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL),
c AS (SELECT document_id, {_strip("name")} AS name, coalesce({_or_null("entity_type")}, '{packs.UNKNOWN}') AS entity_type, flatten(list(coalesce(aliases, []))) AS aliases, arg_min_null(description, canon_id) AS description, arg_min_null(source_name, canon_id) AS source_name
  FROM canonical_entities WHERE length({_strip("name")}) > 0 AND document_id IS NOT NULL GROUP BY ALL)
SELECT coalesce(l.document_id, c.document_id) AS document_id, coalesce(l.name, c.name) AS name, coalesce(l.entity_type, c.entity_type) AS entity_type, array_to_string(list_sort(list_distinct(list_concat(coalesce(l.aliases, []), coalesce(c.aliases, [])))), '|') AS aliases,
  coalesce(nullif(l.description, ''), c.description) AS description, coalesce(nullif(l.source_name, ''), c.source_name) AS source_name, CASE WHEN l.document_id IS NULL THEN 0.8 ELSE l.confidence END AS confidence,
  CASE WHEN l.document_id IS NULL THEN 'canonical' WHEN c.document_id IS NULL THEN 'entity' ELSE 'both' END AS origin
FROM l FULL JOIN c ON l.document_id = c.document_id AND l.name = c.name AND l.entity_type = c.entity_type"""
)
def canonical_merge(spark, d):
    out = resolve.merge_canonical(table(spark, d, "entities"), table(spark, d, "canonical_entities"))
    return out.withColumn("aliases", F.array_join("aliases", "|"))


@query(
    """SELECT DISTINCT document_id, name FROM entities e WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.document_id = e.document_id AND (r.subject = e.name OR r.object = e.name) AND e.name <> '')"""
)
def isolated_entities(spark, d):
    return resolve.isolated(table(spark, d, "entities"), table(spark, d, "relations"))


_BRIDGE = f"""b AS (SELECT DISTINCT relation_id, {_strip("subject")} AS subject, {_strip("predicate")} AS predicate, {_strip("object")} AS object, coalesce(nullif(subject_type, ''), '{packs.UNKNOWN}') AS subject_type, coalesce(nullif(object_type, ''), '{packs.UNKNOWN}') AS object_type, coalesce(confidence, 0.7) AS confidence, {_strip("source_text")} AS proof FROM relations),
k AS (SELECT * FROM b WHERE subject <> '' AND predicate <> '' AND object <> '' AND confidence >= 0.85 AND proof <> ''),
w AS (SELECT *, list_filter(list_distinct(string_split(subject || predicate || object, '')), lambda c: NOT contains('根据上述文本，。', c)) AS chars FROM k)"""


@query(
    f"""WITH {_BRIDGE}, s AS (SELECT *, predicate IN ({_in(packs.BRIDGE_PREDICATES)}) AS schema, round(len(list_filter(chars, lambda c: contains(proof, c))) / len(chars), 6) AS score FROM w)
SELECT relation_id, subject, predicate, object, subject_type, object_type, schema AS predicate_is_schema, CASE WHEN NOT schema THEN score END AS entailment_score FROM s WHERE schema OR score >= 0.85"""
)
def bridge_filter(spark, d):
    out = resolve.bridges(table(spark, d, "relations"), entailment(Offline()))
    return out.select("relation_id", "subject", "predicate", "object", "subject_type", "object_type", "predicate_is_schema", "entailment_score").distinct()


# graph -----------------------------------------------------------------------------------------------------


@query(f"WITH {_GRAPH} SELECT label, name, source_name, description, array_to_string(aliases, '|') AS aliases, document_id, chunk_index FROM nodes")
def node_upsert(spark, d):
    return graph.nodes_of(table(spark, d, "entities")).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"WITH {_GRAPH} SELECT * FROM edges")
def edge_upsert(spark, d):
    return _graph(spark, d)[1]


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first_event, arg_max(value, (ts, event_id)) FILTER (value IS NOT NULL) AS last_value FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def event_upsert(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.struct("ts", "event_id").alias("seq"))
    return graph.upsert(rows, ["user_id", "event_type"], "seq", ["event_id"], ["value"]).select("user_id", "event_type", F.col("event_id").alias("first_event"), F.col("value").alias("last_value"))


@query(f"WITH {_GRAPH} SELECT src_label, dst_label, type, count(*) AS n FROM resolved GROUP BY ALL")
def edge_resolution(spark, d):
    nodes, _ = _graph(spark, d)
    rels = table(spark, d, "relations").where("subject is not null and predicate is not null and object is not null")
    return graph.resolve_edges(rels, nodes).groupBy("src_label", "dst_label", "type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, name, source_name, count(*) AS copies FROM (SELECT entity_type AS label, name, source_name FROM entities) GROUP BY ALL HAVING count(*) > 1 OR name IS NULL OR source_name IS NULL")
def key_violations(spark, d):
    return graph.violations(table(spark, d, "entities").select(F.col("entity_type").alias("label"), "name", "source_name"))


@query(
    f"""WITH s AS (SELECT DISTINCT source_name FROM entities WHERE source_name IS NOT NULL)
SELECT '{packs.SOURCE_LABEL}' AS label, source_name AS name, source_name FROM s UNION ALL SELECT '{packs.TYPE_LABEL}', unnest([{_in(packs.LABELS)}]), source_name FROM s"""
)
def meta_nodes(spark, d):
    return graph.meta_nodes(table(spark, d, "entities"))


@query(f"WITH s AS (SELECT DISTINCT source_name FROM entities WHERE source_name IS NOT NULL) SELECT source_name AS src_name, '{packs.HAS_TYPE}' AS type, unnest([{_in(packs.LABELS)}]) AS dst_name FROM s")
def meta_edges(spark, d):
    return graph.meta_edges(table(spark, d, "entities")).select("src_name", "type", "dst_name")


@query(f"WITH {_GRAPH} SELECT 'label' AS kind, label AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM edges GROUP BY ALL")
def graph_statistics(spark, d):
    return graph.statistics(*_graph(spark, d))


@query(f"WITH {_GRAPH} SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")
def graph_totals(spark, d):
    return graph.totals(*_graph(spark, d))


@query(
    f"""WITH {_GRAPH} SELECT source_name, label, count(*) AS n, CAST(grouping(source_name) * 2 + grouping(label) AS INTEGER) AS level FROM nodes GROUP BY GROUPING SETS ((source_name), (label), (source_name, label))"""
)
def nodes_by_source(spark, d):
    return graph.nodes_by_source(graph.nodes_of(table(spark, d, "entities")))


@query(f"WITH {_GRAPH} SELECT source_name, count(*) AS n FROM edges WHERE source_name IS NOT NULL GROUP BY ALL")
def edges_by_source(spark, d):
    return graph.edges_by_source(_graph(spark, d)[1])


@query(
    f"""WITH {_GRAPH} SELECT count(CASE WHEN type = '{packs.HAS_TYPE}' THEN 1 END) AS has_type, count(CASE WHEN type = '{packs.OF_TYPE}' THEN 1 END) AS of_type, count(CASE WHEN is_bridge THEN 1 END) AS is_bridge, count(CASE WHEN is_meta THEN 1 END) AS is_meta, count(CASE WHEN stat_edge THEN 1 END) AS stat_edge, count(CASE WHEN is_llm_generated THEN 1 END) AS is_llm_generated,
count(CASE WHEN is_bridge AND chunk_index = -1 THEN 1 END) AS paragraph_bridges, count(CASE WHEN is_bridge AND is_llm_generated THEN 1 END) AS llm_bridges, count(CASE WHEN NOT coalesce(is_bridge, false) AND is_llm_generated THEN 1 END) AS llm_not_bridge FROM flagged"""
)
def flag_counts(spark, d):
    return graph.flag_counts(_flagged(spark, d))


@query(f"WITH {_GRAPH} SELECT 'source' AS kind, source_name AS name, count(*) AS n FROM flagged WHERE is_bridge GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM flagged WHERE is_bridge GROUP BY ALL")
def bridge_breakdown(spark, d):
    return graph.bridge_breakdown(_flagged(spark, d))


@query(
    f"""WITH {_GRAPH}, l(label) AS (VALUES {_LABEL_ROWS}) SELECT l.label, count(n.name) AS total, count(CASE WHEN n.name IS NOT NULL AND trim(coalesce(description, '')) = '' THEN 1 END) AS no_description, count(CASE WHEN n.name IS NOT NULL AND coalesce(len(aliases), 0) = 0 THEN 1 END) AS no_aliases,
count(CASE WHEN n.name IS NOT NULL AND trim(coalesce(document_id, '')) = '' THEN 1 END) AS no_document, count(CASE WHEN n.name IS NOT NULL AND chunk_index IS NULL THEN 1 END) AS no_chunk FROM l LEFT JOIN nodes n ON n.label = l.label GROUP BY ALL"""
)
def property_completeness(spark, d):
    return graph.completeness(graph.nodes_of(table(spark, d, "entities")))


_ENDS = """ends AS (SELECT type, src_label AS label, src_name AS name, src_source AS source_name, dst_label AS far_label FROM edges UNION ALL SELECT type, dst_label, dst_name, dst_source, src_label FROM edges WHERE NOT (src_label = dst_label AND src_name = dst_name AND src_source = dst_source))"""


@query(
    f"""WITH {_GRAPH}, {_ENDS}, g AS (SELECT label, name, source_name, count(*) AS degree FROM ends GROUP BY ALL)
SELECT n.label, n.name, n.source_name, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN g USING (label, name, source_name) ORDER BY degree DESC, name COLLATE "binary", label COLLATE "binary", source_name COLLATE "binary" LIMIT 25""".replace(' COLLATE "binary"', "")
)
def top_degree(spark, d):
    return graph.top_degree(*_graph(spark, d), 25)


@query(
    f"""WITH {_GRAPH}, {_LINKED}, k AS (SELECT DISTINCT src_label AS label, src_name AS name, src_source AS source_name, 1 AS linked FROM faulty WHERE type = '{packs.OF_TYPE}' AND dst_label = '{packs.TYPE_LABEL}' AND dst_name = src_label), l(label) AS (VALUES {_LABEL_ROWS})
SELECT l.label, count(n.name) AS total, count(k.linked) AS linked, count(n.name) - count(k.linked) AS missing FROM l LEFT JOIN nodes n ON n.label = l.label LEFT JOIN k ON k.label = n.label AND k.name = n.name AND k.source_name = n.source_name GROUP BY ALL"""
)
def type_link_stats(spark, d):
    return graph.link_statistics(*_faulty(spark, d))


@query(f"WITH {_GRAPH}, {_LINKED} SELECT coalesce(fault, 'sound') AS fault, count(*) AS n FROM marked GROUP BY ALL")
def cleanup_links(spark, d):
    return graph.classify_links(_faulty(spark, d)[1]).groupBy(F.coalesce("fault", F.lit("sound")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


_LEGACY = " ".join(f"WHEN label = '{a}' THEN '{b}'" for a, b in packs.LEGACY_LABELS.items())
_BACKFILL = f"""wanted AS (SELECT DISTINCT label AS src_label, name AS src_name, source_name AS src_source, '{packs.OF_TYPE}' AS type, '{packs.TYPE_LABEL}' AS dst_label, CASE {_LEGACY} ELSE label END AS dst_name, source_name AS dst_source FROM nodes),
missing AS (SELECT * FROM wanted w WHERE dst_name IN ({_in(packs.LABELS)}) AND NOT EXISTS (SELECT 1 FROM clean c WHERE c.src_label = w.src_label AND c.src_name = w.src_name AND c.src_source = w.src_source AND c.type = w.type AND c.dst_label = w.dst_label AND c.dst_name = w.dst_name AND c.dst_source = w.dst_source))"""


@query(f"WITH {_GRAPH}, {_LINKED}, {_BACKFILL} SELECT src_label, src_name, src_source, dst_name FROM missing")
def backfill_links(spark, d):
    nodes, edges = _faulty(spark, d)
    return graph.backfill(nodes, graph.cleanup(edges)).select("src_label", "src_name", "src_source", "dst_name")


@query(
    f"""WITH {_GRAPH}, {_LINKED}, e AS (SELECT * FROM clean), n AS (SELECT label, name, source_name FROM nodes UNION ALL SELECT label, name, source_name FROM type_nodes),
x AS (SELECT type, src_label AS label, src_name AS name, src_source AS source_name, dst_label AS far FROM e UNION ALL SELECT type, dst_label, dst_name, dst_source, src_label FROM e),
alive AS (SELECT DISTINCT label, name, source_name FROM x WHERE NOT (type = '{packs.OF_TYPE}' AND far = '{packs.TYPE_LABEL}'))
SELECT label, name, source_name FROM n WHERE label IN ('{packs.TYPE_LABEL}', '{packs.SOURCE_LABEL}', '{packs.PLAN_LABEL}') OR EXISTS (SELECT 1 FROM alive a WHERE a.label = n.label AND a.name = n.name AND a.source_name = n.source_name)"""
)
def prune_nodes(spark, d):
    nodes, edges = _faulty(spark, d)
    types = graph.meta_nodes(nodes).where(F.col("label") == packs.TYPE_LABEL)
    return graph.prune(nodes.select(*graph.NODE_KEY).unionByName(types), graph.cleanup(edges))[0]


_TOP = f"{_GRAPH}, {_ENDS}, hub AS (SELECT name FROM ends GROUP BY name ORDER BY count(*) DESC, name LIMIT 1)"


def _hub(spark, d, edges) -> str:
    return graph.ends(edges).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").first()["name"]


def _lookup(direction: str, where: str, kind: str | None = None):
    def run(spark, d):
        edges = cut(_graph(spark, d)[1])
        return graph.lookup_relations(edges, _hub(spark, d, edges), direction, kind)

    run.__name__ = f"relation_lookup_{direction}" + ("_kind" if kind else "")
    sql = f"WITH {_TOP} SELECT DISTINCT src_name AS subject, replace(type, '_', ' ') AS predicate, dst_name AS object FROM edges WHERE ({where})" + (f" AND type = '{kind}'" if kind else "")
    query(sql)(run)


_lookup("out", "src_name = (SELECT name FROM hub)")
_lookup("in", "dst_name = (SELECT name FROM hub)")
_lookup("both", "src_name = (SELECT name FROM hub) OR dst_name = (SELECT name FROM hub)")
_lookup("both", "src_name = (SELECT name FROM hub) OR dst_name = (SELECT name FROM hub)", "负责")


@query(f"WITH {_TOP} SELECT label, name, source_name FROM nodes WHERE name = (SELECT name FROM hub)")
def entity_lookup(spark, d):
    nodes, edges = _graph(spark, d)
    return graph.lookup_entity(nodes, _hub(spark, d, cut(edges))).select("label", "name", "source_name")


@query(f"WITH {_GRAPH}, {_ENDS} SELECT label, name, source_name, count(*) AS degree FROM ends GROUP BY ALL")
def node_degrees(spark, d):
    return graph.degrees(_graph(spark, d)[1])


@query("SELECT DISTINCT source_name FROM entities WHERE source_name IS NOT NULL ORDER BY source_name")
def source_list(spark, d):
    return table(spark, d, "entities").select("source_name").where("source_name is not null").distinct().orderBy("source_name")


@query(f"SELECT predicate, predicate IN ({_in(packs.BRIDGE_PREDICATES)}) AS in_schema, count(*) AS n FROM relations WHERE predicate IS NOT NULL GROUP BY ALL")
def predicate_membership(spark, d):
    rows = table(spark, d, "relations").where("predicate is not null")
    return rows.groupBy("predicate", F.col("predicate").isin(packs.BRIDGE_PREDICATES).alias("in_schema")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_NEAR} SELECT a AS key, count(DISTINCT b) AS degree FROM linked GROUP BY a")
def neighbour_degrees(spark, d):
    return _near(spark, d).groupBy(F.col("a").alias("key")).agg(F.count_distinct("b").alias("degree"))


# ontology --------------------------------------------------------------------------------------------------

_PLAN_VALUES = ", ".join(f"('{n}', '{level}')" for n, level in packs.PLANS)
_PLAN_EDGE_VALUES = ", ".join(f"('{c}', '{p}')" for c, p in packs.PLAN_EDGES)


@query(
    f"""WITH RECURSIVE p(name, level) AS (VALUES {_PLAN_VALUES}), e(child, parent) AS (VALUES {_PLAN_EDGE_VALUES}), r(name, depth) AS (SELECT name, 0 FROM p WHERE level = 'L0' UNION ALL SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.name),
m AS (SELECT name, min(depth) AS depth FROM r GROUP BY name) SELECT p.name, depth, round(depth / (SELECT max(depth) FROM m), 6) AS specificity FROM p LEFT JOIN m USING (name)"""
)
def plan_specificity(spark, d):
    nodes = ontology.plan_nodes(spark)
    return ontology.specificity(nodes, ontology.plan_edges(spark), nodes.where("level = 'L0'"))


@query(
    """WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region),
r(name, depth) AS (SELECT 'world', 0 UNION ALL SELECT e.child, r.depth + 1 FROM r JOIN e ON e.parent = r.name) SELECT depth, count(*) AS n FROM r GROUP BY depth"""
)
def hierarchy_depths(spark, d):
    t = lambda name: table(spark, d, name)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = t("nation").select(key("n", "n_nationkey").alias("child"), key("r", "n_regionkey").alias("parent"))
    edges = edges.unionByName(t("customer").select(key("c", "c_custkey").alias("child"), key("n", "c_nationkey").alias("parent")))
    edges = edges.unionByName(t("supplier").select(key("s", "s_suppkey").alias("child"), key("n", "s_nationkey").alias("parent")))
    edges = edges.unionByName(t("region").select(key("r", "r_regionkey").alias("child"), F.lit("world").alias("parent")))
    root = spark.range(1).select(F.lit("world").alias("name"))
    nodes = edges.select(F.col("child").alias("name")).unionByName(root)
    return ontology.depths(nodes, edges, root).groupBy("depth").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT e.source_name, r.rule_source AS plan FROM (SELECT DISTINCT document_id AS source_name FROM entities WHERE document_id IS NOT NULL) e JOIN (SELECT DISTINCT rule_source FROM rules WHERE rule_source <> '') r ON contains(e.source_name, r.rule_source)")
def anchor_contains(spark, d):
    plans = table(spark, d, "rules").select(F.col("rule_source").alias("name")).where("name is not null")
    return ontology.anchor(table(spark, d, "entities"), plans, "document_id")


# payloads, records, reports --------------------------------------------------------------------------------


@query("SELECT record_id, body->>'rule_name' AS name, CAST(coalesce(json_array_length(body->'elements'), 0) AS BIGINT) AS n_elements FROM (SELECT record_id, body::JSON AS body FROM rule_json)")
def json_payload(spark, d):
    """Each rule's JSON as the answer of a model, in four shapes: fenced and broken off, bare, with words and commas too many, broken off within a record; read back by the tolerant reader."""
    shapes = [('结果如下：\n```json\n{"entities": [', ',], "relations": [], "bridge_relations": [{"subject": "'), ('{"entities": [', '], "relations": []}'), ('说明{如下}：\n{"relations": [], "entities": [', ", ], }\n以上。"), ('{"entities": [', ', {"name": "断')]
    body, k = F.col("body"), F.col("record_id") % 4
    answer = F.coalesce(*[F.when(k == i, F.concat(F.lit(x), body, F.lit(y))) for i, (x, y) in enumerate(shapes)])
    rows = table(spark, d, "rule_json").select("record_id", payload.parsed(answer).alias("p"))
    first = F.get("p.entities", F.lit(0))
    n = F.size(F.from_json(first["elements"], "array<string>"))
    return rows.select("record_id", first["rule_name"].alias("name"), F.when(n > 0, n).otherwise(0).cast("long").alias("n_elements"))


@query("SELECT 'Offline' AS model, coalesce(length(text), 0) AS prompt_chars, sha256(coalesce(text, '')) AS prompt_sha256, 'ok' AS status, 1 AS attempt FROM documents")
def trace_records(spark, d):
    """Every document put to the offline provider, and the audit rows of the calls."""
    asked = ask(table(spark, d, "documents").select(F.col("text").alias("prompt")), Offline())
    return trace(asked, "Offline").select("model", F.col("prompt_chars").cast("long").alias("prompt_chars"), "prompt_sha256", "status", "attempt")


@query(
    """WITH d AS (SELECT coalesce(e.document_id, r.document_id) AS document_id, coalesce(e.n, 0) AS entities, coalesce(r.n, 0) AS relations FROM (SELECT document_id, count(DISTINCT entity_id) AS n FROM entities GROUP BY ALL) e FULL JOIN (SELECT document_id, count(DISTINCT relation_id) AS n FROM relations GROUP BY ALL) r ON e.document_id = r.document_id)
SELECT count(*) AS documents, count(CASE WHEN entities > 0 AND relations > 0 THEN 1 END) AS succeeded, count(CASE WHEN NOT (entities > 0 AND relations > 0) THEN 1 END) AS failed, round(count_if(entities > 0 AND relations > 0) / count(*), 6) AS success_rate, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations FROM d"""
)
def run_report(spark, d):
    from planweave.plans.pipeline import run_counters

    return run_counters(table(spark, d, "entities"), table(spark, d, "relations"))


@query(f"WITH {_ENTITIES} SELECT 'entity' AS kind, entity_type AS name, count(*) AS n FROM first_entities GROUP BY ALL UNION ALL SELECT 'relation', predicate, count(*) FROM ({_REL_FIRST}) GROUP BY ALL")
def type_distributions(spark, d):
    return extract.distributions(extract.dedupe_entities(table(spark, d, "entities")), extract.dedupe_relations(table(spark, d, "relations")))


# prompts ---------------------------------------------------------------------------------------------------


@query(
    f"""WITH h AS (SELECT document_id, string_agg(DISTINCT name, chr(10) || '- ' ORDER BY name) AS names FROM entities WHERE name IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL)
SELECT document_id, md5('{prompts.EXTRACTION}' || chr(10) || '已知实体：' || chr(10) || '- ' || names || chr(10) || '文本：' || chr(10) || document_id) AS prompt_md5 FROM h"""
)
def extraction_prompts(spark, d):
    rows = table(spark, d, "entities").where("name is not null and document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("hints"))
    return rows.select("document_id", F.md5(prompts.extraction(F.col("document_id"), F.col("hints"))).alias("prompt_md5"))


@query(
    f"""WITH e AS (SELECT document_id, string_agg(DISTINCT name, chr(10) ORDER BY name) AS names FROM entities WHERE name IS NOT NULL AND document_id IS NOT NULL GROUP BY ALL),
r AS (SELECT document_id, string_agg(DISTINCT subject || predicate || object, chr(10) ORDER BY subject || predicate || object) AS triples FROM relations WHERE subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL GROUP BY ALL),
i AS (SELECT DISTINCT document_id, name FROM entities e WHERE name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM relations r WHERE r.document_id = e.document_id AND (r.subject = e.name OR r.object = e.name) AND e.name <> '')),
l AS (SELECT document_id, string_agg(name, chr(10) ORDER BY name) AS lonely FROM i GROUP BY ALL)
SELECT document_id, md5('{prompts.CONSOLIDATION}' || chr(10) || '实体：' || chr(10) || names || chr(10) || '关系：' || chr(10) || coalesce(triples, '') || chr(10) || '孤立实体：' || chr(10) || coalesce(lonely, '')) AS prompt_md5 FROM e LEFT JOIN r USING (document_id) LEFT JOIN l USING (document_id)"""
)
def consolidation_prompts(spark, d):
    e, r = table(spark, d, "entities"), table(spark, d, "relations")
    listed = prompts.consolidation_inputs(e, r, resolve.isolated(e, r))
    return listed.select("document_id", F.md5(prompts.consolidation(F.col("entities"), F.col("relations"), F.col("lonely"))).alias("prompt_md5"))


@query(f"SELECT chunk_id, md5('{prompts.RULES}' || chr(10) || '文本：' || chr(10) || chunk_text) AS prompt_md5 FROM chunk_texts")
def rule_prompts(spark, d):
    return table(spark, d, "chunk_texts").select("chunk_id", F.md5(prompts.rules(F.col("chunk_text"))).alias("prompt_md5"))


@query("SELECT chunk_id, CASE WHEN length(trim(chunk_text)) > 0 THEN 'ok' ELSE 'empty' END AS status FROM chunk_texts")
def provider_calls(spark, d):
    """Every chunk put to the offline provider, which answers with the length of the text; the status of each call."""
    rows = table(spark, d, "chunk_texts").select("chunk_id", F.trim(F.coalesce("chunk_text", F.lit(""))).alias("prompt"))
    return ask(rows, Offline(answer=lambda p: str(len(p)) if p else "")).select("chunk_id", "status")


# the stages of a build -------------------------------------------------------------------------------------

_GROUPED = f"""grouped AS (
  SELECT 'group_' || source_name || '_' || (b * 12 + 1) || '_' || (b * 12 + count(*)) AS doc_id, string_agg('【' || rid || '】' || rule_text, chr(10) ORDER BY rn) AS text
  FROM (SELECT *, (rn - 1) // 12 AS b FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY record_id) AS rn, coalesce({_or_null("rule_id")}, 'doc_' || record_id) AS rid FROM shaped)) GROUP BY source_name, b
)"""


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    groups = chunking.group_rules(_ordered_rules(spark, d)).select(F.col("group_id").alias("document_id"), "source_name", "group_text")
    return pipeline.extraction(cut(groups), Offline(16))


@query(
    f"""WITH RECURSIVE {_RULES}, {_GROUPED}, {_SPANS.replace("FROM documents", "FROM grouped")}
SELECT doc_id AS document_id, name, {_canonical("entity_type", "name")} AS entity_type, CAST(arg_min(start_pos, start_pos) AS INTEGER) AS start_pos, CAST(arg_min(end_pos, start_pos) AS INTEGER) AS end_pos, CAST({DEFAULT.pattern_confidence} AS DOUBLE) AS confidence FROM spans GROUP BY ALL"""
)
def build_entities(spark, d):
    """Both channels over groups of rules; the offline model says nothing, so the patterns decide."""
    return _extracted(spark, d)[0].select("document_id", "name", "entity_type", "start_pos", "end_pos", "confidence")


@query(
    f"""WITH {_RULES}, {_GROUPED}, m AS (SELECT doc_id, k, predicate, subject_type, object_type, {_strip("s")} AS subject, {_strip("o")} AS object FROM ({_TRIPLES.replace("FROM documents", "FROM grouped")}))
SELECT doc_id AS document_id, subject, predicate, object, arg_min(subject_type, k) AS subject_type, arg_min(object_type, k) AS object_type FROM m WHERE subject <> '' AND object <> '' GROUP BY doc_id, subject, predicate, object"""
)
def build_relations(spark, d):
    return _extracted(spark, d)[1].select("document_id", "subject", "predicate", "object", "subject_type", "object_type")


#: A span that overlaps the last kept one replaces it if it is surer; ``was`` is the one it replaces.
_CHANNELS = """
each_row AS (SELECT DISTINCT document_id, entity_id, name, entity_type, start_pos, end_pos, coalesce(confidence, 0.0) AS c FROM entities WHERE document_id IS NOT NULL AND start_pos IS NOT NULL AND end_pos IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY start_pos, end_pos, entity_id % 2, entity_id) AS n FROM each_row),
r(document_id, n, last, e, c, taken, was) AS (
  SELECT document_id, n, n, end_pos, c, true, CAST(NULL AS BIGINT) FROM n WHERE n = 1
  UNION ALL
  SELECT document_id, n, CASE WHEN taken THEN n ELSE last END, CASE WHEN taken THEN end_pos ELSE e END, CASE WHEN taken THEN c2 ELSE c END, taken, CASE WHEN taken AND meets THEN last END
  FROM (SELECT n.document_id, n.n, r.last, r.e, r.c, n.end_pos, n.c AS c2, n.start_pos < r.e AND n.end_pos > l.start_pos AS meets, NOT (n.start_pos < r.e AND n.end_pos > l.start_pos) OR n.c > r.c AS taken
    FROM r JOIN n ON n.document_id = r.document_id AND n.n = r.n + 1 JOIN n l ON l.document_id = r.document_id AND l.n = r.last)
)
"""


@query(
    f"""WITH RECURSIVE {_CHANNELS}
SELECT n.document_id, CAST(row_number() OVER (PARTITION BY n.document_id ORDER BY n.c DESC, n.n) - 1 AS INTEGER) AS place, n.name, n.entity_type, n.start_pos, n.end_pos, n.c AS confidence
FROM n JOIN r ON r.document_id = n.document_id AND r.n = n.n WHERE r.taken AND NOT EXISTS (SELECT 1 FROM r o WHERE o.document_id = n.document_id AND o.was = n.n)"""
)
def channel_union(spark, d):
    """Entities of even ids as the model's channel and of odd ids as the patterns', merged by place and sureness."""
    rows = table(spark, d, "entities").where("document_id is not null and start_pos is not null and end_pos is not null")
    spans = rows.select("document_id", "entity_id", "name", "entity_type", "start_pos", "end_pos", F.coalesce("confidence", F.lit(0.0)).alias("confidence")).distinct()
    return extract.combine_channels(spans.withColumns({"chan": F.col("entity_id") % 2, "ord": F.col("entity_id")}), "document_id")


@query(
    f"""WITH b AS (SELECT record_id, body::JSON AS body FROM rule_json)
SELECT record_id, body->>'rule_name' AS rule_name, body->>'rule_text' AS rule_text, len(list_filter(coalesce(CAST(body->'elements' AS VARCHAR[]), []), lambda x: x IS NOT NULL)) AS elements, len(list_filter(coalesce(CAST(body->'rule_tags' AS VARCHAR[]), []), lambda x: x IS NOT NULL)) AS tags
FROM b WHERE {_strip("body->>'rule_text'")} <> ''"""
)
def rule_answers(spark, d):
    """Each rule's JSON as a model's list of rules: fenced, under ``rules``, or under ``data`` with words around."""
    k, body = F.col("record_id") % 3, F.col("body")
    shapes = [("```json\n[", "]\n```"), ('{"rules": [', "]}"), ('结果：{"data": [', ",]}。")]
    answer = F.coalesce(*[F.when(k == i, F.concat(F.lit(x), body, F.lit(y))) for i, (x, y) in enumerate(shapes)])
    rows = table(spark, d, "rule_json").select("record_id", F.explode(payload.parsed_rules(answer)).alias("r"))
    return rows.select("record_id", "r.rule_name", "r.rule_text", F.size("r.elements").cast("long").alias("elements"), F.size("r.rule_tags").cast("long").alias("tags"))


_MARK = '{"entities": [], "relations": []}'


@query(
    f"""WITH s AS (SELECT doc_id, unnest([title, text, CASE WHEN doc_id % 3 = 0 THEN '{_MARK}' END, CASE WHEN doc_id % 5 = 0 THEN 'alias_map' END]) AS v, generate_subscripts([1, 2, 3, 4], 1) AS i FROM documents),
t AS (SELECT doc_id, i, {_strip("v")} AS v FROM s WHERE v IS NOT NULL)
SELECT d.doc_id, md5(b.v) AS best_md5 FROM documents d LEFT JOIN (
  SELECT doc_id, arg_max(v, (CASE WHEN contains(v, 'entities') AND contains(v, 'relations') THEN 5.0 ELSE 0.0 END + CASE WHEN contains(v, 'alias_map') OR contains(v, 'bridge_relations') THEN 4.0 ELSE 0.0 END
    + CASE WHEN contains(v, '{{') AND contains(v, '}}') THEN 2.0 ELSE 0.0 END + least(length(v), 20000) / 20000.0, -i)) AS v FROM t WHERE v <> '' GROUP BY doc_id) b USING (doc_id)"""
)
def best_strings(spark, d):
    strings = F.array("title", "text", F.when(F.col("doc_id") % 3 == 0, F.lit(_MARK)), F.when(F.col("doc_id") % 5 == 0, F.lit("alias_map")))
    return table(spark, d, "documents").select("doc_id", F.md5(payload.best_string(strings)).alias("best_md5"))


@query("SELECT DISTINCT relation_id, '根据上述文本，' || subject || predicate || object || '。' AS hypothesis FROM relations")
def hypotheses(spark, d):
    return table(spark, d, "relations").select("relation_id", resolve.hypothesis(F.col("subject"), F.col("predicate"), F.col("object")).alias("hypothesis")).distinct()


@query("SELECT canon_id AS id, name AS text, 'Offline' AS model, 16 AS dim, document_id FROM canonical_entities WHERE length(trim(name)) > 0")
def embedding_records(spark, d):
    done = alias.embedding_records(table(spark, d, "canonical_entities"), "canon_id", "name", Offline(16), "Offline", ["document_id", "entity_type"])
    return done.select("id", "text", "model", "dim", "source.document_id")


@query(
    f"""WITH {_GRAPH}, {_LINKED}, {_BACKFILL}, full_links AS (SELECT src_label, src_name, src_source, dst_name FROM clean WHERE type = '{packs.OF_TYPE}' AND dst_label = '{packs.TYPE_LABEL}' UNION SELECT src_label, src_name, src_source, dst_name FROM missing),
k AS (SELECT DISTINCT src_label AS label, src_name AS name, src_source AS source_name, 1 AS linked FROM full_links WHERE dst_name = src_label), l(label) AS (VALUES {_LABEL_ROWS}),
e AS (SELECT (SELECT count(*) FROM clean) + (SELECT count(*) FROM missing) AS edges)
SELECT l.label, count(n.name) AS total, count(k.linked) AS linked, any_value(e.edges) AS edges FROM l CROSS JOIN e LEFT JOIN nodes n ON n.label = l.label LEFT JOIN k ON k.label = n.label AND k.name = n.name AND k.source_name = n.source_name GROUP BY l.label"""
)
def repair_job(spark, d):
    """The link statistics after cleaning and filling in, and the number of edges then."""
    full, _, after = graph.repair(*_faulty(spark, d))
    return after.select("label", "total", "linked").join(full.agg(F.count(F.lit(1)).alias("edges")))


@query(f"WITH {_V}, {_PROBE} SELECT vec_id, round(list_cosine_similarity(e, q), 6) AS similarity, 'chunk' AS tier FROM v, p ORDER BY list_cosine_similarity(e, q) DESC, vec_id LIMIT 10")
def tiered_chunks(spark, d):
    """A search where there is no rule at all, so that the chunks answer."""
    rows = table(spark, d, "embeddings")
    return search.tiered(rows.where("vec_id is null"), rows, "embedding", _probe(spark, d), "vec_id", 10).select("vec_id", F.round("similarity", 6).alias("similarity"), "tier")


@query(f"WITH {_GRAPH} SELECT label, name, source_name, description, document_id FROM nodes")
def graph_store(spark, d):
    """The nodes merged into a store in three parts, by turns, and read back: the same as one upsert of all."""
    store = graph.GraphStore(spark, shared_folder(spark, "store"), compact_after=2)
    entities = cut(table(spark, d, "entities").where("name is not null and source_name is not null"))
    bounds = entities.approxQuantile("entity_id", [1 / 3, 2 / 3], 0.05)
    parts = [F.col("entity_id") < bounds[0], (F.col("entity_id") >= bounds[0]) & (F.col("entity_id") < bounds[1]), F.col("entity_id") >= bounds[1]] if bounds else []
    for part in parts:
        nodes, edges = graph.graph_of(entities.where(part), table(spark, d, "relations").limit(0))
        store.merge(nodes.withColumn("seq", F.lit(0)), edges.withColumn("seq", F.lit(0)))
    return store.read()[0].select("label", "name", "source_name", "description", "document_id")


@query(
    f"""WITH {_GRAPH} SELECT 'statistics' AS section, name, n FROM (SELECT label AS name, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT type, count(*) FROM edges GROUP BY ALL)
UNION ALL SELECT 'totals', 'nodes', count(*) FROM nodes UNION ALL SELECT 'totals', 'edges', count(*) FROM edges UNION ALL SELECT 'edges_by_source', source_name, count(*) FROM edges GROUP BY source_name"""
)
def graph_summary(spark, d):
    """What the summary says of counts: it comes as lists to the driver, as for the command line."""
    got = graph.summary(*_graph(spark, d))
    rows = [("totals", k, v) for k, v in got["totals"][0].items()] + [(s, r.get("name", r.get("source_name")), r["n"]) for s in ("statistics", "edges_by_source") for r in got[s]]
    return spark.createDataFrame(rows, "section string, name string, n long")


@query(f"WITH {_RULES} SELECT DISTINCT source_name, md5(rule_text) AS text_hash FROM shaped")
def rule_stream(spark, d):
    """The rules as JSON lines, read as a stream in one run, repeats of a source dropped."""
    folder = shared_folder(spark, "stream")
    rows = _rules(spark, d).select("rule_id", "rule_name", "rule_text", "elements", "rule_tags", F.col("source_name").alias("rule_source"), F.lit("2031-01-01 00:00:00").cast("timestamp").alias("loaded_at"))
    rows.write.json(f"{folder}/in")
    stream = streaming.rule_stream(spark, f"{folder}/in").select("source_name", "text_hash")
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")
