"""The property graph as two tables: keyed upserts, endpoint resolution, statistics, look-ups and repair.

A node is keyed by ``(label, name, source_name)``, an edge by its type and the keys of its ends. All steps work on whole
sets; nothing is done node by node.
"""

from __future__ import annotations

import logging
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.functions import packs
from planweave.functions.text import canonical_type, relation_type
from planweave.operators.skew import lookup_counted

log = logging.getLogger(__name__)

NODE_KEY = ["label", "name", "source_name"]
EDGE_KEY = ["src_label", "src_name", "src_source", "type", "dst_label", "dst_name", "dst_source"]
FLAGS = ["is_bridge", "is_meta", "stat_edge", "is_llm_generated"]
END = {"src": ["src_label", "src_name", "src_source"], "dst": ["dst_label", "dst_name", "dst_source"]}


def upsert(rows: DataFrame, keys: list[str], seq: str, first: list[str] = (), last: list[str] = ()) -> DataFrame:
    """One row per ``keys``: of columns in ``first`` the earliest value by ``seq`` stays, of those in ``last`` the latest non-null one.

    Both are aggregates with a partial step before the shuffle. Rows with a null key are left out. Applying
    the same rows again changes nothing.
    """
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    aggregates = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in first]
    aggregates += [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in last]
    return known.groupBy(*keys).agg(*aggregates) if aggregates else known.select(*keys).distinct()


def upsert_nodes(stored: DataFrame | None, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Nodes after the upsert: ``created_at`` of the first write, every other property of the last write that has it."""
    props = [c for c in rows.columns if c not in (*NODE_KEY, seq, "created_at")]
    return _upsert_table(stored, rows, NODE_KEY, props, seq)


def upsert_edges(stored: DataFrame | None, rows: DataFrame, seq: str = "seq") -> DataFrame:
    """Edges after the upsert, by type and ends; properties as for nodes."""
    props = [c for c in rows.columns if c not in (*EDGE_KEY, seq, "created_at")]
    return _upsert_table(stored, rows, EDGE_KEY, props, seq)


def _upsert_table(stored: DataFrame | None, rows: DataFrame, keys: list[str], props: list[str], seq: str) -> DataFrame:
    first = ["created_at"] if "created_at" in rows.columns else []
    new = rows.withColumn("seq_", F.struct(F.lit(1).alias("g"), F.col(seq).cast("long").alias("s")))
    if stored is not None:
        old = stored.withColumn("seq_", F.struct(F.lit(0).alias("g"), F.lit(0).cast("long").alias("s")))
        new = old.unionByName(new.drop(seq), allowMissingColumns=True)
        props = [c for c in new.columns if c not in (*keys, "seq_", "created_at")]
        first = ["created_at"] if "created_at" in new.columns else []
    return upsert(new, keys, "seq_", first, props)


def violations(nodes: DataFrame) -> DataFrame:
    """``(label, name, source_name, copies)`` of keys that occur more than once, or whose name or source is missing."""
    counted = nodes.groupBy(*NODE_KEY).agg(F.count(F.lit(1)).alias("copies"))
    return counted.where("copies > 1 or name is null or source_name is null")


def meta_nodes(sources: DataFrame) -> DataFrame:
    """The root and the eight type nodes of each distinct source, ``(label, name, source_name)``; eight is fixed by the label set."""
    names = sources.where("source_name is not null").select("source_name").distinct()
    roots = names.select(F.lit(packs.SOURCE_LABEL).alias("label"), F.col("source_name").alias("name"), "source_name")
    types = names.select(F.lit(packs.TYPE_LABEL).alias("label"), F.explode(F.array(*map(F.lit, packs.LABELS))).alias("name"), "source_name")
    return roots.unionByName(types)


def meta_edges(sources: DataFrame) -> DataFrame:
    """The edges from each source root to its eight type nodes."""
    types = meta_nodes(sources).where(F.col("label") == packs.TYPE_LABEL)
    return types.select(
        F.lit(packs.SOURCE_LABEL).alias("src_label"), F.col("source_name").alias("src_name"), F.col("source_name").alias("src_source"), F.lit(packs.HAS_TYPE).alias("type"), F.col("label").alias("dst_label"), F.col("name").alias("dst_name"), F.col("source_name").alias("dst_source")
    )


def resolve_edges(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations with both ends found among the nodes, one row for every pair of labels the two names carry.

    By name and source where the relation has a source, by name alone where it has none. Relations with an end
    that is no node vanish.
    """
    out = None
    for sourced in (True, False):
        part = relations.where(F.col("source_name").isNotNull() if sourced else F.col("source_name").isNull())
        rels = part.withColumn("type", relation_type(F.col("predicate")))
        for side, end in (("src", "subject"), ("dst", "object")):
            if sourced:
                # a name has a node of each label at most in a source; a hub, or a source with a large share of all relations, is looked up apart
                known = nodes.select(F.col("name").alias(end), "source_name", F.col("label").alias(f"{side}_label"), F.col("name").alias(f"{side}_name"), F.col("source_name").alias(f"{side}_source"))
                rels = lookup_counted(rels, known, [end, "source_name"])
            else:
                known = nodes.select(F.col("name").alias(end), F.col("label").alias(f"{side}_label"), F.col("name").alias(f"{side}_name"), F.col("source_name").alias(f"{side}_source"))
                rels = rels.join(known, end)
        out = rels if out is None else out.unionByName(rels)
    return out


def type_links(nodes: DataFrame) -> DataFrame:
    """Edges from every node with one of the eight labels to the type node of its source."""
    some = nodes.where(F.col("label").isin(packs.LABELS))
    return some.select(
        F.col("label").alias("src_label"), F.col("name").alias("src_name"), F.col("source_name").alias("src_source"), F.lit(packs.OF_TYPE).alias("type"), F.lit(packs.TYPE_LABEL).alias("dst_label"), F.col("label").alias("dst_name"), F.col("source_name").alias("dst_source")
    )


def ends(edges: DataFrame) -> DataFrame:
    """Each edge once for either end, a self-loop once: ``(label, name, source_name)`` of that end, with the type and the far label."""
    pairs = F.array(
        F.struct(F.col("src_label").alias("label"), F.col("src_name").alias("name"), F.col("src_source").alias("source_name"), F.col("dst_label").alias("far_label")),
        F.struct(F.col("dst_label").alias("label"), F.col("dst_name").alias("name"), F.col("dst_source").alias("source_name"), F.col("src_label").alias("far_label")),
    )
    loop = (F.col("src_label") == F.col("dst_label")) & (F.col("src_name") == F.col("dst_name")) & (F.col("src_source") == F.col("dst_source"))
    return edges.select("type", F.explode(F.when(loop, F.slice(pairs, 1, 1)).otherwise(pairs)).alias("n")).select("type", "n.*")


# statistics ------------------------------------------------------------------------------------------------


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(nodes, edges)`` as one row, zeros for empty tables."""
    counted = nodes.select(F.lit(1).alias("n"), F.lit(0).alias("e")).unionByName(edges.select(F.lit(0).alias("n"), F.lit(1).alias("e")))
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.coalesce(F.sum("e"), F.lit(0)).alias("edges"))


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(kind, name, n)``: nodes by label and edges by type, in two passes."""
    by_label = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), F.col("label").alias("name"), "n")
    by_type = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    return by_label.unionByName(by_type)


def nodes_by_source(nodes: DataFrame) -> DataFrame:
    """``(source_name, label, n, level)``: by label, by source and by both in one pass of grouping sets; level says which."""
    some = nodes.where("source_name is not null")
    grouped = some.groupingSets([[F.col("source_name")], [F.col("label")], [F.col("source_name"), F.col("label")]], "source_name", "label")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.grouping_id("source_name", "label").cast("int").alias("level"))


def edges_by_source(edges: DataFrame, source: str = "source_name") -> DataFrame:
    return edges.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)).alias("n"))


def _set(flag: str) -> Column:
    return F.coalesce(F.col(flag), F.lit(False))


def flag_counts(edges: DataFrame) -> DataFrame:
    """One row of counts: meta types, the four flags, bridges in all, of a paragraph (chunk -1), by a model, and by a model but no bridge."""
    paragraph = F.col("chunk_index").cast("string") == "-1"
    return edges.agg(
        F.count_if(F.col("type") == packs.HAS_TYPE).alias("has_type"),
        F.count_if(F.col("type") == packs.OF_TYPE).alias("of_type"),
        *[F.count_if(_set(f)).alias(f) for f in FLAGS],
        F.count_if(_set("is_bridge") & F.coalesce(paragraph, F.lit(False))).alias("paragraph_bridges"),
        F.count_if(_set("is_bridge") & _set("is_llm_generated")).alias("llm_bridges"),
        F.count_if(~_set("is_bridge") & _set("is_llm_generated")).alias("llm_not_bridge"),
    )


def bridge_breakdown(edges: DataFrame) -> DataFrame:
    """``(kind, name, n)`` of bridges by source and by type, one pass of grouping sets."""
    some = edges.where(_set("is_bridge"))
    grouped = some.groupingSets([[F.col("source_name")], [F.col("type")]], "source_name", "type").agg(F.count(F.lit(1)).alias("n"), F.grouping("source_name").alias("g"))
    return grouped.select(F.when(F.col("g") == 0, "source").otherwise("type").alias("kind"), F.when(F.col("g") == 0, F.col("source_name")).otherwise(F.col("type")).alias("name"), "n")


def completeness(nodes: DataFrame) -> DataFrame:
    """``(label, total, no_description, no_aliases, no_document, no_chunk)`` of the eight labels; blank strings and empty lists are missing too."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    counted = nodes.where(F.col("label").isin(packs.LABELS)).groupBy("label").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(blank("description")).alias("no_description"),
        F.count_if(F.coalesce(F.size("aliases"), F.lit(0)) <= 0).alias("no_aliases"),
        F.count_if(blank("document_id")).alias("no_document"),
        F.count_if(F.col("chunk_index").isNull()).alias("no_chunk"),
    )
    return _labels(nodes.sparkSession).join(counted, "label", "left").na.fill(0)


def _labels(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*map(F.lit, packs.LABELS))).alias("label"))


def degrees(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy(*NODE_KEY).agg(F.count(F.lit(1)).alias("degree"))


def top_degree(nodes: DataFrame, edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` entity nodes with most edges, ties by name, label and source; nodes without edges have degree 0."""
    some = nodes.where(~F.col("label").isin(packs.TYPE_LABEL, packs.SOURCE_LABEL)).select(*NODE_KEY)
    counted = some.join(degrees(edges), NODE_KEY, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return counted.orderBy(F.desc("degree"), "name", "label", "source_name").limit(k)


def link_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(label, total, linked, missing)`` of the eight labels: nodes with and without an edge to the type node of their label."""
    links = edges.where((F.col("type") == packs.OF_TYPE) & (F.col("dst_label") == packs.TYPE_LABEL) & (F.col("dst_name") == F.col("src_label"))).select(*[F.col(a).alias(b) for a, b in zip(END["src"], NODE_KEY)]).distinct().withColumn("linked", F.lit(1))
    some = nodes.where(F.col("label").isin(packs.LABELS)).select(*NODE_KEY)
    counted = some.join(links, NODE_KEY, "left").groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count("linked").alias("linked"), F.count_if(F.col("linked").isNull()).alias("missing"))
    return _labels(nodes.sparkSession).join(counted, "label", "left").na.fill(0)


#: Lists of the summary that grow with the data (sources, labels and edge types), and what their rows are counted by.
OPEN = {"statistics": ["kind", "name"], "nodes_by_source": ["level", "source_name", "label"], "edges_by_source": ["source_name"], "bridges": ["kind", "name"]}


def summary(nodes: DataFrame, edges: DataFrame, k: int = 20, tables: str | None = None) -> dict[str, list[dict]]:
    """All statistics as lists of rows by name, those in OPEN ordered by count.

    With ``tables`` the lists in OPEN, which grow with sources, labels and edge types, are written whole as JSON lines in
    a folder each instead of coming to the driver, and stand in the summary as that folder and the number of rows.
    A section that fails is reported under its name and does not stop the others.
    """
    for flag in (*FLAGS, "chunk_index", "source_name"):
        if flag not in edges.columns:
            edges = edges.withColumn(flag, F.lit(None).cast("int" if flag == "chunk_index" else "string" if flag == "source_name" else "boolean"))
    sections = {
        "totals": lambda: totals(nodes, edges),
        "statistics": lambda: statistics(nodes, edges),
        "nodes_by_source": lambda: nodes_by_source(nodes),
        "edges_by_source": lambda: edges_by_source(edges),
        "flags": lambda: flag_counts(edges),
        "bridges": lambda: bridge_breakdown(edges),
        "completeness": lambda: completeness(nodes),
        "type_links": lambda: link_statistics(nodes, edges),
        "top_degree": lambda: top_degree(nodes, edges, k),
    }
    out = {}
    for name, make in sections.items():
        try:
            df = make()
            if name in OPEN and tables:
                folder = f"{tables.rstrip('/')}/{name}"
                df.orderBy(F.desc("n"), *OPEN[name]).write.mode("overwrite").json(folder)
                out[name] = [{"table": folder, "rows": nodes.sparkSession.read.text(folder).count()}]
            else:
                out[name] = [r.asDict() for r in (df.orderBy(F.desc("n"), *OPEN[name]) if name in OPEN else df).collect()]
        except Exception as e:  # noqa: BLE001
            out[name] = [{"error": f"{type(e).__name__}: {e}"[:300]}]
    return out


# repair ----------------------------------------------------------------------------------------------------


def classify_links(edges: DataFrame) -> DataFrame:
    """Edges with ``fault``: a type edge that is a self-loop, starts at a type node, or ends at none, in that order; null for sound ones."""
    loop = (F.col("src_label") == F.col("dst_label")) & (F.col("src_name") == F.col("dst_name")) & (F.col("src_source") == F.col("dst_source"))
    of_type = F.col("type") == packs.OF_TYPE
    fault = F.when(of_type & loop, "self_loop").when(of_type & (F.col("src_label") == packs.TYPE_LABEL), "from_type").when(of_type & (F.col("dst_label") != packs.TYPE_LABEL), "to_other")
    return edges.withColumn("fault", fault)


def cleanup(edges: DataFrame) -> DataFrame:
    return classify_links(edges).where("fault is null").drop("fault")


def backfill(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The type edges that are missing, older labels mapped to the eight; nodes without a source or a known label stay unlinked."""
    mapped = F.col("label")
    for old, new in packs.LEGACY_LABELS.items():
        mapped = F.when(F.col("label") == old, F.lit(new)).otherwise(mapped)
    wanted = nodes.where("source_name is not null and name is not null").withColumn("kind", mapped).where(F.col("kind").isin(packs.LABELS)).select(
        F.col("label").alias("src_label"), F.col("name").alias("src_name"), F.col("source_name").alias("src_source"), F.lit(packs.OF_TYPE).alias("type"), F.lit(packs.TYPE_LABEL).alias("dst_label"), F.col("kind").alias("dst_name"), F.col("source_name").alias("dst_source")
    ).distinct()
    return wanted.join(edges.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def prune(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the entities that have nothing but edges to type nodes; meta and plan nodes always stay."""
    kept_labels = [packs.TYPE_LABEL, packs.SOURCE_LABEL, packs.PLAN_LABEL]
    alive = ends(edges).where(~((F.col("type") == packs.OF_TYPE) & (F.col("far_label") == packs.TYPE_LABEL))).select(*NODE_KEY).distinct()
    gone = nodes.where(~F.col("label").isin(kept_labels)).select(*NODE_KEY).join(alive, NODE_KEY, "left_anti")
    left_edges = edges
    for side in END.values():
        left_edges = left_edges.join(gone.select(*[F.col(b).alias(a) for a, b in zip(side, NODE_KEY)]), side, "left_anti")
    return nodes.join(gone, NODE_KEY, "left_anti"), left_edges


def repair(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, before, after)``: type edges cleaned and filled in, with the link statistics on either side."""
    clean = cleanup(edges)
    full = clean.unionByName(backfill(nodes, clean), allowMissingColumns=True)
    return full, link_statistics(nodes, edges), link_statistics(nodes, full)


# look-ups --------------------------------------------------------------------------------------------------


def lookup_entity(nodes: DataFrame, name: str) -> DataFrame:
    """All nodes of a name, in order of label and source."""
    return nodes.where(F.col("name") == name).orderBy("label", "source_name")


def lookup_relations(edges: DataFrame, name: str, direction: str = "both", kind: str | None = None) -> DataFrame:
    """``(subject, predicate, object)`` of the edges out of, into, or at a name, of one predicate if given."""
    at = {"out": F.col("src_name") == name, "in": F.col("dst_name") == name}
    where = at["out"] | at["in"] if direction == "both" else at[direction]
    if kind is not None:
        where = where & (F.col("type") == relation_type(F.lit(kind)))
    return edges.where(where).select(F.col("src_name").alias("subject"), F.replace("type", F.lit("_"), F.lit(" ")).alias("predicate"), F.col("dst_name").alias("object")).distinct()


def nodes_of(entities: DataFrame) -> DataFrame:
    """Nodes of extracted entities: canonical labels, upserts by id; rows without a name or a source are none."""
    rows = entities.where("name is not null and source_name is not null").select(
        canonical_type(F.col("entity_type"), F.col("name")).alias("label"), "name", "source_name", "description", "aliases", "document_id", "chunk_index", F.col("entity_id").alias("seq")
    )
    return upsert_nodes(None, rows.where(F.col("label") != ""))


def graph_of(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted entities and relations, the ends resolved by name and source."""
    nodes = nodes_of(entities)
    found = resolve_edges(relations.where("subject is not null and predicate is not null and object is not null"), nodes)
    edge_rows = found.select(*EDGE_KEY, "source_name", "document_id", "chunk_index", "confidence", F.col("relation_id").alias("seq"))
    return nodes, upsert_edges(None, edge_rows)


class GraphStore:
    """Nodes and edges kept as parquet under one folder; every write makes a new version, so a lost job leaves the last one whole.

    A version is whole or holds only what a merge added. Reading unites the last whole version with the additions
    since by one aggregation; after ``compact_after`` additions a merge writes a whole version again.
    """

    def __init__(self, spark: SparkSession, path: str, compact_after: int = 16):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after

    def _versions(self) -> list[tuple[int, bool]]:
        """``(version, whole)`` in order: one line for each write that ended."""
        try:
            rows = self.spark.read.schema("v long, whole boolean").json(f"{self.path}/_written").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return sorted((r["v"], r["whole"]) for r in rows)

    def version(self) -> int:
        return max((v for v, _ in self._versions()), default=-1)

    def _current(self) -> list[tuple[int, bool]]:
        known = self._versions()
        whole = max((k for k, (_, w) in enumerate(known) if w), default=0)
        return known[whole:]

    def read(self) -> tuple[DataFrame, DataFrame] | None:
        parts = self._current()
        if not parts:
            return None
        out = []
        for name, merge in (("nodes", upsert_nodes), ("edges", upsert_edges)):
            base = self.spark.read.parquet(f"{self.path}/{name}/v={parts[0][0]}") if parts[0][1] else None
            added = None
            for v, whole in parts:
                if not whole:
                    rows = self.spark.read.parquet(f"{self.path}/{name}/v={v}").withColumn("seq", F.lit(v).cast("long"))
                    added = rows if added is None else added.unionByName(rows, allowMissingColumns=True)
            out.append(base if added is None else merge(base, added))
        return out[0], out[1]

    def write(self, nodes: DataFrame, edges: DataFrame, whole: bool = True) -> int:
        v = self.version() + 1
        nodes.write.mode("overwrite").parquet(f"{self.path}/nodes/v={v}")
        edges.write.mode("overwrite").parquet(f"{self.path}/edges/v={v}")
        line = self.spark.createDataFrame([(v, whole)], "v long, whole boolean")
        line.coalesce(1).write.mode("append").json(f"{self.path}/_written")  # only now does the version exist
        return v

    def merge(self, nodes: DataFrame, edges: DataFrame, seq: str = "seq") -> int:
        """Adds rows: what is kept is not written again, but after ``compact_after`` additions."""
        v = self.write(upsert_nodes(None, nodes, seq), upsert_edges(None, edges, seq), whole=False)
        return self.write(*self.read()) if sum(not w for _, w in self._current()) >= self.compact_after else v

    def merge_all(self, parts: Iterable[tuple[DataFrame, DataFrame]], seq: str = "seq") -> int:
        """Merges one after another; the first that fails ends it, what was merged stays. Gives the number merged."""
        done = 0
        for nodes, edges in parts:
            try:
                self.merge(nodes, edges, seq)
            except Exception as e:  # noqa: BLE001
                log.warning("part %d is not merged: %s", done, str(e)[:300])
                break
            done += 1
        return done

    def clear(self) -> int:
        old = self.read()
        return self.version() if old is None else self.write(old[0].limit(0), old[1].limit(0))
