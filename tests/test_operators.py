"""Operators against plain models, golden cases and edge cases."""

import io
import json
import math
import random
import zipfile

import pytest
import regex
from pyspark.sql import Row
from pyspark.sql import functions as F

from planweave.functions import packs, payload, text, vectors
from planweave.operators import alias, chunking, extract, graph, ontology, resolve, search, skew
from planweave.plans import pipeline
from planweave.sources import providers, readers, sinks

SENTENCES = [
    "市应急管理局负责组织防汛抢险救援工作，各成员单位配合。",
    "２０２４年5月1日，水库　险情发生后30分钟内启动III级响应。",
    "依据《防汛 条例》第3条，应急指挥部向上级部门报告灾情。",
    "国家地震局和省水利厅、市气象局联合发布台风预警ABCD123",
    "",
    "plain latin text only",
    "专项预案包含人员转移、物资储备，行动需要应急物资",
    "应急" * 300 + "设备",
]


def span_model(t):
    out = []
    for k, (kind, pattern) in enumerate(packs.ENTITY_PATTERNS):
        for i, m in enumerate(regex.finditer(pattern, t)):
            out.append((m.start(), m.end(), k * 100000 + i, 0.6, m[0], packs.TYPE_MAP.get(kind, kind)))
    return out


def merge_model(spans):
    kept = []
    for s in sorted(spans):
        hit = next((k for k in kept if s[0] < k[1] and s[1] > k[0]), None)
        if hit is None:
            kept.append(s)
        elif s[3] > hit[3]:
            kept.remove(hit)
            kept.append(s)
    return sorted(kept, key=lambda s: -s[3])


def test_matches_and_offsets_equal_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES)] + [(99, None)], "doc_id long, text string")
    got = {r[0]: sorted(tuple(x) for x in r[1]) for r in df.select("doc_id", extract.entity_matches(F.col("text"))).collect()}
    for i, t in enumerate(SENTENCES):
        assert got[i] == sorted(span_model(t)), t
    assert got[99] == []


def test_merge_equals_model(spark):
    rnd = random.Random(3)
    cases = []
    for i in range(200):
        spans = []
        for k in range(rnd.randint(0, 12)):
            s = rnd.randint(-1, 30)
            spans.append((s, -1 if s < 0 else s + rnd.randint(1, 8), k, rnd.choice([0.5, 0.6, 0.8]), f"n{k}", "事件"))
        cases.append((i, spans))
    df = spark.createDataFrame(cases, f"i int, s array<{extract.SPAN}>")
    for i, got in df.select("i", extract.merge_overlaps(F.col("s"))).collect():
        assert [tuple(x) for x in got] == merge_model(cases[i][1])


def test_merged_spans_do_not_overlap(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES)], "doc_id long, text string")
    by_doc = {}
    for r in extract.entity_spans(df).collect():
        assert SENTENCES[r.doc_id][r.start_pos : r.end_pos] == r.name
        by_doc.setdefault(r.doc_id, []).append((r.start_pos, r.end_pos))
    for spans in by_doc.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_channels_model_first(spark):
    rows = [("d", 0, 4, 0, 0.8, "甲乙丙丁", "事件", 0), ("d", 2, 6, 0, 0.6, "丙丁戊己", "事件", 1), ("d", 8, 9, 1, 0.6, "庚", "事件", 1), ("d", 8, 9, 0, 0.6, "庚", "地点", 0)]
    df = spark.createDataFrame(rows, "k string, start_pos int, end_pos int, ord int, confidence double, name string, entity_type string, chan int")
    assert [(r.name, r.entity_type) for r in extract.combine_channels(df, "k").orderBy("place").collect()] == [("甲乙丙丁", "事件"), ("庚", "地点")]


def test_channels_with_large_ids(spark):
    """Ids beyond an int, and odd ids below even ones beyond 50,000,000: the channel decides before the id."""
    big = 7_000_000_000
    rows = [("d", 0, 4, 1, "odd", 1), ("d", 0, 4, big, "even", 0), ("d", 8, 9, big + 1, "odd", 1), ("d", 8, 9, 60_000_000, "even", 0), ("e", -1, -1, big, "even", 0), ("e", -1, -1, 3, "odd", 1)]
    df = spark.createDataFrame([(k, s, e, i, 0.6, n, "事件", c) for k, s, e, i, n, c in rows], "k string, start_pos int, end_pos int, ord long, confidence double, name string, entity_type string, chan long")
    got = [tuple(r) for r in extract.combine_channels(df, "k").select("k", "place", "start_pos", "name").orderBy("k", "place").collect()]
    assert got == [("d", 0, 0, "even"), ("d", 1, 8, "even"), ("e", 0, -1, "even"), ("e", 1, -1, "odd")]


def test_channels_in_short_runs(spark):
    """Runs of any length give the merge of the whole document, chains of overlaps and unknown places included."""
    rnd = random.Random(5)
    spans = {}
    for k in ("a", "b", None):
        for i in range(400):
            s = rnd.randint(-1, 900)
            spans.setdefault(k, []).append((s, -1 if s < 0 else s + rnd.randint(1, 9), i, rnd.choice([0.5, 0.6, 0.8]), f"n{i}", "事件"))
    rows = [(k, *s, s[2] % 2) for k, own in spans.items() for s in own]
    df = spark.createDataFrame(rows, "k string, start_pos int, end_pos int, ord int, confidence double, name string, entity_type string, chan int")
    for run in (1, 7, 1_000):
        got = {}
        for r in extract.combine_channels(df, "k", run).orderBy("place").collect():
            got.setdefault(r.k, []).append((r.place, r.name))
        for k, own in spans.items():
            want = merge_model([(s, e, i % 2 * 1_000 + i, *rest) for s, e, i, *rest in own])
            assert got[k] == [(place, s[4]) for place, s in enumerate(want)]


def chunk_model(t, size, overlap):
    if not t:
        return []
    tokens = lambda s: len(s) // 2
    if tokens(t) <= size:
        return [t]
    parts = lambda s: [x.strip() for x in regex.split(r"[。！？；]\s*", s) if x.strip()]
    chunks, now, n = [], "", 0
    for s in parts(t):
        if n + tokens(s) > size:
            if now:
                chunks.append(now)
            now = s
            if chunks:
                tail, used = [], 0
                for x in reversed(parts(chunks[-1])):
                    if used + tokens(x) > overlap:
                        break
                    tail.insert(0, x)
                    used += tokens(x)
                now = ("。".join(tail) + "。" if tail else "") + s
            n = tokens(now)
        else:
            now = now + "。" + s if now else s
            n += tokens(s)
    return chunks + [now] if now else chunks


def test_sentence_chunks_equal_model(spark):
    rnd = random.Random(5)
    texts = ["", None, "短文本", "无标点" * 50] + ["".join("灾" * rnd.randint(1, 30) + rnd.choice("。！？；") + " " * rnd.randint(0, 2) for _ in range(rnd.randint(1, 40))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for i, got in df.select("i", chunking.sentence_chunks(F.col("t"), 60, 20)).collect():
        assert got == chunk_model(texts[i], 60, 20), texts[i]


def test_groups_of_twelve_and_hot_source(spark):
    rows = [(f"r{i}", "a", f"text {i}", i) for i in range(25)] + [("", None, "x", 25), ("z", "a", "  ", 26)]
    df = spark.createDataFrame(rows, "rule_id string, source_name string, rule_text string, ord long")
    got = {r.group_id: len(r.members) for r in chunking.group_rules(df, 12).collect()}
    assert got == {"group_a_1_12": 12, "group_a_13_24": 12, "group_a_25_25": 1, "group_未知_1_1": 1}
    ranks = [r.rn for r in chunking.rank_within(df.where("source_name = 'a'"), "source_name", "ord", slice_rows=4).orderBy("ord").collect()]
    assert ranks == list(range(1, 27))


def test_golden_alias_map(spark):
    rows = [("A", [0.9063078, -0.42261827]), ("B", [1.0, 0.0]), ("C", [0.9063078, 0.42261827]), ("D", [0.64278764, 0.76604444])]
    df = spark.createDataFrame([(k, n, "t", v) for k, (n, v) in enumerate(rows)], "id long, name string, block string, v array<double>")
    got = alias.alias_map(df, "block", "id", "name", "v").collect()
    assert {(r.alias, r.canonical) for r in got} == {("B", "C"), ("D", "C")}


def test_neighbours_across_tiles(spark):
    rnd = random.Random(1)
    rows = [(i, "b", [rnd.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, block string, v array<double>")
    one = {(r.a, r.b) for r in alias.neighbours(df, "block", "id", "v", 0.5, 5).collect()}
    many = {(r.a, r.b) for r in alias.neighbours(df, "block", "id", "v", 0.5, 5, tile=7).collect()}
    assert one == many and one


def test_components_chain_and_shuffle(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    random.Random(2).shuffle(links)
    got = {r.key: r.component for r in alias.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert alias.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_vector_edges(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([], [1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(vectors.norm(F.col("a")).alias("n"), vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.dot(F.col("a"), F.col("b")).alias("d"), vectors.normalized(F.col("a")).alias("u")).collect()
    assert [round(r.n, 6) for r in got] == [5.0, 0.0, 0.0, 1.0]
    assert [round(r.c, 6) for r in got] == [0.96, 0.0, 0.0, 0.0]
    assert [r.d for r in got] == [24.0, 0.0, 0.0, 1.0]
    assert got[0].u == [0.6, 0.8] and got[2].u == [0.0, 0.0]


def test_search_tiers(spark):
    rules = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    none = rules.limit(0)
    assert {r.tier for r in search.tiered(rules, rules, "v", [1.0, 0.0], "id", 1).collect()} == {"rule"}
    assert {r.tier for r in search.tiered(rules.where("id = 2"), rules, "v", [1.0, 0.2], "id", 1).collect()} == {"weak_rule"}
    assert [r.tier for r in search.tiered(none, rules, "v", [1.0, 0.0], "id", 2).collect()] == ["chunk", "chunk"]


def test_search_of_a_query_set(spark):
    rnd = random.Random(5)
    data = [(i, i % 3, [rnd.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(rnd.choice([3, 4]))]) for i in range(60)] + [(60, 0, None), (61, 1, []), (62, 9, [1.0, 1.0, 1.0])]
    rows = spark.createDataFrame(data, "id long, b long, v array<double>")
    queries = rows.where("id % 5 = 0")

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a or []) * sum(x * x for x in b or []))
        return round(sum(x * y for x, y in zip(a, b)) / n, 12) if n and len(a) == len(b) else 0.0

    def model(pool, block):
        return sorted((q, i, s) for q, c, v in data if q % 5 == 0 for s, i in [(-s, i) for s, i in sorted((-cos(v, w), i) for i, b, w in pool if not block or b == c)[:7]])

    for tile in (2048, 8):
        for block in (None, "b"):
            got = sorted((r.query, r.key, round(r.similarity, 9)) for r in search.top_k_set(rows, queries, "v", "id", 7, block, tile).collect())
            assert got == [(q, i, round(s, 9)) for q, i, s in model(data, block)]
    out = search.tiered_set(rows.where("b < 2"), rows, rows.where("id in (0, 1, 2, 62)"), "v", "id", 3, block="b").collect()
    assert {(r.query, r.tier) for r in out} == {(0, "rule"), (1, "rule"), (2, "chunk"), (62, "chunk")}
    assert {r.tier for r in search.tiered_set(rows.where("b < 0"), rows, queries, "v", "id", 3).collect()} == {"chunk"}


def test_upsert_first_and_last_writes(spark):
    rows = [("事件", "n", "s", 1, "a", None, 10), ("事件", "n", "s", 2, None, "x", 20), ("事件", "n", "s", 3, "c", None, 30), ("事件", None, "s", 4, "d", None, 40)]
    df = spark.createDataFrame(rows, "label string, name string, source_name string, seq long, description string, document_id string, created_at long")
    once = graph.upsert_nodes(None, df)
    assert [tuple(r) for r in once.select("description", "document_id", "created_at").collect()] == [("c", "x", 10)]
    twice = graph.upsert_nodes(once, df)
    assert sorted(map(tuple, twice.select(once.columns).collect())) == sorted(map(tuple, once.collect()))


def test_endpoints_fan_out_and_vanish(spark):
    nodes = spark.createDataFrame([("事件", "a", "s"), ("地点", "a", "s"), ("行动", "b", "s"), ("行动", "b", "t")], "label string, name string, source_name string")
    rels = spark.createDataFrame([("a", "包含 于", "b", "s"), ("a", "向...报告", "zz", "s"), ("b", "p", "b", None)], "subject string, predicate string, object string, source_name string")
    got = graph.resolve_edges(rels, nodes).collect()
    assert sorted((r.src_label, r.type) for r in got if r.source_name) == [("事件", "包含_于"), ("地点", "包含_于")]
    assert len([r for r in got if r.source_name is None]) == 4


def test_repair_is_idempotent_and_prunes(spark):
    nodes = spark.createDataFrame([("事件", "a", "s"), ("设备", "b", "s"), ("地点", "c", "s"), ("实体类型", "事件", "s"), ("数据源", "s", "s")], "label string, name string, source_name string")
    edge = "src_label string, src_name string, src_source string, type string, dst_label string, dst_name string, dst_source string"
    edges = spark.createDataFrame([("事件", "a", "s", "属于类型", "事件", "a", "s"), ("实体类型", "事件", "s", "属于类型", "地点", "c", "s"), ("地点", "c", "s", "属于类型", "数据源", "s", "s"), ("事件", "a", "s", "位于", "地点", "c", "s")], edge)
    fixed, before, after = graph.repair(nodes, edges)
    assert {(r.src_name, r.type, r.dst_name) for r in fixed.collect()} == {("a", "位于", "c"), ("a", "属于类型", "事件"), ("b", "属于类型", "物资"), ("c", "属于类型", "地点")}
    assert sum(r.missing for r in before.collect()) == 2 and sum(r.missing for r in after.collect()) == 0
    again, _, _ = graph.repair(nodes, fixed)
    assert again.count() == fixed.count()
    kept, left = graph.prune(nodes, fixed)
    assert {r.name for r in kept.collect()} == {"a", "c", "事件", "s"}
    assert {r.src_name for r in left.collect()} == {"a", "c"}


def test_store_versions(spark, tmp_path):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    assert store.read() is None
    nodes = spark.createDataFrame([("事件", "a", "s", 1, "x")], "label string, name string, source_name string, seq long, description string")
    edges = spark.createDataFrame([("事件", "a", "s", "t", "事件", "a", "s", 1, 0.5)], "src_label string, src_name string, src_source string, type string, dst_label string, dst_name string, dst_source string, seq long, confidence double")
    store.merge(nodes, edges)
    store.merge(nodes, edges)
    got = store.read()
    assert store.version() == 1 and got[0].count() == 1 and got[1].first().confidence == 0.5
    store.clear()
    assert store.read()[0].count() == 0


def test_specificity_and_cycles(spark):
    nodes = ontology.plan_nodes(spark)
    got = {r.name: (r.depth, r.specificity) for r in ontology.specificity(nodes, ontology.plan_edges(spark), nodes.where("level = 'L0'")).collect()}
    depths = sorted(d for d, _ in got.values())
    assert depths == [0] + [1] * 9 + [2] * 5 + [3] and got["赤潮灾害应急预案"][1] == 1.0
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("a", "c"), ("x", "y")], "child string, parent string")
    names = spark.createDataFrame([(n,) for n in "abcxy"], "name string")
    assert {r.name: r.depth for r in ontology.depths(names, edges, names.where("name = 'a'")).collect()} == {"a": 0, "b": 1, "c": 2, "x": None, "y": None}


def test_depths_of_a_long_chain(spark):
    n = 70
    nodes = spark.range(n + 1).selectExpr("concat('n', id) as name")
    edges = spark.range(n).selectExpr("concat('n', id + 1) as child", "concat('n', id) as parent")
    got = {r.name: r.depth for r in ontology.depths(nodes, edges.unionByName(spark.createDataFrame([("n0", "n70")], edges.schema)), nodes.where("name = 'n0'")).collect()}
    assert got == {f"n{i}": i for i in range(n + 1)}


def test_anchor_equals_containment(spark):
    sources = spark.createDataFrame([("某市防汛抗旱应急预案汇编",), ("防汛",), ("无关",), (None,)], "source_name string")
    plans = spark.createDataFrame([("防汛抗旱应急预案",), ("防汛",), ("抗旱应急",), ("",)], "name string")
    got = {tuple(r) for r in ontology.anchor(sources, plans).select("source_name", "plan").collect()}
    want = {(s, p) for (s,) in map(tuple, sources.collect()) for (p,) in map(tuple, plans.collect()) if s and p and p in s}
    assert got == want and len(got) == 4


def test_bridge_thresholds(spark):
    base = {"subject": "甲", "object": "乙", "subject_type": None, "object_type": "", "relation_id": 1}
    rows = [Row(**base, predicate=p, confidence=c, source_text=e) for p, c, e in [("负责", 0.85, "甲负责乙"), ("负责", 0.84, "甲负责乙"), ("负责", None, "甲负责乙"), ("负责", 0.9, " "), ("听说", 0.9, "甲听说乙"), ("听说", 0.9, "无")]]
    df = spark.createDataFrame(rows, "subject string, object string, subject_type string, object_type string, relation_id int, predicate string, confidence double, source_text string")
    got = [(r.predicate, r.confidence, r.entailment_score, r.subject_type) for r in resolve.bridges(df, providers.entailment(providers.Offline())).collect()]
    assert sorted(got) == sorted([("负责", 0.85, None, "未知"), ("听说", 0.9, 1.0, "未知")])


PAYLOADS = [
    ('```json\n{"entities": [{"name": "a", "type": "事件"}], "relations": [],}\n```', "a", 0),
    ('前言 {"entities": [{"name": "a", "confidence": NaN}], "relations": [{"subject": "x", "predicate": "p", "object": "o"},]} 后记', "a", 1),
    ("{'entities': [{'name': 'a', 'type': None}], 'relations': []}", "a", 0),
    ('{"entities": [{"name": "a", "type": "t"}, {"name": "b", "ty', "a", 0),
    ('{"result": {"entities": [{"name": "a"}], "relations": []}}', "a", 0),
    ('[{"name": "a", "type": "t"}]', "a", 0),
    ('[{"subject": "s", "predicate": "p", "object": "o"}]', None, 1),
    ('{"entities": [{实体"name": "a", "confidence": 约0.9}], "relations": []}', "a", 0),
    ("", None, 0),
    (None, None, 0),
    ("no json { at all", None, 0),
]


@pytest.mark.parametrize("answer,name,relations", PAYLOADS)
def test_tolerant_payload(answer, name, relations):
    got = payload.parse(answer)
    assert set(got) == {"entities", "relations", "alias_map", "canonical_entities", "bridge_relations"}
    assert (got["entities"][0]["name"] if got["entities"] else None) == name and len(got["relations"]) == relations


def test_payload_column_and_alias_map(spark):
    df = spark.createDataFrame([('{"alias_map": {"a": "b"}, "canonical_entities": [{"name": "b", "aliases": ["a"]}]}',), (None,)], "t string")
    rows = [r.p for r in df.select(payload.parsed("t").alias("p")).collect()]
    assert rows[0].alias_map == {"a": "b"} and rows[0].canonical_entities[0]["aliases"] == '["a"]' and rows[1].entities == []
    best = spark.createDataFrame([(["x", '{"entities": [], "relations": []}', '{"alias_map": {}}'],)], "s array<string>").select(payload.best_string(F.col("s"))).first()[0]
    assert best.startswith('{"entities"')


def docx(paragraphs, table):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in table)
    xml = f"<w:document {w}><w:body>{p(paragraphs[0])}<w:tbl>{rows}</w:tbl>{''.join(map(p, paragraphs[1:]))}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def test_docx_scan(spark, tmp_path):
    (tmp_path / "plan.docx").write_bytes(docx(["第一段", " ", "第二段"], [["a", "", "b"], ["", ""]]))
    (tmp_path / "bad.docx").write_bytes(b"not a zip")
    (tmp_path / "other.txt").write_text("x")
    got = {(r.document, r.section_index): (r.text, r.error is None) for r in readers.read_docx(spark, str(tmp_path)).collect()}
    assert got[("plan", 0)] == ("第一段", True) and got[("plan", 1)] == ("第二段", True) and got[("plan", 2)] == ("a | b", True)
    assert got[("bad", -1)] == (None, False) and len(got) == 4


def test_rule_files(spark, tmp_path):
    sinks.save_json([{"rule_id": "1", "rule_text": "应当报告", "rule_source": ""}, {"rule_text": " ", "rule_source": "源"}], str(tmp_path / "a.json"))
    sinks.save_json({"rule_id": "2", "rule_text": "必须"}, str(tmp_path / "b.json"))
    (tmp_path / "c.json").write_text("{broken")
    rows = readers.read_rules(spark, str(tmp_path / "*.json"))
    assert sorted((r.rule_id or "", r.source_name) for r in rows.collect()) == [("", "源"), ("1", "a"), ("2", "b")]
    shaped = readers.shape_rules(rows).collect()
    assert {r.rule_name for r in shaped} == {packs.DEFAULT_RULE_NAME} and len(shaped) == 2
    assert sinks.load_json(str(tmp_path / "b.json"))[0]["rule_id"] == "2"


def test_scalar_edges(spark):
    rows = [("a", None), ("b", ""), ("c", "　全角ＡＢＣ１２　（x）—y "), ("d", "12345"), ("e", "ab!!!"), ("f", "好！！？。了")]
    df = spark.createDataFrame(rows, "k string, t string")
    c = F.col("t")
    got = {r.k: r for r in df.select("k", text.normalize_text(c).alias("n"), text.clean_text(c).alias("cl"), text.valid_entity(c).alias("v"), text.token_estimate(c).alias("tok"), text.features(c)["word_count"].alias("w")).collect()}
    assert got["c"].n == "全角ABC12 (x)-y" and got["a"].n == "" and got["f"].cl == "好。了"
    assert [got[k].v for k in "abcdef"] == [False, False, True, False, False, False] or got["f"].v is False
    assert got["a"].tok == 0 and got["a"].w is None and got["d"].w == 1


def test_canonical_types(spark):
    df = spark.createDataFrame([("设备", "x"), (" 事件 ", "x"), ("未知", "某预案"), ("未知", "监测系统"), (None, None), ("怪", "x")], "t string, n string")
    assert [r[0] for r in df.select(text.canonical_type(F.col("t"), F.col("n"))).collect()] == ["物资", "事件", "法规", "物资", "", "怪"]


def test_provider_attempts_and_errors(spark):
    class Flaky(providers.Offline):
        def chat(self, prompt, system="", temperature=0.3):
            if prompt == "bad":
                raise RuntimeError("x")
            return "" if temperature == 0.3 else "ok"


    df = spark.createDataFrame([("good",), ("bad",)], "prompt string")
    got = {r.prompt: (r.answer, r.status, r.attempt) for r in providers.ask(df, Flaky()).collect()}
    assert got == {"good": ("ok", "ok", 2), "bad": (None, "error: RuntimeError", 3)}
    with pytest.raises(ValueError):
        providers.create("nobody")
    traced = providers.trace(providers.ask(df, Flaky()), "m").collect()
    assert {r.prompt_chars for r in traced} == {3, 4} and all("prompt" not in r or len(r.prompt_sha256) == 64 for r in traced)


def test_pipeline_end_to_end(spark):
    from planweave.plans import pipeline

    rules = spark.createDataFrame([(f"r{i}", "规则", f"应急指挥部负责防汛抢险。第{i}次应当在3小时内报告。", ["Action"], ["预警"], "国家防汛抗旱应急预案", "国家防汛抗旱应急预案", i) for i in range(14)], readers.RULE + ", source_name string, ord long")
    entities = '{"entities": [{"name": "防汛抢险", "type": "行动", "confidence": 0.9}, {"name": "应急指挥部", "type": "组织机构", "confidence": 0.9}], "relations": []}'
    merged = '{"alias_map": {"防汛抢险": "防汛抢险行动"}, "canonical_entities": [{"name": "水库", "type": "地点", "aliases": ["大坝"]}], "bridge_relations": [{"subject": "应急指挥部", "predicate": "管辖", "object": "水库", "confidence": 0.9, "s_evidence": "管辖水库"}, {"subject": "水库", "predicate": "听说", "object": "应急指挥部", "confidence": 0.9, "s_evidence": "无"}]}'
    built = pipeline.build(spark, rules, providers.Offline(16, lambda p: merged if "孤立实体" in p else entities))
    names = {r.name for r in built.nodes.where("label <> '实体类型'").collect()}
    kinds = {r.type: r["count"] for r in built.edges.groupBy("type").count().collect()}
    assert built.groups.count() == 2 and {"应急指挥部", "防汛抢险行动", "水库", "国家防汛抗旱应急预案"} <= names
    assert kinds == {"负责": 1, "管辖": 1, "属于类型": 3, "包含类型": 8, "BELONGS_TO_SOURCE": 4, "SUB_PLAN_OF": 15}
    assert "documents: 2" in built.report and built.traces.count() == 2
    assert sum(r.missing for r in built.after.collect()) == 0


def test_rule_stream_into_graph(spark, tmp_path):
    from planweave.streaming import rules as stream

    folder = tmp_path / "in"
    folder.mkdir()
    line = '{"rule_id": "1", "rule_text": "市应急部门负责防汛工作", "rule_source": "源", "loaded_at": "2031-01-01T00:00:00"}\n'
    (folder / "a.json").write_text(line * 3)
    store = graph.GraphStore(spark, str(tmp_path / "graph"))
    job = stream.rule_stream(spark, str(folder)).writeStream.foreachBatch(stream.merge_into(store)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert job.awaitTermination(120)
    nodes, edges = store.read()
    assert nodes.count() > 0
    first = nodes.count()
    (folder / "b.json").write_text(line)
    job = stream.rule_stream(spark, str(folder)).writeStream.foreachBatch(stream.merge_into(store)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert job.awaitTermination(120)
    assert store.read()[0].count() == first


def test_skewed_lookup_equals_join(spark):
    from planweave.operators.skew import lookup

    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(100)], "k string, x int")
    values = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("m"))
    plain = sorted(map(tuple, rows.join(values.drop("n"), "k").collect()))
    split = sorted(map(tuple, lookup(rows, values, "k", "n", 600, 500, share=0.1, least=10).collect()))
    assert plain == split


def test_documents_to_rules(spark, tmp_path):
    from planweave.plans import pipeline

    (tmp_path / "plan.docx").write_bytes(docx(["应急部门应当在3小时内报告。", "演练。"], [["表", "一"]]))
    answer = '好的：```json\n{"rules": [{"rule_text": "部门应当报告", "elements": ["主体"], "动作": "报告"}, {"rule_text": "部门应当报告 "}, {"rule_text": "无"}, {"rule_name": "x"},]}\n```'
    rules = pipeline.rules_from_documents(spark, str(tmp_path), str(tmp_path / "out"), providers.Offline(8, lambda p: answer))
    got = rules.collect()
    assert [(r.rule_text, r.rule_id, r.rule_name, r.rule_source) for r in got] == [("部门应当报告", "1", packs.DEFAULT_RULE_NAME, "plan")]
    assert {"Action", "Subject"} <= set(got[0].elements)
    records = spark.read.parquet(str(tmp_path / "out" / "rules")).collect()
    assert records[0].dim == 8 and records[0].source.document == "plan" and round(records[0].norm_l2, 6) == 1.0


@pytest.mark.parametrize("answer,n", [('[{"rule_text": "a"}, {"rule_text": " "}]', 1), ('{"output": [{"rule_text": "a"}]}', 1), ("x", 0), (None, 0), ('{"rule_text": "a"}', 1), ('[{"rule_text": "a"}, {"rule_text": "b', 1)])
def test_rule_answers(answer, n):
    assert len(payload.parse_rules(answer)) == n


def test_command_line(spark, tmp_path, capsys):
    from planweave import __main__ as cli

    sinks.save_json([{"rule_id": "1", "rule_text": "应急指挥部负责组织抢险。", "rule_source": "国家防汛抗旱应急预案"}], str(tmp_path / "r.json"))
    folder = str(tmp_path / "graph")
    assert cli.main(["query", "--graph", folder]) == 1
    assert cli.main(["build", "--rules", str(tmp_path / "r.json"), "--graph", folder]) == 0
    assert "Build report" in capsys.readouterr().out
    for args in (["query", "--graph", folder], ["query", "--graph", folder, "--name", "国家防汛抗旱应急预案"], ["summary", "--graph", folder, "--out", str(tmp_path / "s.json")], ["repair", "--graph", folder]):
        assert cli.main(args) == 0
    out = capsys.readouterr().out
    assert "SUB_PLAN_OF" in out and '"missing_after": 0' in out and "error" not in out


def test_summary_loses_no_count(spark, tmp_path):
    rows = [("任务", f"n{i}", f"s{i % 7}") for i in range(30)] + [("地点", f"m{i}", "s0") for i in range(5)]
    nodes = spark.createDataFrame(rows, "label string, name string, source_name string").withColumns({"description": F.lit(""), "aliases": F.array().cast("array<string>"), "document_id": F.lit("d"), "chunk_index": F.lit(0)})
    edges = spark.createDataFrame([("任务", f"n{i}", f"s{i % 7}", f"T{i % 11}", "任务", "n0", "s0", f"s{i % 7}", True) for i in range(30)], "src_label string, src_name string, src_source string, type string, dst_label string, dst_name string, dst_source string, source_name string, is_bridge boolean")
    whole, part = graph.summary(nodes, edges), graph.summary(nodes, edges, tables=str(tmp_path))
    for name in graph.OPEN:
        assert [r["n"] for r in whole[name]] == sorted((r["n"] for r in whole[name]), reverse=True)
        assert part[name] == [{"table": f"{tmp_path}/{name}", "rows": len(whole[name])}] and spark.read.json(f"{tmp_path}/{name}").agg(F.sum("n")).first()[0] == sum(r["n"] for r in whole[name])
    many = spark.range(10_500).selectExpr("concat('l', id) as label")
    text = pipeline.report_text(spark.createDataFrame([(1, 1, 0, 1.0, 1, 1)], "documents int, succeeded int, failed int, success_rate double, entities int, relations int"), many, edges, graph.link_statistics(nodes, edges), 1.0)
    assert text.count("- label l") == 10_500 and text.count("- type T") == 11 and "seconds a document: 1.000" in text


def test_command_line_gives_every_row_of_a_name(spark, tmp_path, capsys):
    from planweave import __main__ as cli

    folder = str(tmp_path / "graph")
    nodes = spark.range(1500).selectExpr("'任务' as label", "'hub' as name", "concat('s', id) as source_name")
    edges = spark.range(2500).selectExpr("'hub' as src_name", "'A_B' as type", "concat('o', id) as dst_name")
    graph.GraphStore(spark, folder).write(nodes, edges)
    capsys.readouterr()
    assert cli.main(["query", "--graph", folder, "--name", "hub"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert [r["source_name"] for r in got["nodes"]] == sorted(f"s{i}" for i in range(1500))
    assert [r["object"] for r in got["relations"]] == sorted(f"o{i}" for i in range(2500)) and got["relations"][0]["predicate"] == "A B"
    assert cli.main(["query", "--graph", folder, "--name", "nobody"]) == 0
    assert json.loads(capsys.readouterr().out) == {"nodes": [], "relations": []}


def test_store_adds_and_compacts(spark, tmp_path):
    """A merge writes what it adds and nothing else, and reading gives the same as one upsert of all."""
    folder = tmp_path / "g"
    store = graph.GraphStore(spark, str(folder), compact_after=3)
    schema = "label string, name string, source_name string, seq long, description string"
    edges = spark.createDataFrame([], "src_label string, src_name string, src_source string, type string, dst_label string, dst_name string, dst_source string, seq long, confidence double")
    batches = [[("任务", f"n{i % (3 + b)}", "s", i, f"b{b}i{i}") for i in range(6)] for b in range(5)]
    for b, rows in enumerate(batches):
        v = store.merge(spark.createDataFrame(rows, schema), edges)
        written = spark.read.parquet(str(folder / f"nodes/v={b if b < 2 else b}"))
        assert written.count() <= 3 + b
        assert v == (b if b < 2 else b + 1)
    want = {}
    for rows in batches:
        for _, name, _, _, text in rows:
            want[name] = text
    assert {r["name"]: r["description"] for r in store.read()[0].collect()} == want
    assert [w for _, w in store._versions()] == [False, False, False, True, False, False]


def test_merging_ends_at_the_first_failure(spark, tmp_path):
    store = graph.GraphStore(spark, str(tmp_path / "g"))
    nodes = spark.createDataFrame([("任务", "n", "s", 1)], "label string, name string, source_name string, seq long")
    edges = spark.createDataFrame([], "src_label string, src_name string, src_source string, type string, dst_label string, dst_name string, dst_source string, seq long, confidence double")
    assert store.merge_all([(nodes, edges), (nodes.drop("label"), edges), (nodes, edges)]) == 1 and store.read()[0].count() == 1


def test_hub_and_star_are_looked_up_apart(spark, monkeypatch):
    """A name in a third of all relations, and a vertex with half of all links, give the same with and without the hot path."""
    nodes = spark.createDataFrame([("任务", f"n{i}", "s") for i in range(50)] + [("地点", "n0", "s")], "label string, name string, source_name string")
    rels = spark.createDataFrame([(f"n{0 if i % 3 == 0 else i % 50}", "在", f"n{i % 47}", "s" if i % 5 else None, i) for i in range(900)], "subject string, predicate string, object string, source_name string, relation_id long")
    links = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 420)], "a long, b long")
    plain = sorted(map(tuple, graph.resolve_edges(rels, nodes).select(*graph.EDGE_KEY, "relation_id").collect())), sorted(map(tuple, alias.components(links).collect()))
    monkeypatch.setattr(skew, "hot_threshold", lambda total, share=0, least=0: 40)
    hot = sorted(map(tuple, graph.resolve_edges(rels, nodes).select(*graph.EDGE_KEY, "relation_id").collect())), sorted(map(tuple, alias.components(links).collect()))
    assert plain == hot and len(plain[0]) > 900


def test_rule_files_in_order_of_name(spark, tmp_path):
    """A large late file and a small early one: order follows the names, then the place in the file."""
    for name, n in (("c.json", 3), ("b+ 二.json", 400), ("a.json", 1)):
        (tmp_path / name).write_text(json.dumps([{"rule_id": f"{name[0]}{k:03}", "rule_text": "应当巡查"} for k in range(n)], ensure_ascii=False), encoding="utf-8")
    got = [r["rule_id"] for r in readers.read_rules(spark, f"{tmp_path}/*.json").orderBy("ord").collect()]
    assert got == ["a000"] + [f"b{k:03}" for k in range(400)] + [f"c{k:03}" for k in range(3)]


def test_best_string_is_bounded_in_length(spark):
    good = '{"entities": [], "relations": []}'
    rows = spark.createDataFrame([([good, "z" * 200_000],), ([" ", ""],), ([],), ([good, '{"alias_map": {}}'],)], "v array<string>")
    assert [r[0] for r in rows.select(payload.best_string(F.col("v"))).collect()] == [good, None, None, good]
    assert payload.pick_string({"a": ["z" * 200_000, {"b": good}], "c": 3}) == good and payload.pick_string([None, " "]) == ""


def test_chat_over_http(monkeypatch):
    """JSON is asked for, an empty content is replaced by the best string of the answer, and entailment reads labels."""
    sent = []

    def post(self, path, body):
        sent.append((path, body))
        if path == "http://judge":
            return [[{"label": "ENTAILMENT", "score": 0.7}, {"label": "neutral", "score": 0.9}, {"label": "weak-entail", "score": 0.8}]]
        return {"choices": [{"message": {"role": "assistant", "content": None if body["messages"][-1]["content"] == "empty" else "0.25", "reasoning": 'so {"entities": [], "relations": []}'}}]}

    monkeypatch.setattr(providers.Http, "_post", post)
    client = providers.create("http", url="http://x", model="m")
    assert client.chat("empty") == 'so {"entities": [], "relations": []}' and sent[-1][1]["response_format"] == {"type": "json_object"}
    assert client.entail("a", "b") == 0.25 and "response_format" not in sent[-1][1]
    assert providers.create("http", url="http://x", model="m", entailment_url="http://judge").entail("a", "b") == 0.8
    assert providers.create("classifier", path="/nowhere").entail("a", "b") == 0.0
    assert providers.entailment_score({"label": "contradiction", "score": 1}) == 0.0


def test_upsert_is_idempotent_and_order_free(spark):
    rnd = random.Random(12)
    rows = [(rnd.choice("ab"), rnd.choice("xyz"), "s", i, rnd.choice([None, f"d{i}"])) for i in range(60)]
    schema = "label string, name string, source_name string, seq long, description string"
    one = sorted(map(tuple, graph.upsert_nodes(None, spark.createDataFrame(rows, schema)).collect()))
    rnd.shuffle(rows)
    assert sorted(map(tuple, graph.upsert_nodes(None, spark.createDataFrame(rows + rows, schema)).collect())) == one
