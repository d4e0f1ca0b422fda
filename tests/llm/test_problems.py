"""The operators on training data against brute force, round trips, edge cases and the SQL that exists."""

import random

import pytest
from oracle import compare
from pyspark.sql import functions as F

from planweave.llm import components, copies, encode, lookalikes, moderation, names, packing, pieces, queries
from planweave.session import table

FULL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, small, name):
    compare(spark, small, queries.QUERIES[name], queries.ORACLE[name])


# 1 -----------------------------------------------------------------------------------------------------------


def union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def groups_of(spark, rows, schema="alias_id long, canonical_id long, v long, u string, m int"):
    df = spark.createDataFrame([(a, b, 1, "x", None) for a, b in rows], schema)
    return {r.id: r.group_id for r in components.connected_groups(df, "alias_id", "canonical_id").collect()}


def test_groups_equal_union_find(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randint(0, 150), rnd.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (7, 3), (3, 7), (900, 900)]
    pairs += [(2000, 2001 + i) for i in range(50)]
    want = union_find(pairs)
    assert groups_of(spark, pairs) == want
    rnd.shuffle(pairs)
    assert groups_of(spark, [(b, a) for a, b in pairs]) == want


def test_groups_of_nothing_and_nulls(spark):
    assert groups_of(spark, []) == {}
    assert groups_of(spark, [(None, 1), (1, None), (None, None)]) == {}
    assert groups_of(spark, [(4, 4), (None, 4)]) == {4: 4}


def test_every_record_has_one_group(spark, small):
    rows = [tuple(r) for r in queries.p1_groups(spark, small).collect()]
    group = dict(rows)
    records = {r.canon_id for r in table(spark, small, "canonical_entities").collect()}
    matched = dict(tuple(r) for r in components.connected_groups(table(spark, small, "alias_map"), "alias_id", "canonical_id").collect())
    assert len(rows) == len(group) and set(group) == records | set(matched) and records - set(matched)
    assert all(group[i] == matched.get(i, i) for i in group)


# 2 -----------------------------------------------------------------------------------------------------------


def linked(spark, rows, canonical=()):
    """Pairs of names that come out as one, from (name, type) rows of one document."""
    e = spark.createDataFrame([(i, "d", n, t, "x") for i, (n, t) in enumerate(rows)], "entity_id long, document_id string, name string, entity_type string, form string")
    c = spark.createDataFrame([(i, "d", n, t, a) for i, (n, t, a) in enumerate(canonical)], "canon_id long, document_id string, name string, entity_type string, aliases array<string>")
    return {tuple(sorted((rows[r.entity_id_a][0], rows[r.entity_id_b][0]))) for r in names.found(e, c).collect()}


ORG, PER = names.ORGANISATION, names.PERSON


def test_bodies(spark):
    same = ["临河湾县交通运输局", "交通运输局（临河湾县）", "临河湾县交运局", "临河湾县交通运输居", "某某省临河湾县交通运输局", "临​河湾县交通运输局"]
    other = ["临河湾区交通运输局", "临河湾县应急救援第一中队", "临河湾县应急救援第二中队"]
    got = linked(spark, [(n, ORG) for n in same + other])
    assert got == {tuple(sorted((a, b))) for a in same for b in same if a != b}


def test_latin_bodies(spark):
    same = ["Oakmere District Water Supply Authority", "Water Supply Authority, Oakmere District", "The Oakmere Dist. Water Supply Auth.", "ODWSA", "Oakmer District Water Supply Authority"]
    got = linked(spark, [(n, ORG) for n in same + ["Oakmere Borough Water Supply Authority", "Oakmere District Mine Rescue Unit"]])
    assert got == {tuple(sorted((a, b))) for a in same for b in same if a != b}


def test_persons(spark):
    same = ["彭志鹏", "彭致鹏", "Zhipeng Peng", "PENG Zhi-peng", "彭志鹏主任", "老彭"]
    english = ["Margaret Oakley", "Peggy Oakley", "OAKLEY Margaret", "Margaret Oakly", "M. Oakley"]
    got = linked(spark, [(n, PER) for n in same + english + ["韩志琳", "Rebecca Oakley"]])
    assert got == {tuple(sorted((a, b))) for part in (same, english) for a in part for b in part if a != b}


def test_a_slip_in_each_word(spark):
    assert linked(spark, [("Andrea Brcakbroke", PER), ("Adrea Brackbroke", PER)]) == {("Adrea Brackbroke", "Andrea Brcakbroke")}
    rnd = random.Random(7)

    def slip(w):
        k, c = rnd.randrange(len(w)), rnd.choice("bdkmz")
        return rnd.choice([w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + w[k + 1 : k + 2] + w[k] + w[k + 2 :]])

    for w in ["Andrea", "Brackbroke", "Oakly", "Mary", "Lee", "Rosa"] * 200:
        v = slip(w.lower())
        assert len(v) < 3 or set(names._ends(w.lower())) & set(names._ends(v)), (w, v)


def test_short_bodies_with_a_slip_in_the_third_sign(spark):
    assert linked(spark, [("临河县民政局", ORG), ("临河山民政局", ORG)]) == {tuple(sorted(("临河县民政局", "临河山民政局")))}


def test_jaro_winkler_decides(spark, monkeypatch):
    """With another similarity other names are the same, in Han as in Latin letters."""
    names.use_readings(names.readings(spark))
    near = [("临河湾县交通运输局", "临河湾县交通运输居", ORG), ("临河湾县交通运输局", "临河湾县交通输运局", ORG), ("彭志鹏", "彭致鹏", PER), ("Margaret Oakley", "Matgaret Oakley", PER), ("Oakmere District Water Supply Authority", "Oakmere Disttict Water Suply Authority", ORG)]
    far = [("临河湾县交通运输局", "河临县湾通交运输局", ORG), ("彭志鹏", "彭志强", PER), ("Margaret Oakley", "Rgamrate Oakley", PER), ("Oakmere District Water Supply Authority", "Oakmere District Mine Rescue Unit", ORG)]

    def verdicts(rows):
        return [names.compare(names.Name(a, t == PER), names.Name(b, t == PER)) for a, b, t in rows]

    assert verdicts(near) == ["strong"] * 5 and verdicts(far) == [""] * 4
    real = names.jaro_winkler
    monkeypatch.setattr(names, "jaro_winkler", lambda a, b: real(a, b) if a == b else 0.0)
    assert verdicts(near)[1:2] + verdicts(near)[3:] == [""] * 3
    monkeypatch.setattr(names, "jaro_winkler", lambda a, b: 1.0)
    assert all(verdicts(far)[k] == "strong" for k in (0, 1, 2))


def test_bodies_a_slip_apart_share_a_block(spark):
    names.use_readings(names.readings(spark))
    rnd = random.Random(8)
    whole = "临河湾县交通运输局"
    for _ in range(200):
        k, c = rnd.randrange(len(whole)), rnd.choice("水火山木石")
        slipped = rnd.choice([whole[:k] + c + whole[k + 1 :], whole[:k] + c + whole[k:], whole[:k] + whole[k + 1 :], whole[:k] + whole[k + 1 : k + 2] + whole[k] + whole[k + 2 :]])
        keys = [{x for x in names.Name(n, False).keys() if x[0] == "s"} for n in (whole, slipped)]
        assert keys[0] & keys[1], slipped


def test_ambiguous_short_form_joins_nobody(spark):
    assert linked(spark, [("王小明", PER), ("王大海", PER), ("老王", PER)]) == set()


def test_alias_of_a_record_links(spark):
    assert linked(spark, [("老黄牛", PER), ("李波华", PER)], [("李波华", PER, ["老黄牛", None])]) == {("李波华", "老黄牛")}


def test_names_nulls_types_and_repeats(spark):
    e = spark.createDataFrame([(1, "d", None, ORG), (2, None, "甲县水务局", ORG), (3, "d", " ", ORG), (4, "d", "临河湾县水务局", None), (5, "d", "临河湾县水务局", ORG), (5, "d", "临河湾县水务局", ORG), (6, "d", "临河湾县水务局", ORG), (7, "e", "临河湾县 水务局", ORG)], "entity_id long, document_id string, name string, entity_type string")
    c = spark.createDataFrame([], "canon_id long, document_id string, name string, entity_type string, aliases array<string>")
    assert names.found(e, c).count() == 0
    assert names.found(e.limit(0), c).count() == 0
    assert {r.entity_id for r in names.groups(e, c).collect()} == {5, 6, 7}


def test_records_of_one_document_stay_apart(spark):
    """Canonical records of a document are different ones, so no direct comparison may join two of them for sure."""
    names.use_readings(names.readings(spark))
    rows = table(spark, FULL, "canonical_entities").where(F.col("entity_type").isin(ORG, PER) & F.col("name").isNotNull()).select("document_id", "entity_type", "name").collect()
    by = {}
    for r in rows:
        by.setdefault((r.document_id, r.entity_type), []).append(names.parse(lookalikes.image(lookalikes.appearance(r.name)), r.entity_type == PER))
    wrong = [(a.form, b.form) for part in by.values() for k, a in enumerate(part) for b in part[:k] if names.compare(a, b) == "strong"]
    assert len(wrong) <= 1, wrong


# 3 -----------------------------------------------------------------------------------------------------------


def check_pieces(text):
    spans = pieces.spans(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c < b < d and b - c <= pieces.OVERLAP
    assert all(b - a <= pieces.LIMIT for a, b in spans)
    assert (len(spans) > 1) == (len(text) > pieces.LIMIT)
    return spans


def sample_text(rnd, n):
    return "".join("".join(rnd.choice("水火风雷山川河湖abc12") for _ in range(rnd.randint(3, 40))) + rnd.choice(["。", "，", "\n", " ", "！", ". ", "；"]) for _ in range(n))


def test_pieces_cover_in_order():
    rnd = random.Random(6)
    for text in ["", "x" * 1000, "x" * 1001, "é" * 900, "，" * 3000, "\r\n" * 2000, "👍🏽" * 1500] + [sample_text(rnd, rnd.randint(20, 400)) for _ in range(60)]:
        check_pieces(text)


def test_cuts_at_boundaries():
    text = sample_text(random.Random(7), 300)
    for _, end in check_pieces(text)[:-1]:
        assert text[end - 1] in "。，！\n ；.."


def test_an_edit_changes_only_neighbours():
    rnd = random.Random(8)
    text = sample_text(rnd, 3000)
    at = len(text) // 2
    new = text[:at] + "改动一句话。" + text[at:]
    old_pieces = {text[a:b] for a, b in check_pieces(text)}
    new_pieces = {new[a:b] for a, b in check_pieces(new)}
    assert len(new_pieces - old_pieces) <= 8 < len(old_pieces) / 4


def test_items_null_and_repeated(spark):
    s = spark.createDataFrame([(1, "d", 0, "a" * 1500, "z"), (1, "d", 0, "a" * 1500, "z"), (2, "d", 1, None, None), (3, "d", 2, "", "z"), (None, "d", 3, "b" * 2000, "z")], "section_id long, document string, section_index int, text string, piece string")
    c = spark.createDataFrame([(1, "d", 0, "c" * 1001)], "chunk_id long, document string, chunk_index int, chunk_text string")
    assert {tuple(r) for r in pieces.found(pieces.items(s, c)).collect()} == {("section", 1), ("chunk", 1)}
    rows = pieces.pieces(pieces.items(s, c)).collect()
    assert [(r.item_id, r.end_pos) for r in rows if r.item_kind == "section" and r.item_id == 3] == [(3, 0)]
    assert pieces.pieces(pieces.items(s.limit(0), c.limit(0))).count() == 0


# 4 -----------------------------------------------------------------------------------------------------------


def test_copies(spark):
    rows = [(5, "Name A", "Text: one."), (2, "name　a", "TEXT one"), (9, "Name A", "Text: one+"), (11, None, "41.0 米"), (12, "  ", "41.0 米！"), (13, "", "410米"), (14, "x", " ，。"), (15, "x", None), (None, "x", "y"), (5, "Name A", "Text: one.")]
    df = spark.createDataFrame(rows, "record_id long, rule_name string, rule_text string")
    assert {tuple(r) for r in copies.found(df).collect()} == {(2, 5), (11, 12)}
    assert {(r.keep_id, r.copies) for r in copies.collapsed(df).collect()} == {(2, 2), (9, 1), (11, 2), (13, 1)}
    assert copies.found(df.limit(0)).count() == 0


def test_copies_survive_hash_collisions(spark, monkeypatch):
    monkeypatch.setattr(F, "md5", lambda c: F.lit("same"))
    df = spark.createDataFrame([(1, "a", "x"), (2, "A", "x."), (3, "b", "y")], "record_id long, rule_name string, rule_text string")
    assert {tuple(r) for r in copies.found(df).collect()} == {(1, 2)}


# 5 -----------------------------------------------------------------------------------------------------------

SAME = [("ＡＢ１２", "AB12"), ("é", "é"), ("a​b", "ab"), ("a b", "a　b"), ("Каte", "Kate"), ("Ⅱ级", "II级"), ("⼤坝", "大坝"), ("金色", "金色"), ("X−2", "X-2"), ("（a）", "(a)"), ("ﬁre", "fire"), ("Ι级", "I级"), ("甲︀乙", "甲乙")]
DIFFERENT = [("ab", "Ab"), ("e", "é"), ("m²", "m2"), ("①号", "1号"), ("a b", "ab"), ("β型", "B型"), ("王方", "王芳")]


def test_appearance():
    for a, b in SAME:
        assert lookalikes.image(lookalikes.appearance(a)) == lookalikes.image(lookalikes.appearance(b)), (a, b)
    for a, b in DIFFERENT:
        assert lookalikes.image(lookalikes.appearance(a)) != lookalikes.image(lookalikes.appearance(b)), (a, b)
    for a, b in SAME + DIFFERENT:
        for x in (a, b):
            assert lookalikes.appearance(lookalikes.appearance(x)) == lookalikes.appearance(x)


def test_forms_follow_the_corpus(spark):
    df = spark.createDataFrame([("сор",), ("соp",), ("хоp",), ("xop",), ("",), (None,), ("сор",)], "s string")
    got = {r.s: r.form for r in lookalikes.forms(df, "s").collect()}
    assert got["сор"] == got["соp"] == "сор"
    assert got["хоp"] == got["xop"] == "xop" and got[""] == "" and len(got) == 5


def test_vocabulary_counts_rows(spark):
    rows = [("рор",)] * 5 + [("ρορ",), ("ρορ а",), ("роp",)]
    got = {r.s: r.form for r in lookalikes.forms(spark.createDataFrame(rows, "s string"), "s").collect()}
    assert got["роp"] == got["рор"] == "рор"


def test_only_mixed_tokens_with_a_known_repair_change(spark):
    rows = [("сор",), ("cop",), ("Аbzq",), ("Кate",), ("Kate",), ("дoм",), ("дом",), ("ABC站",), ("АBC站",), ("дoр",)]
    got = {r.s: (r.form, r.look) for r in lookalikes.forms(spark.createDataFrame(rows, "s string"), "s").collect()}
    assert got["сор"] == ("сор", "cop") and got["cop"] == ("cop", "cop")
    assert got["Аbzq"] == ("Аbzq", "Abzq") and got["Кate"] == ("Kate", "Kate")
    assert got["дoм"][0] == "дом" and got["дoр"][0] == "дoр" and got["АBC站"][0] == "ABC站"
    assert lookalikes.repairs("дoр") == ["дор"] and lookalikes.repairs("Аbzq") == ["Abzq"] and lookalikes.repairs("соp")[0] == "сор"


def test_unrepaired_tokens_meet_by_look(spark):
    names = spark.createDataFrame([("d", "cop"), ("d", "Kate"), ("e", "cop")], "document_id string, s string")
    sides = spark.createDataFrame([("d", "сор"), ("d", "Кate"), ("d", "ϲор")], "document_id string, s string")
    form_of = lookalikes.forms(names.select("s").unionByName(sides.select("s")), "s")
    got = {tuple(r) for r in lookalikes.alike(names.join(form_of, "s"), sides.join(form_of, "s")).collect()}
    assert got == {("d", "cop", "сор", "look"), ("d", "Kate", "Кate", "form"), ("d", "cop", "ϲор", "look")}


def test_found_looks_alike(spark):
    e = spark.createDataFrame([(1, "d", "Kate", "x"), (1, "d", "Kate", "y"), (2, "d", "", "x"), (3, "d", None, "x"), (4, None, "Kate", "x"), (5, "e", "Каte", "x"), (6, "d", "zone ", "x")], "entity_id long, document_id string, name string, form string")
    r = spark.createDataFrame([(7, "d", "Каte", "Kate"), (7, "d", "Каte", "Kate"), (8, "d", None, "zone"), (9, "d", "Kate​", " ")], "relation_id long, document_id string, subject string, object string")
    assert {tuple(x) for x in lookalikes.found(e, r).collect()} == {(1, 7, "subject"), (6, 8, "object"), (1, 9, "subject")}
    assert lookalikes.found(e.limit(0), r).count() == 0


def test_found_equals_brute_force(spark, small):
    form = lambda s: lookalikes.image(lookalikes.appearance(s))
    es = {(r.entity_id, r.document_id, r.name) for r in table(spark, small, "entities").select("entity_id", "document_id", "name").collect() if r.name}
    rs = {(r.relation_id, r.document_id, r.subject, r.object) for r in table(spark, small, "relations").select("relation_id", "document_id", "subject", "object").collect()}
    want = {(e, r, side) for e, d, n in es for r, d2, s, o in rs if d == d2 for side, x in (("subject", s), ("object", o)) if x and x != n and form(x) == form(n) != ""}
    assert {tuple(x) for x in queries.p5_found(spark, small).collect()} == want


# 6 -----------------------------------------------------------------------------------------------------------


def test_ids_equal_the_tokenizer_and_decode(spark, small):
    tokenizer = encode.load(f"{encode.TOKENIZER_DIR}/{encode.TOKENIZER}")
    extra = [(10**9 + k, t) for k, t in enumerate(["<|endoftext|> x", " ", "\n\n  a\t b", "", None, "𠮷野家 👍🏽 don't", "a" * 5000, "\u0085x y  z", "١٢٣ ½ Ⅷ"])]
    docs = table(spark, small, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    docs = docs.withColumns({"pos": F.lit(1), "word": F.lit("w"), "ids": F.lit(0)})
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    docs = docs.unionByName(docs.where("doc_id % 3 = 0"))
    encoded = encode.encode(docs)
    rows = encoded.collect()
    got = {r.doc_id: list(r.ids) for r in rows}
    assert len(rows) == len(got)
    assert got == {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    back = {r.doc_id: r.text for r in encode.decode(encoded).collect()}
    assert back == {i: t or "" for i, t in texts.items()}
    assert encode.encode(docs.limit(0)).count() == 0
    counts = {r.doc_id: r.n_tokens for r in encode.sizes(docs).collect()}
    assert counts == {i: len(ids) for i, ids in got.items() if ids}
    shared = spark.createDataFrame([(7, [1, 2]), (7, [3]), (None, [4]), (7, [1, 2]), (8, [])], "doc_id long, ids array<int>")
    single = {tuple(r.ids): encode.decode(spark.createDataFrame([(0, list(r.ids))], "doc_id long, ids array<int>")).first().text for r in shared.collect()}
    assert sorted((r.doc_id or 0, r.text) for r in encode.decode(shared).collect()) == sorted([(7, single[1, 2]), (7, single[3,]), (0, single[4,]), (8, "")])


# 7 -----------------------------------------------------------------------------------------------------------


def test_packing_is_whole_and_tight():
    rnd = random.Random(9)
    for sizes in [[], [1], [2048], [1100] * 30, [rnd.randint(1, 2048) for _ in range(300)], [rnd.randint(700, 1100) for _ in range(200)], [683, 683, 682] * 20]:
        bins = packing.pack(sizes)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        assert len(bins) <= len(packing.best_fit(sizes, 2048))


def test_search_empties_a_bin():
    """Best fit leaves a bin that only an exchange of items can empty."""
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]
    bins = packing.improve([[0, 6], [1, 4], [2, 5], [3, 7]], sizes, 10)
    assert len(bins) == 3 and all(sum(sizes[i] for i in b) <= 10 for b in bins)


def test_search_wins_where_best_fit_does_not():
    sizes = [28, 30, 41, 23, 22, 46, 30, 16, 17, 58, 32, 44]
    assert len(packing.best_fit(sizes, 100)) == 5 and len(packing.pack(sizes, 100)) == 4
    rnd, won = random.Random(1), 0
    for _ in range(300):
        sizes = [rnd.randint(8, 60) for _ in range(rnd.randint(6, 20))]
        first, last = packing.best_fit(sizes, 100), packing.pack(sizes, 100)
        assert sorted(i for b in last for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in last) and len(last) <= len(first)
        # stable: no further exchange is left
        assert sorted(map(sorted, packing.improve(last, sizes, 100))) == sorted(map(sorted, last))
        won += len(last) < len(first)
    assert won >= 10


def test_two_texts_of_one_id_are_two_items(spark):
    docs = spark.createDataFrame([(1, "one two three"), (1, "two one three"), (1, "one two three"), (2, None), (3, "")], "doc_id long, text string")
    sizes = encode.sizes(docs)
    assert sorted((r.doc_id, r.n_tokens) for r in sizes.collect()) == [(1, 3), (1, 3)]
    rows = packing.containers(sizes).collect()
    assert len(rows) == 2 and {r.fill for r in rows} == {6} and len({r.container_id for r in rows}) == 1


def test_containers(spark):
    rows = [(1, 5000), (2, 100), (2, 100), (3, 0), (4, None), (None, 7)] + [(10 + i, 1 + (i * 37) % 900) for i in range(9000)]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "doc_id long, n_tokens int, shard string")
    got = packing.containers(df).toPandas()
    assert got.groupby("container_id")["size"].sum().max() <= 2048
    assert (got.groupby("container_id")["size"].sum() == got.groupby("container_id")["fill"].first()).all()
    per_doc = got.groupby("doc_id")["size"].sum().to_dict()
    assert per_doc == {a: b for a, b in rows if a and b}
    assert got[got.doc_id == 1].sort_values("piece")["start_token"].tolist() == [0, 2048, 4096]
    total = sum(b for a, b in set(rows) if a and b)
    assert got.container_id.nunique() <= -(-total // 2048) + 2
    assert packing.containers(df.limit(0)).count() == 0


# 8 -----------------------------------------------------------------------------------------------------------


def moderation_tables(spark):
    rnd = random.Random(10)
    calm = ["请问{}什么时候能修好？", "{}的水退了，谢谢大家。", "我们住在{}东头。", "{} road is closed today."]
    rude = ["你这个白痴，滚出{}！", "{}的人都是废物，去死吧。", "you {} idiot, drop dead"]
    docs, labels = [], []
    for i in range(600):
        place = "".join(rnd.choice("东西南北山水城镇") for _ in range(3))
        bad = i % 4 == 0
        parts = [rnd.choice(calm).format(place) for _ in range(rnd.randint(1, 4))] + ([rnd.choice(rude).format(place)] if bad else [])
        rnd.shuffle(parts)
        docs.append((i, "\n".join(parts), f"s{i % 3}", i))
        if i < 400:
            labels.append((i, i, "r", int(bad), "abusive" if bad else None))
    docs += [(1000, None, "s0", 1), (1001, "", None, 1), (1002, " \n", "s0", 1), (1003, "请" * 30000, "s1", 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, source string, score int"), spark.createDataFrame(labels, "label_id long, doc_id long, reviewer string, flagged int, category string")


def test_moderation_on_held_out_documents(spark):
    docs, labels = moderation_tables(spark)
    scored = moderation.scores(docs, labels).cache()
    got = {r.doc_id for r in moderation.found(scored).collect()}
    held = range(400, 600)
    right = sum((i in got) == (i % 4 == 0) for i in held)
    assert right / len(held) >= 0.95
    by = {r.doc_id: r.score for r in scored.collect()}
    assert by[1000] == by[1001] == by[1002] == 0 and by[1003] is not None
    rates = {r.source: r for r in moderation.rates(scored).collect()}
    assert None in rates and sum(r.documents for r in rates.values()) == docs.count()


def test_segments_are_chosen_again(monkeypatch):
    fits, learn = [], moderation.Lessons.learn
    monkeypatch.setattr(moderation.Lessons, "learn", lambda self, *args: fits.append(len(args)) or learn(self, *args))
    docs = [moderation.segments("calm water here\nyou idiot drop dead"), moderation.segments("the road is closed")]
    moderation.train(docs * 8, [1, 0] * 8)
    assert len(fits) == 2 * 4 + 1


def test_a_sentence_that_clean_documents_hold_too_stays_clean():
    rnd = random.Random(3)
    common = ["车钥匙在值班室第{}个抽屉", "queue at the shelter took {} hours", "刚刚地震了吗 楼晃了一下"]
    docs, labels = [], []
    for i in range(600):
        bad, slip = i % 10 == 0, i % 25 == 1
        lines = [rnd.choice(common).format(i) for _ in range(3)] + (["你这个白痴滚出去", "whoever wrote this is an idiot"][i % 20 == 0 :][:1] if bad else [])
        docs.append(moderation.segments("\n".join(lines)))
        labels.append(int(bad or slip))
    learnt = moderation.train(docs, labels)
    calm = 1 - moderation.score_parts([s for c in common for s in moderation.segments(c.format(7))], *learnt)[:, 0]
    rude = 1 - moderation.score_parts(moderation.segments("你这个白痴滚出去\nwhoever wrote this is an idiot"), *learnt)[:, 0]
    assert calm.max() < 0.5 < rude.min()


def test_labels_are_bounded_in_rows_and_characters(spark):
    docs, labels = moderation_tables(spark)
    whole = moderation.labelled(docs, labels).count()
    assert whole == 400 and moderation.labelled(docs, labels, most=50).count() == 50
    lengths = sum(len(r.text) for r in moderation.labelled(docs, labels).collect())
    some = moderation.labelled(docs, labels, chars=lengths // 2).collect()
    assert 0 < len(some) < whole and sum(len(r.text) for r in some) <= lengths // 2
    assert moderation.labelled(docs, labels, chars=lengths).count() == whole


@pytest.mark.parametrize("folder, parts, precision, recall", [("sf0.1", 3, 0.75, 0.25), ("check_l", 1, 0.93, 0.7)])
def test_moderation_held_out_on_the_real_tables(spark, folder, parts, precision, recall):
    """Against the reviewers' labels as they stand, slips included: at least a fifth of those that flag are slips, which no model can find again."""
    found = labelled = both = 0
    rows = moderation.labelled(table(spark, f"/root/testdata/{folder}", "documents"), table(spark, f"/root/testdata/{folder}", "moderation_labels"))
    rows = [(moderation.segments(r.text), r["class"]) for r in sorted(rows.collect())]
    for split in range(parts):
        kept, held = [r for i, r in enumerate(rows) if i % 3 != split], [r for i, r in enumerate(rows) if i % 3 == split]
        learnt = moderation.train([d for d, _ in kept], [c for _, c in kept])
        got = [bool(d) and (1 - moderation.score_parts(d, *learnt)[:, 0]).max() >= moderation.THRESHOLD for d, _ in held]
        found, labelled, both = found + sum(got), labelled + sum(c > 0 for _, c in held), both + sum(g and c > 0 for g, (_, c) in zip(got, held))
    print(folder, "held out:", labelled, "labelled,", found, "found,", both, "both")
    assert both >= precision * found and both >= recall * labelled


def test_moderation_without_labels(spark):
    docs, labels = moderation_tables(spark)
    assert moderation.found(moderation.scores(docs, labels.limit(0))).count() == 0
    assert moderation.scores(docs.limit(0), labels).count() == 0


def test_every_query_of_the_small_tables_runs(spark, small):
    for name in ("p2_groups", "p2_found", "p3_pieces", "p5_forms", "p7_containers", "p8_rates"):
        assert queries.QUERIES[name](spark, small).count() > 0, name
