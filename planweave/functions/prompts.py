"""Prompts as column expressions, so that they are made where their texts are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planweave.functions import packs

#: What belongs to each label, so that a model draws the lines where the patterns do.
KINDS = {
    "组织机构": "指挥机构、政府及其部门、单位、队伍",
    "人员": "负责人、专家、值守人员、群众等人或岗位",
    "地点": "行政区划、河流、场所，也包括水库、堤防、泵站等工程设施",
    "物资": "装备、器材、系统、生活物资，设备也算物资",
    "事件": "灾害、事故和险情",
    "行动": "处置措施和工作步骤，职责、责任也算行动",
    "法规": "法律、条例、办法、制度，预案和方案也算法规",
    "时间": "时点、时段和时限",
}
_ONE_OBJECT = "只输出一个JSON对象，不要代码块，不要解释；没有内容的列表写成空数组。"
EXTRACTION = "\n".join(
    [
        "任务：读下面的应急管理文本，找出其中的实体和实体之间的关系。",
        "类型只有八种，不得另立：",
        *(f"- {k}：{v}" for k, v in KINDS.items()),
        "响应等级不是实体，写进事件或行动的说明。",
        "关系只取文中明说的，谓词尽量用原文的动词；主语和宾语都要出现在实体里。同一实体只用一个名称。",
        "输出的键：",
        "entities，每项含 name、type、description、aliases（简称或全称，至少一个）、confidence（0到1）、source_text（原文片段，可省）；",
        "relations，每项含 subject、predicate、object、subject_type、object_type、description、confidence、source_text（可省）。",
        _ONE_OBJECT,
        '样式：{"entities": [{"name": "水务局", "type": "组织机构", "description": "管理堤防", "aliases": ["市水务局"], "confidence": 0.9}], "relations": [{"subject": "水务局", "predicate": "巡查", "object": "东堤", "subject_type": "组织机构", "object_type": "地点", "description": "汛期巡查", "confidence": 0.8}]}',
    ]
)
CONSOLIDATION = "\n".join(
    [
        "任务：下面是一份文件里抽出的实体和关系。请合并指同一事物的名称，并补上文件整体意义上缺少的关系。",
        "合并：简称、全称、代称归到一个规范名称；拿不准的不合并。",
        "补充关系：谓词只能取自 " + "、".join(packs.BRIDGE_PREDICATES) + "；两端必须是已有的规范名称，并给出两端在文中的依据；优先连接孤立的实体，没有依据的宁可不连。",
        "输出的键：",
        "alias_map，别名到规范名称的对象；",
        "canonical_entities，每项含 name、type、description、aliases；",
        "bridge_relations，每项含 subject、predicate、object、subject_type、object_type、confidence、s_evidence、o_evidence。",
        _ONE_OBJECT,
    ]
)
RULES = "\n".join(
    [
        "任务：把下面的文本拆成一条条规则，每条规定一个主体在某种条件下要做的一件事。",
        "每条含 rule_name（十来个字）、rule_text（尽量照原文，能独立读懂）、elements（主体、动作、条件、对象、时间中出现的几项）、rule_tags（领域标签）。",
        "目录、标题、套话和没有动作的句子不算规则；至少要有主体和动作。",
        "只输出JSON数组，不要解释；没有规则就输出 []。",
    ]
)


def extraction(text: Column, hints: Column) -> Column:
    """The prompt of a text; ``hints`` are names known from it, left out when there are none."""
    known = F.when(F.size(hints) > 0, F.concat(F.lit("\n已知实体：\n- "), F.array_join(hints, "\n- "))).otherwise(F.lit(""))
    return F.concat(F.lit(EXTRACTION), known, F.lit("\n文本：\n"), text)


def consolidation(entities: Column, relations: Column, lonely: Column) -> Column:
    """The prompt of a document from its names, triples and isolated names, one a line."""
    return F.concat(F.lit(CONSOLIDATION), *[x for title, c in (("实体", entities), ("关系", relations), ("孤立实体", lonely)) for x in (F.lit(f"\n{title}：\n"), F.array_join(c, "\n"))])


def rules(text: Column) -> Column:
    return F.concat(F.lit(RULES + "\n文本：\n"), text)


def consolidation_inputs(entities: DataFrame, relations: DataFrame, isolated: DataFrame) -> DataFrame:
    """``(document_id, entities, relations, lonely)``: sorted distinct names, triples and isolated names of each document."""
    none = F.array().cast("array<string>")
    e = entities.where("name is not null and document_id is not null").groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("entities"))
    r = relations.groupBy("document_id").agg(F.array_sort(F.collect_set(F.concat("subject", "predicate", "object"))).alias("relations"))
    i = isolated.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("lonely"))
    return e.join(r, "document_id", "left").join(i, "document_id", "left").withColumns({c: F.coalesce(c, none) for c in ("relations", "lonely")})
