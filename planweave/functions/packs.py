"""Domain knowledge as data: labels, type maps, pattern packs, predicates and the plan hierarchy.

All are fixed values of the domain: results depend on them sign by sign. Patterns are written so that Java, RE2 and
the regex module read them alike: Han is the range 一-龥, white space and digits are spelled as Unicode classes.
"""

from __future__ import annotations

LABELS = ["组织机构", "人员", "地点", "物资", "事件", "行动", "法规", "时间"]
SOURCE_LABEL, TYPE_LABEL, PLAN_LABEL = "数据源", "实体类型", "PlanMeta"
HAS_TYPE, OF_TYPE, SUB_PLAN, OF_SOURCE = "包含类型", "属于类型", "SUB_PLAN_OF", "BELONGS_TO_SOURCE"
UNKNOWN = "未知"
DEFAULT_RULE_NAME, DEFAULT_RULE_TAG = "未命名规则", "应急管理"

TYPE_MAP = {"设备": "物资", "预案": "法规", "职责": "行动"}
LEGACY_LABELS = TYPE_MAP | {"标准": "法规", "程序": "行动", "措施": "行动", "要求": "法规", "条件": "法规"}
NAME_HINTS = [("法规", ["预案", "方案", "制度", "条例", "办法"]), ("物资", ["设备", "系统", "器材", "装备"])]
BRIDGE_PREDICATES = ["负责", "主管", "协同", "管辖", "执行", "资源需求", "位于", "适用于", "适用范围", "依据", "处置", "响应", "采取", "需要", "使用", "相关", "涉及"]

H, S, D = "[一-龥]+", r"\s\p{Z}", r"\p{Nd}"

#: (type as the pattern names it, pattern), in order of evaluation
ENTITY_PATTERNS: list[tuple[str, str]] = [
    ("组织机构", f"{H}(?:局|厅|部|委|办|中心|指挥部|领导小组|工作组|委员会|公司|企业|单位)"),
    ("组织机构", f"{H}(?:人民政府|政府|街道办|村委会|居委会)"),
    ("组织机构", f"国家{H}(?:局|委|部|办)"),
    ("组织机构", f"{H}省{H}(?:厅|局)"),
    ("组织机构", f"{H}市{H}(?:局|委|办)"),
    ("人员", f"{H}(?:长|主任|书记|局长|厅长|部长|委员|指挥|领导|负责人|专家|人员|工作人员)"),
    ("人员", "(?:总指挥|副总指挥|组长|副组长|成员|联络员|信息员)"),
    ("人员", f"{H}同志"),
    ("地点", f"{H}(?:省|市|县|区|镇|乡|村|街道|社区)"),
    ("地点", f"{H}(?:山|河|湖|海|江|水库|大坝|桥梁|隧道)"),
    ("地点", f"{H}(?:现场|区域|地段|路段|水域|空域)"),
    ("地点", f"[A-Z][A-Z][A-Z][A-Z]{D}+"),
    ("设备", f"{H}(?:设备|装置|仪器|仪表|系统|平台|车辆|船舶|飞机|直升机)"),
    ("设备", f"(?:通信|监测|监控|救援|应急|指挥|调度){H}(?:设备|系统)"),
    ("设备", f"{H}(?:卫星|雷达|传感器|摄像头|无人机)"),
    ("物资", f"{H}(?:物资|材料|药品|食品|水|燃料|器材|装备)"),
    ("物资", f"(?:应急|救援|救灾|医疗|生活){H}(?:物资|用品)"),
    ("物资", f"{H}(?:储备|库存|仓库|基地)"),
    ("事件", f"{H}(?:事故|灾害|事件|险情|预警|警报|紧急状态)"),
    ("事件", "(?:地震|洪水|台风|暴雨|雪灾|火灾|爆炸|泄漏|坍塌|滑坡|泥石流)"),
    ("事件", f"{H}(?:级响应|级预警|级警报)"),
    ("事件", f"(?:特别重大|重大|较大|一般){H}(?:事故|灾害|事件)"),
    ("行动", f"{H}(?:救援|抢险|救灾|疏散|转移|安置|抢修|维护|保障)"),
    ("行动", f"(?:应急|抢险|救援|救灾){H}(?:行动|工作|任务)"),
    ("行动", f"{H}(?:演练|演习|培训|宣传|教育)"),
    ("行动", f"{H}(?:调查|评估|分析|总结|报告)"),
    ("职责", f"{H}(?:职责|责任|义务|任务|工作|职能)"),
    ("职责", f"(?:主要|重要|基本|法定){H}(?:职责|责任)"),
    ("职责", f"{H}(?:工作|任务|职能){H}(?:职责|责任)"),
    ("预案", f"{H}(?:预案|方案|计划|规划|策略)"),
    ("预案", f"(?:应急|救援|抢险|救灾){H}(?:预案|方案)"),
    ("预案", f"{H}(?:专项|部门|总体|综合){H}(?:预案|方案)"),
    ("预案", f"{H}(?:修订|制定|编制|完善){H}(?:预案|方案)"),
    ("法规", f"《[一-龥{S}{D}]+》"),
    ("法规", f"{H}(?:法|条例|规定|办法|细则|规范|标准|制度)"),
    ("法规", f"(?:国家|地方|行业){H}(?:标准|规范|制度)"),
    ("法规", f"{H}(?:法律|法规|规章|规范性文件)"),
    ("时间", f"{D}{{4}}年{D}{{1,2}}月{D}{{1,2}}日"),
    ("时间", f"{D}{{1,2}}月{D}{{1,2}}日"),
    ("时间", "(?:立即|马上|及时|迅速|第一时间)"),
    ("时间", "(?:小时|分钟|秒|天|周|月|年)内"),
    ("时间", f"{D}+(?:小时|分钟|秒|天|周|月|年)"),
]

BODY, PLAN, EVENT, ACTION = "机构|部门|单位|指挥部", "预案|方案|计划", "事件|事故|灾害", "行动|工作|任务"
_TAIL = f"([一-龥、，,{S}]+)"

#: (predicate, subject family, verb, what follows the object, object family or '' for an open tail, subject type, object type)
_RELATIONS = [
    ("负责", BODY, "负责", "", "", "组织机构", "行动"),
    ("承担职责", BODY, "承担", "职责", "", "组织机构", "职责"),
    ("承担", BODY, "承担", "", "", "组织机构", "行动"),
    ("管理", BODY, "管理", "", "", "组织机构", "地点"),
    ("指导", BODY, "指导", "", "", "组织机构", "组织机构"),
    ("监督", BODY, "监督", "", "", "组织机构", "组织机构"),
    ("协调", BODY, "协调", "", "", "组织机构", "组织机构"),
    ("组织", BODY, "组织", "", "", "组织机构", "行动"),
    ("领导", BODY, "领导", "", "", "组织机构", "行动"),
    ("参与", BODY, "参与", "", "", "组织机构", "行动"),
    ("配合", BODY, "配合", "", "", "组织机构", "组织机构"),
    ("支持", BODY, "支持", "", "", "组织机构", "组织机构"),
    ("报告", BODY, "报告", "", "", "组织机构", "组织机构"),
    ("向...报告", BODY, "向", "报告", BODY, "组织机构", "组织机构"),
    ("处置", BODY, "处置", "", "", "组织机构", "事件"),
    ("响应", BODY, "响应", "", "", "组织机构", "事件"),
    ("启动", BODY, "启动", "", "", "组织机构", "预案"),
    ("包含", PLAN, "包含", "", "", "预案", "行动"),
    ("包括", BODY, "包括", "", "", "组织机构", "组织机构"),
    ("属于", BODY, "属于", "", BODY, "组织机构", "组织机构"),
    ("属于", EVENT, "属于", "", "", "事件", "事件"),
    ("使用", BODY, "使用", "", "", "组织机构", "设备"),
    ("采用", BODY, "采用", "", "", "组织机构", "设备"),
    ("需要", BODY, "需要", "", "", "组织机构", "物资"),
    ("需要", ACTION, "需要", "", "", "行动", "物资"),
    ("制定", BODY, "制定", "", "", "组织机构", "预案"),
    ("编制", BODY, "编制", "", "", "组织机构", "预案"),
]
#: (predicate, subject type, object type, pattern with the subject as group 1 and the object as group 2)
RELATION_PATTERNS = [(p, TYPE_MAP.get(st, st), TYPE_MAP.get(ot, ot), f"({H}(?:{family})){verb}{f'({H}(?:{of}))' if of else _TAIL}{after}") for p, family, verb, after, of, st, ot in _RELATIONS]



def anchored(pattern: str) -> str:
    """The same pattern for Java, tried only where it can match.

    A pattern that begins with a run of Han signs matches from the first sign of the run if it matches from any,
    so after a failure there the rest of the run need not be tried: the effort is in proportion to the text and not
    to the square of its runs. What follows a match is tried too, at the place where it ended.
    """
    return rf"(?:(?<![一-龥])|\G){pattern}" if pattern.startswith((H, "(" + H)) else pattern


ACTION_MARKERS = "应当 必须 不得 禁止 应及时 应立即 需要 要求 负责 建立 启动 报告 发布 处置 组织 统筹 协调 完善 落实".split()
CONDITION = "(当|若|如果|如遇|如发生|发生|出现|遇到|在.+?时|在.+?期间)"
TIME_LIMIT = f"({D}+[{S}]*(分钟|小时|天|日|月)[{S}]*(内|以内|之内)?|立即|及时|尽快|第一时间)"
NORM_VERB = "(应当|必须|不得|禁止|需要|要求|负责|组织|建立|启动|报告|发布|处置|统筹|协调|完善|落实)"
OBJECT_MARK = f"(对|向|将|把)[^{S}]{{1,40}}"
ELEMENT_KEYS = {"Subject": ["s", "subject", "主体"], "Action": ["a", "action", "动作"], "Condition": ["c", "condition", "条件"], "Object": ["o", "object", "对象", "范围"], "Time": ["t", "time", "时限", "时间"]}

PLAN_ROOT = "国家突发事件总体应急预案"
_RELIEF, _ENVIRONMENT, _MARINE = "国家自然灾害救助应急预案", "国家突发环境事件应急预案", "海洋灾害应急预案"
PLANS: list[tuple[str, str]] = [
    (PLAN_ROOT, "L0"),
    *((n, "L1") for n in (_RELIEF, _ENVIRONMENT, "国家通信保障应急预案", "国家食品安全事故应急预案", "国家粮食应急预案", "地方政府性债务风险应急处置预案")),
    *((n, "L2") for n in ("国家地震应急预案", "国家防汛抗旱应急预案", "国家森林草原火灾应急预案", _MARINE, "国家重大海上溢油应急处置预案", "国家大面积停电事件应急预案", "国家城市轨道交通运营突发事件应急预案", "养老机构突发事件应急预案")),
    ("赤潮灾害应急预案", "L3"),
]
PLAN_EDGES: list[tuple[str, str]] = [
    *((name, PLAN_ROOT) for name, level in PLANS if level == "L1"),
    *((name, _RELIEF) for name in ("国家地震应急预案", "国家防汛抗旱应急预案", "国家森林草原火灾应急预案", _MARINE)),
    ("国家重大海上溢油应急处置预案", _ENVIRONMENT),
    *((name, PLAN_ROOT) for name in ("国家大面积停电事件应急预案", "国家城市轨道交通运营突发事件应急预案", "养老机构突发事件应急预案")),
    ("赤潮灾害应急预案", _MARINE),
]
