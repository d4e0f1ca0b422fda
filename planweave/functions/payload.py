"""Tolerant reading of model answers into entities, relations, aliases, canonical records and bridges.

Instead of repairing the text and handing it to a strict parser, a small reader walks the text once and forgives what
models do: fences, comments in Han before keys, single quotes, Python literals, NaN, trailing commas, invisible signs,
answers that break off. Objects that were complete before a break are kept, the broken one is dropped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from planweave.functions.text import ustrip

LISTS = ("entities", "relations", "canonical_entities", "bridge_relations")
MAP = "alias_map"
_ROW = T.MapType(T.StringType(), T.StringType())
PAYLOAD = T.StructType([T.StructField("entities", T.ArrayType(_ROW)), T.StructField("relations", T.ArrayType(_ROW)), T.StructField(MAP, _ROW), T.StructField("canonical_entities", T.ArrayType(_ROW)), T.StructField("bridge_relations", T.ArrayType(_ROW))])

_WORD = re.compile(r"[A-Za-z_+\-.0-9]+")
_CONSTANTS = {"true": True, "false": False, "null": None, "none": None, "nan": None, "infinity": None, "inf": None, "-infinity": None, "-inf": None}
_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)\s*```", re.S)
_HAN_START = re.compile("^[一-鿿]+(?=[A-Za-z_])")
_BROKEN = object()


class _Reader:
    def __init__(self, text: str):
        self.t, self.i = text, 0

    def skip(self, also: str = "") -> None:
        """Over blanks, what cannot be seen, and Han words that stand before a value."""
        t, n = self.t, len(self.t)
        while self.i < n and (t[self.i].isspace() or t[self.i] in "​﻿ " or t[self.i] in also or "一" <= t[self.i] <= "鿿"):
            self.i += 1

    def value(self) -> Any:
        self.skip()
        if self.i >= len(self.t):
            return _BROKEN
        c = self.t[self.i]
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in "\"'":
            return self.string(c)
        m = _WORD.match(self.t, self.i)
        if not m:
            return _BROKEN
        self.i = m.end()
        word = m[0]
        if word.lower() in _CONSTANTS:
            return _CONSTANTS[word.lower()]
        try:
            return float(word) if re.search(r"[.eE]", word) else int(word)
        except ValueError:
            return word

    def string(self, quote: str) -> Any:
        out, t = [], self.t
        self.i += 1
        while self.i < len(t):
            c = t[self.i]
            if c == "\\" and self.i + 1 < len(t):
                e = t[self.i + 1]
                if e == "u" and re.fullmatch("[0-9a-fA-F]{4}", t[self.i + 2 : self.i + 6]):
                    out.append(chr(int(t[self.i + 2 : self.i + 6], 16)))
                    self.i += 6
                    continue
                out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(e, e))
                self.i += 2
                continue
            self.i += 1
            if c == quote:
                s = "".join(out)
                try:
                    return s.encode("utf-16", "surrogatepass").decode("utf-16")
                except UnicodeDecodeError:
                    return s.encode("utf-8", "replace").decode()
            out.append(c)
        return _BROKEN

    def array(self) -> Any:
        self.i += 1
        out: list = []
        while True:
            self.skip(",")
            if self.i >= len(self.t):
                return out
            if self.t[self.i] == "]":
                self.i += 1
                return out
            v = self.value()
            if v is _BROKEN:
                if self.i < len(self.t) and self.t[self.i] not in "]}":
                    self.i += 1
                    continue
                return out
            out.append(v)

    def object(self) -> Any:
        self.i += 1
        out: dict = {}
        while True:
            self.skip(",")
            if self.i >= len(self.t):
                return _BROKEN if not set(out) & {*LISTS, MAP} else out
            if self.t[self.i] == "}":
                self.i += 1
                return out
            key = self.value()
            if not isinstance(key, (str, int, float)):
                return _BROKEN if not set(out) & {*LISTS, MAP} else out
            key = _HAN_START.sub("", str(key).strip())
            self.skip()
            if self.i >= len(self.t) or self.t[self.i] != ":":
                return _BROKEN if not set(out) & {*LISTS, MAP} else out
            self.i += 1
            at = self.i
            v = self.value()
            if v is _BROKEN or key == "confidence" and isinstance(v, str):
                m = re.compile(r"[^\d,}\]\-+]*([-+]?\d+(?:\.\d+)?)").match(self.t, at)
                if key != "confidence" or not m:
                    return _BROKEN if not set(out) & {*LISTS, MAP} else out
                v, self.i = float(m[1]), max(self.i, m.end())
            out[key] = v


def _payload(v: Any) -> dict | None:
    """The payload a value is or holds: an object with payload keys, else the first nested one; lists of records by their keys."""
    if isinstance(v, dict):
        if {"entities", "relations"} <= set(v) or {MAP, "canonical_entities", "bridge_relations"} & set(v):
            return v
        for x in v.values():
            if isinstance(x, dict) and (got := _payload(x)) is not None:
                return got
        partial = {k: v[k] for k in LISTS if isinstance(v.get(k), list)}
        return partial or None
    if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
        if all("name" in x or "type" in x for x in v):
            return {"entities": v}
        if all("subject" in x or "predicate" in x or "object" in x for x in v):
            return {"relations": v}
    return None


def parse(text: str | None) -> dict:
    """The five fields of an answer, empty where it has none; null, blank and senseless answers give the empty payload."""
    out: dict = {k: [] for k in LISTS} | {MAP: {}}
    for part in [*_FENCE.findall(text or ""), text or ""]:
        at = 0
        while at < len(part):
            opens = [k for k in (part.find("{", at), part.find("[", at)) if k >= 0]
            if not opens:
                break
            reader = _Reader(part)
            reader.i = min(opens)
            v = reader.value()
            got = _payload(v) if v is not _BROKEN else None
            if got is not None:
                for k in LISTS:
                    if isinstance(got.get(k), list):
                        out[k] = [x for x in got[k] if isinstance(x, dict)]
                if isinstance(got.get(MAP), dict):
                    out[MAP] = got[MAP]
                return out
            at = max(reader.i, min(opens) + 1) if v is not _BROKEN else min(opens) + 1
    return out


def parse_rules(text: str | None) -> list[dict]:
    """The rule records of an answer: a list, or the list under rules, data or output, fenced or not; records without a text are left out."""
    for part in [*_FENCE.findall(text or ""), text or ""]:
        at = 0
        while (opens := [k for k in (part.find("{", at), part.find("[", at)) if k >= 0]):
            reader = _Reader(part)
            reader.i = min(opens)
            v = reader.value()
            if isinstance(v, dict):
                v = next((v[k] for k in ("rules", "data", "output") if isinstance(v.get(k), list)), [v] if "rule_text" in v else None)
            if isinstance(v, list) and (rows := [x for x in v if isinstance(x, dict) and str(x.get("rule_text") or "").strip()]):
                return rows
            at = min(opens) + 1
    return []


RULES = T.ArrayType(T.StructType([T.StructField("rule_name", T.StringType()), T.StructField("rule_text", T.StringType()), T.StructField("elements", T.ArrayType(T.StringType())), T.StructField("rule_tags", T.ArrayType(T.StringType()))]))
_ELEMENT_FIELDS = ("Subject", "Action", "Condition", "Object", "Time", "S", "A", "C", "O", "T", "主体", "动作", "条件", "对象", "范围", "时限", "时间")


def _texts(v: Any) -> list[str]:
    """Strings of a list, or the keys of an object that have a value."""
    if isinstance(v, dict):
        return [str(k) for k, x in v.items() if x not in (None, "", [], {})]
    return [str(x) for x in v if x is not None] if isinstance(v, list) else []


@F.pandas_udf(RULES)
def parsed_rules(answers: pd.Series) -> pd.Series:
    """Column of answers to column of rule records; elements are those listed and the element fields that have a value."""
    out = []
    for answer in answers:
        rows = []
        for r in parse_rules(answer):
            fields = [k for k in _ELEMENT_FIELDS if str(r.get(k) or "").strip() not in ("", "[]", "{}")]
            rows.append({"rule_name": None if r.get("rule_name") is None else str(r["rule_name"]), "rule_text": str(r["rule_text"]), "elements": fields + _texts(r.get("elements") or r.get("Elements")), "rule_tags": _texts(r.get("rule_tags"))})
        out.append(rows)
    return pd.Series(out)


def _flat(row: dict) -> dict[str, str | None]:
    return {str(k): None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True) for k, v in row.items()}


@F.pandas_udf(PAYLOAD)
def parsed(answers: pd.Series) -> pd.DataFrame:
    """Column of answers to column of payloads; values come as strings, nested ones as JSON."""
    rows = [parse(a) for a in answers]
    return pd.DataFrame({**{k: [[_flat(x) for x in r[k]] for r in rows] for k in LISTS}, MAP: [_flat(r[MAP]) for r in rows]})[[f.name for f in PAYLOAD]]


def strict(c: Column) -> Column:
    """Payloads of well-formed answers, inside the JVM; null where the tolerant reader is needed."""
    got = F.from_json(c, PAYLOAD)
    return F.when(got["entities"].isNotNull() & got["relations"].isNotNull(), got)


#: What a string is worth that names all, or any, of some keys, that has both braces, and the length that counts for 1.
ALL_KEYS, ANY_KEY, BRACES, FULL_LENGTH = (("entities", "relations"), 5.0), (("alias_map", "bridge_relations"), 4.0), 2.0, 20_000


def best_string(strings: Column) -> Column:
    """The string of an array that most looks like a payload: keys count most, then braces, then length up to a bound; ties to the first."""

    def score(s: Column) -> Column:
        every = s.contains(ALL_KEYS[0][0]) & s.contains(ALL_KEYS[0][1])
        some = s.contains(ANY_KEY[0][0]) | s.contains(ANY_KEY[0][1])
        worth = F.when(every, ALL_KEYS[1]).otherwise(0.0) + F.when(some, ANY_KEY[1]).otherwise(0.0) + F.when(s.contains("{") & s.contains("}"), BRACES).otherwise(0.0)
        return worth + F.least(F.length(s), F.lit(FULL_LENGTH)) / FULL_LENGTH

    known = F.filter(F.transform(strings, ustrip), lambda s: F.length(s) > 0)
    return F.array_max(F.transform(known, lambda s, i: F.struct(score(s).alias("score"), (-i).alias("i"), s.alias("s"))))["s"]


def strings_in(value: Any) -> Iterator[str]:
    """All strings inside a nested value, in order."""
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings_in(v)
    elif isinstance(value, (list, tuple)):
        for v in value:
            yield from strings_in(v)


def pick_string(value: Any) -> str:
    """As ``best_string``, for the strings inside a value that is at hand; '' when there is none."""

    def worth(s: str) -> float:
        return ALL_KEYS[1] * all(k in s for k in ALL_KEYS[0]) + ANY_KEY[1] * any(k in s for k in ANY_KEY[0]) + BRACES * ("{" in s and "}" in s) + min(len(s), FULL_LENGTH) / FULL_LENGTH

    return max((t for s in strings_in(value) if (t := s.strip())), key=worth, default="")
