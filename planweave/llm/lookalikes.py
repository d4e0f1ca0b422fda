"""Problem 5: visually identical text with different characters.

``appearance`` folds, character by character and by a rule over the Unicode data, everything that looks the same:
widths of signs and blanks, invisible characters, compatibility forms and composed or decomposed accents. Raised and
circled signs, letter case and accents stay. Look-alike letters of other alphabets are repaired token by token: in a
token of several scripts they become letters of its dominant script, if the corpus holds the token so written in one
script, else of the next script for which it does; tokens of one script, and mixed ones whose repair the corpus does
not hold, stay as they are. Such a token may still look like another, so a string also has a ``look``, its form with
every look-alike letter as the Latin one: strings look the same if and only if their looks are equal.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.session import cut

#: Letters of the Cyrillic and Greek alphabets that look like a Latin letter, and that letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХӀҮԚԜаеоросухѕіјһԁԛԝүѵ"
CYRILLIC_AS = "ABESIJKMHOPCTYXIYQWaeopocyxsijhdqwyv"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονϲ"
GREEK_AS = "ABEZHIKMNOPTYXCjovc"
LATIN_IMAGE = {ord(a): b for a, b in zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)}
#: Short dashes and centred dots that look like another.
SIGNS = {ord(c): "-" for c in "‐‑‒−﹣－"} | {ord(c): "·" for c in "‧∙⋅･・"}

_KEPT = ("<super>", "<sub>", "<circle>", "<fraction>", "<vertical>")
_LETTERS = re.compile("[A-Za-zÀ-ɏ̀-ͯͰ-ϿЀ-ԯḀ-ỿ]+")


def _decomposed(c: str) -> str:
    parts = unicodedata.decomposition(c).split()
    if not parts or parts[0] in _KEPT or c in "ſϲϹ":  # the last two are read as sigma but look like c
        return c
    if parts[0][0] == "<":
        parts = parts[1:]
        if parts[0] == "0020" and len(parts) > 1:
            return c
        return "".join(_decomposed(chr(int(p, 16))) for p in parts)
    return c


@lru_cache(1)
def fold_table() -> dict[int, str]:
    """What each character turns into; only those that change are listed."""
    table: dict[int, str] = {}
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]:
        c = chr(o)
        kind = unicodedata.category(c)
        if kind == "Zs":
            table[o] = " "
        elif kind in ("Cf", "Cc") or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x34F, 0x17B4, 0x17B5) or 0x180B <= o <= 0x180F:
            table[o] = ""
        elif (d := _decomposed(c)) != c:
            table[o] = d
    for o in range(32):
        table[o] = " " if chr(o).isspace() else ""
    table[0x7F] = ""
    table[0x85] = table[0x2028] = table[0x2029] = " "
    return table | SIGNS


_BLANKS = re.compile(" {2,}")


def appearance(text: str) -> str:
    """One form of all strings that look the same but for look-alike letters; idempotent, '' for a text of blanks."""
    if text.isascii() and text.isprintable():
        return _BLANKS.sub(" ", text).strip(" ")
    table = fold_table()
    once = unicodedata.normalize("NFC", text.translate(table))
    return _BLANKS.sub(" ", unicodedata.normalize("NFC", once.translate(table))).strip(" ")


def image(text: str) -> str:
    """``text`` with every look-alike letter as the Latin letter it looks like."""
    return text if text.isascii() else unicodedata.normalize("NFC", text.translate(LATIN_IMAGE))


def tokens(text: str) -> list[str]:
    """Runs of letters of the alphabets that hold look-alikes."""
    return _LETTERS.findall(text)


SCRIPTS = ("latin", "cyrillic", "greek")
#: What each letter turns into in the other script; letters that look like none of it are missing.
_INTO = {
    "latin": LATIN_IMAGE,
    "cyrillic": {ord(b): a for a, b in zip(CYRILLIC, CYRILLIC_AS)} | {ord(g): CYRILLIC[CYRILLIC_AS.index(b)] for g, b in zip(GREEK, GREEK_AS) if b in CYRILLIC_AS},
    "greek": {ord(b): a for a, b in zip(GREEK, GREEK_AS)} | {ord(c): GREEK[GREEK_AS.index(b)] for c, b in zip(CYRILLIC, CYRILLIC_AS) if b in GREEK_AS},
}


def _script(o: int) -> str:
    return "greek" if 0x370 <= o < 0x400 else "cyrillic" if 0x400 <= o < 0x530 else "latin"


def script(token: str) -> str:
    """``latin``, ``greek`` or ``cyrillic`` when all letters are of one script, else ``mixed``."""
    seen = {_script(o) for o in map(ord, token) if not 0x300 <= o < 0x370}
    return seen.pop() if len(seen) == 1 else "mixed"


def repairs(token: str) -> list[str]:
    """Spellings of a mixed token in one script, that of the dominant script first: it has the most letters that look like no other script's, then the most letters."""
    letters = [o for o in map(ord, token) if not 0x300 <= o < 0x370]
    own = {c: [o for o in letters if _script(o) == c] for c in SCRIPTS}
    sure = {c: sum(all(o not in _INTO[other] for other in SCRIPTS if other != c) for o in own[c]) for c in SCRIPTS}
    order = sorted((c for c in SCRIPTS if own[c]), key=lambda c: (-sure[c], -len(own[c]), SCRIPTS.index(c)))
    written = [unicodedata.normalize("NFC", "".join(x if _script(ord(x)) == c else _INTO[c].get(ord(x), x) for x in token)) for c in order]
    return [w for w, c in zip(written, order) if script(w) == c]


def _describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        forms = [appearance(s) for s in batch["s"]]
        found = [tokens(f) for f in forms]
        mixed = [[{"token": t, "repairs": repairs(t)} for t in dict.fromkeys(ts) if script(t) == "mixed"] for ts in found]
        plain = [[t for t in dict.fromkeys(ts) if script(t) != "mixed"] for ts in found]
        yield pd.DataFrame({"s": batch["s"], "base": forms, "plain": plain, "mixed": mixed})


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for base, chosen in zip(batch["base"], batch["chosen"]):
            known = {c["token"]: c["spelling"] for c in chosen}
            out.append(_LETTERS.sub(lambda m: known.get(m[0], m[0]), base))
        yield pd.DataFrame({"s": batch["s"], "form": out, "look": [image(f) for f in out]})


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"s": batch["s"], "form": batch["base"], "look": [image(f) for f in batch["base"]]})


def spellings(described: DataFrame) -> DataFrame:
    """``(token, spelling)`` for each mixed token that has a repair which a token of one script in the corpus equals; the first such repair counts."""
    vocabulary = described.select(F.explode("plain").alias("w")).distinct()
    wanted = described.select(F.explode("mixed").alias("t")).select("t.token", F.posexplode("t.repairs").alias("rank", "w")).distinct()
    held = wanted.join(vocabulary, "w", "left_semi")
    return held.groupBy("token").agg(F.min(F.struct("rank", "w")).alias("best")).select("token", F.col("best.w").alias("spelling"))


def forms(strings: DataFrame, column: str) -> DataFrame:
    """``(s, form, look)``, one row per distinct non-null string of ``column``.

    ``form`` is the repaired string. Strings with equal looks look the same and strings that look different have
    different looks and forms. Null has no form; a blank string has the form ''. Other columns are ignored.
    """
    distinct = strings.select(F.col(column).alias("s")).where("s is not null").distinct()
    described = cut(distinct.mapInPandas(_describe, "s string, base string, plain array<string>, mixed array<struct<token:string,repairs:array<string>>>"))
    made = "s string, form string, look string"
    plain = described.where(F.size("mixed") == 0).select("s", "base").mapInPandas(_plain, made)
    spread = described.where(F.size("mixed") > 0).select("s", "base", F.explode("mixed.token").alias("token"))
    placed = spread.join(spellings(described), "token", "left").select("s", "base", F.struct("token", F.coalesce("spelling", "token").alias("spelling")).alias("c"))
    return plain.unionByName(placed.groupBy("s", "base").agg(F.collect_list("c").alias("chosen")).mapInPandas(_assemble, made))


def named(entities: DataFrame) -> DataFrame:
    return entities.where("entity_id is not null and document_id is not null and name is not null and name <> ''").select("entity_id", "document_id", F.col("name").alias("s")).distinct()


def mentioned(relations: DataFrame) -> DataFrame:
    sides = relations.where("relation_id is not null and document_id is not null").select("relation_id", "document_id", F.explode(F.array(F.struct(F.lit("subject").alias("side"), F.col("subject").alias("s")), F.struct(F.lit("object").alias("side"), F.col("object").alias("s")))).alias("x"))
    return sides.select("relation_id", "document_id", "x.side", "x.s").where("s is not null and s <> ''").distinct()


def field_forms(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(kind, id, field, form, look)`` of every name, subject and object; null fields have a null form and look."""
    e = entities.select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), F.lit("name").alias("field"), F.col("name").alias("s"))
    r = relations.select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id"), F.explode(F.array(F.struct(F.lit("subject").alias("field"), F.col("subject").alias("s")), F.struct(F.lit("object").alias("field"), F.col("object").alias("s")))).alias("x")).select("kind", "id", "x.field", "x.s")
    fields = e.unionByName(r).distinct()
    return fields.join(forms(fields, "s"), "s", "left").select("kind", "id", "field", "form", "look")


def alike(in_names: DataFrame, in_sides: DataFrame) -> DataFrame:
    """``(document_id, name, said, by)``: other strings of one document that look the same.

    ``by`` is 'form' where the repaired forms are equal, and 'look' where a string holds tokens that no repair
    applies to, such as one wholly in look-alike letters.
    """
    # a form is one key; one that still holds look-alike letters has its look as another, which is the form of whatever has none
    keys = F.explode(F.array_distinct(F.array("form", "look"))).alias("key")
    left = in_names.select("document_id", F.col("s").alias("name"), F.col("form").alias("form_a"), keys)
    right = in_sides.select("document_id", F.col("s").alias("said"), F.col("form").alias("form_b"), keys)
    same = F.col("form_a") == F.col("form_b")
    met = left.join(right, ["document_id", "key"]).where((F.col("name") != F.col("said")) & (~same | (F.col("key") == F.col("form_a"))))
    return met.select("document_id", "name", "said", F.when(same, "form").otherwise("look").alias("by"))


def found(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(entity_id, relation_id, side)`` where a name and a subject or object look the same but are other strings.

    Strings are compared once per document and distinct spelling; only pairs of spellings that differ are then
    spread over the rows that hold them. Null and empty strings, and blank ones, are no cases.
    """
    names, sides = named(entities), mentioned(relations)
    form_of = cut(forms(names.select("s").unionByName(sides.select("s")), "s").where("form <> ''"))
    in_names = names.select("document_id", "s").distinct().join(form_of, "s")
    in_sides = sides.select("document_id", "s").distinct().join(form_of, "s")
    pairs = alike(in_names, in_sides)
    with_names = pairs.join(names.withColumnRenamed("s", "name"), ["document_id", "name"]).select("document_id", "said", "entity_id")
    return with_names.join(sides.withColumnRenamed("s", "said"), ["document_id", "said"]).select("entity_id", "relation_id", "side").distinct()
