"""Scalar text functions as column expressions; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from planweave.functions import packs

SPACE = r"[\s\p{Z}\x1c-\x1f\x85]"
_WIDE = "　" + "".join(chr(o) for o in range(0xFF01, 0xFF5F))
_NARROW = " " + "".join(chr(o - 0xFEE0) for o in range(0xFF01, 0xFF5F))


def ustrip(c: Column) -> Column:
    """Strips Unicode white space at both ends; null stays null."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(c: Column) -> Column:
    """The value, or null where nothing but white space is in it."""
    return F.when(F.length(ustrip(c)) > 0, c)


def text_hash(c: Column) -> Column:
    return F.md5(c)


def prompt_hash(c: Column) -> Column:
    """SHA-256 of the text; null counts as ''."""
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def token_estimate(c: Column, chars_per_token: int = 2) -> Column:
    """Deterministic number of tokens: characters over ``chars_per_token``, whole part; null has none."""
    return F.floor(F.coalesce(F.length(c), F.lit(0)) / chars_per_token).cast("int")


def clean_text(c: Column) -> Column:
    """Runs of white space to one blank, only Han, Latin letters, digits and common punctuation kept, runs of stops to one 。, stripped."""
    one = F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " ")
    kept = F.regexp_replace(one, r'[^一-龥a-zA-Z0-9\s。，！？；："（）()【】\[\]<>《》]', "")
    return ustrip(F.regexp_replace(kept, "[。，！？；：]{2,}", "。"))


def narrow(c: Column) -> Column:
    """Full-width signs and the ideographic blank to their half-width forms."""
    return F.translate(c, _WIDE, _NARROW)


def unify_punctuation(c: Column) -> Column:
    return F.translate(c, "（）—–", "()--")


def normalize_text(c: Column) -> Column:
    return ustrip(F.regexp_replace(unify_punctuation(narrow(F.coalesce(c, F.lit("")))), f"{SPACE}+", " "))


def features(c: Column) -> dict[str, Column]:
    """Counts and ratios of a text; all null for a null or empty one."""
    n, some = F.length(c), F.length(c) > 0
    stripped = ustrip(c)
    words = F.when(F.length(stripped) > 0, F.size(F.split(stripped, f"{SPACE}+"))).otherwise(0)
    han, numbers, marks = F.regexp_count(c, F.lit("[一-龥]")), F.regexp_count(c, F.lit(r"\p{Nd}+")), F.regexp_count(c, F.lit('[，。！？；："（）()【】\\[\\]<>《》]'))
    out = {
        "char_count": n,
        "word_count": words,
        "sentence_count": F.size(F.split(c, "[。！？；]")),
        "chinese_chars": han,
        "chinese_ratio": F.round(F.try_divide(han, n), 6),
        "numbers": numbers,
        "number_ratio": F.round(F.coalesce(F.try_divide(numbers, words), F.lit(0.0)), 6),
        "punctuations": marks,
        "punctuation_ratio": F.round(F.try_divide(marks, n), 6),
    }
    return {k: F.when(some, v) for k, v in out.items()}


def valid_entity(name: Column) -> Column:
    """At least two characters once stripped, not all digits, at most 30 % special characters; null is not valid."""
    special = F.regexp_count(name, F.lit("[^一-龥a-zA-Z0-9]"))
    return F.coalesce((F.length(ustrip(name)) >= 2) & ~name.rlike(r"^\p{Nd}+$") & (special <= F.length(name) * 0.3), F.lit(False))


def valid_relation(s: Column, p: Column, o: Column) -> Column:
    """All three of at least two characters and the two ends different, all once stripped; null is not valid."""
    long = [F.length(ustrip(c)) >= 2 for c in (s, p, o)]
    return F.coalesce(long[0] & long[1] & long[2] & (ustrip(s) != ustrip(o)), F.lit(False))


def window(text: Column, start: Column, end: Column, margin: int = 10) -> Column:
    """The text around a span, ``margin`` characters on either side."""
    begin = F.greatest(start - margin, F.lit(0))
    return F.substring(text, begin + 1, end + margin - begin)


def find(text: Column, name: Column) -> Column:
    """First offset of ``name`` in ``text`` from 0, or -1."""
    return F.position(name, text) - 1


def relation_type(predicate: Column) -> Column:
    """A predicate as an edge type; not invertible, so the predicate itself is kept beside it."""
    return F.replace(F.replace(predicate, F.lit(" "), F.lit("_")), F.lit("..."), F.lit("_"))


def canonical_type(kind: Column, name: Column | None = None) -> Column:
    """One of the closed labels: known ones stay, older ones are mapped, unknown ones follow from the name if it is given."""
    t = ustrip(F.coalesce(kind, F.lit("")))
    out = F.when(t.isin(packs.LABELS), t)
    for old, new in packs.TYPE_MAP.items():
        out = out.when(t == old, F.lit(new))
    if name is not None:
        for label, parts in packs.NAME_HINTS:
            hit = F.lit(False)
            for part in parts:
                hit = hit | F.coalesce(name.contains(part), F.lit(False))
            out = out.when(hit, F.lit(label))
    return out.otherwise(t)


def element_key(c: Column) -> Column:
    """The canonical name of a semantic element, or '' for none."""
    k = F.lower(ustrip(F.coalesce(c, F.lit(""))))
    out = None
    for name, keys in packs.ELEMENT_KEYS.items():
        out = F.when(k.isin(keys), F.lit(name)) if out is None else out.when(k.isin(keys), F.lit(name))
    return out.otherwise("")


def semantic_elements(text: Column, given: Column) -> Column:
    """Sorted distinct elements of a rule: those given by name and those its text shows."""
    t = ustrip(F.coalesce(text, F.lit("")))
    marked = F.lit(False)
    for m in packs.ACTION_MARKERS:
        marked = marked | t.contains(m)
    first = F.regexp_extract(t, packs.NORM_VERB, 1)
    shown = F.array(
        F.when(marked, F.lit("Action")),
        F.when(t.rlike(packs.CONDITION), F.lit("Condition")),
        F.when(t.rlike(packs.TIME_LIMIT), F.lit("Time")),
        F.when((first != "") & (F.position(first, t) >= 3), F.lit("Subject")),
        F.when(t.rlike(packs.OBJECT_MARK), F.lit("Object")),
    )
    named = F.transform(F.coalesce(given, F.array().cast("array<string>")), lambda x: F.nullif(element_key(x), F.lit("")))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(named, shown))))


def admissible(elements: Column) -> Column:
    """At least two elements, an action or a condition among them."""
    return (F.size(elements) >= 2) & (F.array_contains(elements, "Action") | F.array_contains(elements, "Condition"))


def format_epoch(seconds: Column) -> Column:
    """Seconds since the epoch as ``yyyy-MM-dd HH:mm:ss`` in the session's zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss")


def safe_get(m: Column, key: str, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), default)
