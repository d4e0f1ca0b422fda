"""Problem 3: splitting oversized items at natural boundaries by content-defined chunking.

A rolling hash over a short window marks landmarks that depend on nothing but the characters around them. The cut
after each piece is a natural boundary within the allowed range of lengths: of the strongest kind that the range holds
(line end, sentence end, clause end, blank) the one nearest to the first landmark there. So an edit moves the cuts of its own piece and perhaps of the next ones, until both versions meet at the same landmark
again; all others stay.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP, LEAST, WINDOW, MASK = 1000, 100, 300, 16, 0x7F

SENTENCE_END = "。！？；!?;…｡"
CLAUSE_END = "，、：,:､"
CLOSERS = "”’」』）)】》〉\"'"


def _gear() -> np.ndarray:
    """Pseudo-random weights for the low 12 bits of a code point, from a linear congruential rule."""
    out, x = np.empty(4096, np.uint32), 0x9E3779B9
    for i in range(4096):
        x = (x * 1664525 + 1013904223) & 0xFFFFFFFF
        out[i] = x ^ (x >> 15)
    return out


GEAR = _gear()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def landmarks(codes: np.ndarray) -> np.ndarray:
    """Positions after which the rolling hash of the last WINDOW characters has its low bits clear."""
    weights = GEAR[(codes ^ (codes >> 12)) & 0xFFF]
    h = np.zeros(len(codes), np.uint32)
    for k in range(min(WINDOW, len(codes))):
        h[k:] += weights[: len(codes) - k] * np.uint32((2654435761 * (2 * k + 1)) & 0xFFFFFFFF)
    h ^= h >> np.uint32(16)
    return np.flatnonzero((h & np.uint32(MASK)) == 0) + 1


def _member(codes: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(codes, np.array([ord(c) for c in chars], np.uint32))


def _joiner(c: str) -> bool:
    """Characters that belong to the one before them."""
    return unicodedata.category(c) in ("Mn", "Me", "Mc") or c == "‍" or 0x1F3FB <= ord(c) <= 0x1F3FF


def boundaries(text: str, codes: np.ndarray) -> list[np.ndarray]:
    """Positions of natural boundaries, strongest kind first: line ends, sentence ends, clause ends, blanks."""
    n = len(codes)
    newline = (codes == 10) | (codes == 0x2029) | (codes == 0x2028)
    newline |= (codes == 13) & np.append(codes[1:] != 10, True)
    space = newline | _member(codes, " \t\r 　    ")
    ender = _member(codes, SENTENCE_END)
    stop = codes == ord(".")
    after_space = np.append(space[1:], True)
    closer = _member(codes, CLOSERS)
    after_closer = np.append(closer[1:], False)
    ends = (ender | (stop & (after_space | after_closer))) & ~np.append(ender[1:] | closer[1:], False)
    before_end = np.append(False, (ender | stop)[:-1])
    ends |= closer & before_end & ~np.append(closer[1:], False)
    clause = _member(codes, CLAUSE_END) & ~np.append((codes[1:] >= 48) & (codes[1:] <= 57), False)
    out = []
    for flags in (newline, ends, clause, space & ~np.append(space[1:], False)):
        at = np.flatnonzero(flags) + 1
        out.append(at[at < n])
    return out


def _within(at: np.ndarray, low: int, high: int) -> np.ndarray:
    return at[np.searchsorted(at, low) : np.searchsorted(at, high, "right")]


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """``(start, end)`` of the pieces in code points; one span for a text within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    codes = code_points(text)
    kinds, marks = boundaries(text, codes), landmarks(codes)
    strong = np.union1d(kinds[0], kinds[1])
    out, start, cut = [], 0, 0
    while True:
        high = start + limit
        if high >= n:
            out.append((start, n))
            return out
        low = min(cut + least, high)
        near = _within(marks, low, high)
        mark = int(near[0]) if len(near) else high
        for at in kinds:
            inside = _within(at, low, high)
            if len(inside):
                new = int(inside[np.argmin(np.abs(inside - mark))])
                break
        else:
            # none within the allowed lengths: a shorter piece, if there is a boundary beyond the overlap
            early = next((x for x in (_within(at, max(cut, start + overlap) + 1, low - 1) for at in kinds) if len(x)), None)
            if early is not None:
                mark = int(early[-1])
            new = mark
            while new > low and (_joiner(text[new]) or text[new - 1] == "‍"):
                new -= 1
        out.append((start, new))
        cut, start = new, new - overlap
        for at in (strong, *kinds[2:]):
            inside = _within(at, new - overlap, new - 1)
            if len(inside):
                start = int(inside[0])
                break
        else:
            while start < new - 1 and _joiner(text[start]):
                start += 1


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for kind, item, text in zip(batch["item_kind"], batch["item_id"], batch["text"]):
            rows += [(kind, item, k, a, b, text[a:b]) for k, (a, b) in enumerate(spans(text))]
        yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece", "start_pos", "end_pos", "piece_text"])


def items(sections: DataFrame, chunk_texts: DataFrame) -> DataFrame:
    """``(item_kind, item_id, text)`` of both tables; a row delivered twice comes once, null texts not at all.

    Should one id come with different texts, the longest is taken and of equally long ones the last in order.
    """
    both = sections.select(F.lit("section").alias("item_kind"), F.col("section_id").alias("item_id"), "text").unionByName(
        chunk_texts.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("chunk_text").alias("text"))
    )
    known = both.where("item_id is not null and text is not null")
    best = F.max(F.struct(F.length("text").alias("n"), F.col("text")))
    return known.groupBy("item_kind", "item_id").agg(best.alias("t")).select("item_kind", "item_id", F.col("t.text").alias("text"))


def pieces(rows: DataFrame) -> DataFrame:
    """``(item_kind, item_id, piece, start_pos, end_pos, piece_text)`` with positions in code points.

    A text within the limit is its own only piece, the empty text too. Null texts have no pieces.
    """
    whole = rows.where("text is not null").where(F.length("text") <= LIMIT)
    kept = whole.select("item_kind", "item_id", F.lit(0).alias("piece"), F.lit(0).alias("start_pos"), F.length("text").alias("end_pos"), F.col("text").alias("piece_text"))
    long = rows.where(F.length("text") > LIMIT).select("item_kind", "item_id", "text")
    cut = long.mapInPandas(_split, "item_kind string, item_id long, piece int, start_pos int, end_pos int, piece_text string")
    return kept.unionByName(cut)


def found(rows: DataFrame) -> DataFrame:
    """``(item_kind, item_id)`` of the items that came out in more than one piece."""
    return pieces(rows).where("piece = 1").select("item_kind", "item_id")
