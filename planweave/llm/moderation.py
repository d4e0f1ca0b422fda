"""Problem 8: abusive, hateful or sexual content, by subword-bag embeddings and a linear softmax.

A text is cut into short segments; a segment is the bag of its character n-grams, hashed to buckets. The mean of the
bucket embeddings goes through a linear softmax over (clean, abusive, hateful, sexual); embeddings and softmax are
trained jointly in numpy. A label speaks of a whole document while the offence is usually one sentence, so training
alternates: models that have not seen a flagged document share its label out over its segments, by their scores
and the chance that the label is a reviewer's slip; then each distinct segment is one example, whose target is the
part of its documents that gave it their label. So a sentence that clean and flagged documents hold alike stays clean.
A document scores as its worst segment.

Labels are read up to ``MAX_LABELS`` documents and ``MAX_CHARS`` characters, a bound on what training holds; every
document is scored, whole. The models of a round are trained side by side on the executors.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweave.llm.lookalikes import appearance, image
from planweave.session import cut, spread

#: The most labelled documents that training takes, and the most characters of them; beyond it a hash sample of that size is taken.
MAX_LABELS, MAX_CHARS = 30_000, 60_000_000
BUCKETS, DIM, ORDERS = 1 << 17, 12, (1, 2, 3, 4)
CLASSES = ("clean", "abusive", "hateful", "sexual")
SEGMENT = 64
#: Characters that are turned into n-grams at once, a bound on memory.
SLICE = 100_000
THRESHOLD = 0.5
#: The weight of a slip of the reviewer beside the scores of a flagged document's segments.
SLIP = 0.05
#: How much more a segment's share of a label counts than a document that holds it without one.
BOOST = 6.0
#: The least number of steps of a training, so that few labels are learnt too: small sets are gone through more often.
STEPS = 400
#: So many n-grams without a say are added to each bag that is scored, so that a word or two alone decide nothing.
PAD = 4

_CUT = re.compile(r"[\n\r。！？!?；;\u2600-\u27bf\U0001f000-\U0001faff]+|(?<=[a-zA-Z\])])\.+(?:\s+|$)|…+|\.{3,}")
_DROP = re.compile(r"[^\w *]|_")
_LATIN, _OTHER = re.compile("[a-z][a-z0-9* ]+"), re.compile("[^a-z0-9* ]{4,}")
_STARS = re.compile(r"\*{2,}")
_GAP = re.compile(r"(?<![a-z0-9]) +| +(?![a-z0-9])")
_DIGITS = re.compile(r"(?<![a-z\d])\d+(?![a-z\d])")


def segments(text: str) -> list[str]:
    """Lower-case sentences of letters, of at most SEGMENT characters where a clause or word end allows; runs of digits become 0. A sentence in two scripts is followed by its parts in each."""
    out = []
    for line in _CUT.split(text):
        parts = [line] if len(line) <= SEGMENT else re.split(r"(?<=[，,、：:])", line)
        for part in parts:
            bare = _DROP.sub("", image(appearance(part)).lower().replace("-", " "))
            bare = _GAP.sub("", _DIGITS.sub("0", _STARS.sub("*", bare)))
            while len(bare) > 2 * SEGMENT:
                at = bare.rfind(" ", SEGMENT // 2, 2 * SEGMENT)
                at = at if at > 0 else 2 * SEGMENT
                out.append(bare[:at])
                bare = bare[at:]
            if bare:
                out.append(bare)
                if _LATIN.search(bare) and _OTHER.search(bare):
                    # texts run together: what is said in one script is looked at by itself too
                    out += [x for x in (*_LATIN.findall(bare), *_OTHER.findall(bare)) if x.strip()]
    return out


def grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every n-gram of every segment, and the number of n-grams of each, computed over slices of bounded length."""
    done = [_grams(part) for part in _slices(parts)]
    return np.concatenate([b for b, _ in done]), np.concatenate([n for _, n in done])


def _slices(parts: list[str]) -> Iterator[list[str]]:
    start, chars = 0, 0
    for k, part in enumerate(parts, 1):
        chars += len(part)
        if chars >= SLICE or k == len(parts):
            yield parts[start:k]
            start, chars = k, 0


def _grams(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    joined = "\x02" + "\x02".join(parts) + "\x02"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    edge = codes == 2
    which = np.cumsum(edge) - 1
    n = len(codes)
    where, what = [], []
    h = np.zeros(n, np.uint64)
    open_ = np.ones(n, bool)
    for k in range(max(ORDERS)):
        m = n - k
        if m <= 0:
            break
        h = (h[:m] * np.uint64(0x100000001B3)) ^ (codes[k:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k))
        # an n-gram may begin or end at an edge mark but not run across one, and is never the mark alone
        inner = edge[k:] if k == 0 else np.zeros(m, bool)
        open_ = open_[:m] & (~edge[k - 1 : k - 1 + m] if k > 1 else True)
        if k + 1 in ORDERS:
            at = np.flatnonzero(open_ & ~inner & ~((which[:m] < 0) | (which[:m] >= len(parts))))
            where.append(which[at])
            x = h[at]
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            what.append(((x ^ (x >> np.uint64(32))) % np.uint64(BUCKETS)).astype(np.int32))
    segment, bucket = np.concatenate(where), np.concatenate(what)
    order = np.argsort(segment, kind="stable")
    return bucket[order], np.bincount(segment, minlength=len(parts))


class Model:
    """Embeddings and softmax; ``table`` is their product, which is all that scoring needs."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.e = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        self.w = np.zeros((DIM, len(CLASSES)), np.float32)
        self.b = np.zeros(len(CLASSES), np.float32)

    def fit(self, parts: list[str], target: np.ndarray, weights: np.ndarray, epochs: int, rate: float = 0.15, batch: int = 256, seed: int = 11) -> None:
        """Adagrad on minibatches of distinct segments; ``target`` has a row of class shares for each, ``weights`` are how much each counts. ``epochs`` are the least number of them."""
        bucket, sizes = grams(parts)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ge, gw, gb = np.full(BUCKETS, 1e-4, np.float32), np.full_like(self.w, 1e-4), np.full_like(self.b, 1e-4)
        rng = np.random.default_rng(seed)
        epochs = max(epochs, -(-STEPS // max(1, -(-len(parts) // batch))))
        for epoch in range(epochs):
            order = rng.permutation(len(parts))
            step = rate * (1 - epoch / epochs) + 0.01
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                n = sizes[at]
                rows = np.repeat(np.arange(len(at)), n)
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                flat = bucket[(starts[at] - first)[rows] + np.arange(len(rows))]
                mean = np.add.reduceat(self.e[flat], first, axis=0) / n[:, None]
                z = (mean @ self.w + self.b) * 4
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p -= target[at]
                p *= (weights[at] / len(at))[:, None] * 4
                dw, db, dm = mean.T @ p, p.sum(0), (p @ self.w.T) / n[:, None]
                gw += dw * dw
                gb += db * db
                self.w -= step * dw / np.sqrt(gw)
                self.b -= step * db / np.sqrt(gb)
                by = np.argsort((flat & 0xFFFF).astype(np.uint16), kind="stable")
                by = by[np.argsort((flat[by] >> 16).astype(np.uint16), kind="stable")]  # twice by 16 bits is a radix sort
                sorted_flat = flat[by]
                heads = np.flatnonzero(np.concatenate([[True], sorted_flat[1:] != sorted_flat[:-1]]))
                de = np.add.reduceat(dm[rows[by]], heads, axis=0)
                own = sorted_flat[heads]
                ge[own] += (de * de).mean(1)
                self.e[own] -= step * de / np.sqrt(ge[own])[:, None]

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        return (self.e @ self.w).astype(np.float32) * 4, self.b * 4


def score_parts(parts: list[str], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Probabilities of the classes for each segment."""
    out = [np.zeros((0, len(CLASSES)), np.float32)]
    for some in _slices(parts):
        bucket, sizes = _grams(some)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        z = np.add.reduceat(table[bucket], first, axis=0) / (sizes + PAD)[:, None] + bias
        p = np.exp(z - z.max(1, keepdims=True))
        out.append(p / p.sum(1, keepdims=True))
    return np.concatenate(out)


class Lessons:
    """Labelled documents as arrays: the distinct segments, and for each segment of each document its number and that of the document."""

    def __init__(self, docs: list[list[str]], labels: list[int], folds: int):
        number: dict[str, int] = {}
        for d in docs:
            for s in d:
                number.setdefault(s, len(number))
        self.parts = list(number)
        self.segment = np.array([number[s] for d in docs for s in d], int)
        self.doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        self.label = np.array(labels, int)[self.doc]
        self.fold = self.doc % folds

    def first(self) -> np.ndarray:
        """At first every segment of a flagged document that no clean one has is suspect."""
        clean = np.bincount(self.segment[self.label == 0], minlength=len(self.parts))
        return np.where((self.label > 0) & (clean[self.segment] == 0), 1.0, 0.0)

    def shares(self, suspect: np.ndarray) -> np.ndarray:
        """The part of its document's label that each segment gets; the rest is the reviewer's slip."""
        own = np.where(self.label > 0, suspect, 0.0)
        return own / (SLIP + np.bincount(self.doc, own)[self.doc])

    def learn(self, share: np.ndarray, epochs: int, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """One model, from all documents or all but those of one fold."""
        seen = np.flatnonzero(self.fold != without) if without is not None else np.arange(len(self.doc))
        n, segment, w = len(self.parts), self.segment[seen], share[seen]
        offence = np.zeros((n, len(CLASSES)))
        np.add.at(offence, (segment, self.label[seen]), np.where(self.label[seen] > 0, w * BOOST, 0.0))
        offence[:, 0] = np.bincount(segment, 1 - w, n)
        total = offence.sum(1)
        used = np.flatnonzero(total > 0)
        model = Model()
        model.fit([self.parts[i] for i in used], (offence[used] / total[used, None]).astype(np.float32), np.sqrt(total[used]).astype(np.float32), epochs)
        return model.table()

    def judged(self, share: np.ndarray, epochs: int, fold: int) -> np.ndarray:
        """What a model that has not seen the documents of a fold thinks of their segments; 0 for all others."""
        here = np.flatnonzero(self.fold == fold)
        out = np.zeros(len(self.doc), np.float32)
        own, back = np.unique(self.segment[here], return_inverse=True)
        out[here] = (1 - score_parts([self.parts[i] for i in own], *self.learn(share, epochs, fold))[:, 0])[back]
        return out


#: Runs a method of the lessons once for each list of arguments.
Each = Callable[[Lessons], Callable[[str, list[tuple]], list]]


def here(lessons: Lessons) -> Callable[[str, list[tuple]], list]:
    return lambda method, calls: [getattr(lessons, method)(*args) for args in calls]


def on_executors(spark: SparkSession) -> Each:
    """The calls as tasks of one job, each on whatever executor is free; a lost one is done again."""

    def each(lessons: Lessons) -> Callable[[str, list[tuple]], list]:
        shared = spark.sparkContext.broadcast(lessons)

        def run(method: str, calls: list[tuple]) -> list:
            sent = spark.sparkContext.broadcast(calls)

            def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for k in batch["id"]:
                        yield pd.DataFrame({"id": [k], "result": [pickle.dumps(getattr(shared.value, method)(*sent.value[k]))]})

            rows = spark.range(0, len(calls), 1, len(calls)).mapInPandas(work, "id long, result binary").collect()
            return [pickle.loads(r["result"]) for r in sorted(rows, key=lambda r: r["id"])]

        return run

    return each


def train(docs: list[list[str]], labels: list[int], rounds: int = 3, epochs: int = 6, folds: int = 4, each: Each = here) -> tuple[np.ndarray, np.ndarray]:
    """``(table, bias)`` from the segments of documents and their class numbers (0 for clean).

    Without a single flagged or a single clean document nothing can be learnt: every text then scores 0.
    """
    kept = [(list(dict.fromkeys(d)), c) for d, c in zip(docs, labels) if d]
    if not any(c for _, c in kept) or all(c for _, c in kept):
        return np.zeros((BUCKETS, len(CLASSES)), np.float32), np.array([50, -50, -50, -50], np.float32)
    lessons = Lessons([d for d, _ in kept], [c for _, c in kept], folds)
    run, suspect = each(lessons), lessons.first()
    for _ in range(rounds - 1):
        # a document is judged by a model that has not seen it, else slips of reviewers are learnt by heart
        suspect = sum(run("judged", [(lessons.shares(suspect), epochs, fold) for fold in range(folds)]))
    return run("learn", [(lessons.shares(suspect), epochs)])[0]


def labelled(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELS, chars: int = MAX_CHARS) -> DataFrame:
    """``(place, text, class)`` of labelled documents, ``place`` being the order in which they are taken: flagged when more labels of it say so than not; at most ``most`` of at most ``chars`` characters together.

    Labels with a null document or flag, and documents with a null or empty text, are left out; an unknown
    or null category of a flagged document counts as abusive.
    """
    number = F.when(F.col("category") == "hateful", 2).when(F.col("category") == "sexual", 3).otherwise(1)
    votes = labels.where("doc_id is not null and flagged is not null").groupBy("doc_id").agg(
        F.avg("flagged").alias("share"), F.max(F.when(F.col("flagged") == 1, F.struct(F.col("category").isNotNull(), number.alias("c")))).alias("best")
    )
    decided = votes.where("share <> 0.5").select("doc_id", F.when(F.col("share") > 0.5, F.col("best.c")).otherwise(0).alias("class"))
    texts = documents.where(F.length("text") > 0).select("doc_id", "text")
    place = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("t"))
    rows = cut(texts.join(decided, "doc_id").select("text", "class", place.alias("place")))
    known = rows.select("place", F.length("text").alias("n")).orderBy("place").limit(most + 1).collect()
    room = next((k for k, total in enumerate(accumulate(r["n"] for r in known[:most])) if total > chars), min(most, len(known)))
    if room < len(known):
        end = F.struct(*(F.lit(x).cast("long").alias(f) for f, x in zip("hdt", known[room]["place"])))
        rows = rows.where(F.col("place") < end)
    return rows.select("place", "text", "class")


def _segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"h": batch["h"], "d": batch["d"], "t": batch["t"], "parts": [segments(t) for t in batch["text"]], "class": batch["class"]})


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, source, score, category)`` of every document; ``score`` is the worst segment's probability of not being clean.

    Null, empty and blank texts score 0 with a null category, as does every text where there are no labels.
    """
    spark = documents.sparkSession
    rows = spread(labelled(documents, labels)).select("place.*", "text", "class")
    sample = sorted(rows.mapInPandas(_segmented, "h long, d long, t long, parts array<string>, class int").collect())
    learnt = spark.sparkContext.broadcast(train([r["parts"] for r in sample], [r["class"] for r in sample], each=on_executors(spark)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, bias = learnt.value
        for batch in batches:
            parts, ends = [], []
            for text in batch["text"]:
                parts += segments(text or "")
                ends.append(len(parts))
            p = score_parts(parts, table, bias)
            score, category, start = [], [], 0
            for end in ends:
                if end == start:
                    score.append(0.0)
                    category.append(None)
                else:
                    worst = start + int(p[start:end, 0].argmin())
                    score.append(float(1 - p[worst, 0]))
                    category.append(CLASSES[1 + int(p[worst, 1:].argmax())] if score[-1] >= THRESHOLD else None)
                start = end
            yield pd.DataFrame({"doc_id": batch["doc_id"], "source": batch["source"], "score": score, "category": category})

    return spread(documents.select("doc_id", "source", "text")).mapInPandas(run, "doc_id long, source string, score double, category string")


def rates(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(source, documents, flagged, rate)``: share of flagged documents per source, a null source being one of its own."""
    flagged = F.count_if(F.col("score") >= threshold)
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), flagged.alias("flagged")).select("source", "documents", "flagged", F.round(F.col("flagged") / F.col("documents"), 6).alias("rate"))


def found(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.where(F.col("score") >= threshold).select("doc_id").where("doc_id is not null").distinct()
