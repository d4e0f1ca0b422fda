"""Problem 6: encoding of the whole corpus with a public tokenizer, each distinct word once.

Texts are cut into pre-tokens in the JVM and exploded with their positions; the distinct pre-tokens of the whole
corpus are encoded once each by the public tokenizer; the ids are joined back and put together by position.
A pre-token that holds a large share of all positions is looked up in a broadcast of a bounded number of such
words, so no reducer gets them all.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planweave.operators.skew import lookup
from planweave.session import cut

TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
#: The pre-token pattern of the byte-level BPE, a fixed value of the published tokenizer; (?U) gives \s its Unicode meaning.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def load(path: str):
    """The tokenizer, once per process."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        _loaded[path] = tokenizer
    return _loaded[path]


#: A word of at most HOT_LENGTH signs goes through the broadcast if it has more than HOT_WORDS positions and more than HOT_SHARE of all; so at most 10,000 words do, some megabytes whatever the data.
HOT_WORDS, HOT_SHARE, HOT_LENGTH = 2_000, 0.0001, 64


def words(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_key, pos, word)`` of every pre-token of every text; the key tells texts apart that share an id or have none."""
    some = documents.where(F.length("text") > 0)
    return some.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), 0)).alias("pos", "word"))


def encode_words(distinct: DataFrame, path: str) -> DataFrame:
    """Adds ``word_ids`` and their number ``n_ids`` to rows that each hold one ``word``; the other columns stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = load(path)
        for batch in batches:
            encoded = [e.ids for e in tokenizer.encode_batch(list(batch["word"]), add_special_tokens=False)]
            yield batch.assign(word_ids=encoded, n_ids=[len(ids) for ids in encoded])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema) + ", word_ids array<int>, n_ids int"
    return distinct.mapInPandas(run, schema)


def _looked_up(positions: DataFrame, path: str, wanted: list[str]) -> DataFrame:
    """The positions with columns of their words, each distinct word of the corpus being encoded once."""
    vocabulary = cut(encode_words(positions.groupBy("word").agg(F.count(F.lit(1)).alias("n")), path))
    values = vocabulary.select("word", F.when(F.length("word") <= HOT_LENGTH, F.col("n")).otherwise(0).alias("n"), *wanted)
    total = vocabulary.agg(F.sum("n")).first()[0] or 0
    return lookup(positions, values, "word", "n", total, total, HOT_SHARE, HOT_WORDS)


def encode(documents: DataFrame, path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``(doc_id, ids)`` for every document: empty and null texts have the empty list.

    A string that looks like a special token is ordinary text, since words are cut before the vocabulary is
    consulted. Rows that repeat an id and its text come out once; different texts under one id, or under none,
    come out one by one.
    """
    texts = documents.select("doc_id", "text")
    placed = _looked_up(words(texts), path, ["word_ids"])
    parts = placed.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("pos", "word_ids"))).alias("parts"))
    # a row delivered twice has every position twice, side by side now; whole texts need no shuffle to find such rows
    once = F.filter("parts", lambda x, i: (i == 0) | (F.get("parts", i - 1)["pos"] != x["pos"]))
    ids = parts.select("doc_id", F.flatten(F.transform(once, lambda x: x["word_ids"])).alias("ids"))
    without = texts.where("text is null or text = ''").distinct().select("doc_id", F.array().cast("array<int>").alias("ids"))
    return ids.unionByName(without).select("doc_id", "ids")


def sizes(documents: DataFrame, path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``(doc_id, text_key, n_tokens)`` of every text that is neither null nor empty, once for each id and text; the ids themselves are not put together."""
    placed = _looked_up(words(documents.select("doc_id", "text")), path, ["n_ids"])
    counted = placed.groupBy("doc_id", "text_key").agg(F.sum("n_ids").alias("n"), F.count_if(F.col("pos") == 0).alias("copies"))
    return counted.select("doc_id", "text_key", (F.col("n") / F.col("copies")).cast("int").alias("n_tokens"))


def byte_table(path: str) -> dict[int, bytes]:
    """The bytes of each id, by the published byte-to-letter rule: printable bytes stand for themselves, the others follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable}
    letters |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(printable))}
    vocab = load(path).get_vocab(with_added_tokens=False)
    return {i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token, i in vocab.items()}


def decode(encoded: DataFrame, path: str = f"{TOKENIZER_DIR}/{TOKENIZER}") -> DataFrame:
    """``(doc_id, text)`` from ``(doc_id, ids)`` by a join with the token-byte table; the empty list gives ''.

    The table has one row per vocabulary entry, a size fixed by the tokenizer and not by the data.
    """
    spark = encoded.sparkSession
    table = spark.createDataFrame([(i, bytearray(b)) for i, b in byte_table(path).items()], "id int, bytes binary")
    # rows that share an id, or have none, are told apart by their ids
    keyed = encoded.select("doc_id", F.xxhash64("ids").alias("ids_key"), "ids").distinct()
    exploded = keyed.select("doc_id", "ids_key", F.posexplode("ids").alias("pos", "id"))
    placed = exploded.join(F.broadcast(table), "id").groupBy("doc_id", "ids_key").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    joined = placed.select("doc_id", F.decode(F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["bytes"])), "")), "UTF-8").alias("text"))
    empty = keyed.where(F.size("ids") == 0).select("doc_id", F.lit("").alias("text"))
    return joined.unionByName(empty)
