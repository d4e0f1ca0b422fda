"""Sinks: JSON, JSON lines, results per document, text on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines under a folder. ``one_file`` is for results known to be small."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def write_per_document(results: DataFrame, entities: DataFrame, relations: DataFrame, folder: str, buckets: int = 256) -> None:
    """The three results of a run, partitioned by a hash of the document, so that the number of folders does not grow with the documents."""
    for name, df in (("processing_results", results), ("extracted_entities", entities), ("extracted_relations", relations)):
        df.withColumn("bucket", F.pmod(F.xxhash64("document_id"), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").json(f"{folder.rstrip('/')}/{name}")


def write_trace(trace: DataFrame, path: str) -> None:
    trace.write.mode("append").json(path)


def write_text(text: str, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def save_json(data, path: str, indent: int = 2) -> None:
    """A small driver-side value as one JSON file, folders made."""
    write_text(json.dumps(data, ensure_ascii=False, indent=indent, default=str), path)


def load_json(path: str) -> list[dict]:
    """A small JSON file as a list: an object is one row, an array its rows, anything else an error."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if isinstance(data, dict):
        return [data]
    if isinstance(data, list):
        return data
    raise ValueError(f"{path} holds neither an object nor an array")
