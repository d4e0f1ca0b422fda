"""Sources: rule records from JSON, word-processor documents, embedding records, tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave.functions import packs
from planweave.functions.text import ustrip

RULE = "rule_id string, rule_name string, rule_text string, elements array<string>, rule_tags array<string>, rule_source string"
EMBEDDING = "id string, name string, text string, embedding array<double>, model string, dim int, norm_l2 double, source struct<document:string,chunk_index:int>"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def or_null(c: str | Column) -> Column:
    """The value stripped, or null where it is blank."""
    s = ustrip(F.col(c) if isinstance(c, str) else c)
    return F.when(F.length(s) > 0, s)


def with_source(rules: DataFrame, file: Column) -> DataFrame:
    """``source_name``: the rule's own source, or the stem of its file; blank counts as missing."""
    return rules.withColumn("source_name", F.coalesce(or_null("rule_source"), file_stem(file)))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule records of one JSON file or a glob, each file one object or an array; files that cannot be read are skipped.

    ``ord`` follows the order of files by name and of records in a file, since every first-wins step depends on it.
    """
    raw = spark.read.option("multiLine", True).option("ignoreCorruptFiles", True).option("columnNameOfCorruptRecord", "_bad").schema(RULE + ", _bad string").json(path)
    # a file of several lines is read whole by one task, so the low bits of the row number follow the order in the file
    placed = raw.withColumns({"file": F.input_file_name(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    rows = with_source(placed, F.col("file")).where("_bad is null").drop("_bad")
    by_name = Window.orderBy(F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B"))))
    files = raw.select(F.input_file_name().alias("file")).distinct().withColumn("rank", F.row_number().over(by_name) - 1)
    return rows.join(files, "file").withColumn("ord", F.col("rank").cast("long") * (1 << 33) + F.col("at")).drop("file", "rank", "at")


def shape_rules(rules: DataFrame) -> DataFrame:
    """Rules with a text, defaults filled in: name 未命名规则, tags [应急管理], source 未知."""
    tags = F.when(F.size("rule_tags") > 0, F.col("rule_tags")).otherwise(F.array(F.lit(packs.DEFAULT_RULE_TAG)))
    return rules.where(F.length(ustrip(F.col("rule_text"))) > 0).withColumns(
        {"rule_name": F.coalesce(or_null("rule_name"), F.lit(packs.DEFAULT_RULE_NAME)), "rule_tags": tags, "rule_text": ustrip(F.col("rule_text")), "source_name": F.coalesce(or_null("source_name"), F.lit(packs.UNKNOWN))}
    )


def table_rules(rules: DataFrame, rule_json: DataFrame) -> DataFrame:
    """The records of both rule tables as one: ``(record_id, RULE, source_name)``."""
    flat = rules.select("record_id", "rule_id", "rule_name", "rule_text", "elements", "rule_tags", "rule_source", F.coalesce(or_null("rule_source"), or_null("source_name")).alias("source_name"))
    parsed = rule_json.select("record_id", "file_name", F.from_json("body", RULE).alias("r")).select("record_id", "r.*", "file_name")
    return flat.unionByName(with_source(parsed, F.col("file_name")).drop("file_name"))


def docx_sections(content: bytes) -> list[str]:
    """Non-blank paragraphs in order, then every table as one section: cells by `` | ``, rows by line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")

    def words(node) -> str:
        return "".join(x.text or "" if x.tag == f"{_W}t" else "\t" if x.tag == f"{_W}tab" else "\n" if x.tag in (f"{_W}br", f"{_W}cr") else "" for x in node.iter()).strip()

    paragraphs = [t for p in body.findall(f"{_W}p") if (t := words(p))]
    tables = []
    for table in body.findall(f"{_W}tbl"):
        lines = []
        for row in table.findall(f"{_W}tr"):
            cells = [t for c in row.findall(f"{_W}tc") if (t := "\n".join(filter(None, (words(p) for p in c.findall(f"{_W}p")))))]
            if cells:
                lines.append(" | ".join(cells))
        if lines:
            tables.append("\n".join(lines))
    return paragraphs + tables


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """``(document, section_index, text, error)`` of every .docx file under a folder; a file that cannot be read gives one row with its error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", True).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["document"], batch["content"]):
                try:
                    rows += [(name, k, t, None) for k, t in enumerate(docx_sections(content))]
                except Exception as e:  # noqa: BLE001 - a broken file must not fail the scan
                    rows.append((name, -1, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["document", "section_index", "text", "error"])

    return files.select(file_stem(F.col("path")).alias("document"), "content").mapInPandas(run, "document string, section_index int, text string, error string")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EMBEDDING).json(path)
