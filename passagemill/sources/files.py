"""Scans and sinks: CSV pairs, JSON lines with physical line numbers, resume scans, splits, dead letters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, strip


class InputError(ValueError):
    """What a reader finds wrong with its input, with the first line concerned."""


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source_index, query, positive of a CSV file with the columns question and content_text. Every row is numbered;
    rows with a blank in either are dropped afterwards. Other columns are not read."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    names = {c.lstrip("﻿"): c for c in df.columns}
    missing = {"question", "content_text"} - set(names)
    if missing:
        raise InputError(f"CSV lacks {sorted(missing)}")
    rows = df.select(F.col(f"`{names['question']}`").alias("question"), F.col(f"`{names['content_text']}`").alias("content_text"))
    return nonempty_pairs(numbered(rows, "source_index", 0))


def numbered(df: DataFrame, name: str, first: int) -> DataFrame:
    """df, a scan of files, in physical order with an ordinal: files by path, within a file its blocks by their start, the
    place within the block plus the rows of those before it, from a count per block. A scan deals blocks to its partitions
    by size, so the partitions' own order is not that of the lines. Splits of a scan are the same in both passes."""
    block = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")]
    at = df.select(*(F.col(f"`{c}`") for c in df.columns), *block, F.monotonically_increasing_id().alias("_at"))
    sizes = df.select(*block, F.monotonically_increasing_id().alias("_at")).groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
    starts = sizes.select("_file", "_start", "_least", before.alias("_before"))
    place = (F.col("_before") + F.col("_at") - F.col("_least") + first).cast("long").alias(name)
    return at.join(F.broadcast(starts), ["_file", "_start"]).select(place, *(F.col(f"`{c}`") for c in df.columns))


def nonempty_pairs(rows: DataFrame) -> DataFrame:
    return rows.where(~blank(F.col("question")) & ~blank(F.col("content_text"))).select("source_index", strip(F.col("question")).alias("query"), strip(F.col("content_text")).alias("positive"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 1, blank lines counted), line: the lines that are not blank. A byte order mark is dropped."""
    lines = numbered(spark.read.text(path), "line_no", 1)
    return lines.select("line_no", F.when(F.col("line_no") == 1, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")).alias("line")).where(~blank(F.col("line")))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line, value: a variant, null where the line is not JSON."""
    return read_lines(spark, path).withColumn("value", F.try_parse_json("line"))


def completed(lines: DataFrame, strict: bool = True) -> DataFrame:
    """source_index of finished rows, from line_no, line, value. Strict: a bad line or a repeated index is an error;
    lenient: bad lines are ignored and repeats collapse."""
    found = lines.select("line_no", F.try_variant_get("value", "$.source_index", "bigint").alias("source_index"))
    if not strict:
        return found.where("source_index IS NOT NULL").select("source_index").distinct()
    bad = found.agg(F.min(F.when(F.col("source_index").isNull(), F.col("line_no")))).first()[0]
    if bad is not None:
        raise InputError(f"Line {bad} has no source_index")
    again = found.groupBy("source_index").agg(F.count("*").alias("n"), F.max("line_no").alias("line_no")).where("n > 1").agg(F.min("line_no")).first()[0]
    if again is not None:
        raise InputError(f"Line {again} repeats a source_index")
    return found.select("source_index")


def repaired(text: str) -> str:
    """Imported JSON lines whose last line was cut off: it goes if it is not JSON, else it gets its line feed."""
    import json

    if not text or text.endswith("\n"):
        return text
    head, _, tail = text.rpartition("\n")
    try:
        json.loads(tail)
    except ValueError:
        return head + "\n" * bool(head)
    return text + "\n"


def json_text(df: DataFrame) -> DataFrame:
    """One column, value: each row as JSON with its nulls."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite", one_file: bool = False) -> None:
    out = json_text(df)
    (out.coalesce(1) if one_file else out).write.mode(mode).text(path)


def write_splits(df: DataFrame, path: str) -> None:
    """A folder per value of split, in one pass."""
    df.select("split", F.to_json(F.struct(*(c for c in df.columns if c != "split")), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def errors_path(output: str) -> str:
    """Where the rows go that failed: beside the output, with the suffix .errors.jsonl added."""
    return re.sub(r"(\.[^./]+)?/*$", lambda m: f"{m[1] or ''}.errors.jsonl", output, count=1)


def write_errors(errors: DataFrame, output: str) -> None:
    errors.write.mode("append").json(errors_path(output))
