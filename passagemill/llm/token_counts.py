"""Counts of tokens per document in flat token files without an index, by a scan for separators.

A token file is little-endian 16-bit ids, each document followed by the end-of-document id, and nothing else. The end
id, 65535, lies above the vocabulary (0 to 49407), so no text, not even a literal <|endoftext|>, yields it. Files are
read in blocks; each block is searched for the end id as a vector and yields its documents that begin and end in it, and
what lies before its first and after its last separator. A prefix scan over the blocks of a file stitches those ends to
documents that cross blocks, however many they cross, and numbers the documents. Ids after the last separator of a file
are a document without end, marked so.

token_files() writes such files with Spark's text writer, whose line separator is the end id: the shared file system is
reached only through Spark. Files end after FILE_DOCS documents, and a file is read by one task, so files from elsewhere
must be below the 2 GB that Spark reads at a time. Ids that 16 bits don't hold beside the end are an error. places() says
which document of which file a row became, by the scan's partition and place, so that counts get their doc_id back.

Nulls: a null text is an empty document, of 0 tokens; a null doc_id stays. Repeated rows are documents of their own. A
document of any length is counted whole. An empty table gives no documents. Extra columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import new_path, table, written
from .tokens import chunks, encoded, tokenizer_path

END, BLOCK, FILE_DOCS = 65535, 1 << 20, 4000


def _flat(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    if chunks(path).whole.get_vocab_size() > end:
        raise ValueError(f"16-bit token files hold ids below {end}; {path} has more")
    for _, texts in encoded(batches, path):
        yield pa.RecordBatch.from_arrays([pa.array([np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in texts], pa.binary())], ["value"])


def token_files(docs: DataFrame, to: str, path: str | None = None, end: int = END, file_docs: int = FILE_DOCS) -> None:
    """Writes the texts' ids, without special tokens, as flat files. An id equal to end would split its document."""
    flat = docs.select("text").mapInArrow(functools.partial(_flat, path=path or tokenizer_path(), end=end), "value binary")
    separator = np.array([end], "<u2").tobytes().decode("iso-8859-1")
    flat.select(F.col("value").cast("string")).write.option("lineSep", separator).option("encoding", "iso-8859-1").option("maxRecordsPerFile", file_docs).text(to)


def places(docs: DataFrame, file_docs: int = FILE_DOCS) -> DataFrame:
    """doc_id, part, file_no, doc: where token_files() puts each row of docs, a scan of files, whose splits are the same
    in every job that reads them."""
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    at = docs.select("doc_id", F.spark_partition_id().cast("long").alias("part"), row.alias("row"))
    return at.select("doc_id", "part", F.floor(F.col("row") / file_docs).cast("long").alias("file_no"), (F.col("row") % file_docs).alias("doc"))


def numbers_of(file: str) -> dict[str, Column]:
    """part and file_no that Spark's writer put in a file's name; the job's random id between them may itself hold what
    looks like a file number, so the last one before the ending counts."""
    name = r"part-(\d+)-[^/]*-c(\d+)\.[^/]*$"
    return {c: F.regexp_extract(file, name, k).cast("long") for k, c in enumerate(("part", "file_no"), 1)}


def _scan(batches: Iterator[pa.RecordBatch], end: int, block: int) -> Iterator[pa.RecordBatch]:
    """Rows (file, block, head, ends, tail, inner): ids before the first separator, separators, ids after the last, and
    lengths of the documents between separators."""
    for batch in batches:
        for file, content in zip(batch["path"].to_pylist(), batch["content"]):
            ids = np.frombuffer(content.as_buffer(), "<u2")
            rows = []
            for b, s in enumerate(range(0, len(ids), block)):
                part = ids[s : s + block]
                ends = np.flatnonzero(part == end)
                rows.append((file, b, int(ends[0]) if len(ends) else len(part), len(ends), len(part) - 1 - int(ends[-1]) if len(ends) else 0, np.diff(ends) - 1 if len(ends) else np.empty(0, np.int64)))
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["file", "block", "head", "ends", "tail", "inner"])


def counted(spark: SparkSession, path: str, end: int = END, block: int = BLOCK) -> DataFrame:
    """file, doc (number in the file, from 0), n_tokens without the separator, ended."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = written(files.mapInArrow(functools.partial(_scan, end=end, block=block), "file string, block long, head long, ends long, tail long, inner array<long>"))
    file = Window.partitionBy("file").orderBy("block")
    past = file.rowsBetween(Window.unboundedPreceding, -1)
    # open: ids since the last separator before the block, a prefix sum of heads of separator-free blocks from the last tail on
    runs = rows.withColumns({"first": F.coalesce(F.sum("ends").over(past), F.lit(0)), "run": F.coalesce(F.sum(F.when(F.col("ends") > 0, 1).otherwise(0)).over(past), F.lit(0))})
    run = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last_tail = F.last(F.when(F.col("ends") > 0, F.col("tail")), ignorenulls=True).over(past)
    open_ = F.coalesce(last_tail, F.lit(0)) + F.coalesce(F.sum("head").over(run), F.lit(0))
    whole = runs.withColumn("open", open_)
    done = whole.where("ends > 0").select("file", "first", F.concat(F.array(F.col("open") + F.col("head")), "inner").alias("n")).select("file", "first", F.posexplode("n").alias("k", "n_tokens")).select("file", (F.col("first") + F.col("k")).alias("doc"), "n_tokens", F.lit(True).alias("ended"))
    final = whole.groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("ends")).alias("doc"), F.when(F.col("ends") > 0, F.col("tail")).otherwise(F.col("open") + F.col("head")).alias("n_tokens")), "block").alias("e")).select("file", "e.*", F.lit(False).alias("ended"))
    return done.union(final.where("n_tokens > 0"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    to, docs = new_path(spark), table(spark, sf_dir, "documents")
    where = written(places(docs))
    token_files(docs, to)
    found = counted(spark, to).withColumns(numbers_of("file"))
    return where.join(found, ["part", "file_no", "doc"], "full").select("doc_id", "n_tokens", "ended", "part", "file_no", "doc")
