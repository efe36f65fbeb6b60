"""What the operators of this subpackage share: written tables, words, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The characters between words, as a Java or Python class body.
GAP = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is set and all run in one process, as in
    tests. A cluster without one is an error: what executors write to their own disks is lost to others."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="passagemill-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/passagemill-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark, path = df.sparkSession, new_path(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    jvm, paths = df.sparkSession._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for path in paths:
        if "/passagemill-" in path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df bears it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text with A-Z lower-cased; bytes.split parts at exactly the characters of GAP."""
    return text.lower().split() if text else []


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


#: Rows of a batch that are Python objects at a time: a worker keeps the memory that it once took.
SOME = 500


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SOME):
            yield batch.slice(at, SOME)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, by remainder; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, root): the smallest node each node of edges (a, b) can reach. Nodes without an edge are not in it.

    Alternates large-star and small-star until nothing moves, some log^2 of the nodes; each round is written to the
    shared folder. Least neighbours are partial aggregations. They are joined to the edges by a key of their own, so that
    both sides of the join are plain exchanges and Spark splits the one that a hub has made long.
    """

    def lows(df: DataFrame, least) -> DataFrame:
        return df.groupBy("a").agg(least.alias("low")).select(F.col("a").bitwiseXOR(F.lit(0).cast("long")).alias("key"), "low")

    now = written(edges.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct())
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    seen = None
    for _ in range(most):
        both = now.union(now.select("b", "a"))
        low = lows(both, F.least(F.min("b"), F.first("a")))
        large = both.join(low, F.col("a") == F.col("key")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = lows(large, F.min("b"))
        small = large.join(low, F.col("a") == F.col("key")).select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        mark = Observation()
        then = written(small.observe(mark, F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")))
        drop(now)
        now = then
        if mark.get == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = mark.get
    raise RuntimeError(f"components: no fixed point after {most} rounds")
