"""Exact dense retrieval: corpus and relevance, normalised vectors, neighbours, ranks and metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import ordinal

#: Queries that are compared at once: what is broadcast is this many vectors, whatever the number of queries.
QUERY_BLOCK = 4096


def corpus(examples: DataFrame, full: bool) -> DataFrame:
    """doc_index, text of (line_no, pos, neg): distinct texts by first appearance, all positives before any negative."""
    texts = F.array(F.col("pos")[0])
    if full:
        texts = F.concat(texts, F.coalesce("neg", F.array().cast("array<string>")))
    parts = examples.select("line_no", F.posexplode(texts).alias("at", "text")).withColumn("section", F.least("at", F.lit(1)))
    first = parts.groupBy("text").agg(F.min(F.struct("section", "line_no", "at")).alias("first")).persist()  # numbered in two passes
    sections = []
    for s in (0, 1) if full else (0,):
        own = first.where(F.col("first.section") == s)
        within = F.row_number().over(Window.partitionBy("line_no").orderBy("at"))
        own = own.select("text", F.col("first.line_no").alias("line_no"), F.col("first.at").alias("at")).withColumn("_place", F.col("line_no") * 100_000 + within)
        sections.append(ordinal(own, "_place", "doc_index", chunk=10_000_000_000).select("doc_index", "text"))
    if not full:
        return sections[0]
    shift = sections[0].agg(F.count("*").alias("shift"))  # one row
    return sections[0].union(sections[1].join(F.broadcast(shift)).select((F.col("doc_index") + F.col("shift")).alias("doc_index"), "text"))


def qrels(examples: DataFrame, docs: DataFrame) -> DataFrame:
    """query_index (by line), doc_index of the one relevant document."""
    queries = ordinal(examples.select("line_no", F.col("pos")[0].alias("text")), "line_no", "query_index")
    return queries.join(docs, "text").select("query_index", "doc_index")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector.cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalize(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of length one; a vector of length zero is an error."""
    n = norm(F.col(column))
    one = F.when(F.col("_norm") > 0, F.col("_norm")).otherwise(F.raise_error(F.lit("zero-length embedding")).cast("double"))
    return df.withColumn("_norm", n).withColumn("_norm", one).withColumn(column, F.expr(f"transform(cast({column} AS array<double>), x -> x / _norm)")).drop("_norm")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _best(scores: np.ndarray, docs: np.ndarray, had: np.ndarray, had_docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of scores (of docs, in rising order) and of what each query had: scores and documents, ties by document.
    Only what reaches the k-th best score of its query is sorted."""
    if scores.shape[1] > k:
        least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        wide = int((scores >= least[:, None]).sum(1).max())
        near = np.sort(np.argsort(-scores, axis=1, kind="stable")[:, :wide], axis=1) if wide > 4 * k else np.sort(np.argpartition(-scores, wide - 1, axis=1)[:, :wide], axis=1)
        scores, docs = np.take_along_axis(scores, near, 1), docs[near]
    else:
        docs = np.broadcast_to(docs, scores.shape)
    scores, docs = np.concatenate([had, scores], 1), np.concatenate([had_docs, docs], 1)
    order = np.lexsort((docs, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(docs, order, 1)


def neighbours(queries: DataFrame, docs: DataFrame, k: int = 10, at_once: int = QUERY_BLOCK) -> DataFrame:
    """query_index, doc_index, score, rank of the k best documents, ties by doc_index, of queries (query_index,
    embedding) and docs (doc_index, embedding). The corpus is scanned once per block of queries; each task keeps its own
    k best as its batches come, so what is shuffled is k rows per query and task. at_once: queries of one product."""
    spark, out = queries.sparkSession, None
    blocks = queries.withColumn("_block", F.floor(F.col("query_index") / QUERY_BLOCK))
    for b in [r[0] for r in blocks.select("_block").distinct().orderBy("_block").collect()]:
        rows = blocks.where(F.col("_block") == b).select("query_index", "embedding").orderBy("query_index").collect()
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best = np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)
            for batch in batches:
                docs_, d = batch["doc_index"].to_numpy(), _matrix(batch["embedding"])
                if not len(docs_):
                    continue
                up = np.argsort(docs_, kind="stable")
                docs_, d = docs_[up], d[up]
                parts = [_best(q[s : s + at_once] @ d.T, docs_, best[0][s : s + at_once], best[1][s : s + at_once], k) for s in range(0, len(ids), at_once)]
                best = tuple(np.concatenate(x) for x in zip(*parts))
            n = best[0].shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, n)), pa.array(best[1].ravel()), pa.array(best[0].ravel())], ["query_index", "doc_index", "score"])

        part = docs.select("doc_index", "embedding").mapInArrow(search, "query_index long, doc_index long, score double")
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_index long, doc_index long, score double, rank int")
    best = Window.partitionBy("query_index").orderBy(F.desc("score"), "doc_index")
    return out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def ranks(found: DataFrame, relevant: DataFrame) -> DataFrame:
    """query_index, rank of the relevant document among the neighbours; null if it is not one of them."""
    return relevant.join(found.select("query_index", "doc_index", "rank"), ["query_index", "doc_index"], "left").select("query_index", "rank")


def metrics(ranked: DataFrame) -> DataFrame:
    """One row: query_count, recall_at_1, recall_at_5, mrr_at_10 of (query_index, rank)."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return ranked.agg(F.count("*").alias("query_count"), hit(1).alias("recall_at_1"), hit(5).alias("recall_at_5"), F.avg(F.when(F.col("rank") <= 10, 1 / F.col("rank")).otherwise(0.0)).alias("mrr_at_10"))


def encoded(texts: DataFrame, encoder, column: str = "text", batch_size: int = 16) -> DataFrame:
    """Adds embedding by encoder(list of str) -> list of vectors, made once per worker by calling encoder()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            values = batch[column].to_pylist()
            vectors = [v for s in range(0, len(values), batch_size) for v in encode(values[s : s + batch_size])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields)
    return texts.mapInArrow(run, f"{cols}, embedding array<float>")
