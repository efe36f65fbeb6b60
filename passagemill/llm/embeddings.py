"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its LISTS nearest pivots, in order. Pivots are fitted on a bounded sample, by hash of id, of four
times as many vectors; there are PER_ROOT times the square root of the rows, up to MOST_PIVOTS, so that a list's length
grows as that root too; every vector is indexed. Pivots lie far apart, below cosine APART, so a large group of near copies
holds one of them and its vectors agree on the others. Each pivot has an inverted list per label. Of two vectors of a
list the pivots they share are counted first, through the inverted lists of the block; those that share at least SHARED
(all, if there are fewer) are verified by cosine in double precision. A pair is handled only in the list of its first
common pivot, so it counts once. Long lists are dealt to blocks of BLOCK vectors; each pair of blocks is one task, which
returns counts and a spanning set of links, never pairs.

Vectors that are null, zero or hold null or non-finite components, and vectors without label, link with nothing; vectors
of different length do not link. A cosine of exactly COSINE links. Rows with the same vec_id are one vector: the least
(label, embedding) counts. A row without vec_id is returned with no links, a null component_id and kept. An empty table
gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, table, written

COSINE = 0.93
SAMPLE, PER_ROOT, MOST_PIVOTS, LISTS, SHARED = 4096, 4, 16_384, 12, 2
APART = 0.7
BLOCK = 1024


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can link, and those as rows of length one, padded to the longest."""
    fine = np.array([v is not None and len(v) > 0 and all(x is not None for x in v) for v in vectors], bool)
    dims = max((len(v) for v, ok in zip(vectors, fine) if ok), default=0)
    rows = np.zeros((len(vectors), dims))
    for i in np.flatnonzero(fine):
        rows[i, : len(vectors[i])] = vectors[i]
    fine &= np.isfinite(rows).all(1)
    top = np.abs(np.where(fine[:, None], rows, 0)).max(1, initial=0)
    fine &= top > 0
    rows = rows[fine] / top[fine, None]
    return fine, rows / np.sqrt((rows * rows).sum(1))[:, None]


def nearest(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Numbers of the LISTS nearest pivots of each row, nearest first."""
    d = min(rows.shape[1], pivots.shape[1])
    score = rows[:, :d] @ pivots[:, :d].T
    return np.argsort(-score, axis=1, kind="stable")[:, :LISTS]


def _describe(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = batch["embedding"].to_pylist()
        fine, rows = unit(vectors)
        kept = np.flatnonzero(fine)
        order = nearest(rows, pivots) if len(kept) else np.empty((0, 0), int)
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"].take(pa.array(kept)), batch["label"].take(pa.array(kept)), pa.array([len(vectors[i]) for i in kept], pa.int32()), pa.array(list(order.astype(np.int16)), pa.list_(pa.int16())), batch["embedding"].take(pa.array(kept))],
            ["vec_id", "label", "dims", "pivots", "embedding"],
        )


def linked(ids: np.ndarray, rows: np.ndarray, pivots: np.ndarray, list_of: int, first: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row that belong to this list, and the least id of those it is linked to; with first, only links
    between rows[:first] and the rest."""
    a, b = candidates(pivots, list_of, first)
    keep = np.concatenate([np.einsum("ij,ij->i", rows[a[s : s + 65536]], rows[b[s : s + 65536]]) >= COSINE for s in range(0, len(a), 65536)]) if len(a) else np.empty(0, bool)
    a, b = a[keep], b[keep]
    n = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
    low = ids.copy()
    while len(a):
        then = low.copy()
        np.minimum.at(then, a, low[b])
        np.minimum.at(then, b, then[a])
        if (then == low).all():
            break
        low = then
    return n.astype(np.int64), low


def candidates(pivots: np.ndarray, list_of: int, first: int | None, small: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that share enough pivots and list_of as their first common one, by counting in inverted lists;
    of at most small rows, by a product of incidences."""
    n, wide = pivots.shape
    names, codes = np.unique(pivots, return_inverse=True)
    codes, own = codes.reshape(n, wide), int(np.searchsorted(names, list_of))
    to = 0 if first is None else first
    if n <= small:
        has = np.zeros((n, len(names)), np.float32)
        has[np.arange(n)[:, None], codes] = 1
        hit = (has @ has.T >= min(SHARED, wide)) & (has[:, :own] @ has[:, :own].T == 0)
        hit = np.triu(hit, 1)
        if first is not None:
            hit[first:] = False
            hit[:, :first] = False
        return np.nonzero(hit)
    order = np.argsort(codes[to:], axis=None, kind="stable")
    members = order // wide + to
    ends = np.concatenate([[0], np.cumsum(np.bincount(codes[to:].ravel(), minlength=len(names)))])
    lists = [members[s:e] for s, e in zip(ends, ends[1:])]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(n if first is None else first):
        shared = np.bincount(np.concatenate([lists[c] for c in codes[i]]), minlength=n)
        for c in codes[i][codes[i] < own]:
            shared[lists[c]] = 0
        if first is None:
            shared[: i + 1] = 0
        hit = np.flatnonzero(shared >= min(SHARED, wide))
        if len(hit):
            out.append((np.full(len(hit), i), hit))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def _join(key: tuple, group: pa.Table) -> pa.Table:
    list_of, i, j = (key[k].as_py() for k in (2, 3, 4))
    ids, block = group["vec_id"].to_numpy(), group["block"].to_numpy()
    order = np.lexsort((ids, block != i))
    vectors = group["embedding"].combine_chunks().flatten().to_numpy().astype(float).reshape(len(ids), -1)[order]
    vectors = vectors / np.abs(vectors).max(1)[:, None]
    vectors /= np.sqrt((vectors * vectors).sum(1))[:, None]
    pivots = group["pivots"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
    n, low = linked(ids[order], vectors, pivots, list_of, None if i == j else int((block == i).sum()))
    hit = n > 0
    return pa.table({"vec_id": pa.array(ids[order][hit], pa.int64()), "n": pa.array(n[hit], pa.int64()), "low": pa.array(low[hit], pa.int64())})


def apart(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to most of the rows, each the farthest from those before it, until all others are within cosine APART of one."""
    if not len(rows):
        return rows
    out, near = [0], rows @ rows[0]
    while len(out) < most and near.min() < APART:
        out.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[out[-1]])
    return rows[out]


def fitted(vectors: DataFrame) -> np.ndarray:
    """Pivots from a bounded sample of the vectors."""
    most = min(MOST_PIVOTS, max(2 * LISTS, PER_ROOT * math.isqrt(vectors.count())))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(SAMPLE, 4 * most)).select("embedding").toArrow()
    _, rows = unit(rows["embedding"].to_pylist())
    return apart(rows, most)


def clustered(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept, a row per vector."""
    asked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    own = asked.where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"), F.count("*").alias("c")).select("vec_id", "v.*")
    ids = own.select("vec_id").union(asked.where("vec_id IS NULL").select("vec_id"))
    able = written(own.where("label IS NOT NULL AND embedding IS NOT NULL"))
    pivots = fitted(able)
    if not len(pivots):
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    kind, vector = (able.schema[c].dataType.simpleString() for c in ("label", "embedding"))
    described = written(able.mapInArrow(functools.partial(_describe, pivots=pivots), f"vec_id long, label {kind}, dims int, pivots array<short>, embedding {vector}"))
    posted = described.withColumn("list", F.explode("pivots"))
    lists = posted.groupBy("label", "dims", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    dealt = posted.join(lists, ["label", "dims", "list"]).withColumn("block", F.expr("pmod(xxhash64(vec_id), blocks)").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.select("vec_id", "pivots", "embedding", "block", "label", "dims", "list", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = written(pairs.groupBy("label", "dims", "list", "i", "j").applyInArrow(_join, "vec_id long, n long, low long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")))
    out = ids.join(counts, "vec_id", "left").join(roots.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op2_embeddings(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def op2_sql() -> str:
    """All pairs of a label, for DuckDB."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS n FROM embeddings WHERE label IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= {COSINE}),
 reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 low AS (SELECT a, min(b) AS low FROM reach GROUP BY a), deg AS (SELECT a, count(*) AS n FROM link GROUP BY a)
 SELECT vec_id, CAST(coalesce(deg.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
 FROM embeddings LEFT JOIN low ON vec_id = low.a LEFT JOIN deg ON vec_id = deg.a"""
