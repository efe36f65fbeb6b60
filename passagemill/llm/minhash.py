"""Near-duplicate documents by fast similarity sketches, banding and exact verification.

A document's set is its distinct 5-word shingles as 64-bit hashes. The sketch has COORDS coordinates and is filled in
rounds: in each of the first COORDS rounds every shingle goes to one hashed bin, which keeps the least (round, value);
rounds stop once every bin is filled, and a second series of rounds, one per bin that is still empty, takes every shingle
and so fills it for certain. Each coordinate agrees between two sets with probability equal to their similarity, and
the sketch concentrates like one of independent hashes, at a cost of about |set| + COORDS log COORDS.

Documents with the same set are one node. Nodes that agree on all ROWS coordinates of one of the BANDS bands meet in a
bucket; buckets are joined to their least node, and the connected components of that candidate graph bring together all
that may have to be compared: each text moves once, to its candidate component. Large components are dealt to blocks of
bounded size and every pair of blocks is one task, so no group is unbounded. Within a task only pairs that share a band
and are not yet connected are compared, first with one member of each class found so far: copies of one text cost one
comparison each, not one per pair, and pages that only a chain of others connects cost none. A pair of similarity 0.85
shares no band with probability 2e-9, so that links are not lost in practice; each is confirmed on full sets by
100 * common >= 85 * union.

Nulls: a null or empty text has an empty set and links with nothing; a row without doc_id links with nothing, its
component_id is null and it is kept. Rows that share a doc_id are one node of the graph, one row each in the result.
Whole texts count, however long; a pair at exactly the threshold links. deduplicated() returns the columns that it got,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import GAP, LOWER, UPPER, as_bytes, components, drop, slices, table, unused, words_of, written

SHINGLE, PERCENT = 5, 85
BANDS, ROWS = 64, 8
COORDS = BANDS * ROWS
#: Most documents and shingles of a block, about.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 1 << 20

_U = np.uint64
_FULL = _U(2**64 - 1)
_LOW = _U(2**44 - 1)
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    x = (x ^ (x >> _U(30))) * _ODD[6]
    x = (x ^ (x >> _U(27))) * _ODD[7]
    return x ^ (x >> _U(31))


def shingle_set(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles; of the whole sequence if it is shorter than a shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(words))
    acc = np.full(len(words) - k + 1, k, np.uint64)
    for j in range(k):
        acc = mix(acc + h[j : len(h) - k + 1 + j] * _ODD[j])
    return np.unique(acc)


_SEEDS = mix(np.arange(1, 2 * COORDS + 1, dtype=np.uint64) * _ODD[0])
_SHIFT = _U(64 - (COORDS - 1).bit_length())


def sketch(items: np.ndarray) -> np.ndarray:
    """COORDS coordinates of a set that is not empty."""
    best = np.full(COORDS, _FULL)
    n, r = len(items), 0
    step = max(1, -(-2 * COORDS // n))
    while r < COORDS:
        seeds = _SEEDS[r : r + step]
        x = mix(items[None, :] ^ seeds[:, None])
        key = (x & _LOW) | (np.arange(r, r + len(seeds), dtype=np.uint64)[:, None] << _U(44))
        np.minimum.at(best, (x >> _SHIFT).astype(np.int64).ravel(), key.ravel())
        if best.max() != _FULL:
            return best
        r += len(seeds)
    for b in np.flatnonzero(best == _FULL):
        best[b] = (_U(COORDS + int(b)) << _U(44)) | (mix(items ^ _SEEDS[COORDS + b]) & _LOW).min()
    return best


def band_keys(coords: np.ndarray) -> np.ndarray:
    parts = coords.reshape(BANDS, ROWS)
    acc = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[1]
    for j in range(ROWS):
        acc = mix(acc + parts[:, j] * _ODD[j])
    return acc.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        n, digest, bands, ends = [], [], [], [0]
        for text in as_bytes(batch["text"]):
            items = shingle_set(words_of(text))
            n.append(len(items))
            digest.append(xxhash.xxh3_128_digest(items.tobytes()) if len(items) else None)
            if len(items):
                bands.append(band_keys(sketch(items)))
            ends.append(ends[-1] + BANDS * bool(len(items)))
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), keys], ["doc_id", "n_shingles", "digest", "bands"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node) in order: (null, node, least node of its key here) but for that node itself, and (key, least node,
    null) of the first and the last key, which may go on in other partitions."""
    key = low = ends = None
    for batch in batches:
        keys, nodes = batch["key"].to_numpy(), batch["node"].to_numpy()
        if not len(keys):
            continue
        new = np.append(True, keys[1:] != keys[:-1])
        lows = nodes[new][np.cumsum(new) - 1]
        if key is None:
            ends = [(int(keys[0]), int(nodes[0]))]
        elif keys[0] == key:
            lows[keys == key] = low
        key, low = int(keys[-1]), int(lows[-1])
        on = nodes != lows
        yield pa.RecordBatch.from_arrays([pa.nulls(int(on.sum()), pa.int64()), pa.array(nodes[on]), pa.array(lows[on])], ["key", "node", "low"])
    if key is not None:
        ends.append((key, low))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in ends]), pa.array([n for _, n in ends]), pa.nulls(2, pa.int64())], ["key", "node", "low"])


def buckets(nodes: DataFrame) -> DataFrame:
    """(a, b): each node of a bucket with one of its least nodes, from (node, bands). Keys are dealt by range of key and
    node, so that a bucket of any size is spread over as many partitions as it takes, and sorted; the least nodes of the
    parts of a bucket, two rows a partition at most, are joined to each other."""
    keys = nodes.select(F.explode("bands").alias("key"), "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    runs = written(keys.mapInArrow(_runs, "key long, node long, low long"))
    parts = runs.where("low IS NULL").select("key", "node")
    least = parts.groupBy("key").agg(F.min("node").alias("low"))
    return runs.where("low IS NOT NULL").select("node", "low").union(parts.join(least, "key").where("node <> low").select("node", "low")).toDF("a", "b")


def links(ids: np.ndarray, sets: list[np.ndarray], first: int | None = None, bands: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link, a spanning set of them; with first, those of sets[:first] with the rest. With bands, a row of
    keys per set, only sets that share one are compared."""
    sizes = np.array([len(x) for x in sets])
    root = np.arange(len(sets))
    found = []
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marks = np.zeros(len(names), bool)

    def close(i: int, others: np.ndarray) -> np.ndarray:
        """Those of others that link with i."""
        if not len(others):
            return others
        n, ends = sizes[others], np.cumsum(sizes[others])
        at = np.arange(ends[-1]) + np.repeat(starts[others] - (ends - n), n)
        common = np.add.reduceat(marks[codes[at]], ends - n, dtype=np.int64)
        return others[100 * common >= PERCENT * (sizes[i] + n - common)]

    def join(i: int, others: np.ndarray) -> None:
        for k in others.tolist():
            if root[k] != root[i]:
                root[root == root[k]] = root[i]
                found.append((int(ids[i]), int(ids[k])))

    for i in range(len(sets) - 1 if first is None else first):
        scope = np.arange(i + 1 if first is None else first, len(sets))
        if bands is not None:
            scope = scope[(bands[scope] == bands[i]).any(1)]
        scope = scope[root[scope] != root[i]]
        # sizes so far apart cannot link
        scope = scope[100 * np.minimum(sizes[scope], sizes[i]) >= PERCENT * np.maximum(sizes[scope], sizes[i])]
        if not len(scope):
            continue
        own = codes[starts[i] : starts[i + 1]]
        marks[own] = True
        _, one = np.unique(root[scope], return_index=True)
        join(i, close(i, scope[one]))
        rest = np.delete(scope, one)
        join(i, close(i, rest[root[rest] != root[i]]))
        marks[own] = False
    return found


def _verify(key: tuple, group: pa.Table) -> pa.Table:
    i, j = key[1].as_py(), key[2].as_py()
    ids, block = group["node"].to_numpy(), group["block"].to_numpy()
    order = np.lexsort((ids, block != i))
    first = None if i == j else int((block == i).sum())
    found = []
    if len(ids) > 1 and first not in (0, len(ids)):
        texts = as_bytes(group["text"].combine_chunks())
        bands = group["bands"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)[order]
        found = links(ids[order], [shingle_set(words_of(texts[k])) for k in order], first, bands)
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def clustered(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, a row per row of docs (columns doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_sign, _SIGNED))
    sets = signed.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = written(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    nodes = written(sets.join(reps.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select(F.col("doc_id").alias("node"), "n_shingles", "bands"))
    same = buckets(nodes)
    near = components(same)
    drop(same)
    members = written(near.union(near.select(F.col("root"), "root").distinct()))
    own = nodes.join(members, "node")
    blocks = own.groupBy("root").agg(F.expr(f"greatest(ceil(count(*) / {BLOCK_DOCS}), ceil(sum(n_shingles) / {BLOCK_SHINGLES}))").cast("int").alias("blocks"))
    dealt = own.join(blocks, "root").withColumn("block", F.expr("pmod(xxhash64(node), blocks)").cast("int")).drop("n_shingles")
    texts = docs.join(dealt, F.col("doc_id") == F.col("node")).select("node", "root", "block", "blocks", "bands", "text")
    pairs = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("node", "block", "bands", "text", "root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = written(pairs.groupBy("root", "i", "j").applyInArrow(_verify, "a long, b long"))
    joined = components(found)
    roots = reps.join(joined, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("root", "rep").alias("found"), "copies", "rep").where("copies > 1 OR found <> rep").select("digest", "found")
    out = signed.select("doc_id", "n_shingles", "digest").join(roots, "digest", "left")
    out = written(out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    for done in (signed, reps, nodes, members, found):
        drop(done)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each component: the one with the least doc_id, with its own columns."""
    key = unused(docs, "_gone")
    gone = clustered(docs.select("doc_id", "text")).where("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")


def op4_minhash(spark, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "documents"))


def op4_sql() -> str:
    """All pairs that share a shingle, for DuckDB."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^{GAP}]+') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, CASE WHEN len(w) < {SHINGLE} THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + {SHINGLE - 1}], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {SHINGLE - 2}))) AS i FROM w WHERE len(w) > 0))),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {PERCENT} * (x.n + y.n - c)),
 reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
 low AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
 SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept
 FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN low ON doc_id = a"""
