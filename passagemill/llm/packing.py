"""Packing documents into sequences of a fixed window by best-fit decreasing.

Documents longer than the window are first cut into full windows; what is left of each is one item. Best fit takes items
from long to short and puts each into the tightest open window that holds it. Only lengths matter to it, and there are
at most `window` of them, so the plan is made from the histogram of lengths: windows are kept in runs of consecutive
numbers with equal remaining capacity, and a segment tree indexed by capacity finds the tightest that holds an item. A
step fills as many windows of one run as there are items of one length, so the plan's size depends on the window, not on the
corpus, and the result is that of best-fit decreasing over the whole corpus. Each piece then finds its window by its
rank among the pieces of its length; ranks are prefix sums over groups salted by the row's place in the written table, so
neither a common length nor a text that many rows share is a hot key.

Nulls: a null text is empty: one piece of the end id alone. Rows without doc_id and repeated rows are packed like any
other; texts of any length are cut whole. Extra columns are ignored. Sequences are numbered from 0, full windows of long documents last. An empty table gives no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table, written
from .tokens import encoded, tokenizer_path

WINDOW, END = 2048, 1
SALTS = 256


class Tightest:
    """A segment tree over capacities 0..n: number of open windows of each, and the least capacity of at least c."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.tree = [0] * (2 * self.size)

    def add(self, capacity: int, n: int) -> None:
        at = capacity + self.size
        while at:
            self.tree[at] += n
            at >>= 1

    def find(self, c: int) -> int | None:
        """Least capacity >= c with an open window."""
        at = c + self.size
        if self.tree[at]:
            return c
        while at > 1:
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.tree[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def plan(lengths: dict[int, int], window: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of lengths[l] items of each length l < window: (length, rank from, rank to, first window,
    offset), ranks from 0 within a length; and the number of windows."""
    free: dict[int, list[tuple[int, int]]] = {}
    tree, opened, steps = Tightest(window), 0, []
    for length in sorted(lengths, reverse=True):
        left, rank = lengths[length], 0
        while left:
            room = tree.find(length)
            if room is None:
                free.setdefault(window, []).append((opened, left))
                tree.add(window, left)
                opened, room = opened + left, window
            # the tightest window stays the tightest until it holds no more of this length
            start, n = free[room].pop()
            per = min(room // length, left)
            take = min(n, left // per)
            if take < n:
                free[room].append((start + take, n - take))
            tree.add(room, -take)
            for k in range(per):
                steps.append((length, rank, rank + take, start, window - room + k * length))
                rank += take
            free.setdefault(room - per * length, []).append((start, take))
            tree.add(room - per * length, take)
            left -= per * take
        if tree.tree[tree.size + window]:
            # windows opened in advance for this length and not needed
            start, n = free.pop(window)[0]
            tree.add(window, -n)
            opened -= n
    return steps, opened


def _cut(batches: Iterator[pa.RecordBatch], path: str, window: int, end: int, ids: bool) -> Iterator[pa.RecordBatch]:
    tail = np.array([end], "<u4").tobytes()
    for batch, texts in encoded(batches, path):
        row, start, length, crc, total, own = [], [], [], [], [], []
        for r, data in enumerate(texts):
            data += tail
            n = len(data) // 4
            for s in range(0, n, window):
                part = data[4 * s : 4 * (s + window)]
                row.append(r)
                start.append(s)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                total.append(n)
                if ids:
                    own.append(np.frombuffer(part, "<u4").astype(np.int32))
        out = [batch["doc_id"].take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        if ids:
            out.append(pa.array(own, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names)


def _place(batches: Iterator[pa.RecordBatch], steps: np.ndarray, window: int, first_full: int) -> Iterator[pa.RecordBatch]:
    """steps: rows (length, from, to, window, offset) by length and from."""
    key = steps[:, 0] << 44 | steps[:, 1]
    for batch in batches:
        length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
        full = length == window
        at = np.searchsorted(key, length << 44 | rank, side="right") - 1 if len(key) else np.zeros(len(length), int)
        own = steps[np.where(full, 0, at)] if len(key) else np.zeros((len(length), 5), np.int64)
        seq = np.where(full, first_full + rank, own[:, 3] + rank - own[:, 1])
        out = pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "rank"), pa.array(seq, pa.int64()), pa.array(np.where(full, 0, own[:, 4]), pa.int64())], [*(c for c in batch.schema.names if c != "rank"), "sequence_id", "offset"])
        yield out


def packed(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with ids, its token ids."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids
    cut = functools.partial(_cut, path=path or tokenizer_path(), window=window, end=end, ids=ids)
    cut_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)
    salted = written(cut_.withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")))
    #: At most window x SALTS rows.
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).orderBy("length", "salt").collect()
    sums: dict[int, int] = {}
    before = []
    for length, at, n in counts:
        before.append((length, at, sums.get(length, 0)))
        sums[length] = sums.get(length, 0) + n
    steps, opened = plan({k: n for k, n in sums.items() if k < window}, window)
    # rows that the order leaves equal are interchangeable
    spark = docs.sparkSession
    base = F.broadcast(spark.createDataFrame(before, "length long, salt int, base long"))
    from pyspark.sql import Window

    own = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(own).cast("long")).join(base, ["length", "salt"]).withColumn("rank", F.col("rank") - 1 + F.col("base"))
    place = functools.partial(_place, steps=np.array(sorted(steps), np.int64).reshape(-1, 5), window=window, first_full=opened)
    return ranked.select(*cut_.columns, "rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
