"""Buckets over several partitions, batches and hot keys; verification of candidates only."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from passagemill.llm import minhash, shared


def test_runs_across_batches_and_partitions():
    rng = random.Random(1)
    rows = sorted({(rng.randrange(6), rng.randrange(200)) for _ in range(300)})
    for parts in (1, 4, 40):
        got, ends = [], []
        cut = [rows[len(rows) * i // parts : len(rows) * (i + 1) // parts] for i in range(parts)]
        for part in cut:
            batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in x], pa.int64()), pa.array([n for _, n in x], pa.int64())], ["key", "node"]) for x in (part[i : i + 7] for i in range(0, len(part), 7))]
            for b in minhash._runs(iter(batches)):
                for r in b.to_pylist():
                    (ends if r["low"] is None else got).append(r)
        edges = [(("n", r["node"]), ("n", r["low"])) for r in got]
        assert all(a[1] > b[1] for a, b in edges)
        low = {}
        for k, n in rows:
            low.setdefault(k, n)
        # each row is the least of its part of the bucket, or points to it
        for part in cut:
            for key in {k for k, _ in part}:
                nodes = [n for k, n in part if k == key]
                assert all(any(r["node"] == n and r["low"] == min(nodes) for r in got) for n in nodes if n != min(nodes))
        firsts = {(r["key"], r["node"]) for r in ends}
        for part in cut:
            if part:
                for key in (part[0][0], part[-1][0]):
                    assert (key, min(n for k, n in part if k == key)) in firsts


def test_buckets_like_sql(spark):
    rng = random.Random(2)
    rows = [(i, [rng.randrange(40) if i % 3 else 7, 1000 + i]) for i in range(500)]
    df = spark.createDataFrame(rows, "node long, bands array<long>")
    got = {r["node"]: r["root"] for r in shared.components(minhash.buckets(df)).collect()}
    low = {i: i for i, _ in rows}
    for _ in range(50):
        for key in range(40):
            members = [i for i, b in rows if b[0] == key]
            if members:
                least = min(low[i] for i in members)
                for i in members:
                    low[i] = least
    assert {i: got.get(i, i) for i, _ in rows} == low


def test_only_candidates_are_compared():
    sets = [np.arange(100, dtype=np.uint64) + np.uint64(k) for k in range(6)]
    one, none = np.zeros((6, 2), np.int64), np.arange(12).reshape(6, 2)
    assert len(minhash.links(np.arange(6), sets, None, one)) == 5
    assert minhash.links(np.arange(6), sets, None, none) == []
