"""The pipeline's stages against their operators, and whole."""

from __future__ import annotations

import collections
import random

import corpus_pipeline as p
from passagemill.llm import minhash, quality

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    first = p.quality_rules(spark, docs, SF)
    assert ids(first) == ids(quality.rated(docs).where("kept"))
    second = p.toxic_documents(spark, first, SF)
    assert set(ids(second)) <= set(ids(first)) and len(ids(second)) >= 0.7 * len(ids(first))
    third = p.near_duplicates(spark, second, SF)
    assert ids(third) == ids(minhash.clustered(second).where("kept"))
    fourth = p.mix(spark, third, SF)
    assert all(x.columns == docs.columns or sorted(x.columns) == sorted(docs.columns) for x in (first, second, third, fourth))
    assert max(collections.Counter(ids(fourth)).values()) <= 3
    last = p.pack(spark, fourth, SF)
    assert set(ids(last)) == set(ids(fourth))


def test_near_duplicates_like_all_pairs(spark):
    """Pairs on both sides of 0.85, against words and sets in plain Python."""
    rng = random.Random(11)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(9999)}" for _ in range(100)]
        for k in (0, 1, 2, 3):
            rows.append((len(rows), " ".join([f"x{g}.{k}.{i}" if i < 3 * k else w for i, w in enumerate(base)]), "en", "a", 1))
    sets = {}
    for i, t, *_ in rows:
        w = t.split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    low = {i: i for i in sets}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    pairs = [(a, b) for a in sets for b in range(a + 1, a // 4 * 4 + 4)]
    assert sum(0.8 <= share(a, b) < 0.85 for a, b in pairs) > 20
    for _ in range(4):
        for a, b in pairs:
            if share(a, b) >= 0.85:
                low[a] = low[b] = min(low[a], low[b])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r[0] for r in p.near_duplicates(spark, df, SF).collect()) == sorted(i for i in low if low[i] == i)


def test_empty(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, empty, SF).count() == 0
