"""Quality thresholds follow their group's data; columns with clashing names stay what they are."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from passagemill.llm import quality


def _text(rng, words, symbols):
    return " ".join(f"w{rng.randrange(10**6):06d}" + "#" * (rng.random() < symbols) for _ in range(words))


def test_cutoffs_follow_their_source(spark):
    """A source full of symbols gets a wide cut-off, a plain one a narrow one; brute force agrees."""
    rng = random.Random(1)
    rows = [(i, _text(rng, 80, rng.uniform(0.2, 0.9) if i % 2 else 0.0), "en", "code" if i % 2 else "prose") for i in range(400)]
    rows += [(1000 + i, _text(rng, 80, 0.8), "en", "prose") for i in range(5)] + [(2000 + i, _text(rng, 80, 0.0), "en", "rare") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    m = quality.measured(df, "m")
    cuts = {r["source"]: r["cut"] for r in quality.thresholds(quality.sketches(m, "m")).collect()}
    values = {}
    for r in m.select("source", "m.*").collect():
        for name in quality.METRICS:
            values.setdefault((r["source"], name), []).append(r[name])
            values.setdefault((None, name), []).append(r[name])

    def cut(source, name):
        v = sorted(values[source, name])
        q = lambda p: v[-int(-p * len(v) // 1) - 1]
        return q(quality.UPPER) + max(quality.SPREAD * (q(quality.UPPER) - q(0.5)), quality.METRICS[name][2])

    for name in quality.METRICS:
        assert cuts["code"][name] == cut("code", name) and cuts["prose"][name] == cut("prose", name)
        assert cuts["rare"][name] == cut(None, name)
    assert cuts["code"]["symbol_share"] > 3 * cuts["prose"]["symbol_share"]
    kept = {r["doc_id"] for r in quality.rated(df).where("kept").collect()}
    assert kept >= {i for i in range(400)} and not kept & set(range(1000, 1005))


def test_sketches_merge(spark):
    """Cut-offs of a large group, made of many partial sketches, are near the exact ones."""
    df = spark.range(60_000, numPartitions=7).select(F.lit("en").alias("lang"), F.lit("a").alias("source"), F.struct(*(F.expr("(id * 7919) % 50021").alias(x) for x in quality.METRICS), F.lit(False).alias("base_failed")).alias("m"))
    cut = quality.thresholds(quality.sketches(df, "m")).first()["cut"]
    want = 0.875 * 50021 + 4 * 0.375 * 50021
    assert all(abs(cut[x] - want) < 0.02 * want for x in quality.METRICS)


def test_clashing_columns(spark):
    rng = random.Random(2)
    names = ["n_words", "word_chars", "kept", "_words", "_lines", "_quality", "_kept", "_lang", "_cut", "m", "base_failed", "symbol_share", "docs", "cut", "one"]
    rows = [(i, _text(rng, 60, 0.0), None, None, *range(i, i + len(names))) for i in range(4)] + [(9, "few words", None, None, *range(len(names)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    out = quality.filtered(df)
    assert out.columns == df.columns and sorted(map(tuple, out.collect())) == sorted(rows[:4])
    assert quality.rated(df).count() == 5
