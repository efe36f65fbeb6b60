"""Extra columns, with every name that the operators use themselves, and odd rows through operators and pipeline."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from passagemill.llm import minhash, mixing, packing, toxicity

NAMES = ["score", "spans", "predicted", "copies", "size", "target", "kept", "n_words", "word_chars", "_gone", "_words", "_lines", "_measures", "_quality", "_l", "_s", "_d", "_z", "_doc", "_source", "_size", "_copies", "_copy", "_score", "_predicted", "_spans", "m", "root", "node", "rep", "digest", "component_id", "n_shingles", "block", "salt", "length", "start", "rank", "id", "y", "title"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, k=70)) for _ in range(12)]
    rows = [(i, t, "en", "a" if i % 3 else None) for i, t in enumerate(texts)] + [(20, texts[0], "en", "a"), (20, texts[0], "en", "a"), (None, texts[1], None, "b"), (21, None, "en", "a"), (22, "", "en", "a"), (23, " ".join(rng.choices(words, k=20_000)), "en", "b")]
    full = [r + tuple(100 * (r[0] or 0) + j for j in range(len(NAMES))) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` long" for n in NAMES))


def _rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_own_columns_stay(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(12)], "doc_id long, toxic int")
    whole = set(_rows(docs))
    for out in (toxicity.filtered(docs, labels), minhash.deduplicated(docs), mixing.repeated(docs)):
        assert out.columns == docs.columns and set(_rows(out)) <= whole
    assert packing.packed(docs).groupBy("doc_id").count().count() == docs.select("doc_id").distinct().count()
    assert toxicity.scored(docs, toxicity.fitted(docs, labels), spans=True).count() == docs.count()


def test_pipeline_of_odd_rows(spark, docs, tmp_path):
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, f"file://{tmp_path}")
        assert df.columns == docs.columns, name
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert got and all(r["length"] <= 2048 for r in got)


def test_a_repeated_id_is_sampled_once(spark):
    df = spark.createDataFrame([(1, "fine words here")] * 2000 + [(2, "awful words here")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (2, 0)], "doc_id long, toxic int")
    seen = []
    texts = {}
    for r in toxicity._fit(iter([]), 10):
        seen.append(r.num_rows)
    assert seen == [1]
    model = toxicity.fitted(df, labels)
    texts = {r["doc_id"]: r["score"] for r in toxicity.scored(df, model).distinct().collect()}
    assert set(texts) == {1, 2} and all(0 <= s <= 1 for s in texts.values())
