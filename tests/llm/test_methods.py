"""Each method's own result against a brute-force version, and large or odd inputs."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagemill.llm import embeddings, html, license_rules, licenses, token_counts, tokens

SF = "/root/testdata/sf0.001"


# 1

@pytest.mark.parametrize("page", ["<div>" * 16_000 + "text" + "</div>" * 16_000, "<div>" * 16_000 + "<li>text" * 16_000, "<p><section>" + "<div>" * 16_000 + "a</p>" * 16_000, "<table><tr><td>a" * 8_000, "<div>a, b " * 16_000])
def test_deep_pages(page):
    began = time.process_time()
    assert html.extracted(page)
    assert time.process_time() - began < 4


def test_long_page():
    lines = [f"Paragraph {i}, with some words, and more of them." for i in range(30_000)]
    assert html.extracted("<body><main>" + "".join(f"<p>{x}</p>" for x in lines) + "</main></body>") == "\n".join(lines)


def test_formulas_stay():
    assert html.extracted("<article><p>Let <math><mi>x</mi> = 1</math> be so.</p></article>") == "Let x = 1 be so."


def test_pages_without_rows(spark):
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# 2

def _unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("rows", [2000, 51_282, 300_000])
def test_recall_of_pairs_at_the_threshold(rows):
    """Of pairs at cosine 0.93 exactly, as many pivots as so many rows get; and few random pairs are verified."""
    rng = np.random.default_rng(1)
    most = embeddings.PER_ROOT * int(rows**0.5)
    pivots = embeddings.apart(_unit(rng.normal(size=(max(embeddings.SAMPLE, 4 * most), 64))), most)
    x = _unit(rng.normal(size=(2000, 64)))
    z = rng.normal(size=x.shape)
    z = _unit(z - (z * x).sum(1)[:, None] * x)
    a, b = (embeddings.nearest(v, pivots) for v in (x, 0.93 * x + np.sqrt(1 - 0.93**2) * z))
    assert len(pivots) == most and np.mean([len(np.intersect1d(i, j)) >= embeddings.SHARED for i, j in zip(a, b)]) >= 0.99
    if rows > 50_000:
        has = np.zeros((2000, most), np.float32)
        has[np.arange(2000)[:, None], a] = 1
        assert ((has @ has.T)[np.triu_indices(2000, 1)] >= embeddings.SHARED).mean() < 0.05


@pytest.mark.parametrize("small", [0, 256])
def test_candidates_like_counting(small):
    rng = np.random.default_rng(2)
    pivots = np.array([rng.permutation(15)[:4] for _ in range(80)])
    sets = [set(x) for x in pivots.tolist()]
    for p in range(15):
        on = [i for i in range(80) if p in sets[i]]
        for first in (None, len(on) // 2):
            a, b = embeddings.candidates(pivots[on], p, first, small)
            scope = [(i, j) for i in range(len(on)) for j in range(i + 1, len(on)) if first is None or i < first <= j]
            want = {(i, j) for i, j in scope if len(s := sets[on[i]] & sets[on[j]]) >= 2 and min(s) == p}
            assert set(zip(a.tolist(), b.tolist())) == want


def test_ties_at_the_threshold(spark):
    """A cosine of 0.93 as doubles have it links; the next smaller one does not."""
    at = np.array([0.93, np.sqrt(1 - 0.93**2)])
    rows = [(1, 0, [1.0, 0.0]), (2, 0, list(map(float, at))), (3, 1, [1.0, 0.0]), (4, 1, [0.9299, float(np.sqrt(1 - 0.9299**2))])]
    got = {r["vec_id"]: r["n_links"] for r in embeddings.clustered(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    unit = at / np.sqrt((at * at).sum())
    assert got == {1: int(unit[0] >= 0.93), 2: int(unit[0] >= 0.93), 3: 0, 4: 0}


# 7

def test_counts_by_document(spark):
    c = tokens.Chunks(tokens.tokenizer_path())
    got = {r["doc_id"]: (r["n_tokens"], r["ended"]) for r in token_counts.op7_token_counts(spark, SF).collect()}
    assert got == {r["doc_id"]: (len(c.text(r["text"])) // 4, True) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_file_numbers_beside_random_ids(spark):
    """A job's random id that holds -c and digits is no file number, nor is a folder's name a part."""
    names = ["file:/x/part-9-c7/part-00003-8a3a5495-c981-4a34-8739-c7fd834dea95-c002.txt", "file:/x/part-00012-8a3a5495-0981-4a34-a739-c12345678901-c000.txt.gz"]
    df = spark.createDataFrame([(x,) for x in names], "file string").select(*(c.alias(n) for n, c in token_counts.numbers_of("file").items()))
    assert [tuple(r) for r in df.collect()] == [(3, 2), (12, 0)]


def test_counts_over_several_files(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 9 > 0, F.expr("repeat('<|endoftext|> word ', cast(id as int))")).alias("text"))
    df.repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    token_counts.token_files(docs, f"file://{tmp_path}/tokens", file_docs=4)
    where = token_counts.places(docs, file_docs=4)
    found = token_counts.counted(spark, f"file://{tmp_path}/tokens", block=5).withColumns(token_counts.numbers_of("file"))
    got = {r["doc_id"]: r["n_tokens"] for r in where.join(found, ["part", "file_no", "doc"], "full").collect()}
    c = tokens.Chunks(tokens.tokenizer_path())
    assert got == {r["doc_id"]: len(c.text(r["text"])) // 4 for r in docs.collect()}


def test_no_token_files(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_counts.token_files(empty, f"file://{tmp_path}/tokens")
    assert token_counts.counted(spark, f"file://{tmp_path}/tokens").count() == 0


def test_ids_that_do_not_fit(spark, tmp_path):
    with pytest.raises(Exception, match="16-bit"):
        token_counts.token_files(spark.createDataFrame([("a",)], "text string"), f"file://{tmp_path}/tokens", end=9)


# 10

RULES = [(re.compile(r.pattern, re.ASCII), r) for r in license_rules.RULES]


def _spans(text):
    """All matches of all rules, then the rule of suppression over each run of overlapping spans."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = sorted((m.start(), m.end(), r.priority, r.label, r.weight) for p, r in RULES if any(k in low for k in ("licen", *r.gate)) for m in p.finditer(low))
    kept = []
    for x in sorted(found, key=lambda x: (x[2], x[0] - x[1], x[0], x[3])):
        if not any(k[0] <= x[0] and x[1] <= k[1] or x[0] < k[1] and k[0] < x[1] and k[2] < x[2] for k in kept):
            kept.append(x)
    return sorted((s, e, label, weight) for s, e, _, label, weight in kept)


def test_spans_like_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if r["text"]]
    texts = [t for t in texts if "licen" in t.lower() or "copyright" in t.lower() or "reserved" in t.lower()][:150]
    texts += ["Licensed under the MIT License or the Apache License, Version 2.0; see the GNU General Public License version 3 or the GPL v3.", "SPDX-License-Identifier: (MIT OR Apache-2.0)", "under the terms of the creative commons attribution-noncommercial-sharealike 4.0 international license, cc by-nc-sa 4.0", "the BSD\n 3-clause   license, new BSD license, https://opensource.org/licenses/BSD-3-Clause license: bsd-3-clause", "This file is free software; you can redistribute it. GNU Lesser General Public License; GNU General Public License", "ÀÉ mit license \U0001f600 \U0001f600 mit license"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scanned(df).collect():
        want = _spans(texts[r["doc_id"]])
        assert [(x["start"], x["end"], x["label"], x["weight"]) for x in r["spans"]] == want, texts[r["doc_id"]]
        assert set(filter(None, r["labels"].split(","))) == {x[2] for x in want} | set(filter(None, r["base_labels"].split(",")))


def test_suppressed_only_by_what_stays(spark):
    """a lies in b, which c suppresses: a stays."""
    rows = [(0, -30, 4, "b", 0.1), (5, -10, 4, "a", 0.1), (25, -50, 1, "c", 0.9)]
    df = spark.createDataFrame([(rows,)], "s array<struct<start:int,back:int,priority:int,label:string,weight:double>>")
    assert [x["label"] for x in df.select(licenses.resolved(F.col("s")).alias("k")).first()["k"]] == ["a", "c"]


def test_many_matches_in_a_long_text(spark):
    text = "the mit license. " * 8000 + "x " * 30_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    licenses.scanned(df.limit(0)).collect()
    licenses.scanned(spark.createDataFrame([(1, "the mit license")], "doc_id long, text string")).collect()
    began = time.perf_counter()
    r = licenses.scanned(df).first()
    assert len(r["spans"]) == 8000 and r["n_base"] == 8000 and time.perf_counter() - began < 30
